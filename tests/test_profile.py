import math
from collections import Counter

import pytest
from frames import BASE, DAY, SECOND, before, flow_of, random_rows
from pyspark.sql import functions as F

from trailmark.operators.novelty import new_member_ratio, value_history
from trailmark.plans import profile as P
from trailmark.plans.blocked import hot_accounts
from trailmark.plans.dyadic import window_tops
from trailmark.plans.profile import at_least, distinct, key_profile, key_profile_days, rows as row_count, squares, xlogx
from trailmark.schema import WINDOWS


@pytest.mark.parametrize("hot_rows", [2_000_000, 1, 7])
def test_matches_definition(spark, hot_rows):
    rows = random_rows(120)
    flow = flow_of(spark, rows)
    prof = {"nd": distinct, "rep": at_least(2), "sq": squares, "n": row_count, "x": xlogx}
    got = {r["txn_id"]: r for r in key_profile(flow, flow, ["party"], "3d", prof, peak="top", hot_rows=hot_rows).collect()}
    for a in rows:
        counts = Counter(r["party"] for r in before(rows, a, WINDOWS["3d"]) if r["party"] is not None)
        g = got[a["txn_id"]]
        assert g["nd"] == len(counts)
        assert g["rep"] == sum(c for c in counts.values() if c >= 2)
        assert g["sq"] == sum(c * c for c in counts.values())
        assert g["n"] == sum(counts.values())
        assert g["top"] == max(counts.values(), default=0)
        assert g["x"] == pytest.approx(sum(c * math.log(c) for c in counts.values()), abs=1e-9)


def test_null_key_is_a_key_only_on_request(spark):
    flow = flow_of(spark, [dict(txn_id=i, acct=1, t=BASE + i * SECOND, party=None) for i in range(3)])
    a = flow.filter("txn_id = 2")
    assert key_profile(a, flow, ["party"], "1d", {"n": distinct}).first()["n"] == 0
    assert key_profile(a, flow, ["party"], "1d", {"n": distinct}, nulls=True, peak="top").first()["top"] == 2


def test_day_profile_band(spark):
    d0 = BASE + 300 * DAY
    flow = flow_of(spark, [dict(txn_id=i, acct=1, t=d0 - off * DAY, party=str(off)) for i, off in enumerate([0, 6, 7, 180, 181])])
    got = key_profile_days(flow.filter("txn_id = 0"), flow, ["party"], (7, 180), {"n": distinct}).first()
    assert got["n"] == 2


@pytest.mark.parametrize("hot_rows", [2_000_000, 2])
def test_new_member_ratio(spark, hot_rows):
    rows = random_rows(100, seed=3)
    flow = flow_of(spark, rows)
    got = {r["txn_id"]: r["new_ratio"] for r in new_member_ratio(flow, flow, "party", "3d", "14d", hot_rows=hot_rows).collect()}
    for a in rows:
        h = before(rows, a, WINDOWS["14d"])
        old = {r["party"] for r in h if a["t"] - r["t"] > WINDOWS["3d"] * SECOND}
        new = {r["party"] for r in before(rows, a, WINDOWS["3d"])} - {None}
        expect = len(new - old) / len(new) if new else None
        assert got[a["txn_id"]] == (pytest.approx(expect) if expect is not None else None)


def test_value_history_null_matches_null_and_blank_is_a_value(spark):
    rows = [dict(txn_id=0, acct=1, t=BASE, party=None), dict(txn_id=1, acct=1, t=BASE + 1, party=""),
            dict(txn_id=2, acct=1, t=BASE + 2, party=None), dict(txn_id=3, acct=1, t=BASE + 3, party="")]
    flow = flow_of(spark, rows)
    got = {r["txn_id"]: r["cur_party_14d"] for r in value_history(flow, flow, "party", "14d").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}
    unseen = value_history(flow.filter("txn_id = 0"), flow, "party", "14d", F.lit(True)).first()
    assert unseen["cur_party_14d_unseen"] == 1.0


def test_distinct_counts_make_steps_only_where_a_key_comes_or_goes(spark):
    """Rows of a key that stays in the window are steps of no window: two steps for 50 rows, whatever their number."""
    flow = flow_of(spark, [dict(txn_id=i, acct=1, t=BASE + i * SECOND, chan="a") for i in range(50)])
    steps = P._presence(flow, [P.KeyMeasure({"n": distinct}, ("chan",), "1d"), P.KeyMeasure({"m": distinct}, ("chan",), "3d")], hot_accounts(flow))
    assert sorted((r.e - BASE, r.n, r.m) for r in steps.collect()) == [(0, 1, 1), (DAY + 49 * SECOND, -1, 0), (3 * DAY + 49 * SECOND, 0, -1)]


@pytest.mark.parametrize("hot_rows", [2_000_000, 1, 7])
def test_distinct_counts_over_windows_that_share_keys(spark, hot_rows):
    rows = random_rows(150, seed=11)
    rows += [dict(r, txn_id=1000 + i, t=r["t"] + 3 * DAY) for i, r in enumerate(rows[:40])]  # rows exactly one window apart
    flow, out = flow_of(spark, rows), F.expr("dir = 0")
    measures = [P.KeyMeasure({"a": distinct}, ("party",), "3d"), P.KeyMeasure({"b": distinct}, ("party",), "14d"),
                P.KeyMeasure({"c": distinct}, ("party",), "3d", out), P.KeyMeasure({"d": distinct}, ("party",), "1d", out, True), P.KeyMeasure({"x1": distinct, "x2": row_count}, ("party",), "3d", out)]
    got = {r["txn_id"]: tuple(r)[1:] for r in P.key_profiles(flow, flow, measures, hot_rows).collect()}
    for x in rows:
        near, far, day = (before(rows, x, WINDOWS[w]) for w in ("3d", "14d", "1d"))
        known = lambda rs: len({r["party"] for r in rs} - {None})
        outs = [r for r in near if r["dir"] == 0]
        assert got[x["txn_id"]] == (known(near), known(far), known(outs), len({r["party"] for r in day if r["dir"] == 0}), known(outs), sum(r["party"] is not None for r in outs))


def test_profile_and_tops_of_a_single_last_anchor(spark):
    """Changes after the last anchor are left out; rows at its moment are not before it."""
    flow = flow_of(spark, [dict(txn_id=i, acct=1, t=BASE + i * DAY, party="xy"[i % 2]) for i in range(6)] + [dict(txn_id=9, acct=1, t=BASE + 4 * DAY, party="z")])
    a = flow.filter("txn_id = 4")
    got = key_profile(a, flow, ["party"], "3d", {"n": distinct}, peak="top").first()
    assert (got["n"], got["top"]) == (2, 2)
    top = window_tops(a, flow, "party", "3d").first()
    assert (top["party"], top["top"], top["total"], top["keys"]) == ("y", 2, 3, 2)
