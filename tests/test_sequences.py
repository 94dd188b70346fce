import datetime as dt

import pytest
from frames import BASE, DAY, SECOND, before, flow_of, random_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import sequences as Q
from trailmark.operators.novelty import novel_values, novel_values_anti
from trailmark.operators.ranking import last_n_before, score_rank, stratified_folds
from trailmark.plans.blocked import carry_last, hot_accounts, neighbours, running_sum
from trailmark.schema import WINDOWS, account_days

ORDER = ["t", "txn_id"]


@pytest.mark.parametrize("hot_rows", [2_000_000, 1, 5])
def test_blocked_windows_equal_plain_windows(spark, hot_rows):
    flow = flow_of(spark, random_rows(200))
    hot = hot_accounts(flow, "t", hot_rows)
    w = Window.partitionBy("acct").orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("dir") == 1, F.col("txn_id"))
    expect = flow.select(
        "txn_id", F.sum("dir").over(run).alias("s"), F.last(mark, ignorenulls=True).over(run).alias("last"),
        F.lag("txn_id").over(w).alias("prev"), F.lead("party").over(w).alias("next_party"))
    a = running_sum(flow, ["acct"], ORDER, {"s": F.col("dir")}, hot).select("txn_id", "s")
    b = carry_last(flow, ["acct"], ORDER, {"last": mark}, hot).select("txn_id", "last")
    c = neighbours(flow, ["acct"], ORDER, hot, {"prev": "txn_id"}, {"next_party": "party"}).select("txn_id", "prev", "next_party")
    got = a.join(b, "txn_id").join(c, "txn_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect()))


@pytest.mark.parametrize("hot_rows", [2_000_000, 3])
def test_gap_stats(spark, hot_rows):
    rows = random_rows(120, seed=5)
    flow = flow_of(spark, rows)
    got = {r["txn_id"]: r for r in Q.gap_stats(flow, flow, "3d", F.col("dir") == 0, 7_200, hot_rows).collect()}
    for a in rows:
        times = sorted((r["t"], r["txn_id"]) for r in before(rows, a, WINDOWS["3d"]) if r["dir"] == 0)
        gaps = [(y[0] - x[0]) / SECOND for x, y in zip(times, times[1:])]
        pos = [g for g in gaps if g > 0]
        g = got[a["txn_id"]]
        assert g["gap_n"] == len(pos)
        # Zero gaps are no positive gaps but they are rapid repeats.
        assert g["rapid_cnt"] == sum(x <= 7_200 for x in gaps)
        assert g["gap_avg"] == (pytest.approx(sum(pos) / len(pos)) if pos else None)


@pytest.mark.parametrize("hot_rows", [2_000_000, 3])
def test_gap_range(spark, hot_rows):
    rows = random_rows(120, seed=6)
    flow = flow_of(spark, rows)
    for lab in ("1d", "3d", "14d"):
        got = {r["txn_id"]: r for r in Q.gap_range(flow, flow, lab, F.col("dir") == 0, hot_rows).collect()}
        for a in rows:
            times = sorted(r["t"] for r in before(rows, a, WINDOWS[lab]) if r["dir"] == 0)
            pos = [(y - x) / SECOND for x, y in zip(times, times[1:]) if y > x]
            g = got[a["txn_id"]]
            assert (g["gap_min"], g["gap_max"]) == (min(pos, default=None), max(pos, default=None))


@pytest.mark.parametrize("pair_factor,hot_rows", [(1e9, 2_000_000), (0.0, 6)])
def test_gap_median(spark, pair_factor, hot_rows):
    rows = random_rows(80, seed=8)
    flow = flow_of(spark, rows)
    got = {r["txn_id"]: r["gap_median"] for r in Q.gap_median(flow, flow, "3d", F.col("dir") == 0, pair_factor, hot_rows).collect()}
    for a in rows:
        times = sorted(r["t"] for r in before(rows, a, WINDOWS["3d"]) if r["dir"] == 0)
        pos = sorted((y - x) / SECOND for x, y in zip(times, times[1:]) if y > x)
        assert got[a["txn_id"]] == (pos[(len(pos) + 1) // 2 - 1] if pos else None)


@pytest.mark.parametrize("pair_factor,hot_rows", [(1e9, 2_000_000), (0.0, 2_000_000), (1e9, 8), (3.0, 40)])
def test_low_gap_average_by_pairs_and_by_digits(spark, pair_factor, hot_rows):
    rows = random_rows(90, seed=12)
    flow = flow_of(spark, rows)
    snaps = account_days(flow, 1)
    got = {(r["acct"], r["snap_dt"]): r["low_gap_avg"] for r in Q.low_gap_average(snaps, flow, 6, 0.2, 0.6, hot_rows=hot_rows, pair_factor=pair_factor).collect()}
    assert len(got) == snaps.count()
    for s in snaps.collect():
        day = (s["snap_dt"] - dt.date(1970, 1, 1)).days
        times = sorted((r["t"], r["txn_id"]) for r in rows if r["acct"] == s["acct"] and 0 <= day - r["t"] // DAY <= 5)
        gaps = [y[0] - x[0] for x, y in zip(times, times[1:])]
        rank = {v: i + 1 for i, v in enumerate(sorted(set(gaps)))}
        low = [v for v in gaps if 0.2 < rank[v] / len(times) < 0.6]
        mean = got[(s["acct"], s["snap_dt"])]
        assert mean == (pytest.approx(sum(low) / len(low) / SECOND) if low else None)


def test_low_gap_average_of_quiet_accounts_needs_no_rounds(spark):
    """Accounts of few pairs are ranked in one pass: no frame of digits is stored (each stored frame is a job or more)."""
    flow = flow_of(spark, random_rows(60, seed=13))
    stored = []
    real = Q.smallest_sums
    Q.smallest_sums = lambda *a, **k: stored.append(1) or real(*a, **k)
    try:
        Q.low_gap_average(account_days(flow, 1), flow, 6, 0.2, 0.6).collect()
    finally:
        Q.smallest_sums = real
    assert not stored


@pytest.mark.parametrize("hot_rows", [2_000_000, 2])
def test_last_n_before(spark, hot_rows):
    rows = random_rows(80, seed=9)
    flow = flow_of(spark, rows)
    got = {}
    for r in last_n_before(flow, flow, 4, hot_rows).collect():
        got.setdefault(r["anchor_id"], []).append((r["recency"], r["txn_id"]))
    for a in rows:
        older = sorted(((r["t"], r["txn_id"]) for r in rows if r["acct"] == a["acct"] and r["t"] <= a["t"]), reverse=True)[:4]
        assert sorted(got[a["txn_id"]]) == [(i + 1, o[1]) for i, o in enumerate(older)]


def test_novelty_edges_and_both_forms(spark):
    d = BASE + 500 * DAY
    offs = {"three": 3, "seven": 7, "far": 180, "gone": 181}
    rows = []
    for i, (name, off) in enumerate(offs.items()):
        rows += [dict(txn_id=2 * i, acct=1, t=d, party=name), dict(txn_id=2 * i + 1, acct=1, t=d - off * DAY, party=name)]
    flow = flow_of(spark, rows)
    today = dt.date(1970, 1, 1) + dt.timedelta(days=d // DAY)
    new = {r["value"] for r in novel_values(flow, "party").filter(F.col("dt") == today).collect()}
    # Seen 3 days ago only, or 181 days ago: still new. Seen 7 or 180 days ago: not.
    assert new == {"three", "gone"}
    big = flow_of(spark, random_rows(150, days=60))
    a = novel_values(big, "party", 7, 20)
    b = novel_values_anti(big, "party", 7, 20)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def runs_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r["t"], r["txn_id"]))
    runs = []
    for r in rows:
        if runs and runs[-1][0] == r["dir"]:
            runs[-1][1] += r["amt"]
            runs[-1][2] += 1
        else:
            runs.append([r["dir"], r["amt"], 1])
    return runs


@pytest.mark.parametrize("hot_rows", [2_000_000, 2])
def test_direction_runs_and_pairs(spark, hot_rows):
    rows = random_rows(120, seed=11)
    flow = flow_of(spark, rows)
    snaps = account_days(flow, 0)
    got = {}
    for r in Q.direction_runs(snaps, flow, 0, 4, hot_rows=hot_rows).collect():
        got.setdefault((r["acct"], r["snap_dt"]), []).append((r["end_t"], r["run"], r["dir"], round(r["run_amt"], 2), r["run_cnt"]))
    pairs = {(r["acct"], r["snap_dt"]): r["pair_cnt"] for r in Q.equal_amount_runs(snaps, flow, 0, 4, hot_rows=hot_rows).collect()}
    for s in snaps.collect():
        day = (s["snap_dt"] - dt.date(1970, 1, 1)).days
        inside = [r for r in rows if r["acct"] == s["acct"] and 0 <= day - r["t"] // DAY <= 4]
        expect = runs_by_hand(inside)
        mine = [(d, a, c) for _, _, d, a, c in sorted(got.get((s["acct"], s["snap_dt"]), []))]
        assert mine == [(d, round(a, 2), c) for d, a, c in expect]
        ratio = [(y[0], y[1] / x[1]) for x, y in zip(expect, expect[1:])]
        hits = [sum(0.8 <= v <= 1.2 for d, v in ratio if d == k) for k in (0, 1)]
        assert pairs[(s["acct"], s["snap_dt"])] == max(hits)


def test_single_direction_has_no_pairs(spark):
    flow = flow_of(spark, [dict(txn_id=i, acct=1, t=BASE + i * SECOND, dir=0) for i in range(4)])
    r = Q.equal_amount_runs(account_days(flow, 0), flow, 0, 4).first()
    assert (r["pair_cnt"], r["ratio_avg"]) == (0, None)


@pytest.mark.parametrize("hot_rows", [2_000_000, 1])
def test_out_follow_in_rank(spark, hot_rows):
    t = BASE
    rows = [(0, 1, t, 1), (1, 1, t + SECOND, 0), (2, 1, t + 2 * SECOND, 0), (3, 1, t + 3 * SECOND, 1), (4, 1, t + 4 * SECOND, 0), (5, 1, t + 3 * DAY, 0)]
    flow = flow_of(spark, rows)
    got = {r["txn_id"]: r["follow_rank"] for r in Q.out_follow_in_rank(flow, F.col("dir") == 1, F.col("dir") == 0, hot_rows=hot_rows).collect()}
    assert got == {0: None, 1: 1, 2: 2, 3: None, 4: 1, 5: None}


def test_global_rank_and_folds_with_heavy_ties(spark):
    df = spark.range(500).selectExpr("id as txn_id", "case when id % 3 = 0 then 0.5 else id / 500.0D end as score", "cast(id % 7 = 0 as int) as label")
    order = Window.orderBy(F.desc("score"), F.md5(F.col("txn_id").cast("string")), "txn_id")
    expect = df.withColumn("rank", F.row_number().over(order)).select("txn_id", "rank")
    assert sorted(map(tuple, score_rank(df, buckets=8).select("txn_id", "rank").collect())) == sorted(map(tuple, expect.collect()))
    folds = stratified_folds(df, k=5).groupBy("label", "fold").count().collect()
    sizes = {}
    for r in folds:
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(max(s) - min(s) <= 1 and len(s) == 5 for s in sizes.values())
