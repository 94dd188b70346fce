import datetime as dt

import pytest
from frames import BASE, DAY, SECOND, before, flow_of, random_rows
from pyspark.sql import functions as F

from trailmark.plans.lookback import Measure, look_back, look_back_days
from trailmark.schema import WINDOWS

OUT = "dir = 0"
AMT = "amt"


def collect(df):
    return {r["txn_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("label", ["30min", "1d", "14d"])
def test_window_edges(spark, label):
    w = WINDOWS[label] * SECOND
    t0 = BASE + 40 * DAY + 5 * 3_600 * SECOND
    rows = [(1, 1, t0), (2, 1, t0), (3, 1, t0 - 1), (4, 1, t0 - w), (5, 1, t0 - w - 1), (6, 1, t0 + 1), (7, 2, t0 - 5)]
    flow = flow_of(spark, rows)
    anchors = flow.filter("txn_id = 1")
    got = collect(look_back(anchors, flow, [Measure("n", "count", [label]), Measure("last", "max", [label], None, F.col("txn_id"))]))
    # At the anchor time and one microsecond too old: out. One microsecond before and exactly W before: in.
    assert got[1][f"n_{label}"] == 2
    assert got[1][f"last_{label}"] == 4
    both = collect(look_back(anchors, flow, [Measure("n", "count", [label])], inclusive=True))
    assert both[1][f"n_{label}"] == 4


def test_empty_history_gives_zero_and_null(spark):
    flow = flow_of(spark, [(1, 1, BASE), (2, 2, BASE + DAY)])
    got = collect(look_back(flow, flow, [
        Measure("n", "count", ["14d"]), Measure("s", "sum", ["14d"], None, AMT), Measure("lo", "min", ["14d"], None, AMT), Measure("d", "days", ["14d"])]))
    assert got[1] == {"txn_id": 1, "n_14d": 0, "s_14d": 0.0, "lo_14d": None, "d_14d": 0}


def test_future_rows_change_nothing(spark):
    rows = random_rows(60)
    cut = BASE + 10 * DAY
    flow = flow_of(spark, rows)
    past = flow.filter(F.col("t") < cut)
    ms = [Measure("n", "count", ["3d", "14d"], OUT), Measure("s", "sum", ["14d"], None, AMT)]
    # the order in which equal times are added up is open, so sums agree but for their last digits
    seen = [{k: r | {"s_14d": round(r["s_14d"], 6)} for k, r in collect(look_back(past, f, ms)).items()} for f in (flow, past)]
    assert seen[0] == seen[1]


@pytest.mark.parametrize("hot_rows", [None, 2_000_000, 1, 3])
def test_matches_definition_on_skewed_data(spark, hot_rows):
    rows = random_rows(150)
    flow = flow_of(spark, rows)
    labels = ["2h", "1d", "3d", "14d"]
    got = collect(look_back(flow, flow, [
        Measure("n", "count", labels, OUT), Measure("s", "sum", labels, None, AMT), Measure("hi", "max", labels, OUT, AMT),
        Measure("lo", "min", labels, None, AMT), Measure("d", "days", ["3d", "14d"]), Measure("p", "peak", ["14d"])], hot_rows=hot_rows))
    assert len(got) == len(rows)
    for a in rows:
        g = got[a["txn_id"]]
        for lab in labels:
            h = before(rows, a, WINDOWS[lab])
            out = [r["amt"] for r in h if r["dir"] == 0]
            assert g[f"n_{lab}"] == len(out)
            assert g[f"s_{lab}"] == pytest.approx(sum(r["amt"] for r in h))
            assert g[f"hi_{lab}"] == max(out, default=None)
            assert g[f"lo_{lab}"] == min((r["amt"] for r in h), default=None)
        h = before(rows, a, WINDOWS["14d"])
        days = [r["t"] // DAY for r in h]
        assert g["d_14d"] == len(set(days))
        assert g["p_14d"] == max((days.count(x) for x in days), default=0)


def test_day_band_offsets(spark):
    day0 = BASE + 400 * DAY
    rows = [(i, 1, day0 - off * DAY) for i, off in enumerate([0, 1, 2, 152, 153])]
    flow = flow_of(spark, rows)
    got = look_back_days(flow.filter("txn_id = 0"), flow, [Measure("s", "sum", ["w"], None, F.pow(F.lit(10), F.col("txn_id")))], {"w": (2, 152)})
    assert got.first()["s_w"] == 10**2 + 10**3
    assert got.first()["dt"] == dt.date(1970, 1, 1) + dt.timedelta(days=19_700 + 400)


def test_rejects_bad_measures(spark):
    flow = flow_of(spark, [(1, 1, BASE)])
    with pytest.raises(ValueError):
        look_back(flow, flow, [Measure("n", "count", ["1d"]), Measure("n", "count", ["3d"])])
    with pytest.raises(ValueError):
        look_back(flow, flow, [Measure("d", "days", ["2h"])])
    with pytest.raises(ValueError):
        look_back(flow, flow, [Measure("t", "count", ["1d"])])


@pytest.mark.parametrize("hot_rows", [None, 1, 3])
def test_spread_of_large_values(spark, hot_rows):
    # deviations of 1 about a mean of 10 millions: squares of the values hold no digit of them
    rows = [r | {"amt": 1e7 + r["amt"] % 3} for r in random_rows(80)]
    flow = flow_of(spark, rows)
    got = collect(look_back(flow, flow, [Measure("x", "spread", ["2h", "1d", "14d"], OUT, AMT)], hot_rows=hot_rows))
    for a in rows:
        for label in ("2h", "1d", "14d"):
            values = [r["amt"] for r in before(rows, a, WINDOWS[label]) if r["dir"] == 0]
            x = got[a["txn_id"]][f"x_{label}"]
            mean = sum(values) / len(values) if values else 0
            assert x["n"] == len(values)
            assert x["m2"] == pytest.approx(sum((v - mean) ** 2 for v in values), rel=1e-7, abs=1e-7)
