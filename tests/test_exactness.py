"""Answers that must not depend on the data's size, on NULLs or on what has left a window."""

import statistics

from frames import flow_of
from pyspark.sql import functions as F

from trailmark.operators import evaluation as V
from trailmark.operators import ranking as R
from trailmark.operators.encodings import freq_encode
from trailmark.operators.rules import bank_rules
from trailmark.operators.sequences import gap_stats
from trailmark.schema import DAY, SECOND

BASE = 1_700_000_000 * SECOND


def row(i, t, acct=1, **more):
    return {"txn_id": i, "acct": acct, "t": t, "dir": 0, "amt": 10.0, "chan": "a", "party": "x", "novel": 0} | more


def test_gap_deviation_forgets_what_left_the_window(spark):
    # a pause of 149 days, then near-regular gaps; it is inside the window of early anchors and has left that of the last
    times, t = [BASE, BASE + 149 * DAY], BASE + 149 * DAY
    for i in range(400):
        t += (60 + (i % 7 == 0)) * SECOND
        times.append(t)
    last = t + 2 * DAY
    flow = flow_of(spark, [row(i, x) for i, x in enumerate(times)])
    anchors = flow_of(spark, [row(9_999, last)])
    gaps = [(b - a) / SECOND for a, b in zip(times, times[1:]) if a >= last - 150 * DAY]
    got = gap_stats(anchors, flow, "150d", F.col("dir") == 0).first()
    assert got["gap_n"] == len(gaps) == 400
    assert abs(got["gap_std"] - statistics.stdev(gaps)) < 1e-6


def test_score_rank_and_folds_keep_every_row(spark):
    rows = [(1, 0.5, 1), (2, None, 0), (3, float("nan"), None), (4, 0.9, 1), (5, 0.5, None)]
    df = spark.createDataFrame(rows, "txn_id long, score double, label int")
    rank = {r.txn_id: r["rank"] for r in R.score_rank(df).collect()}
    assert sorted(rank.values()) == [1, 2, 3, 4, 5]
    assert rank[4] == 1 and {rank[1], rank[5]} == {2, 3} and {rank[2], rank[3]} == {4, 5}
    folds = R.stratified_folds(df, k=2).collect()
    assert len(folds) == 5 and sorted(r.fold for r in folds if r.label is None) == [0, 1]


def test_null_is_a_category(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "chan string")
    assert {(r.chan, r.chan_freq) for r in freq_encode(df, "chan").collect()} == {("a", 0.25), (None, 0.5), ("b", 0.25)}


def test_whole_history_of_400_days(spark):
    flow = flow_of(spark, [row(i, BASE + i * DAY, dir=i % 2) for i in range(400)] + [row(900, BASE, acct=2)])
    missed = flow.filter("txn_id = 398")
    got = V.history_summary(missed, flow).first()
    assert (got["total"], got["out_cnt"], got["in_cnt"], got["total_amt"], got["out_amt"]) == (399, 200, 199, 3990.0, 2000.0)
    all_rows = R.last_n_before(missed, flow, None)
    assert sorted(r.recency for r in all_rows.collect()) == list(range(1, 400))
    assert sorted(r.recency for r in R.last_n_before(missed, flow, 7).collect()) == list(range(1, 8))


def test_top_value_among_many(spark):
    rows = [row(i, BASE + i * SECOND, chan=f"c{i % 70:02d}") for i in range(140)] + [row(200, BASE + 500 * SECOND, chan="c69"), row(201, BASE + 501 * SECOND)]
    flow = flow_of(spark, rows)
    got = {r.txn_id: (r.chan, r.n) for r in R.top_value(flow, flow, "chan", "1d").collect()}
    assert got[201] == ("c69", 3) and got[0] == (None, 0) and got[200] == ("c00", 2)


def test_rule_13_without_a_remembered_inflow(spark):
    cols = {
        "reversed": 0, "cash": 1, "dir": 0, "amt": 1000.0, "prev_amt": 10_000.0, "prev_dir": 1, "min_before_2h": 1.0, "interbank_2h": 1,
        "rows_15d": 1, "days_180d": 1, "p_assets_180d": 1, "p_assets_14d": 0,
    }
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()], F.lit(None).cast("int").alias("in_near_bank"))
    assert one.select(bank_rules()["r13"].alias("hit")).first()["hit"]
