from frames import flow_of, random_rows

from trailmark.operators import joins as J
from trailmark.operators import ranking as R
from trailmark.operators import sequences as Q
from trailmark.plans import dealt as D
from trailmark.plans import lookback as L
from trailmark.schema import account_days


def test_partitions_follow_the_rows(spark):
    df = spark.range(1000)
    assert D.parts_for(df, 1000) == spark.sparkContext.defaultParallelism
    assert D.parts_for(df, 1000, 10) == max(100, spark.sparkContext.defaultParallelism)
    assert D.dealt(df, ["id"], 1000, 10).rdd.getNumPartitions() == D.parts_for(df, 1000, 10)


def test_journal_join_groups_in_bounded_partitions(spark, monkeypatch):
    """Adaptive execution would join these small partitions into one; a task's rows are bounded instead."""
    monkeypatch.setattr(D.parts_for, "__defaults__", (50,))
    monkeypatch.setattr(D.dealt, "__defaults__", (50,))
    line = spark.range(4000).selectExpr("id div 4 as k", "id % 4 as n", "id % 7 as code")
    journal = spark.range(1000).selectExpr("id as key", "case when id % 2 = 0 then 'a' else 'b' end as channel", "id * 1.0D as price")
    org = spark.range(3).selectExpr("id as code").unionByName(spark.range(3).selectExpr("id as code"))
    out = J.join_journal(line, journal, {"k": "key"}, "channel", ["a"], org)
    got = out.groupBy("k", "n", "price", "listed").count()
    assert got.rdd.getNumPartitions() >= 80
    rows = {(r["k"], r["n"]): (r["price"], r["listed"], r["count"]) for r in got.collect()}
    assert rows == {(i // 4, i % 4): (float(i // 4) if i // 4 % 2 == 0 else None, 1 if i % 7 < 3 else None, 1) for i in range(4000)}


def test_run_blocks_end_with_the_longest_account(spark, monkeypatch):
    """Short accounts take no blocks of 65,536 pairs: levels stop at the largest run number."""
    levels = []
    real = Q.above
    monkeypatch.setattr(Q, "above", lambda item, top=16: levels.append(top) or real(item, top))
    flow = flow_of(spark, random_rows(60, seed=14))
    Q.equal_amount_runs(account_days(flow, 0), flow, 0, 4).collect()
    assert levels and max(levels) <= 6


def test_look_back_windows_in_bounded_partitions(spark, monkeypatch):
    """Windows over the blocks are dealt by rows, and give what they give in any number of partitions."""
    flow = flow_of(spark, random_rows(120, seed=15))
    measures = [L.Measure("n", "count", ["1d", "3d"], "dir = 0"), L.Measure("hi", "max", ["3d"], None, "amt")]
    plain = sorted(map(tuple, L.look_back(flow, flow, measures, hot_rows=None).collect()))
    monkeypatch.setattr(L, "EACH", 20)
    got = L.look_back(flow, flow, measures)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == plain


def test_folds_are_numbered_in_bounded_partitions(spark, monkeypatch):
    df = spark.range(300).selectExpr("id as txn_id", "cast(id % 7 = 0 as int) as label")
    plain = sorted(map(tuple, R.stratified_folds(df, k=3).collect()))
    monkeypatch.setattr(R, "EACH", 40)
    got = R.stratified_folds(df, k=3)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == plain
