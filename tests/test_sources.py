import datetime

from pyspark.sql import functions as F

from trailmark.operators.joins import pit_join, pit_join_days
from trailmark.plans.lineage import settle
from trailmark.plans.lookback import Measure, look_back
from trailmark.plans.prune import relevant_history
from trailmark.schema import event_anchors, event_flow
from trailmark.sources import tables as T


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert T.materialize(spark, build, str(tmp_path), "x", {"a": 1}).count() == 5
    assert len(calls) == 1
    T.materialize(spark, build, str(tmp_path), "x", {"a": 2})
    assert len(calls) == 2


def test_stage_saved_table(spark):
    df = T.stage(spark.range(3), "trailmark_stage_saved", saved=True)
    assert df.count() == 3
    assert T.stage(spark.range(4), "trailmark_stage_saved", saved=True).count() == 4


def test_snapshot_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "snap")
    spark.range(10).withColumn("day", F.col("id") % 3).write.partitionBy("day").parquet(path)
    one = T.scan_snapshot(T.read_table(spark, path), "day", 1)
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def test_settle_keeps_rows(spark):
    assert settle(spark.range(7)).count() == 7


def test_relevant_history_changes_no_result(spark, sf):
    flow = event_flow(spark, sf)
    anchors = event_anchors(flow).filter("acct < 5 and dt >= date'2024-01-20'")
    near = relevant_history(flow, anchors, 14)
    assert near.count() < flow.count()
    ms = [Measure("n", "count", ["14d"])]
    assert look_back(anchors, near, ms).exceptAll(look_back(anchors, flow, ms)).count() == 0
    assert relevant_history(flow, anchors.limit(0), 14).count() == 0


def test_band_join_reads_only_what_it_needs(spark, sf):
    flow = event_flow(spark, sf)
    plan = pit_join(event_anchors(flow).select("txn_id", "acct", "t"), flow, 3_600, history=["t"], how="inner")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in plan


def test_pit_join_keeps_every_anchor(spark, sf):
    flow = event_flow(spark, sf)
    anchors = event_anchors(flow)
    got = pit_join(anchors, flow, 60, history=["txn_id", "t"])
    assert got.select("txn_id").distinct().count() == anchors.count()
    days = pit_join_days(anchors, flow, 2, 3, history=["txn_id", "t", "dt"])
    assert days.select("txn_id").distinct().count() == anchors.count()
    assert days.filter("datediff(dt, h_dt) not between 2 and 3").count() == 0


def test_only_changed_days_are_rewritten(spark, tmp_path):
    def source(rows):
        return spark.createDataFrame(rows, "dt date, acct long, amt double")

    day = lambda n: datetime.date(2024, 1, n)
    built = []

    def keep(frame, **kw):
        def build(days):
            built.append(sorted(r["day"] for r in days.collect()))
            return frame.join(days.withColumnRenamed("day", "dt"), "dt").groupBy(F.col("dt").alias("day")).agg(F.sum("amt").alias("total"))

        return T.materialize_days(spark, frame, build, str(tmp_path), "t", {"tag": "same"}, **kw)

    rows = [(day(1), 1, 5.0), (day(2), 1, 1.0), (day(2), 1, 1.0), (day(3), 2, 7.0)]
    table, days = keep(source(rows))
    assert days == ["2024-01-01", "2024-01-02", "2024-01-03"] and {r["day"]: r["total"] for r in table.collect()} == {day(1): 5.0, day(2): 2.0, day(3): 7.0}
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if "__day" in str(p)}
    assert keep(source(rows[::-1]))[1] == [] and len(built) == 1
    rows[1] = (day(2), 1, 2.0)
    table, days = keep(source(rows))
    assert days == ["2024-01-02"] and built[-1] == [day(2)] and {r["day"]: r["total"] for r in table.collect()} == {day(1): 5.0, day(2): 3.0, day(3): 7.0}
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if "__day" in str(p)}
    assert {str(p) for p in files.keys() - after.keys()} == {str(p) for p in files if "2024-01-02" in str(p)}
    table, days = keep(source([r for r in rows if r[0] != day(1)]), reach=1)
    assert days == ["2024-01-02"] and {r["day"] for r in table.collect()} == {day(2), day(3)}
    assert keep(source(rows).filter("false"))[0].count() == 0
