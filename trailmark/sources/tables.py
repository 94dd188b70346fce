"""Scans, splits, staged and cached tables, and the sinks of a run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metastore_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_snapshot(df: DataFrame, col: str, value: str | None = None, between: tuple | None = None) -> DataFrame:
    """One snapshot (or a range): a partition-column filter, so other snapshots are not read."""
    return df.filter(F.col(col) == value) if between is None else df.filter(F.col(col).between(*between))


def split_by(df: DataFrame, col: str, train: Sequence[str], test: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(col).isin(*train)), df.filter(F.col(col).isin(*test))


def stage(df: DataFrame, name: str, saved: bool = False) -> DataFrame:
    """Named stage of a batch: a view that Catalyst plans through, or a stored table that cuts lineage."""
    if saved:
        df.write.mode("overwrite").format("parquet").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def cache_key(name: str, params: Mapping) -> str:
    text = json.dumps([name, dict(params)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def materialize(
    spark: SparkSession, build: Callable[[], DataFrame], root: str, name: str, params: Mapping | None = None
) -> DataFrame:
    """Build a feature frame once per (name, parameters), then reread it.

    The result is written to the shared ``root`` and read back, so it survives lost executors and later
    stages do not recompute it. A partial write has no success marker and is rebuilt.
    """
    path = f"{root.rstrip('/')}/{name}-{cache_key(name, params or {})}"
    if not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def day_prints(source: DataFrame, day: str) -> DataFrame:
    """(day, rows, print): number of rows of each day and a digest of them that does not depend on their order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(source.columns)])
    # a sum beside the exclusive or, in which equal rows would cancel out; halved twice, so that it stays in range
    return source.groupBy(F.col(day).cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("print"), F.sum(F.shiftrightunsigned(h, 33)).alias("total"))


def materialize_days(
    spark: SparkSession,
    source: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    root: str,
    name: str,
    params: Mapping | None = None,
    day: str = "dt",
    reach: int = 0,
) -> tuple[DataFrame, list[str]]:
    """A table kept up to date day by day: (the table, the days written by this call).

    A manifest beside the table holds a digest of the source rows of each day. Only days whose rows differ are built again, and up to
    ``reach`` days after them (as far as features look back); only these partitions are overwritten. ``build`` gets a
    frame of the days to build (one column ``day``) and returns the rows of those days with the column ``day``.
    The manifest is written after the data, so a lost run is repeated, never skipped. Days that the source has no more leave the table.
    """
    path = f"{root.rstrip('/')}/{name}-{cache_key(name, params or {})}"
    prints = f"{path}-days"
    now = {r["day"]: tuple(r)[1:] for r in day_prints(source, day).filter("day is not null").collect()}  # a row for each day
    old = {}
    if _complete(spark, prints):
        old = {r["day"]: tuple(r)[1:] for r in spark.read.parquet(prints).select("day", "rows", "print", "total").collect()}
    changed = sorted(d for d in now.keys() | old.keys() if now.get(d) != old.get(d))
    if changed:
        moved = spark.createDataFrame([(d,) for d in changed], "day string").select(
            F.explode(F.sequence(F.to_date("day"), F.date_add(F.to_date("day"), reach))).alias("day")).distinct()
        days = sorted(str(r["day"]) for r in moved.collect() if str(r["day"]) in now)
        asked = spark.createDataFrame([(d,) for d in days], "day string").withColumn("day", F.col("day").cast(source.schema[day].dataType))
        out = build(asked).withColumn("__day", F.col("day").cast("string")).drop("day")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__day").parquet(path)
        for gone in sorted(old.keys() - now.keys()):
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/__day={gone}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        rows = [(d, *v) for d, v in now.items()]
        spark.createDataFrame(rows, "day string, rows long, print long, total long").coalesce(1).write.mode("overwrite").parquet(prints)
    else:
        days = []
    if not now:  # nothing to keep: an empty table
        return build(source.select(F.col(day).alias("day")).filter("day is not null")), days
    table = spark.read.option("basePath", path).parquet(path)
    return table.withColumn("day", F.col("__day").cast("string").cast(source.schema[day].dataType)).drop("__day"), days


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(tables: Mapping[str, DataFrame], root: str) -> None:
    """A report of several tables, one directory each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


RUN_LOG = "run_at timestamp, run long, f1 double, best_k long, hit_y long, missed_y long, n_features long, seconds double, notes string"


def log_run(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("sep", "\t").csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).option("sep", "\t").csv(path)


def best_run(runs: DataFrame) -> DataFrame:
    """Latest and best run and whether the latest improved on all before it."""
    latest = F.max_by(F.struct("run", "f1"), "run").alias("latest")
    best = F.max_by(F.struct("run", "f1"), F.struct("f1", -F.col("run"))).alias("best")
    return runs.filter("f1 is not null").agg(latest, best).select(
        F.col("latest.run").alias("latest_run"),
        F.col("latest.f1").alias("latest_f1"),
        F.col("best.run").alias("best_run"),
        F.col("best.f1").alias("best_f1"),
        (F.col("latest.run") == F.col("best.run")).alias("improved"),
    )
