"""Top-K evaluation, missed positives, feature gaps and the history of missed accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.scalars import is_night
from trailmark.plans.blocked import HOT_ROWS, hot_accounts, sum_before

# K from 10 to 1000 in steps of 10.
TOPK = (10, 1000, 10)


def topk_table(scored: DataFrame, label: str = "label", score: str = "score", ks: tuple = TOPK) -> DataFrame:
    """Hits, precision, recall, F1 and score at each K.

    Only the ``ks[1]`` best rows are ordered (each task keeps its own best); totals are one aggregate.
    """
    start, stop, step = ks
    digest = F.md5(F.col("txn_id").cast("string"))
    best = scored.select(F.col(score).alias("s"), F.col(label).cast("long").alias("y"), "txn_id", digest.alias("h"))
    best = best.orderBy(F.desc("s"), "h", "txn_id").limit(stop)
    order = Window.orderBy(F.desc("s"), "h", "txn_id")
    total = scored.agg(F.sum(F.col(label).cast("long"))).scalar()
    ranked = best.select(
        F.row_number().over(order).alias("top_k"), F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"), "s"
    ).filter((F.col("top_k") >= start) & (F.pmod(F.col("top_k") - start, F.lit(step)) == 0))
    k, y = F.col("top_k").cast("double"), F.col("hits").cast("double")
    t = F.col("total").cast("double")
    return ranked.withColumn("total", total).select(
        "top_k",
        "hits",
        F.round(y / k, 4).alias("precision"),
        F.round(F.when(t > 0, y / t).otherwise(0.0), 4).alias("recall"),
        F.round(F.when(y > 0, 2 * y / (k + t)).otherwise(0.0), 4).alias("f1"),
        F.round("s", 6).alias("score_at_k"),
    )


def best_k(table: DataFrame) -> DataFrame:
    """Largest F1, then smallest K."""
    return table.agg(F.max_by(F.struct("top_k", "f1", "hits"), F.struct("f1", -F.col("top_k"))).alias("m")).select("m.*")


def missed_positives(ranked: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Positives ranked beyond K; ``ranked`` comes from ``score_rank``."""
    return ranked.filter((F.col(label) == 1) & (F.col("rank") > k))


def feature_gaps(ranked: DataFrame, feats: Sequence[str], k: int, top: int = 15, label: str = "label") -> DataFrame:
    """Means of hit and missed positives per feature, largest differences first."""
    pos = ranked.filter(F.col(label) == 1)
    hit = F.col("rank") <= k
    row = pos.agg(
        *[F.avg(F.when(hit, F.col(f))).alias(f"h_{f}") for f in feats],
        *[F.avg(F.when(~hit, F.col(f))).alias(f"m_{f}") for f in feats],
    )
    items = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"h_{f}").alias("hit_mean"), F.col(f"m_{f}").alias("miss_mean")) for f in feats]
    )
    out = row.select(F.explode(items).alias("x")).select("x.*")
    gap = F.col("hit_mean") - F.col("miss_mean")
    return out.withColumn("gap", gap).orderBy(F.abs("gap").desc_nulls_last(), "feature").limit(top)


def history_summary(missed: DataFrame, flow: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per missed anchor, over the whole history up to it: rows, in and out counts and amounts, small outflows, night rows."""
    out, amt = F.col("dir") == 0, F.coalesce("amt", F.lit(0.0))
    parts = {
        "total": F.lit(True), "out_cnt": out, "in_cnt": F.col("dir") == 1, "small_out": out & (F.col("amt") <= 100), "night": is_night("hh"),
    }
    steps = flow.select(
        "acct", F.col("t").alias("e"), *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in parts.items()],
        amt.alias("total_amt"), F.when(out, amt).otherwise(0.0).alias("out_amt"),
    )
    probes = missed.select("txn_id", "acct", (F.col("t") + 1).alias("e"))
    names = [*parts, "total_amt", "out_amt"]
    return sum_before(probes, steps, "e", names, hot_accounts(flow, "t", hot_rows)).select("txn_id", *names)
