"""Top-N, latest-N, exact global ranks, and set operations on feature lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.plans.blocked import HOT_ROWS, hot_accounts, running_sum, sum_before
from trailmark.plans.dealt import EACH, dealt
from trailmark.plans.dyadic import window_tops
from trailmark.schema import SECOND


def rank_desc(df: DataFrame, col: str | Column, *ties: str) -> DataFrame:
    key = F.col(col) if isinstance(col, str) else col
    return df.orderBy(key.desc_nulls_last(), *ties)


def top_n(df: DataFrame, n: int, by: str | Column, *ties: str) -> DataFrame:
    """Largest ``n`` rows: each task keeps its own n, no full sort."""
    return rank_desc(df, by, *ties).limit(n)


#: Rows of a block in which a whole history is joined.
HISTORY_BLOCK = 10_000


def last_n_before(anchors: DataFrame, flow: DataFrame, n: int | None = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The latest ``n`` rows (None: all) of the account at or before each anchor, newest first, for all anchors at once.

    Rows are numbered per account, so the anchor's own position gives the range of numbers to fetch and
    the join is on (account, number block of size n): at most n rows per anchor are ever paired. A whole
    history is fetched in blocks, so an account of any length is many join keys.
    """
    hot = hot_accounts(flow, "t", hot_rows)
    side = flow.select("acct", "t", "txn_id", "dir", "amt", "chan")
    numbered = running_sum(side, ["acct"], ["t", "txn_id"], {"pos": F.lit(1).cast("long")}, hot)
    probes = anchors.select(F.col("txn_id").alias("anchor_id"), "acct", (F.col("t") + 1).alias("e"))
    one = flow.select("acct", F.col("t").alias("e"), F.lit(1).cast("long").alias("pos"))
    own = sum_before(probes, one, "e", ["pos"], hot).filter("pos > 0")
    size = n or HISTORY_BLOCK
    block = F.expr(f"(pos - pmod(pos, {size}L)) div {size}L")
    first = F.lit(0).cast("long") if n is None else F.greatest(F.col("blk") - 1, F.lit(0).cast("long"))
    wanted = own.withColumn("blk", block).select(
        "anchor_id", "acct", F.col("pos").alias("last_pos"), F.explode(F.sequence(first, "blk")).alias("blk")
    )
    rows = numbered.withColumn("blk", block)
    rank = F.col("last_pos") - F.col("pos") + 1
    wide = wanted.join(rows, ["acct", "blk"]).withColumn("recency", rank).filter("recency >= 1")
    if n is not None:
        wide = wide.filter(F.col("recency") <= n)
    return wide.select("anchor_id", "acct", "recency", "txn_id", "t", "dir", "amt", "chan")


def _digest(id_col: str) -> Column:
    return F.md5(F.col(id_col).cast("string"))


def _rejoin(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the offsets of each unit; a NULL key is a unit like any other."""
    right = offsets.withColumnsRenamed({k: f"__o{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__o{k}")) for k in keys]
    return rows.join(right, same).drop(*[f"__o{k}" for k in keys])


def score_rank(scored: DataFrame, score: str = "score", id_col: str = "txn_id", buckets: int | None = None) -> DataFrame:
    """Exact rank by score descending, ties by the digest of the id; NULL and NaN scores come last.

    Rows are bucketed at score quantiles and, within one score, by digest prefix. Only the counts of
    those units are ordered globally; each unit is numbered on its own, so no task sees all rows and a
    score shared by a third of them is still spread over 4096 units. There are as many buckets as shuffle
    partitions, 64 at least.
    """
    buckets = buckets or max(64, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.col(score).cast("double")
    rows = scored.withColumns({"__s": F.when(~F.isnan(value), value), "__h": _digest(id_col)})
    cuts = rows.approxQuantile("__s", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    cuts = sorted({c for c in cuts if c is not None})
    bucket = F.expr(" + ".join(f"cast(__s < {c!r}D as int)" for c in cuts) or "0")
    rows = rows.withColumns({"__b": F.coalesce(bucket, F.lit(len(cuts) + 1)), "__u": F.substring("__h", 1, 3)})
    units = rows.groupBy("__b", "__s", "__u").agg(F.count(F.lit(1)).alias("n"))
    heads = units.groupBy("__b").agg(F.sum("n").alias("bn"))
    whole = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__b", F.coalesce(F.sum("bn").over(whole), F.lit(0)).alias("b_off"))
    inner = Window.partitionBy("__b").orderBy(F.desc("__s"), "__u").rowsBetween(Window.unboundedPreceding, -1)
    offsets = units.withColumn("u_off", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(heads), "__b")
    own = Window.partitionBy("__b", "__s", "__u").orderBy("__h", id_col)
    out = _rejoin(rows.withColumn("__rn", F.row_number().over(own)), offsets.drop("n"), ["__b", "__s", "__u"])
    return out.withColumn("rank", F.col("b_off") + F.col("u_off") + F.col("__rn")).select(*scored.columns, "rank")


def stratified_folds(df: DataFrame, label: str = "label", k: int = 5, id_col: str = "txn_id") -> DataFrame:
    """Fold = (number of the row within its label, in digest order) mod k; rows without a label are a class of their own.

    Numbers come from digest-prefix units, so no class is ordered in one task.
    """
    rows = df.withColumn("__h", _digest(id_col)).withColumn("__u", F.substring("__h", 1, 3))
    before = Window.partitionBy(label).orderBy("__u").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(label, "__u")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(label, "__u", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    )
    own = Window.partitionBy(label, "__u").orderBy("__h", id_col)
    spread = dealt(rows, [label, "__u"], df.count(), EACH // 4)
    numbered = _rejoin(spread.withColumn("__rn", F.row_number().over(own)), F.broadcast(offsets), [label, "__u"])
    fold = F.pmod(F.col("off") + F.col("__rn") - 1, F.lit(k)).cast("int")
    return numbered.withColumn("fold", fold).select(*df.columns, "fold")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def stack_labelled(a: DataFrame, b: DataFrame, name: str = "source", labels: tuple = (1, 0)) -> DataFrame:
    return a.withColumn(name, F.lit(labels[0])).unionByName(b.withColumn(name, F.lit(labels[1])))


def collapse_max(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[F.max(c).alias(c) for c in cols])


def enumerate_values(flow: DataFrame, col: str, top: int = 50) -> list[str]:
    """Most frequent values of a category: the axis of generated conditional aggregates."""
    counts = flow.filter(F.col(col).isNotNull()).groupBy(col).count()
    return [r[0] for r in counts.orderBy(F.desc("count"), col).limit(top).collect()]


def top_value(anchors: DataFrame, flow: DataFrame, col: str, window: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per anchor the most frequent value of the window (smallest of equals; NULL if empty) and its count.

    No anchor meets the values its account ever had: see ``plans.dyadic.window_tops``.
    """
    got = window_tops(anchors, flow, col, window, hot_rows=hot_rows)
    return got.select("txn_id", col, F.coalesce("top", F.lit(0).cast("long")).alias("n"))


Block = Callable[..., DataFrame]
_BLOCKS: dict[str, Block] = {}


def register_block(name: str, fn: Block) -> Block:
    """Add a user feature block: ``fn(spark, anchors, flow)`` returning one row per ``txn_id``."""
    _BLOCKS[name] = fn
    return fn


def run_blocks(spark, anchors: DataFrame, flow: DataFrame, names: Sequence[str]) -> Mapping[str, DataFrame]:
    return {n: _BLOCKS[n](spark, anchors, flow) for n in names}


def recency(anchors: DataFrame, last_times: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Seconds from the last event times (micros) to the anchor."""
    joined = anchors.select("txn_id", "t").join(last_times, "txn_id", "left")
    return joined.select(
        "txn_id", *[((F.col("t") - F.col(c)) / F.lit(float(SECOND))).alias(f"since_{c}") for c in cols]
    )
