"""Encodings and group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.scalars import safe_ratio, sample_std


def freq_encode(df: DataFrame, col: str) -> DataFrame:
    """Global share of the row's category; NULL is a category."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    shares = counts.select(F.col(col).alias("__c"), (F.col("__n").cast("double") / total).alias(f"{col}_freq"))
    return df.join(shares, F.col(col).eqNullSafe(F.col("__c")), "left").drop("__c")


def target_encode(
    df: DataFrame, col: str, label: str = "label", fold: str = "fold", split: str = "split", train: str = "train"
) -> DataFrame:
    """Mean training label of the row's category, leaving out the row's own fold.

    Sums per (category, fold) are built first; test rows use all training folds.
    """
    cells = (
        df.filter(F.col(split) == train)
        .groupBy(col, fold)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("y"))
    )
    per_cat = cells.groupBy(col).agg(F.sum("n").alias("cn"), F.sum("y").alias("cy"))
    own = cells.withColumnsRenamed({"n": "fn", "y": "fy"})
    joined = df.join(per_cat, col, "left").join(own, [col, fold], "left")
    is_train = F.col(split) == train
    n = F.col("cn") - F.when(is_train, F.coalesce("fn", F.lit(0))).otherwise(0)
    y = F.col("cy") - F.when(is_train, F.coalesce("fy", F.lit(0))).otherwise(0)
    return joined.withColumn(f"{col}_target", safe_ratio(y, n)).select(*df.columns, f"{col}_target")


def group_stats(
    flow: DataFrame, sets: Sequence[Sequence[str]], value: str = "amt", member: str = "party", digits: int | None = None
) -> DataFrame:
    """count, mean, std, min, max and distinct members for several key sets.

    ``digits`` are the decimals of the values: sums are rounded to them before dividing.

    The rows are reduced once to (keys, member) partial sums; every set and the distinct count are built
    from that, so the raw rows are shuffled once and never expanded per set.
    """
    keys = sorted({k for s in sets for k in s})
    base = flow.groupBy(*keys, member).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("s"),
        F.sum(F.col(value) * F.col(value)).alias("ss"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    out = None
    for group in sets:
        part = base.groupBy(*group, member).agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        )
        stats = part.groupBy(*group).agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
            F.min("lo").alias("min_v"), F.max("hi").alias("max_v"),
            F.count_if(F.col(member).isNotNull()).alias("members"),
        )
        keyed = [(F.col(k) if k in group else F.lit(None).cast(flow.schema[k].dataType)).alias(k) for k in keys]
        stats = stats.select(
            F.lit("+".join(group)).alias("grouping"), *keyed, "n",
            safe_ratio("s" if digits is None else F.round("s", digits), "n").alias("mean_v"), sample_std(F.col("n"), F.col("s"), F.col("ss")).alias("std_v"),
            "min_v", "max_v", "members",
        )
        out = stats if out is None else out.unionByName(stats)
    return out


def shared_party(flow: DataFrame, party: str = "party") -> DataFrame:
    """Number of accounts and rows behind each counterparty."""
    pairs = flow.filter(F.col(party).isNotNull()).groupBy(party, "acct").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(party).agg(F.count(F.lit(1)).alias("accounts"), F.sum("n").alias("n_rows"))
