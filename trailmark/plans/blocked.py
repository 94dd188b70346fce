"""Running totals, neighbours and carried values that never put a hot account into one task.

A plain ``Window.partitionBy(acct)`` sends all rows of an account to one task, so an account that owns a
third of the data would run on one core. Accounts above ``HOT_ROWS`` rows are found first (a two-column
aggregate) and their time line is cut into stretches of about ``HOT_ROWS`` rows; windows are
partitioned by (keys, stretch). What has to cross a cut is reduced to one summary row per (keys,
stretch), windowed per key, and joined back. Other accounts have a single stretch and need no summary; where
no account is hot, there are no summaries and the rows are read once.

Keys start with ``acct`` and must not be NULL. The cut list only steers partitioning: results do not
depend on which accounts are on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one account above which its time line is cut.
HOT_ROWS = 2_000_000

_CUT, _LO, _WIDE = "__cut", "__lo", "__wide"


def hot_accounts(flow: DataFrame, time: str = "t", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Accounts to cut: start of their time line and width of one stretch.

    The list has at most rows / hot_rows entries, so it is small enough to fetch and broadcast at any size. It is fetched
    here, once: plans without hot accounts leave out what only these need."""
    found = (
        flow.groupBy("acct")
        .agg(F.count(F.lit(1)).alias("n"), F.min(time).alias(_LO), F.max(time).alias("hi"))
        .filter(F.col("n") > hot_rows)
        .select("acct", _LO, F.expr(f"(hi - {_LO}) div (n div {hot_rows}L + 1) + 1").alias(_WIDE))
    )
    return fetched(found)


def fetched(small: DataFrame) -> DataFrame:
    """A frame of few rows as a literal one, which is known to be empty or not without a job."""
    rows, spark = small.collect(), small.sparkSession
    if rows:
        return spark.createDataFrame(rows, small.schema)
    return spark.range(0).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema])


def _cut(df: DataFrame, time: str, hot: DataFrame) -> DataFrame:
    stretch = F.expr(f"coalesce(greatest((`{time}` - {_LO}) div {_WIDE}, 0L), 0L)")
    return df.join(F.broadcast(hot), "acct", "left").withColumn(_CUT, stretch)


def _attach(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join summaries back; the rows already have the partitioning and order of this join."""
    return rows.join(side, [*keys, _CUT], "left").drop(_CUT, _LO, _WIDE)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    hot: DataFrame,
) -> DataFrame:
    """Inclusive running sums per key; ``order`` starts with the time column."""
    if hot.isEmpty():
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        src = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
        return src.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(whole), F.lit(0)) for n in sums}).drop(*[f"__v_{n}" for n in sums])
    src = _cut(df.withColumns({f"__v_{n}": c for n, c in sums.items()}), order[0], hot)
    inside = Window.partitionBy(*keys, _CUT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_CUT).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        src.filter(F.col(_WIDE).isNotNull())
        .groupBy(*keys, _CUT)
        .agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
        .select(*keys, _CUT, *[F.sum(f"__s_{n}").over(before).alias(f"__c_{n}") for n in sums])
    )
    local = src.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    total = {n: F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums}
    out = _attach(local, carry, keys).withColumns(total)
    return out.drop(*[f"__{p}_{n}" for n in sums for p in "vlc"])


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    hot: DataFrame,
) -> DataFrame:
    """Latest non-null value up to and including the current row, per key."""
    if hot.isEmpty():
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        src = df.withColumns({f"__v_{n}": c for n, c in values.items()})
        return src.withColumns({n: F.last(f"__v_{n}", ignorenulls=True).over(whole) for n in values}).drop(*[f"__v_{n}" for n in values])
    src = _cut(df.withColumns({f"__v_{n}": c for n, c in values.items()}), order[0], hot)
    inside = Window.partitionBy(*keys, _CUT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_CUT).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    carry = (
        src.filter(F.col(_WIDE).isNotNull())
        .groupBy(*keys, _CUT)
        .agg(
            *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(f"__s_{n}") for n in values]
        )
        .select(
            *keys, _CUT, *[F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values]
        )
    )
    local = src.withColumns({f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in values})
    out = _attach(local, carry, keys).withColumns({n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in values})
    return out.drop(*[f"__{p}_{n}" for n in values for p in "vlc"])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot: DataFrame,
    lags: Mapping[str, str] | None = None,
    leads: Mapping[str, str] | None = None,
) -> DataFrame:
    """Previous-row (``lags``) and next-row (``leads``) values as {new column: source column}."""
    lags, leads = dict(lags or {}), dict(leads or {})
    if hot.isEmpty():
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: F.lag(c).over(whole) for n, c in lags.items()} | {n: F.lead(c).over(whole) for n, c in leads.items()})
    src = _cut(df, order[0], hot).withColumn("__row", F.struct(*sorted({*lags.values(), *leads.values()})))
    inside = Window.partitionBy(*keys, _CUT).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_CUT)
    at = F.struct(*order)
    edges = (
        src.filter(F.col(_WIDE).isNotNull())
        .groupBy(*keys, _CUT)
        .agg(F.max_by("__row", at).alias("__last"), F.min_by("__row", at).alias("__first"))
        .select(
            *keys, _CUT, F.lag("__last").over(across).alias("__pb"), F.lead("__first").over(across).alias("__nb")
        )
    )
    local = src.withColumns({"__pl": F.lag("__row").over(inside), "__nl": F.lead("__row").over(inside)})
    out = _attach(local, edges, keys).withColumns(
        {"__p": F.coalesce("__pl", "__pb"), "__n": F.coalesce("__nl", "__nb")}
    )
    new = {n: F.col("__p").getField(c) for n, c in lags.items()}
    new |= {n: F.col("__n").getField(c) for n, c in leads.items()}
    return out.withColumns(new).drop("__row", "__pl", "__nl", "__pb", "__nb", "__p", "__n")


def sum_before(
    probes: DataFrame,
    deltas: DataFrame,
    time: str,
    sums: Sequence[str],
    hot: DataFrame,
) -> DataFrame:
    """For each probe row, the sum of the ``deltas`` of its account at strictly earlier times."""
    types = {f.name: f.dataType for f in probes.schema} | {f.name: f.dataType for f in deltas.schema}
    extra = [c for c in probes.columns if c not in ("acct", time)]
    left = probes.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in sums], F.lit(0).alias("__kind"))
    right = deltas.select(
        "acct", time, *sums, *[F.lit(None).cast(types[c]).alias(c) for c in extra], F.lit(1).alias("__kind")
    )
    run = running_sum(
        left.unionByName(right), ["acct"], [time, "__kind"], {f"__r_{c}": F.col(c) for c in sums}, hot
    )
    return run.filter("__kind = 0").select("acct", time, *extra, *[F.col(f"__r_{c}").alias(c) for c in sums])
