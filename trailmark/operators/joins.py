"""Point-in-time band joins, lookups, anti and semi joins, and feature assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.blocked import carry_last, hot_accounts
from trailmark.plans.dealt import dealt
from trailmark.schema import SECOND


def _bucket(x: str, width: int) -> str:
    return f"({x} - pmod({x}, {width}L)) div {width}L"


def _with_history(probes: DataFrame, history: DataFrame, now: Column, time: str, lo: int, hi: int) -> DataFrame:
    """The probes that have a history row with ``lo < now - time <= hi``: their latest row before ``now - lo`` is looked at, so no pairs are built."""
    rows = history.filter(F.col("acct").isNotNull()).select("acct", F.col(time).alias("__e"), F.col(time).alias("__t"), F.lit(1).alias("__kind"))
    asked = probes.filter(F.col("acct").isNotNull()).withColumns({"__e": now - lo, "__kind": F.lit(0)})
    line = asked.unionByName(rows, allowMissingColumns=True)
    latest = carry_last(line, ["acct"], ["__e", "__kind"], {"__last": F.col("__t")}, hot_accounts(rows, "__e"))
    return latest.filter((F.col("__kind") == 0) & (F.col("__last") >= F.col("__e") + lo - hi)).select(*probes.columns)


def pit_join(
    anchors: DataFrame,
    flow: DataFrame,
    hi_sec: int,
    lo_sec: int = 0,
    how: str = "left",
    history: Sequence[str] = ("t", "dt", "hh", "dir", "amt", "chan", "party"),
    splits: int = 4,
) -> DataFrame:
    """Anchors with each of their earlier rows, ``lo < t0 - t <= hi``; history columns get ``h_``.

    The pairs are the result asked for, so their number is inherent. They are spread by joining on
    (account, time bucket) with ``splits`` buckets per window: a busy account becomes many join keys and
    a task only holds the rows of one bucket, which meet ``splits + 1`` copies of each small anchor row.
    For aggregates over windows use ``plans.lookback`` or ``plans.profile``, which build no pairs.
    """
    lo, hi = lo_sec * SECOND, hi_sec * SECOND
    width = max((hi - lo) // splits, 1)
    h = flow.select(
        F.col("acct").alias("h_acct"),
        F.expr(_bucket("t", width)).alias("h_bucket"),
        *[F.col(c).alias(f"h_{c}") for c in dict.fromkeys([*history, "t"])],
    )
    near = f"sequence({_bucket(f't - {hi}L', width)}, {_bucket(f't - {lo}L', width)})"
    a = anchors.withColumn("h_bucket", F.explode(F.expr(near)))
    age = F.col("t") - F.col("h_t")
    cond = (F.col("a.acct") == F.col("h.h_acct")) & (F.col("a.h_bucket") == F.col("h.h_bucket"))
    pairs = a.alias("a").join(h.alias("h"), cond & (age > lo) & (age <= hi)).drop("h_bucket", "h_acct")
    pairs = pairs.withColumn("age", age / F.lit(float(SECOND)))
    if how == "inner":
        return pairs
    cols = anchors.columns
    hist = [c for c in pairs.columns if c not in cols]
    lonely = anchors.join(_with_history(anchors.select("txn_id", "acct", "t"), flow, F.col("t"), "t", lo, hi), "txn_id", "left_anti")
    empty = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in hist]
    return pairs.select(*cols, *hist).unionByName(lonely.select(*cols, *empty))


def pit_join_days(
    points: DataFrame,
    flow: DataFrame,
    lo: int,
    hi: int,
    day: str = "dt",
    how: str = "left",
    history: Sequence[str] = ("txn_id", "t", "dt", "dir", "amt"),
    splits: int = 4,
) -> DataFrame:
    """The same over day offsets ``lo <= datediff(day, history day) <= hi`` (a gap when ``lo > 0``)."""
    width = max((hi - lo + 1) // splits, 1)
    h = flow.select(
        F.col("acct").alias("h_acct"),
        F.expr(_bucket("cast(unix_date(dt) as bigint)", width)).alias("h_bucket"),
        *[F.col(c).alias(f"h_{c}") for c in dict.fromkeys([*history, "dt"])],
    )
    number = f"cast(unix_date({day}) as bigint)"
    near = f"sequence({_bucket(f'{number} - {hi}', width)}, {_bucket(f'{number} - {lo}', width)})"
    a = points.withColumn("h_bucket", F.explode(F.expr(near)))
    off = F.datediff(day, "h_dt")
    cond = (F.col("a.acct") == F.col("h.h_acct")) & (F.col("a.h_bucket") == F.col("h.h_bucket"))
    pairs = a.alias("a").join(h.alias("h"), cond & off.between(lo, hi)).drop("h_bucket", "h_acct")
    if how == "inner":
        return pairs
    cols = points.columns
    hist = [c for c in pairs.columns if c not in cols]
    key = ["txn_id"] if "txn_id" in cols else ["acct", day]
    probes = points.select(*dict.fromkeys([*key, "acct", day])).distinct()
    days = flow.select("acct", F.unix_date("dt").cast("long").alias("__n")).distinct()
    lonely = points.join(_with_history(probes, days, F.unix_date(day).cast("long"), "__n", lo - 1, hi).select(*key), key, "left_anti")
    empty = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in hist]
    return pairs.select(*cols, *hist).unionByName(lonely.select(*cols, *empty))


def assemble(anchors: DataFrame, blocks: Sequence[DataFrame], key: str = "txn_id") -> DataFrame:
    """Left join of feature blocks on the anchor key; blocks share its partitioning."""
    return reduce(lambda left, block: left.join(block, key, "left"), blocks, anchors)


def assemble_mixed(
    anchors: DataFrame,
    txn_blocks: Sequence[DataFrame],
    acct_day_blocks: Sequence[DataFrame],
    day: str = "dt",
) -> DataFrame:
    """Inner joins of blocks at transaction grain and at (account, day) grain."""
    wide = reduce(lambda left, b: left.join(b, "txn_id"), txn_blocks, anchors)
    return reduce(lambda left, b: left.join(b, ["acct", day]), acct_day_blocks, wide)


def longest_prefix(
    df: DataFrame, dim: DataFrame, key: str, sizes: Sequence[int], prefix: str = "prefix", length: str = "length"
) -> DataFrame:
    """Attach the dimension row with the longest matching prefix (and matching total length).

    ``sizes`` are the prefix lengths that occur in the dimension. Each distinct key is expanded to its
    prefixes of those lengths, which turns the longest-match search into an equi join.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    cands = F.array(*[F.substring(key, 1, n) for n in sizes])
    tried = keys.withColumn(prefix, F.explode(F.array_distinct(cands))).withColumn(length, F.length(key))
    attrs = [c for c in dim.columns if c != length]
    best = (
        tried.join(dim, [prefix, length])
        .groupBy(key)
        .agg(F.max_by(F.struct(*attrs), F.struct(F.length(prefix), prefix)).alias("m"))
        .select(key, "m.*")
    )
    return df.join(best, key, "left")


def positional_lookup(
    df: DataFrame, dim: DataFrame, key: str, shapes: Sequence[tuple[int, int]], order: Sequence[str]
) -> DataFrame:
    """Match a code found at a given position of the key; keep one row per key, smallest ``order``.

    ``dim`` has ``start`` (0-based), ``code`` and attributes; ``shapes`` are its (start, code length)
    pairs. Each distinct key is expanded to its substrings of those shapes: again an equi join.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    parts = F.array(
        *[F.struct(F.lit(s).alias("start"), F.substring(key, s + 1, n).alias("code")) for s, n in shapes]
    )
    tried = keys.withColumn("x", F.explode(parts)).select(key, "x.start", "x.code")
    attrs = [c for c in dim.columns if c not in ("start", "code")]
    rest = [a for a in attrs if a not in order]
    found = (
        tried.join(dim, ["start", "code"])
        .groupBy(key)
        .agg(F.min(F.struct(*order, *rest)).alias("m"))
        .select(key, *[F.col(f"m.{a}").alias(a) for a in attrs])
    )
    return df.join(found, key, "left")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(other, on, "left_anti")


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def lookup_self(df: DataFrame, ref: str, cols: Sequence[str], prefix: str, key: str = "txn_id") -> DataFrame:
    """Attributes of the row that ``ref`` points to."""
    side = df.select(F.col(key).alias(ref), *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return df.join(side, ref, "left")


def join_dim(df: DataFrame, dim: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Dimension lookup. No hint: Spark broadcasts the dimension when its measured size allows."""
    return df.join(dim, on, "left")


def override_from(df: DataFrame, fix: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Use the corrected values wherever a correction row exists, even when they are NULL."""
    side = fix.select(key, F.lit(True).alias("__fixed"), *[F.col(c).alias(f"__fix_{c}") for c in cols])
    joined = df.join(side, key, "left")
    new = {c: F.when(F.col("__fixed"), F.col(f"__fix_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(new).drop("__fixed", *[f"__fix_{c}" for c in cols])


def join_journal(
    txns: DataFrame, journal: DataFrame, on: Mapping[str, str], channel: str, allowed: Sequence[str], org: DataFrame
) -> DataFrame:
    """Left join to a channel-restricted journal on several columns, then to a distinct code list.

    Rows are dealt by the columns into partitions of bounded size, so what a task sorts here or groups afterwards doesn't grow with the table.
    """
    txns = dealt(txns, list(on), txns.count())
    side = journal.filter(F.col(channel).isin(*allowed))
    cond = [F.col(f"x.{left}") == F.col(f"j.{right}") for left, right in on.items()]
    keep = [c for c in journal.columns if c not in on.values()]
    out = txns.alias("x").join(side.alias("j"), cond, "left").select("x.*", *[f"j.{c}" for c in keep])
    codes = org.distinct()
    return out.join(codes.withColumn("listed", F.lit(1)), codes.columns, "left")
