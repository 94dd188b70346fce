"""Ranges of numbered items, as a few aligned blocks of 1, 2, 4, ... items.

A range of n numbers is the union of at most two blocks of each size, so a maximum or a sum over any range meets some 2 log n rows that are
aggregated once, and nothing is subtracted. Two uses:

* *stabbing*: intervals put their value into the blocks that cover them, a point asks the blocks above it (``window_tops``);
* *range queries*: items put their value into the blocks above them, a range asks the blocks that cover it (runs).

Blocks hold ``1 << TOP`` items at most, so no block is asked by more points than that and no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.blocked import HOT_ROWS, hot_accounts, neighbours, running_sum, sum_before
from trailmark.plans.lineage import settle
from trailmark.schema import SECOND, WINDOWS

TOP = 16


def _block(level: Column, node: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), node.cast("long").alias("node"))


def _width(level: Column) -> Column:
    return F.pow(F.lit(2), level).cast("long")


def cover(low: Column, high: Column, top: int = TOP) -> Column:
    """The aligned blocks whose union is the range from ``low`` up to, but not including, ``high``."""

    def parts(level: Column) -> Column:
        width = _width(level)
        first = F.floor((low + width - 1) / width)
        end = F.floor(high / width)
        odd_first = F.pmod(first, F.lit(2))
        left = F.when((first < end) & (odd_first == 1), _block(level, first))
        right = F.when((first < end) & (F.pmod(end, F.lit(2)) == 1) & (end - 1 >= first + odd_first), _block(level, end - 1))
        return F.array(left, right)

    size = 1 << top
    first, end = F.floor((low + size - 1) / size), F.floor(high / size)
    whole = F.when(first < end, F.transform(F.sequence(first, end - 1), lambda node: _block(F.lit(top), node)))
    small = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), parts)) if top else F.array().cast("array<struct<level:int,node:bigint>>")
    return F.array_compact(F.concat(small, F.coalesce(whole, F.array().cast("array<struct<level:int,node:bigint>>"))))


def above(item: Column, top: int = TOP) -> Column:
    """The aligned blocks of every size that hold an item."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda level: _block(level, F.floor(item / _width(level))))


def window_tops(
    anchors: DataFrame, flow: DataFrame, key: str, window: str, value: Column | None = None, where: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per anchor the key with the largest total in the strict trailing window: txn_id, ``key``, top, total of all keys, number of keys.

    ``value`` is summed exactly to 6 decimals; without it rows are counted. Ties go to the smallest key; empty windows have NULL and 0.

    The total of an (account, key) changes when a row enters or leaves the window. Between two changes it is constant, for a range of the
    account's anchors in order; ranges put their totals into aligned blocks, and each anchor takes the best of the blocks above it. So
    cost is (rows + anchors) log(anchors), whatever the number of keys in a window.
    """
    w = WINDOWS[window] * SECOND
    amount = F.lit(1).cast("long") if value is None else value.cast("decimal(26,6)")
    rows = (flow if where is None else flow.filter(where)).filter(F.col(key).isNotNull())
    rows = rows.select("acct", F.col(key).alias("key"), "t", F.coalesce(amount, F.lit(0).cast("decimal(26,6)") if value is not None else F.lit(0)).alias("x"))
    enter = F.struct(F.col("t").alias("e"), F.lit(1).cast("long").alias("d"), F.col("x").alias("x"))
    # no anchor is after the last one: rows that leave from then on leave at once
    last = anchors.agg(F.max("t")).first()[0]
    out = F.col("t") + w if last is None else F.greatest(F.col("t"), F.least(F.col("t") + w, F.lit(last)))
    leave = F.struct(out.alias("e"), F.lit(-1).cast("long").alias("d"), (-F.col("x")).alias("x"))
    steps = rows.select("acct", "key", F.explode(F.array(enter, leave)).alias("s")).select("acct", "key", "s.*")
    steps = steps.groupBy("acct", "key", "e").agg(F.sum("d").alias("d"), F.sum("x").alias("x")).filter("d <> 0 or x <> 0")
    hot = hot_accounts(rows, "t", hot_rows)
    counted = running_sum(steps, ["acct", "key"], ["e"], {"n": F.col("d"), "s": F.col("x")}, hot)

    # anchors are numbered by time; a change is followed by the anchors strictly after it
    left = counted.select("acct", "e", "key", "n", "s", "d", "x", F.lit(None).cast(anchors.schema["txn_id"].dataType).alias("txn_id"), F.lit(1).alias("kind"))
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ("key", "n", "s", "d", "x")]
    right = anchors.select("acct", F.col("t").alias("e"), *none, "txn_id", F.lit(0).alias("kind"))
    line = settle(running_sum(left.unionByName(right), ["acct"], ["e", "kind", "txn_id"], {"place": F.when(F.col("kind") == 0, 1).otherwise(0).cast("long")}, hot))
    top = min(TOP, int(line.agg(F.max("place")).first()[0] or 0).bit_length())
    spans = neighbours(line.filter("kind = 1"), ["acct", "key"], ["e"], hot, leads={"until": "place"}).filter("n > 0 and until > place")
    best = F.min(F.struct((-F.col("s")).alias("minus"), "key"))
    blocks = spans.select("acct", "key", "s", F.explode(cover(F.col("place"), F.col("until"), top)).alias("b"))
    blocks = blocks.groupBy("acct", "b.level", "b.node").agg(best.alias("best"))
    asked = line.filter("kind = 0").select("acct", "txn_id", F.explode(above(F.col("place") - 1, top)).alias("b")).select("acct", "txn_id", "b.*")
    tops = asked.join(blocks, ["acct", "level", "node"]).groupBy("txn_id").agg(F.min("best").alias("best"))

    appear = ((F.col("n") >= 1).cast("long") - (F.col("n") - F.col("d") >= 1).cast("long")).alias("keys")
    moves = line.filter("kind = 1").select("acct", "e", appear, F.col("x").alias("total")).groupBy("acct", "e").agg(F.sum("keys").alias("keys"), F.sum("total").alias("total"))
    whole = sum_before(anchors.select("txn_id", "acct", F.col("t").alias("e")), moves, "e", ["keys", "total"], hot)
    number = "long" if value is None else "double"
    return whole.join(tops, "txn_id", "left").select(
        "txn_id", F.col("best.key").alias(key), (-F.col("best.minus")).cast(number).alias("top"), F.coalesce(F.col("total").cast(number), F.lit(0)).alias("total"),
        F.coalesce("keys", F.lit(0)).alias("keys"))
