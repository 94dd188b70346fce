"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get token targets from their weights (excess over ``most`` times a source's size goes back to the
others). Targets become whole blocks of equal token length by highest quotients, a source's blocks become
quotas of its shards in the same way, and a seeded permutation says which blocks of a shard are taken once
more than its others. A shard is an ordered line of documents, its blocks are equal stretches of that line, so
what a document gives is the overlap of its stretch with the taken blocks. Blocks have ``BLOCK`` words, or as many fewer (one at
least) as the smallest source needs to have ``FEWEST`` of them, so small sources come near their targets too.

Only (id, source, size) rows are shuffled: once by source and shard. Shards split a hot source; there are as many as the root of its blocks,
so neither their number nor their length grows with the source alone. Defined
cases: null texts have size 0 and give 0 words; a null source is a source of its own, last in the order;
repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import settled, word_count

WEIGHTS = (5, 2, 1)
#: Tokens of a block at most, blocks a shard should have at least, passes over a source at most.
BLOCK, SHARD_BLOCKS, MOST = 64, 64, 3
#: Blocks that the smallest source and the smallest target should have, so that whole blocks come near every target.
FEWEST = 32
#: Rounds in which parties far above their caps are held; caps that come to bind later hold in the ranking.
ROUNDS = 2


def apportion(parties: DataFrame, group: list[str], party: str, value: str, seats: str, cap: str, name: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` (a column, equal within a group) go to the highest quotients value / (2k - 1), k <= cap.

    With n parties the common divisor lies between total / (seats + n/2) and total / (seats - n/2), where parties
    are not held by their caps. So a party surely has the seats that it gets under the larger one, and only some
    3n quotients of a group are ranked for the rest. Parties surely above their caps are
    held first, in ``ROUNDS`` rounds.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    free = F.col("__free")
    out = parties.withColumn("__free", F.col(value) > 0).withColumn(name, F.lit(0).cast("long"))
    for _ in range(ROUNDS):  # parties that would exceed their caps hold them; the others share the rest
        total, held = F.sum(F.when(free, F.col(value))).over(w), F.sum(F.when(free, 0).otherwise(F.col(name))).over(w)
        out = out.withColumn("__total", total).withColumn("__left", F.greatest(F.col(seats) - held, F.lit(0)))
        seats_left = F.col("__left") - F.sum(free.cast("long")).over(w) / 2  # fewest, whatever the rounding
        over = free & (F.col(value) * seats_left >= (F.col(cap) + 0.5) * F.col("__total"))
        out = out.withColumn("__over", over)
        out = out.withColumn(name, F.when(F.col("__over"), F.col(cap)).otherwise(F.col(name)))
        out = out.withColumn("__free", free & ~F.col("__over")).drop("__over")
    n, total = F.sum(free.cast("long")).over(w), F.sum(F.when(free, F.col(value))).over(w)
    held = F.sum(F.when(free, 0).otherwise(F.col(name))).over(w)
    out = out.withColumn("__parties", n).withColumn("__total", total).withColumn("__left", F.greatest(F.col(seats) - held, F.lit(0)))
    exact = F.col(value) / F.nullif(F.col("__total"), F.lit(0))
    sure = F.floor(exact * F.greatest(F.col("__left") - F.col("__parties") / 2, F.lit(0)) - 0.5)
    most = F.ceil(exact * (F.col("__left") + 2 * F.col("__parties")) + 1.5)
    out = out.withColumn("__sure", F.when(free, F.least(F.greatest(sure, F.lit(0)), F.col(cap))).otherwise(0).cast("long"))
    out = out.withColumn("__most", F.when(free, F.least(most, F.col(cap))).otherwise(0).cast("long"))
    out = out.withColumn("__rest", F.col("__left") - F.sum("__sure").over(w))
    seats_asked = F.when(F.col("__most") > F.col("__sure"), F.sequence(F.col("__sure") + 1, F.col("__most")))
    asked = out.select(*group, party, value, "__rest", F.explode(seats_asked).alias("__k"))
    rank = F.row_number().over(w.orderBy((F.col(value) / (2 * F.col("__k") - 1)).desc(), F.col(party).asc_nulls_last(), "__k"))
    won = asked.withColumn("__rank", rank).filter(F.col("__rank") <= F.col("__rest"))
    won = won.groupBy(*group, party).agg(F.count(F.lit(1)).alias("__won"))
    keys = [*group, party]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    joined = out.alias("a").join(won.alias("b"), same, "left")
    seats_of = F.when(F.col("__free"), F.col("__sure") + F.coalesce(F.col("__won"), F.lit(0))).otherwise(F.col(f"a.{name}"))
    return joined.select(*(F.col(f"a.{c}") for c in parties.columns), seats_of.alias(name))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) rows with their weight and target.

    Raising the level x in min(most * size, x * weight) until all is shared: sources are held in the order of
    size / weight, so one running sum finds how many are.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    out = sources.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    by_level = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    limit = F.lit(float(most)) * F.col("source_size")
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    out = out.withColumn("__level", rest / F.sum("weight").over(onward))
    # the first source that isn't held sets the level for all after it
    holds = F.col("__level") * F.col("weight") > limit
    out = out.withColumn("__x", F.first(F.when(~holds, F.col("__level")), ignorenulls=True).over(everything.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level = F.coalesce(F.col("__x") * F.col("weight"), limit)
    return out.withColumn("target", F.least(level, limit)).drop("__level", "__x")


def seeded(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 42,
) -> DataFrame:
    """One row per document: size, source_size, target, taken (words, repeats counted) and source."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = settled(sized)  # texts are read once
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sums, weights, most)
    smallest = aimed.filter("source_size > 0").agg(F.min(F.least("target", "source_size"))).first()[0]
    block = int(max(1, min(block, (smallest or 0) // FEWEST)))
    blocks = F.greatest(F.round(F.col("source_size") / block), F.least(F.col("source_size"), F.lit(1)))
    aimed = aimed.withColumn("__blocks", blocks.cast("long"))
    everything = Window.partitionBy(F.lit(0))
    aimed = aimed.withColumn("__seats", F.round(F.sum("target").over(everything) / block).cast("long"))
    aimed = aimed.withColumn("__cap", F.col("__blocks") * most)
    aimed = apportion(aimed, [], "source", "target", "__seats", "__cap", "quota")
    shards = F.greatest(F.least(F.floor(F.col("__blocks") / SHARD_BLOCKS), F.ceil(F.sqrt("__blocks"))), F.lit(1)).cast("long")
    aimed = aimed.withColumn("__shards", shards).drop("__cap", "__seats", "weight")

    placed = sized.alias("a").join(aimed.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
        "a.doc_id", "a.source", "a.size", "b.source_size", "b.target", "b.quota", "b.__shards",
        F.pmod(seeded(seed, F.col("a.doc_id")), F.col("b.__shards")).alias("__shard"),
    )
    spread = Window.partitionBy("source", "__shard")
    line = spread.orderBy(seeded(seed + 1, F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__from", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = settled(placed)

    lines = placed.groupBy("source", "__shard").agg(F.sum("size").alias("__long"), F.first("quota").alias("__quota"))
    lines = lines.withColumn("__n", F.greatest(F.round(F.col("__long") / block), F.least(F.col("__long"), F.lit(1))).cast("long"))
    lines = apportion(lines.withColumn("__cap", F.col("__n") * most), ["source"], "__shard", "__long", "__quota", "__cap", "__take")
    lines = lines.select(F.col("source").alias("__s"), F.col("__shard").alias("__t"), "__long", "__n", "__take")
    rows = placed.join(lines, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__shard") == F.col("__t")), "left")

    # block j of a shard is the stretch from j * long / n to (j + 1) * long / n; each is taken take / n times. The
    # take % n blocks taken once more lie evenly along the line, which is in seeded order, from a seeded start
    div = lambda x, y: F.call_function("div", x, y)
    n, long, begin = F.nullif(F.col("__n"), F.lit(0)), F.nullif(F.col("__long"), F.lit(0)), F.col("__from")
    end = begin + F.col("size")
    passes, extra = div(F.col("__take"), n), F.col("__take") % n
    bound = lambda j: div(j * long, n)
    first = F.greatest(div(begin * n, long) - 1, F.lit(0))
    last = F.least(div((end - 1) * n, long) + 1, n - 1)
    turn = F.pmod(seeded(seed + 2, F.col("source"), F.col("__shard")), n)
    step = lambda k: div((k + 1) * extra, n) - div(k * extra, n)
    overlap = lambda j: F.greatest(F.least(end, bound(j + 1)) - F.greatest(begin, bound(j)), F.lit(0))
    if block > 1:
        taken = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, j: a + overlap(j) * (passes + step(F.pmod(j + turn, n))))
    else:  # blocks are words: those taken once more are counted without listing them
        start, upto = F.pmod(begin + turn, n), lambda k: div(k * extra, n)
        past = start + F.col("size") - n
        more = F.when(past > 0, extra - upto(start) + upto(past)).otherwise(upto(start + F.col("size")) - upto(start))
        taken = passes * F.col("size") + more
    return rows.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"), "source",
    )
