"""Exact order statistics of many columns at once, without sorting or shuffling their values.

A value at a given rank is enclosed in a bracket, first by a mergeable sketch. Each round divides every bracket into ``CELLS`` parts of equal
width, counts the rows of each part (combined map-side, so a task sends at most that many counts for a bracket) and goes on
with the smallest and largest value of the part that holds the rank. A sketch that is off costs a round, never the answer. Only
brackets reach the driver: one row for each feature and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1024
#: How far a bracket reaches beyond the sketch's answer, as a share of the rows.
MARGIN = 0.0005

_BRACKET = "feature string, rank long, lo double, hi double, below long"


def _round(long: DataFrame, brackets: list[tuple]) -> list[tuple]:
    """Brackets one step smaller: (feature, rank, lo, hi, rows below lo, rows up to hi)."""
    open_ = F.broadcast(long.sparkSession.createDataFrame(brackets, _BRACKET + ", first boolean"))
    x = F.col("value")
    # halved first, so that the width of the widest bracket is finite
    width = F.col("hi") / 2 - F.col("lo") / 2
    part = F.when(x < F.col("lo"), -1).when(x > F.col("hi"), CELLS).when(width == 0, 0)
    part = part.otherwise(F.least(F.floor((x / 2 - F.col("lo") / 2) / width * CELLS), F.lit(CELLS - 1))).cast("int")
    inside = long.join(open_, "feature").filter(F.col("first") | x.between(F.col("lo"), F.col("hi")))
    cells = inside.groupBy("feature", "rank", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = cells.groupBy("feature", "rank").agg(F.array_sort(F.collect_list(F.struct("part", "n", "lo", "hi"))).alias("cells"))
    # of at most CELLS + 2 cells the one that holds the rank
    known = rows.join(open_.select("feature", "rank", "below"), ["feature", "rank"])
    before = F.aggregate("cells", F.struct(F.col("below").alias("at"), F.lit(None).cast("struct<part:int,n:bigint,lo:double,hi:double>").alias("cell")),
                         lambda a, c: F.when(a["cell"].isNotNull() | (F.col("rank") < a["at"] + c["n"]),
                                             F.struct(a["at"].alias("at"), F.coalesce(a["cell"], c).alias("cell")))
                         .otherwise(F.struct((a["at"] + c["n"]).alias("at"), a["cell"].alias("cell"))))
    found = known.select("feature", "rank", before.alias("b")).select("feature", "rank", "b.cell.lo", "b.cell.hi", "b.at", (F.col("b.at") + F.col("b.cell.n")).alias("upto"))
    return [tuple(r) for r in found.collect()]


def values_at(long: DataFrame, wanted: dict[str, Sequence[int]], guesses: dict[tuple[str, int], tuple[float, float]]) -> dict[tuple[str, int], tuple[float, int]]:
    """For each (feature, rank from 0): the value there and how many rows come up to it. ``long``: feature, value; no NULL or NaN."""
    open_ = [(f, int(r), *map(float, guesses[f, r]), 0, True) for f, ranks in wanted.items() for r in ranks]
    done: dict[tuple[str, int], tuple[float, int]] = {}
    while open_:
        found = _round(long, open_)
        done |= {(f, r): (lo, upto) for f, r, lo, hi, _, upto in found if lo == hi}
        open_ = [(f, r, lo, hi, at, False) for f, r, lo, hi, at, _ in found if lo < hi]
    return done


def exact_quantiles(long: DataFrame, probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of each feature with linear interpolation between neighbouring rows; NULL and NaN are left out."""
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", "value")
    around = [min(1.0, max(0.0, p + side)) for p in probs for side in (-MARGIN, MARGIN)]
    sketch = F.percentile_approx("value", F.array(*[F.lit(p) for p in around]), 10_000)
    heads = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), sketch.alias("around")).collect()
    place = {r["feature"]: [(r["n"] - 1) * p for p in probs] for r in heads}
    wanted = {f: sorted({int(h) for h in hs}) for f, hs in place.items()}
    guesses = {}
    for r in heads:
        for k, h in enumerate(place[r["feature"]]):
            guesses[r["feature"], int(h)] = tuple(r["around"][2 * k : 2 * k + 2])
    found = values_at(long, wanted, guesses)
    # the neighbour above is another value only where the rank is the last row of its value
    edge = [(f, r, v) for (f, r), (v, upto) in found.items() if upto == r + 1 and any(int(h) == r and h > r for h in place[f])]
    above = {}
    if edge:
        at = F.broadcast(long.sparkSession.createDataFrame(edge, "feature string, rank long, v double"))
        nexts = long.join(at, "feature").filter(F.col("value") > F.col("v")).groupBy("feature", "rank").agg(F.min("value").alias("v"))
        above = {(r["feature"], r["rank"]): r["v"] for r in nexts.collect()}
    out = {}
    for f, hs in place.items():
        out[f] = []
        for h in hs:
            low = found[f, int(h)][0]
            high = above.get((f, int(h)), low)
            out[f].append(low + (high - low) * (h - int(h)))
    return out
