"""Supervised bins: a one-feature Gini tree on exact distinct values, for all features at once.

Rows are reduced to one cell for each (feature, distinct value) with the counts of every fold. Cells are sorted by range and carry running counts of
each training set (all rows, and all but one fold), so the gain of a split after any value follows from one row and its node. A round of
the best-first search is one aggregate: the largest gain of each (feature, training set, node). As trees of m leaves are the first m - 1
splits of the larger ones, all leaf counts are scored from one growth; the areas under the curve come from counts at the thresholds.
Only nodes reach the driver, a few for each feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.plans.lineage import settle

#: Gains up to this count as none.
EPSILON = 1e-9


def running_cells(long: DataFrame, label: str, fold: str, folds: int, others: bool = False) -> DataFrame:
    """(feature, value, cn, cb, nx): a row for each distinct value.

    Entry s of the arrays is about the training set without fold s, entry ``folds`` about all of its rows: rows and positives up to the
    value, and the next larger value of that set. With ``others``, ``long`` has rows without a fold too, which are in no training set, and
    a last entry is about all rows; ``own`` counts the value's rows of the training set.
    """
    sets = range(folds + 2 if others else folds + 1)
    inside = [F.col(fold) != s for s in range(folds)] + ([F.col(fold).isNotNull(), F.lit(True)] if others else [F.lit(True)])
    bad = F.col(label).cast("long")
    cells = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        *[F.count_if(inside[s]).alias(f"n{s}") for s in sets], *[F.coalesce(F.sum(F.when(inside[s], bad)), F.lit(0)).alias(f"b{s}") for s in sets])
    cells = settle(cells.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").withColumn("piece", F.spark_partition_id()))
    held = [F.when(F.col(f"n{s}") > 0, F.col("value")) for s in sets]
    pieces = cells.groupBy("feature", "piece").agg(
        *[F.sum(f"{c}{s}").alias(f"{c}{s}") for s in sets for c in "nb"], *[F.min(held[s]).alias(f"x{s}") for s in sets])
    before = Window.partitionBy("feature").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("feature").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    # a row for each feature and partition: as small as the list of features times that of the partitions
    offsets = F.broadcast(pieces.select("feature", "piece", *[F.coalesce(F.sum(f"{c}{s}").over(before), F.lit(0)).alias(f"o{c}{s}") for s in sets for c in "nb"],
                                        *[F.min(f"x{s}").over(later).alias(f"ox{s}") for s in sets]))
    up = Window.partitionBy("piece", "feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("piece", "feature").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(f"n{folds}").alias("own")] if others else []
    run = cells.select("feature", "piece", "value", *own, *[F.sum(f"{c}{s}").over(up).alias(f"r{c}{s}") for s in sets for c in "nb"],
                       *[F.last(held[s], ignorenulls=True).over(down).alias(f"rx{s}") for s in sets])
    both = run.join(offsets, ["feature", "piece"])
    return settle(both.select(
        "feature", "value", F.array(*[F.col(f"rn{s}") + F.col(f"on{s}") for s in sets]).alias("cn"),
        F.array(*[F.col(f"rb{s}") + F.col(f"ob{s}") for s in sets]).alias("cb"), F.array(*[F.coalesce(f"rx{s}", f"ox{s}") for s in sets]).alias("nx"),
        *(["own"] if others else [])))


def _best_splits(cells: DataFrame, nodes: list[tuple]) -> dict[tuple, tuple]:
    """(gain, value, next value, rows and positives up to it) of the best split of each node; ties go to the smallest value."""
    schema = "feature string, s int, node int, lo double, hi double, n0 long, b0 long, n1 long, b1 long"
    at = F.broadcast(cells.sparkSession.createDataFrame(nodes, schema))
    below = (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    seen = cells.join(at, "feature").filter(below).select(
        "feature", "s", "node", "value", F.get("nx", "s").alias("nx"), F.get("cn", "s").alias("cn"), F.get("cb", "s").alias("cb"),
        (F.get("cn", "s") - F.col("n0")).cast("double").alias("ln"), (F.get("cb", "s") - F.col("b0")).cast("double").alias("lb"),
        (F.col("n1") - F.col("n0")).cast("double").alias("tn"), (F.col("b1") - F.col("b0")).cast("double").alias("tb"))
    seen = seen.filter("ln > 0 and ln < tn").withColumns({"rn": F.col("tn") - F.col("ln"), "rb": F.col("tb") - F.col("lb")})
    impurity = lambda n, b: F.lit(2.0) * F.col(b) * (F.col(n) - F.col(b)) / F.col(n)
    seen = seen.withColumn("gain", impurity("tn", "tb") - impurity("ln", "lb") - impurity("rn", "rb"))
    best = seen.groupBy("feature", "s", "node").agg(F.max(F.struct("gain", (-F.col("value")).alias("minus"), "value", "nx", "cn", "cb")).alias("m"))
    rows = best.select("feature", "s", "node", "m.gain", "m.value", "m.nx", "m.cn", "m.cb").collect()
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows}


def grown(cells: DataFrame, totals: dict[tuple[str, int], tuple[int, int]], leaves: int) -> dict[tuple[str, int], list[tuple]]:
    """For each (feature, training set) the splits in the order of best-first growth: (value, next value, rows, positives up to it)."""
    open_: dict[tuple, list[dict]] = {k: [{"lo": None, "hi": None, "start": (0, 0), "end": t, "best": None}] for k, t in totals.items()}
    splits: dict[tuple, list[tuple]] = {k: [] for k in totals}
    for _ in range(leaves - 1):
        ask = []
        for (feature, s), nodes in open_.items():
            for k, node in enumerate(nodes):
                n, b = (y - x for x, y in zip(node["start"], node["end"], strict=True))
                if node["best"] is None and n > 1 and 0 < b < n:
                    ask.append((feature, s, k, node["lo"], node["hi"], node["start"][0], node["start"][1], node["end"][0], node["end"][1]))
        found = _best_splits(cells, ask) if ask else {}
        for key, nodes in open_.items():
            for k, node in enumerate(nodes):
                if node["best"] is None:
                    node["best"] = found.get((*key, k), (0.0, None, None, None, None))
            top = max(nodes, key=lambda x: (x["best"][0], -(x["lo"] if x["lo"] is not None else float("-inf"))))
            gain, value, following, n, b = top["best"]
            if value is None or gain <= EPSILON:
                continue
            splits[key].append((value, following, n, b))
            nodes.remove(top)
            nodes += [top | {"hi": value, "end": (n, b), "best": None}, top | {"lo": value, "start": (n, b), "best": None}]
    return splits


def _area(parts: list[tuple[float, int, int]]) -> float:
    """Area under the curve of leaves (rate, rows, positives); 0.5 without both classes."""
    bad, good = sum(b for _, _, b in parts), sum(n - b for _, n, b in parts)
    if not bad or not good:
        return 0.5
    total = below = 0.0
    for rate in sorted({r for r, _, _ in parts}):
        b = sum(y for r, _, y in parts if r == rate)
        g = sum(n - y for r, n, y in parts if r == rate)
        total += b * (below + g / 2)
        below += g
    return total / (bad * good)


def tree_bins(long: DataFrame, label: str, fold: str, folds: int = 3, max_leaves: int = 4) -> DataFrame:
    """(feature, bin, lo, hi, n, bad): the leaves of the tree whose leaf count does best on held-out folds, and ``Missing``.

    Leaf count: largest mean area, then smallest spread (to 9 digits), then fewest leaves. Fewer known rows than folds: a bin for each value.
    """
    gone = long.filter(F.col("value").isNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    return cell_bins(running_cells(long, label, fold, folds), [tuple(r) for r in gone.collect()], folds, max_leaves)


def cell_bins(cells: DataFrame, gone: list[tuple], folds: int = 3, max_leaves: int = 4) -> DataFrame:
    """The same from the running cells of the training set, and (feature, rows, positives) without a value."""
    spark = cells.sparkSession
    heads = cells.groupBy("feature").agg(F.max("cn").alias("n"), F.max("cb").alias("b"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    heads = {r["feature"]: r for r in heads}
    total = {(f, s): (r["n"][s], r["b"][s]) for f, r in heads.items() for s in range(folds + 1)}
    big = {f for f, r in heads.items() if r["n"][folds] >= folds}
    splits = grown(cells, {k: t for k, t in total.items() if k[0] in big}, max_leaves)

    # held-out counts up to each threshold of the folds' trees
    marks = [(f, s, k, (v + x) / 2) for (f, s), cuts in splits.items() if s < folds for k, (v, x, _, _) in enumerate(cuts)]
    held = {}
    if marks:
        at = F.broadcast(spark.createDataFrame(marks, "feature string, s int, k int, t double"))
        up = cells.join(at, "feature").filter(F.col("value") <= F.col("t")).groupBy("feature", "s", "k").agg(
            F.max(F.get("cn", F.lit(folds)) - F.get("cn", "s")).alias("n"), F.max(F.get("cb", F.lit(folds)) - F.get("cb", "s")).alias("b"))
        held = {(r["feature"], r["s"], r["k"]): (r["n"], r["b"]) for r in up.collect()}

    def score(f: str, leaves: int) -> tuple[float, float]:
        areas = []
        for s in range(folds):
            cuts = sorted((v, k, n, b) for k, (v, _, n, b) in enumerate(splits[f, s][: leaves - 1]))
            whole = tuple(x - y for x, y in zip(total[f, folds], total[f, s], strict=True))
            train = [(0, 0), *((n, b) for _, _, n, b in cuts), total[f, s]]
            test = [(0, 0), *(held[f, s, k] for _, k, _, _ in cuts), whole]
            parts = []
            for (n0, b0), (n1, b1), (u0, c0), (u1, c1) in zip(train[:-1], train[1:], test[:-1], test[1:], strict=True):
                parts.append(((b1 - b0) / max(n1 - n0, 1), u1 - u0, c1 - c0))
            areas.append(_area(parts))
        mean = sum(areas) / folds
        return -round(mean, 9), round((sum((a - mean) ** 2 for a in areas) / folds) ** 0.5, 9)

    rows = []
    for f in sorted(big):
        best = min(range(2, max_leaves + 1), key=lambda m, f=f: (*score(f, m), m))
        cuts = sorted(splits[f, folds][: best - 1])
        lows, highs = [heads[f]["lo"], *(x for _, x, _, _ in cuts)], [*(v for v, _, _, _ in cuts), heads[f]["hi"]]
        upto = [(0, 0), *((n, b) for _, _, n, b in cuts), total[f, folds]]
        rows += [(f, lo, hi, n1 - n0, b1 - b0) for lo, hi, (n0, b0), (n1, b1) in zip(lows, highs, upto[:-1], upto[1:], strict=True)]
    # a feature of fewer known rows than folds has fewer cells than that
    few: dict[str, tuple[int, int]] = {}
    small = cells.filter(F.col("feature").isin(sorted(heads.keys() - big))).select("feature", "value", F.get("cn", F.lit(folds)).alias("n"), F.get("cb", F.lit(folds)).alias("b"))
    for f, v, n, b in sorted(map(tuple, small.collect())) if heads.keys() - big else []:
        n0, b0 = few.get(f, (0, 0))
        few[f] = (n, b)
        rows.append((f, v, v, n - n0, b - b0))
    made = spark.createDataFrame(rows, "feature string, lo double, hi double, n long, bad long")
    name = F.when(F.col("lo") < F.col("hi"), F.concat(F.col("lo").cast("string"), F.lit("__"), F.col("hi").cast("string"))).otherwise(F.col("lo").cast("string"))
    none = F.lit(None).cast("double")
    lost = spark.createDataFrame(gone, "feature string, n long, bad long")
    return made.select("feature", name.alias("bin"), "lo", "hi", "n", "bad").unionByName(lost.select("feature", F.lit("Missing").alias("bin"), none.alias("lo"), none.alias("hi"), "n", "bad"))


def ranked_values(cells: DataFrame, wanted: Sequence[tuple[str, int, int]]) -> dict[tuple[str, int, int], tuple[float, int, float | None]]:
    """For each (feature, set, rank from 0): the value there, how many rows of the set come up to it, and the set's next larger value."""
    at = F.broadcast(cells.sparkSession.createDataFrame(list(wanted), "feature string, s int, rank long"))
    found = cells.join(at, "feature").filter(F.get("cn", "s") > F.col("rank")).groupBy("feature", "s", "rank").agg(
        F.min(F.struct("value", F.get("cn", "s").alias("upto"), F.get("nx", "s").alias("nx"))).alias("m"))
    return {(r[0], r[1], r[2]): tuple(r[3]) for r in found.collect()}


def counts_upto(cells: DataFrame, cuts: Sequence[tuple[str, float]], sets: Sequence[int]) -> dict[tuple[str, float], tuple[int, ...]]:
    """For each (feature, cut) the rows of the ``sets`` up to the cut; cuts below every value are left out."""
    at = F.broadcast(cells.sparkSession.createDataFrame(list(cuts), "feature string, cut double"))
    found = cells.join(at, "feature").filter(F.col("value") <= F.col("cut")).groupBy("feature", "cut").agg(
        *[F.max(F.get("cn", F.lit(s))).alias(f"n{s}") for s in sets])
    return {(r[0], r[1]): tuple(r)[2:] for r in found.collect()}
