"""Feature screening: weight of evidence, information value, drift, correlation and redundancy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ranking import stratified_folds
from trailmark.operators.treebins import cell_bins, counts_upto, ranked_values, running_cells, tree_bins
from trailmark.plans.selection import exact_quantiles

# Smoothing of bin shares, thresholds of the screens.
SMOOTH = 0.0001
IV_MIN = 0.02
DRIFT_SLIGHT, DRIFT_SIGNIFICANT = 0.1, 0.25
CORR_MAX = 0.95
KEEP_TOP = 69


def to_long(df: DataFrame, feats: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, value): all features in one frame, so one job screens them all."""
    return df.select(*keep, *[_finite(f).alias(f) for f in feats]).unpivot(list(keep), list(feats), "feature", "value")


def _finite(f: str) -> Column:
    value = F.col(f).cast("double")
    return F.when(~(F.isnan(value) | (F.abs(value) == float("inf"))), value)


def quantile_cuts(long: DataFrame, bins: int = 5, digits: int = 3) -> DataFrame:
    """(feature, cuts): sorted distinct inner quantiles, exact and interpolated, whatever the number of distinct values."""
    cuts = exact_quantiles(long, [i / bins for i in range(1, bins)])
    rows = [(f, _rounded_cuts(cs, digits)) for f, cs in cuts.items()]
    return long.sparkSession.createDataFrame(rows, "feature string, cuts array<double>")


def _rounded_cuts(cuts: Iterable[float], digits: int = 3) -> list[float]:
    return sorted({math.floor(c * 10**digits + 0.5) / 10**digits for c in cuts})


def assign_bins(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``bin``: ``01`` for values up to the first cut, ..., ``Missing`` for NULL.

    There is one row of cuts per feature; the frame is as small as the feature list.
    """
    joined = long.join(F.broadcast(cuts), "feature", "left")
    over = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    label = F.when(F.col("value").isNull(), "Missing").otherwise(F.lpad((over + 1).cast("string"), 2, "0"))
    return joined.withColumn("bin", label).drop("cuts")


def woe_table(binned: DataFrame, label: str) -> DataFrame:
    """(feature, bin): counts, rates, shares in percent, weight of evidence and information value.

    Counts per (feature, bin) are combined map-side; the totals come from those few counts.
    """
    cells = binned.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("bad")
    )
    return evidence(cells, ["feature", "bin"])


def evidence(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates, shares in percent, weight of evidence and information value of bins with counts ``n`` and ``bad``."""
    totals = cells.groupBy("feature").agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb"))
    x = cells.join(totals, "feature")
    pct_bad = (F.col("bad") + SMOOTH) / F.nullif(F.col("tb").cast("double"), F.lit(0.0))
    pct_good = (F.col("n") - F.col("bad") + SMOOTH) / F.nullif((F.col("tn") - F.col("tb")).cast("double"), F.lit(0.0))
    woe = F.log(pct_bad / pct_good)
    return x.select(
        *keys,
        "n",
        "bad",
        (F.col("bad") * 100.0 / F.nullif(F.col("n"), F.lit(0))).alias("bad_rate"),
        (F.col("n") * 100.0 / F.col("tn")).alias("pct"),
        (pct_bad * 100).alias("bad_pct"),
        (pct_good * 100).alias("good_pct"),
        woe.alias("woe"),
        ((pct_bad - pct_good) * woe).alias("iv"),
    )


def iv_quantile(df: DataFrame, feats: Sequence[str], label: str, bins: int = 5) -> DataFrame:
    """Weight-of-evidence table with quantile bins for numeric features."""
    long = to_long(df, feats, [label])
    return woe_table(assign_bins(long, quantile_cuts(long, bins)), label)


def iv_category(df: DataFrame, feats: Sequence[str], label: str, order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The same with the categories of text features as bins.

    A feature with an ``order`` has exactly these bins, numbered by ``place``, those without rows included; rows of other values (``Missing``
    is one like any other) count in the totals only. Bins of other features have no place.
    """
    long = df.select(label, *[F.col(f).cast("string").alias(f) for f in feats]).unpivot(
        [label], list(feats), "feature", "value"
    )
    binned = long.withColumn("bin", F.coalesce("value", F.lit("Missing")))
    if not order:
        return woe_table(binned, label)
    cells = binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    listed = df.sparkSession.createDataFrame([(f, v, k) for f, vs in order.items() for k, v in enumerate(vs, 1)], "feature string, bin string, place int")
    bound = F.col("feature").isin(*order)
    all_cells = cells.join(F.broadcast(listed), ["feature", "bin"], "full").fillna(0, ["n", "bad"])
    shown = evidence(all_cells, ["feature", "bin", "place"]).filter(~bound | F.col("place").isNotNull())
    return shown


def iv_total(woe: DataFrame) -> DataFrame:
    return woe.groupBy("feature").agg(F.sum("iv").alias("iv"))


def keep_iv(iv: DataFrame, threshold: float = IV_MIN) -> DataFrame:
    return iv.filter(F.col("iv") >= threshold)


def drift_status(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v < DRIFT_SLIGHT, "Stable").when(v < DRIFT_SIGNIFICANT, "Slight").otherwise("SIGNIFICANT")


def drift_iv(train: DataFrame, test: DataFrame, feats: Sequence[str], bins: int = 5) -> DataFrame:
    """Information value of belonging to the training set, with a verdict."""
    both = train.select(*feats).withColumn("member", F.lit(1)).unionByName(
        test.select(*feats).withColumn("member", F.lit(0))
    )
    iv = iv_total(iv_quantile(both, feats, "member", bins))
    return iv.select("feature", F.col("iv").alias("drift"), drift_status("iv").alias("status"))


def psi(train: DataFrame, test: DataFrame, feats: Sequence[str], bins: int = 5) -> DataFrame:
    """Population stability index over the quantile bins of the training set."""
    long = to_long(train, feats, [])
    cuts = quantile_cuts(long, bins)
    marked = to_long(
        train.select(*feats).withColumn("member", F.lit(1)).unionByName(
            test.select(*feats).withColumn("member", F.lit(0))
        ),
        feats,
        ["member"],
    )
    w = woe_table(assign_bins(marked, cuts), "member")
    return w.groupBy("feature").agg(F.sum("iv").alias("psi"))


def corr_pairs(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """(f1, f2, r): absolute pairwise-complete Pearson correlation of every feature pair; NULL where there is none.

    Two passes whatever the number of features: one for the means, which values are centred on, and one in which every
    task adds up products of its batches. A task sends one row per pair.
    """
    feats = list(feats)
    numbers = df.select(*[F.col(f).cast("double").alias(f) for f in feats])
    means = numbers.agg(*[F.avg(F.when(~F.isnan(f), F.col(f))).alias(f) for f in feats]).first()
    centre = [means[f] or 0.0 for f in feats]

    def products(batches):
        import numpy as np
        import pyarrow as pa

        n = len(feats)
        total = np.zeros((4, n, n))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.triu_indices(n, 1)
        count, sums, squares, both = total
        cols = [i, j, count[i, j], sums[i, j], sums[j, i], squares[i, j], squares[j, i], both[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = numbers.mapInArrow(products, "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double")
    whole = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    names = F.array(*[F.lit(f) for f in feats])
    name = lambda c: F.element_at(names, (F.col(c) + 1).cast("int"))
    ok = F.when(F.col("n") > 1, (vx > 0) & (vy > 0))
    return whole.select(name("i").alias("f1"), name("j").alias("f2"), F.when(ok, F.least(F.abs(r), F.lit(1.0))).alias("r"))


def drop_correlated(pairs: DataFrame, iv: DataFrame, threshold: float = CORR_MAX) -> list[str]:
    """Features to drop: of each redundant pair the one with less information, unless one is gone already.

    Runs over the feature list only: pairs above the threshold and one information value per feature.
    """
    value = {r["feature"]: r["iv"] for r in iv.select("feature", "iv").collect()}
    high = [(r["f1"], r["f2"]) for r in pairs.filter(F.col("r") >= threshold).collect()]
    order = sorted(value, key=lambda f: (-value[f], f))
    place = {f: i for i, f in enumerate(order)}
    dropped: set[str] = set()
    for a, b in sorted(high, key=lambda p: sorted((place[p[0]], place[p[1]]))):
        if a not in dropped and b not in dropped:
            dropped.add(max(a, b, key=lambda f: place[f]))
    return sorted(dropped)


def feature_gate(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: number of kept features that the previous run did not have, and whether there is any."""
    fresh = current.select("feature").join(previous.select("feature"), "feature", "left_anti")
    n = F.count(F.lit(1))
    return fresh.agg(n.alias("n_new"), (n > 0).alias("passed"))


def iv_tree(df: DataFrame, feats: Sequence[str], label: str, max_leaves: int = 4, folds: int = 3, id_col: str = "txn_id") -> DataFrame:
    """Weight-of-evidence table with supervised bins: for each feature a Gini tree of 2..max_leaves leaves on its exact values.

    The number of leaves is chosen on folds that are stratified by the label; see ``treebins``.
    """
    marked = stratified_folds(df.select(id_col, label, *[c for c in feats if c != id_col]), label, folds, id_col)
    bins = tree_bins(to_long(marked, feats, [label, "fold"]), label, "fold", folds, max_leaves)
    return evidence(bins, ["feature", "bin", "lo", "hi"])


def screen_tables(
    train: DataFrame, test: DataFrame, feats: Sequence[str], label: str, max_leaves: int = 4, folds: int = 3, id_col: str = "txn_id", bins: int = 5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``iv_tree``, ``drift_iv`` and ``psi`` return, from one sorted frame of distinct values.

    The rows of both sets are reduced to running counts once. Splits, quantiles (the value at a running count) and the rows of their bins (running
    counts at the cuts) are read from these; no table orders or counts the rows again. The three tables have a few rows for each feature.
    """
    spark, whole, both = train.sparkSession, folds, folds + 1
    inputs = [c for c in feats if c != id_col]
    marked = stratified_folds(train.select(id_col, label, *inputs), label, folds, id_col)
    rest = test.select(id_col, label, *inputs).withColumn("fold", F.lit(None).cast("int"))
    cells = running_cells(to_long(marked.unionByName(rest), feats, [label, "fold"]), label, "fold", folds, others=True)

    # rows, and rows and positives without a value, of both sets
    def totals(df: DataFrame) -> tuple[int, dict[str, tuple[int, int]]]:
        none, bad = {f: _finite(f).isNull() for f in feats}, F.col(label).cast("long")
        row = df.agg(F.count(F.lit(1)), *[F.count_if(none[f]) for f in feats], *[F.sum(F.when(none[f], bad)) for f in feats]).first()
        return row[0], {f: (row[1 + k], row[1 + len(feats) + k]) for k, f in enumerate(feats)}

    (n_train, gone), (n_test, gone_test) = totals(train), totals(test)
    # values that only the test set has are no cells of the training set
    tree = evidence(cell_bins(cells.filter("own > 0").drop("own"), [(f, *v) for f, v in gone.items() if v[0]], folds, max_leaves), ["feature", "bin", "lo", "hi"])

    known = {(f, s): n for f in feats for s, n in ((whole, n_train - gone[f][0]), (both, n_train + n_test - gone[f][0] - gone_test[f][0]))}
    place = {key: [(n - 1) * (i / bins) for i in range(1, bins)] for key, n in known.items() if n}
    at = ranked_values(cells, sorted({(*key, int(h)) for key, hs in place.items() for h in hs})) if place else {}

    def quantile(key: tuple[str, int], h: float) -> float:
        low, upto, above = at[(*key, int(h))]
        high = above if upto == int(h) + 1 and h > int(h) and above is not None else low
        return low + (high - low) * (h - int(h))

    cuts = {key: _rounded_cuts(quantile(key, h) for h in hs) for key, hs in place.items()}
    upto = counts_upto(cells, sorted({(f, c) for (f, _), cs in cuts.items() for c in cs}), [whole, both]) if cuts else {}

    def membership(s: int) -> DataFrame:
        rows = []
        for f in feats:
            ends = [upto.get((f, c), (0, 0)) for c in cuts.get((f, s), [])] + [(known[f, whole], known[f, both])]
            for k, (start, end) in enumerate(zip([(0, 0), *ends], ends), 1):
                rows.append((f, f"{k:02d}", end[1] - start[1], end[0] - start[0]))
            rows.append((f, "Missing", gone[f][0] + gone_test[f][0], gone[f][0]))
        cells_of = spark.createDataFrame([r for r in rows if r[2]], "feature string, bin string, n long, bad long")
        return iv_total(evidence(cells_of, ["feature", "bin"]))

    drift, stable = membership(both), membership(whole)
    return tree, drift.select("feature", F.col("iv").alias("drift"), drift_status("iv").alias("status")), stable.select("feature", F.col("iv").alias("psi"))


def available(declared: Iterable[str], df: DataFrame) -> list[str]:
    have = set(df.columns)
    return [f for f in declared if f in have]
