"""One full experiment: features, screening, training, evaluation and the reports of a run."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.scalars import to_numeric
from trailmark.functions.tagsets import CHANNEL_TAGS
from trailmark.operators import evaluation as V
from trailmark.operators import features as B
from trailmark.operators import modeling as M
from trailmark.operators import ranking as R
from trailmark.operators import screening as L
from trailmark.plans.lineage import settle
from trailmark.sources import tables as T

#: Feature blocks of one build.
TOGETHER = 3
#: F1 that a run aims at (fixed value).
TARGET_F1 = 0.75


def build_wide(
    anchors: DataFrame, flow: DataFrame, blocks: Sequence[str], root: str, tag: str, families: Mapping = CHANNEL_TAGS
) -> tuple[DataFrame, list[str]]:
    """Anchors with all features of ``blocks``, stored by version of the data, blocks and families.

    Blocks are built ``TOGETHER`` at a time, so measures that they share are computed once, and no plan grows with the
    number of blocks.
    """
    spark = anchors.sparkSession
    names = [f for block in blocks for f in B.BLOCKS[block]]
    key = {"tag": tag, "families": {k: list(v) for k, v in sorted(families.items())}}
    wide = anchors
    for i in range(0, len(blocks), TOGETHER):
        some = list(blocks[i : i + TOGETHER])
        stored = T.materialize(spark, lambda some=some: B.build(anchors, flow, some, families), f"{root}/blocks", "-".join(some), key | {"blocks": some})
        wide = wide.join(stored, "txn_id", "left")
    wide = T.materialize(spark, lambda: to_numeric(wide, names), f"{root}/wide", "wide", key | {"blocks": list(blocks)})
    return wide, names


def run_experiment(
    anchors: DataFrame,
    flow: DataFrame,
    blocks: Sequence[str],
    root: str,
    run: int,
    tag: str,
    families: Mapping = CHANNEL_TAGS,
    previous: Sequence[str] | None = None,
    iv_min: float = L.IV_MIN,
    corr_max: float = L.CORR_MAX,
    keep_top: int | None = L.KEEP_TOP,
    folds: int = 5,
    params: Mapping | None = None,
    trials: int = M.TRIALS,
    iterations: tuple[int, int, int] = (300, 1000, 100),
    screen_params: Mapping | None = None,
    missed_accounts: int = 10,
    target: float = TARGET_F1,
) -> DataFrame:
    """Run everything and return one row: run, f1, best_k, n_features, hit and missed counts, passed gate and target.

    Screening uses supervised bins. Unless ``params`` are given, they are searched for in ``trials`` trials. Features kept by the screen are
    stored by run; the last run's list is what the gate compares with, unless ``previous`` is given. A run that stops at the
    gate, or has no feature left, is logged too. ``anchors`` carry ``label`` and ``split`` (train / test). Reports are written below ``root``. Stages
    that feed several jobs are stored; only feature names, information values and the best K reach the
    driver. ``tag`` names the version of anchors and flow: stored features, screens and scores are reused under the same tag
    and parameters only.
    """
    spark, began = anchors.sparkSession, time.perf_counter()
    wide, names = build_wide(anchors, flow, blocks, root, tag, families)
    train, test = T.split_by(wide, "split", ["train"], ["test"])

    key = {"tag": tag, "families": {k: list(v) for k, v in sorted(families.items())}, "blocks": list(blocks)}
    bins, drift, stable = screened(train, test, names, root, key)
    T.write_report({"iv": L.iv_total(bins), "iv_bins": bins, "drift": drift, "psi": stable}, f"{root}/report-{run}")
    iv = spark.read.parquet(f"{root}/report-{run}/iv")
    kept = [r["feature"] for r in R.rank_desc(L.keep_iv(iv, iv_min), "iv", "feature").collect()]
    pairs = lambda: L.corr_pairs(train, kept)
    gone = set(L.drop_correlated(T.materialize(spark, pairs, f"{root}/screen", "corr", key | {"kept": kept}), iv.filter(F.col("feature").isin(kept)), corr_max)) if len(kept) > 1 else set()
    kept = [f for f in kept if f not in gone]
    previous = kept_before(spark, root, run) if previous is None else list(previous)
    fresh = sorted(set(kept) - set(previous)) if previous is not None else kept
    spark.createDataFrame([(f,) for f in kept], "feature string").write.mode("overwrite").parquet(f"{root}/kept/run={run}")
    head = spark.range(1).select(F.lit(run).cast("long").alias("run"))

    def log(row: DataFrame, notes: str) -> None:
        T.log_run(row.select(
            F.current_timestamp().alias("run_at"), F.lit(run).cast("long").alias("run"), "f1", "best_k", "hit_y", "missed_y", "n_features",
            F.lit(round(time.perf_counter() - began, 3)).alias("seconds"), F.lit(notes).alias("notes")), f"{root}/runs")

    if not kept or not fresh:
        log(head.select(*[F.lit(0).cast(t).alias(n) for n, t in _FIELDS]), "GATE_FAIL: no new features after the screen" if kept else "no features pass the screen")
        return head.select("run", *[F.lit(None).cast(t).alias(n) for n, t in _FIELDS], F.lit(False).alias("gate_passed"), F.lit(False).alias("target_passed"))

    if keep_top is not None and len(kept) > keep_top:
        kept = M.importance_screen(train, kept, keep_top, params=screen_params or params or M.SCREEN_PARAMS)
    # search and out-of-fold models read their rows and features many times
    folded = settle(R.stratified_folds(train.select("txn_id", "acct", "t", "dt", "label", *kept), k=folds))
    if params is None:
        positives = train.agg(F.sum("label")).first()[0] or 0
        params, loss, trialled = M.search(folded, kept, folds=folds, trials=trials, space=M.search_space(int(positives), len(kept), folds, iterations))
        T.write_csv(trialled, f"{root}/trials-{run}")
        T.write_json(head.select("run", F.lit(loss).alias("log_loss"), *[F.lit(v).alias(k) for k, v in params.items()]), f"{root}/best_params-{run}")
    kept = M.importance_screen(train, kept, None, params=params) or kept
    scored, importance = M.oof_scores(folded, kept, folds=folds, params=params)
    meta = ["txn_id", "acct", "t", "dt", "label", "score"]
    stored = T.materialize(spark, lambda: scored.select(*meta, *kept), f"{root}/scores", "oof", {"tag": tag, "run": run, "kept": list(kept), "folds": folds, "params": sorted((params or {}).items())})
    T.write_csv(stored, f"{root}/oof_scores-{run}")
    T.write_csv(M.importance_report(importance), f"{root}/importance-{run}")
    M.save_model(M.fit(train, kept, params=params), f"{root}/model-{run}")

    table = V.topk_table(stored)
    T.write_csv(table, f"{root}/topk-{run}")
    best = V.best_k(table).first()
    k, f1 = best["top_k"] or 0, best["f1"] or 0.0
    ranked = settle(R.score_rank(stored))
    missed = V.missed_positives(ranked, k)
    T.write_csv(missed, f"{root}/missed-{run}")
    T.write_csv(V.feature_gaps(ranked, kept, k), f"{root}/gaps-{run}")
    first = R.top_n(missed, missed_accounts, -F.col("rank"), "txn_id").select("txn_id", "acct", "t", "dt")
    # the rows of a few accounts, not one more order of the whole log
    first = settle(first)
    flow = flow.join(F.broadcast(first.select("acct").distinct()), "acct", "left_semi")
    T.write_csv(V.history_summary(first, flow), f"{root}/missed_history-{run}")
    T.write_csv(R.last_n_before(first, flow, None), f"{root}/missed_rows-{run}")
    hits = settle(ranked.agg(
        F.count_if((F.col("label") == 1) & (F.col("rank") <= k)).alias("hit_y"),
        F.count_if((F.col("label") == 1) & (F.col("rank") > k)).alias("missed_y"),
    ))
    out = hits.select(
        F.lit(run).cast("long").alias("run"), F.lit(f1).alias("f1"), F.lit(k).cast("long").alias("best_k"),
        F.lit(len(kept)).cast("long").alias("n_features"), "hit_y", "missed_y", F.lit(True).alias("gate_passed"), F.lit(f1 >= target).alias("target_passed"))
    T.write_json(out, f"{root}/result-{run}")
    log(out, ",".join(blocks))
    return out


def screened(train: DataFrame, test: DataFrame, names: Sequence[str], root: str, key: Mapping) -> list[DataFrame]:
    """Supervised bins, drift and stability of the features, stored by version of the data, blocks and families like the features themselves."""
    spark, parts = train.sparkSession, ("iv_bins", "drift", "psi")
    made: list[DataFrame] = []

    def part(k: int) -> DataFrame:
        if not made:
            made.extend(L.screen_tables(train, test, names, "label"))
        return made[k]

    return [T.materialize(spark, lambda k=k: part(k), f"{root}/screen", name, key) for k, name in enumerate(parts)]


def kept_before(spark, root: str, run: int) -> list[str] | None:
    """The features kept by the screen of the last run before this one; None if there was none."""
    if not T.exists(spark, f"{root}/kept"):
        return None
    stored = spark.read.schema("feature string, run long").parquet(f"{root}/kept").filter(F.col("run") < run)
    last = stored.agg(F.max("run")).first()[0]
    return None if last is None else [r["feature"] for r in stored.filter(F.col("run") == last).select("feature").collect()]


_FIELDS = [("f1", "double"), ("best_k", "long"), ("n_features", "long"), ("hit_y", "long"), ("missed_y", "long")]
