"""Boosted-tree training on Spark ML: search, out-of-fold scores, importance, persistence."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.lineage import settle

#: Trees that rank features before the search (fixed values): 500 rounds, 31 leaves grown by level.
SCREEN_PARAMS = {"maxIter": 500, "maxDepth": 5, "stepSize": 0.05, "minInstancesPerNode": 5}

#: Stands in for a missing value: below every real one, so a tree can split it off.
MISSING = -1.0e12


def prepare(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in feats})


def pipeline(feats: Sequence[str], label: str = "label", params: Mapping | None = None) -> Pipeline:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=42, **(params or {}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(feats), outputCol="features"), gbt])


def fit(df: DataFrame, feats: Sequence[str], label: str = "label", params: Mapping | None = None) -> PipelineModel:
    return pipeline(feats, label, params).fit(prepare(df, feats))


def score(model: PipelineModel, df: DataFrame, feats: Sequence[str]) -> DataFrame:
    made = ("features", "rawPrediction", "probability", "prediction")
    out = model.transform(prepare(df, feats))
    return out.withColumn("score", vector_to_array("probability")[1]).drop(*made)


def importance(spark: SparkSession, model: PipelineModel, feats: Sequence[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feats, values)], "feature string, importance double")


def importance_screen(
    df: DataFrame, feats: Sequence[str], n: int | None = None, label: str = "label", params: Mapping | None = None
) -> list[str]:
    """Features by falling importance: the first ``n``, or all above zero."""
    model = fit(df, feats, label, params)
    ranked = sorted(zip(feats, model.stages[-1].featureImportances.toArray()), key=lambda p: (-p[1], p[0]))
    return [f for f, v in ranked[:n]] if n else [f for f, v in ranked if v > 0]


def oof_scores(
    df: DataFrame,
    feats: Sequence[str],
    label: str = "label",
    fold: str = "fold",
    folds: int = 5,
    params: Mapping | None = None,
    parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Scores of every row from a model that has not seen its fold, and the mean importance; up to ``parallelism`` folds train at a time."""
    spark = df.sparkSession
    scored = imps = None
    with ThreadPool(min(parallelism, folds)) as pool:
        models = pool.map(lambda k: fit(df.filter(F.col(fold) != k), feats, label, params), range(folds))
    for k, model in enumerate(models):
        part = score(model, df.filter(F.col(fold) == k), feats)
        imp = importance(spark, model, feats)
        scored = part if scored is None else scored.unionByName(part)
        imps = imp if imps is None else imps.unionByName(imp)
    return scored, imps.groupBy("feature").agg(F.avg("importance").alias("importance"))


#: Trials of a search, the share of them that each rung keeps, and idle rounds before boosting stops (fixed values).
TRIALS, KEEP, PATIENCE = 100, 3, 50


def search_space(positives: int, n_features: int, folds: int = 5, iterations: tuple[int, int, int] = (300, 1000, 100)) -> dict[str, tuple]:
    """Range of each of the nine dimensions: (kind, low, high, step). Fixed values; leaves and rows of a leaf follow the number of positives."""
    per_fold = max(1, positives // folds)
    rows_low = max(3, per_fold // 4)
    wide = n_features > 30
    return {
        "num_leaves": ("int", 6, min(31, max(8, positives // 3)), 1),
        "learning_rate": ("log", 0.01, 0.1, None),
        "n_estimators": ("int", *iterations),
        "min_child_samples": ("int", rows_low, max(rows_low + 10, per_fold), 1),
        "max_depth": ("int", 3, 8, 1),
        "feature_fraction": ("float", 0.15 if wide else 0.2, 0.5 if wide else 0.8, None),
        "bagging_fraction": ("float", 0.6, 0.95, None),
        "lambda_l1": ("log", 0.01, 1.0, None),
        "lambda_l2": ("log", 0.01, 1.0, None),
    }


def draws(space: Mapping[str, tuple], trials: int, seed: int = 42) -> list[dict]:
    """Parameter sets: whole numbers in steps, fractions uniform, rates and penalties uniform in their logarithm."""
    rng = random.Random(seed)

    def one(kind: str, low: float, high: float, step: float | None) -> float:
        if kind == "int":
            return rng.randrange(int(low), int(high) + 1, int(step))
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [{k: one(*r) for k, r in space.items()} for _ in range(trials)]


def tree_params(draw: Mapping, rows: int) -> dict:
    """What a drawn set means for Spark's boosted trees.

    Trees grow by level here: the leaf limit is a depth. The L1 penalty is on sums of gradients, Spark's least gain is per row; the L2 penalty
    shrinks leaf values by their weight, at most as far as the smallest allowed leaf, so it shrinks the step.
    """
    weight = draw["min_child_samples"] / 4
    return {
        "maxDepth": min(draw["max_depth"], math.ceil(math.log2(draw["num_leaves"]))),
        "stepSize": draw["learning_rate"] * weight / (weight + draw["lambda_l2"]),
        "maxIter": draw["n_estimators"],
        "minInstancesPerNode": draw["min_child_samples"],
        "featureSubsetStrategy": str(round(draw["feature_fraction"], 6)),
        "subsamplingRate": draw["bagging_fraction"],
        "minInfoGain": draw["lambda_l1"] / max(rows, 1),
    }


def best_round(losses: Sequence[float], patience: int = PATIENCE) -> tuple[int, float]:
    """Number of trees and loss where boosting that stops after ``patience`` rounds without a better loss has its best."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1, losses[best]


def watched_loss(train: DataFrame, held: DataFrame, label: str, params: Mapping, patience: int = PATIENCE) -> tuple[int, float]:
    """Best number of trees and log loss of a model that is watched on held-out rows; both frames carry ``features``."""
    model = GBTClassifier(featuresCol="features", labelCol=label, seed=42, **params).fit(train)
    # Spark's loss of a row is 2 log(1 + exp(-2 margin)), the log loss of the same row is half of it
    rounds, loss = best_round(model.evaluateEachIteration(held), patience)
    return rounds, loss / 2


def search(
    df: DataFrame,
    feats: Sequence[str],
    label: str = "label",
    fold: str = "fold",
    folds: int = 5,
    trials: int = TRIALS,
    space: Mapping[str, tuple] | None = None,
    parallelism: int = 4,
    patience: int = PATIENCE,
    seed: int = 42,
) -> tuple[dict, float, DataFrame]:
    """Search by mean log loss over the folds: (parameters of Spark's trees, loss, one row for each trial and rung).

    Successive halving: all trials run with a share of their trees, the best third goes on with three times as many, until the
    last ones run whole. Each model is watched on the fold that it has not seen and judged at its best round.
    The table has the drawn values, trees asked for, mean best round, loss, and the least loss of the rung so far.
    """
    spark = df.sparkSession
    made = VectorAssembler(inputCols=list(feats), outputCol="features").transform(prepare(df, feats))
    made = settle(made.select(F.col(label).cast("double").alias(label), F.col(fold).cast("int").alias(fold), "features"))
    rows, positives = made.agg(F.count(F.lit(1)), F.sum(label)).first()
    space = space or search_space(int(positives or 0), len(feats), folds)
    all_draws = draws(space, trials, seed)
    parts = [(made.filter(F.col(fold) != k), made.filter(F.col(fold) == k)) for k in range(folds)]
    rungs = max(1, math.ceil(math.log(max(trials, 1), KEEP)))

    def judge(job: tuple[int, int]) -> tuple[int, int, float, float]:
        trial, rung = job
        params = tree_params(all_draws[trial], rows)
        params["maxIter"] = max(1, params["maxIter"] // KEEP ** (rungs - 1 - rung))
        watched = [watched_loss(train, held, label, params, patience) for train, held in parts]
        return trial, params["maxIter"], sum(n for n, _ in watched) / folds, sum(x for _, x in watched) / folds

    left, table = list(range(trials)), []
    with ThreadPool(min(parallelism, max(trials, 1))) as pool:
        for rung in range(rungs):
            done = sorted(pool.map(judge, [(t, rung) for t in left]))
            for k, (trial, trees, rounds, loss) in enumerate(done):
                least = min(x[3] for x in done[: k + 1])
                table.append((rung, trial, trees, rounds, loss, least, *(float(all_draws[trial][n]) for n in space)))
            done.sort(key=lambda x: (x[3], x[0]))
            left = sorted(x[0] for x in done[: max(1, len(done) // KEEP)])
            winner = done[0]
    best = tree_params(all_draws[winner[0]], rows)
    best["maxIter"] = max(1, round(winner[2]))
    schema = "rung int, trial int, trees int, rounds double, loss double, least double, " + ", ".join(f"{n} double" for n in space)
    return best, winner[3], spark.createDataFrame(table, schema)


def importance_report(imp: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    out = imp if dictionary is None else imp.join(dictionary, "feature", "left")
    return out.orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
