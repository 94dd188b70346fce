import math

import pytest
from pyspark.sql import functions as F

from trailmark.operators import evaluation as V
from trailmark.operators import modeling as M
from trailmark.operators import screening as L
from trailmark.operators.ranking import score_rank, stratified_folds
from trailmark.plans.selection import exact_quantiles


def test_woe_special_cases(spark):
    rows = [(float("nan"), 1.0, None, 0), (float("inf"), 1.0, None, 1), (3.0, 1.0, None, 0), (4.0, 1.0, None, 1)]
    df = spark.createDataFrame(rows, "odd double, same double, gone double, label int")
    got = {(r["feature"], r["bin"]): (r["n"], r["bad"]) for r in L.iv_quantile(df, ["odd", "same", "gone"], "label").collect()}
    assert got[("odd", "Missing")] == (2, 1)
    assert got[("same", "01")] == (4, 2)
    assert [k for k in got if k[0] == "same"] == [("same", "01")]
    assert got[("gone", "Missing")] == (4, 2)


def test_woe_formula(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("a", 0)] * 7 + [("b", 1)] * 1 + [("b", 0)] * 9 + [(None, 0)], "c string, label int")
    got = {r["bin"]: r for r in L.iv_category(df, ["c"], "label").collect()}
    pb, pg = (3 + 1e-4) / 4, (7 + 1e-4) / 17
    assert got["a"]["woe"] == pytest.approx(math.log(pb / pg))
    assert got["a"]["iv"] == pytest.approx((pb - pg) * math.log(pb / pg))
    assert got["Missing"]["n"] == 1


def test_drift_of_same_and_shifted(spark):
    base = spark.range(400).selectExpr("cast(id % 50 as double) as x", "cast(id % 50 as double) as y")
    moved = spark.range(400).selectExpr("cast(id % 50 as double) as x", "cast(id % 50 + 40 as double) as y")
    got = {r["feature"]: r["status"] for r in L.drift_iv(base, moved, ["x", "y"]).collect()}
    assert got == {"x": "Stable", "y": "SIGNIFICANT"}
    stable = {r["feature"]: r["psi"] for r in L.psi(base, moved, ["x", "y"]).collect()}
    assert stable["x"] < 0.01 < stable["y"]


def test_correlation_pairs_and_greedy_drop(spark):
    df = spark.range(50).selectExpr("cast(id as double) a", "cast(id * 2 as double) b", "cast(id % 7 as double) c", "case when id > 40 then null else cast(id as double) end d")
    pairs = L.corr_pairs(df, ["a", "b", "c", "d"])
    r = {(p["f1"], p["f2"]): p["r"] for p in pairs.collect()}
    assert len(r) == 6 and r[("a", "b")] == pytest.approx(1.0) and r[("a", "d")] == pytest.approx(1.0)
    iv = spark.createDataFrame([("a", 0.3), ("b", 0.2), ("c", 0.1), ("d", 0.25)], "feature string, iv double")
    assert L.drop_correlated(pairs, iv) == ["b", "d"]


def test_tree_bins_find_the_step(spark):
    df = spark.range(600).selectExpr("id as txn_id", "cast(id % 100 as double) as x", "cast((id % 100) >= 60 as int) as label", "case when id % 10 = 0 then null else cast(id % 3 as double) end as z")
    got = {r["bin"]: (r["n"], r["bad"]) for r in L.iv_tree(df, ["x", "z"], "label").filter("feature = 'x'").collect()}
    assert got == {"0.0__59.0": (360, 0), "60.0__99.0": (240, 240)}
    z = L.iv_tree(df, ["x", "z"], "label").filter("feature = 'z' and bin = 'Missing'").first()
    assert z["n"] == 60


def test_tree_bins_of_many_values(spark):
    """A step that no grid of quantiles would meet, among 100,000 distinct values in shuffled order."""
    df = spark.range(100_000).selectExpr("id as txn_id", "cast((id * 7919) % 100003 as double) / 8 as x").withColumn(
        "label", (F.col("x").between(6001.5, 6009.25) | (F.col("x") > 12000)).cast("int"))
    got = {(r["lo"], r["hi"]): (r["n"], r["bad"]) for r in L.iv_tree(df, ["x"], "label").collect()}
    low, high = df.agg(F.min("x"), F.max("x")).first()
    assert len(got) == 4 and {b for _, b in got.values() if b} == {df.filter("x between 6001.5 and 6009.25").count(), df.filter("x > 12000").count()}
    assert all(b in (0, n) for n, b in got.values()) and min(got)[0] == low and max(got)[1] == high


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    columns = {"wide": rng.normal(0, 1, 30_000) * 10.0 ** rng.integers(-9, 9, 30_000), "few": rng.integers(0, 3, 30_000) * 1.0,
               "one": np.full(30_000, 7.0), "hot": np.where(rng.random(30_000) < 0.4, 5.0, rng.random(30_000) * 10)}
    import pandas as pd

    long = spark.createDataFrame(pd.DataFrame(columns)).unpivot([], list(columns), "feature", "value")
    probs = [0.0, 0.2, 0.25, 0.4, 0.5, 0.6, 0.8, 0.999, 1.0]
    got = exact_quantiles(long.unionByName(spark.createDataFrame([("wide", None), ("tiny", 3.0), ("tiny", 4.0)], "feature string, value double")), probs)
    for name, values in {**columns, "tiny": np.array([3.0, 4.0])}.items():
        assert got[name] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)


def test_topk_ties_short_tables_and_no_positives(spark):
    df = spark.range(35).selectExpr("id as txn_id", "0.5D as score", "cast(id < 5 as int) as label")
    table = V.topk_table(df).orderBy("top_k").collect()
    assert [r["top_k"] for r in table] == [10, 20, 30]
    ranked = score_rank(df)
    top10 = ranked.filter("rank <= 10").agg(F.sum("label")).first()[0]
    assert table[0]["hits"] == top10 and table[0]["precision"] == round(top10 / 10, 4)
    none = V.topk_table(df.withColumn("label", F.lit(0))).collect()
    assert {(r["recall"], r["f1"]) for r in none} == {(0.0, 0.0)}
    flat = spark.createDataFrame([(10, 5, 0.5, 0.5, 0.4, 0.1), (20, 9, 0.5, 0.5, 0.4, 0.1)], "top_k long, hits long, precision double, recall double, f1 double, score_at_k double")
    assert V.best_k(flat).first()["top_k"] == 10


def test_training_round_trip(spark, tmp_path):
    df = spark.range(240).selectExpr("id as txn_id", "cast(id % 20 as double) as x", "case when id % 5 = 0 then null else cast(id % 3 as double) end as y", "cast((id % 20) >= 12 as int) as label")
    folds = stratified_folds(df, k=2)
    quick = {"maxIter": 2, "maxDepth": 2}
    scored, imp = M.oof_scores(folds, ["x", "y"], folds=2, params=quick)
    assert scored.count() == 240
    best = {r["label"]: r["s"] for r in scored.groupBy("label").agg(F.avg("score").alias("s")).collect()}
    assert best[1] > 0.7 > 0.3 > best[0]
    assert imp.orderBy(F.desc("importance")).first()["feature"] == "x"
    model = M.fit(df, ["x", "y"], params=quick)
    M.save_model(model, str(tmp_path / "model"))
    again = M.score(M.load_model(str(tmp_path / "model")), df, ["x", "y"])
    assert again.select("txn_id", "score").exceptAll(M.score(model, df, ["x", "y"]).select("txn_id", "score")).count() == 0
