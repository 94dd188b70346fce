import math

from trailmark.operators import modeling as M
from trailmark.operators.ranking import stratified_folds


def test_bounds_follow_positives_and_features():
    few, many = M.search_space(88, 20), M.search_space(9000, 40)
    assert few["num_leaves"][1:3] == (6, 29) and few["min_child_samples"][1:3] == (4, 17) and few["feature_fraction"][1:3] == (0.2, 0.8)
    assert many["num_leaves"][1:3] == (6, 31) and many["min_child_samples"][1:3] == (450, 1800) and many["feature_fraction"][1:3] == (0.15, 0.5)
    assert M.search_space(3, 5)["num_leaves"][2] == 8 and len(few) == 9


def test_draws_stay_inside_and_are_log_uniform():
    space = M.search_space(88, 20)
    drawn = M.draws(space, 2000)
    assert all(space[k][1] <= v <= space[k][2] + 1e-12 for d in drawn for k, v in d.items())
    assert {d["n_estimators"] % 100 for d in drawn} == {0}
    middle = sum(d["lambda_l1"] < 0.1 for d in drawn) / len(drawn)  # half of the draws below the geometric mean
    assert 0.45 < middle < 0.55 and drawn == M.draws(space, 2000)


def test_best_round_stops_after_idle_rounds():
    assert M.best_round([5, 4, 3, 3.5, 3.4, 1], patience=2) == (3, 3)
    assert M.best_round([5, 4, 3, 3.5, 3.4, 1], patience=3) == (6, 1)
    assert M.best_round([2.0], patience=50) == (1, 2.0)


def test_halving_and_held_out_loss(spark):
    df = spark.range(300).selectExpr("id as txn_id", "cast(id % 20 as double) as x", "cast((id * 7) % 13 as double) as y", "cast((id % 20) >= 12 as int) as label")
    folds = stratified_folds(df, k=2)
    best, loss, table = M.search(folds, ["x", "y"], folds=2, trials=4, space=M.search_space(120, 2, 2, (3, 6, 3)), patience=1)
    rows = table.orderBy("rung", "trial").collect()
    assert [r.rung for r in rows] == [0, 0, 0, 0, 1] and rows[-1].trial == min(rows[:4], key=lambda r: (r.loss, r.trial)).trial
    assert all(r.rounds <= r.trees and 0 < r.loss < math.log(2) + 0.1 for r in rows) and loss == rows[-1].loss and best["maxIter"] >= 1
