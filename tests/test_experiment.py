import os

from trailmark.catalog.screens import FAMILIES, QUICK, labelled_rich
from trailmark.experiment import run_experiment
from trailmark.sources.tables import read_runs


def test_run_writes_reports_and_gate_stops_repeats(spark, sf, tmp_path):
    flow, anchors = labelled_rich(spark, sf)
    kw = dict(tag="a", families=FAMILIES, iv_min=0.0, keep_top=5, folds=2, params=QUICK, corr_max=0.99)
    row = run_experiment(anchors, flow, ["inflow_burst"], str(tmp_path), 1, **kw).first()
    train = anchors.filter("split = 'train'")
    assert row["gate_passed"] and row["hit_y"] + row["missed_y"] == train.filter("label = 1").count()
    made = set(os.listdir(tmp_path))
    assert {"wide", "kept", "missed_rows-1", "report-1", "oof_scores-1", "topk-1", "missed-1", "gaps-1", "model-1", "result-1", "runs"} <= made
    assert spark.read.parquet(f"{tmp_path}/report-1/drift").count() == 2
    again = run_experiment(anchors, flow, ["inflow_burst"], str(tmp_path), 2, previous=["d_3d_in_burst_vs_150d", "d_last_bash_in_gap_sec"], **kw).first()
    assert not again["gate_passed"] and again["f1"] is None
    third = run_experiment(anchors, flow, ["inflow_burst"], str(tmp_path), 3, **kw).first()  # compares with the stored list of run 2
    assert not third["gate_passed"]
    log = {r["run"]: r for r in read_runs(spark, f"{tmp_path}/runs").collect()}
    assert set(log) == {1, 2, 3} and log[2]["notes"].startswith("GATE_FAIL") and log[1]["hit_y"] + log[1]["missed_y"] == row["hit_y"] + row["missed_y"]
    assert "topk-2" not in os.listdir(tmp_path)
