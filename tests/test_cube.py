import pytest
from frames import flow_of, random_rows
from pyspark.sql import functions as F

from trailmark.operators.cube import feature_cube


def cube(spark, flow, factor):
    got = feature_cube(flow, flow, ["3d", "14d"], {"in": F.col("dir") == 1}, "chan", {"novel": F.col("novel") == 1}, F.col("amt"), pair_factor=factor)
    return {r["txn_id"]: r.asDict() for r in got.collect()}


def test_cells_of_light_and_of_busy_accounts(spark):
    # one account of them is joined and the other not, all are joined, none is
    flow = flow_of(spark, random_rows(120) + [dict(txn_id=500, acct=9, t=0, chan=None), dict(txn_id=501, acct=9, t=5, chan="a", amt=None)])
    mixed, pairs, lattice = (cube(spark, flow, f) for f in (10.0, 1e9, 0.0))
    assert len(pairs) == 122 and pairs.keys() == lattice.keys() == mixed.keys()
    for other in (lattice, mixed):
        for k, row in pairs.items():
            assert {c for c, v in row.items() if v is None} == {c for c, v in other[k].items() if v is None}
            assert all(v == pytest.approx(other[k][c], rel=1e-6, abs=1e-6) for c, v in row.items() if v is not None)


def test_few_pairs_build_no_wide_lattice(spark):
    flow = flow_of(spark, random_rows(40))
    got = feature_cube(flow, flow, ["3d"], {"in": F.col("dir") == 1}, "chan", {"novel": F.col("novel") == 1}, F.col("amt"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
