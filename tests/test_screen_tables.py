"""The three tables of a screen from one frame of running counts equal those of the operators that make one table each."""

import math

from pyspark.sql import functions as F

from trailmark.experiment import screened
from trailmark.operators import screening as L
from trailmark.operators import treebins

FEATS = ["whole", "real", "holes", "one", "none", "two", "only_test"]


def frame(spark):
    x = "cast((id * 7919) % 1009 as double)"
    return spark.range(900).selectExpr(
        "id as txn_id", f"cast({x} % 11 as int) as whole", f"{x} / 7 as real", f"case when id % 4 = 0 then null when id % 9 = 0 then cast('NaN' as double) else {x} % 37 end as holes",
        "1.5 as one", "cast(null as double) as none", "case when id in (2, 3) then cast(id as double) end as two", "case when id % 5 = 0 then cast(id as double) end as only_test",
        f"cast({x} % 11 > 7 or id % 13 = 0 as int) as label", "if(id % 5 = 0, 'test', 'train') as split")


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def same(mine, theirs, keys):
    mine, theirs = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (mine, theirs))
    assert mine.keys() == theirs.keys() and mine
    for k, row in mine.items():
        assert all(close(v, theirs[k][c]) for c, v in row.items()), (row, theirs[k])


def test_tables_equal_those_of_the_single_operators(spark):
    df = frame(spark)
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    bins, drift, psi = L.screen_tables(train, test, FEATS, "label")
    same(bins, L.iv_tree(train, FEATS, "label"), ["feature", "bin"])
    same(drift, L.drift_iv(train, test, FEATS), ["feature"])
    same(psi, L.psi(train, test, FEATS), ["feature"])


def test_rows_are_ordered_once_and_the_tables_are_small(spark, monkeypatch):
    df, asked = frame(spark), []
    real = treebins.running_cells
    monkeypatch.setattr(L, "running_cells", lambda *a, **k: asked.append(1) or real(*a, **k))
    train, test = df.filter("split = 'train'"), df.filter(F.col("split") == "test")
    tables = L.screen_tables(train, test, FEATS, "label")
    # literal frames: nothing is read again however often a table is
    assert asked == [1] and all("Range" not in t._jdf.queryExecution().toString() for t in tables)


def test_screens_are_stored_by_version(spark, tmp_path, monkeypatch):
    df, asked = frame(spark), []
    real = L.screen_tables
    monkeypatch.setattr(L, "screen_tables", lambda *a, **k: asked.append(1) or real(*a, **k))
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    first, again, other = (screened(train, test, ["whole", "holes"], str(tmp_path), {"tag": tag}) for tag in ("a", "a", "b"))
    assert len(asked) == 2 and [t.count() for t in first] == [t.count() for t in again] == [t.count() for t in other] and first[1].count() == 2
