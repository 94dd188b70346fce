import pytest
from frames import before, flow_of, random_rows

from trailmark.plans.quantiles import heavy_accounts, window_quantile, window_rank
from trailmark.schema import WINDOWS


@pytest.mark.parametrize("pair_factor,hot_rows", [(1e9, 2_000_000), (0.0, 2_000_000), (0.0, 4)])
def test_rank_and_percentiles_match_definition(spark, pair_factor, hot_rows):
    rows = random_rows(90, seed=21)
    for i, r in enumerate(rows[::4]):
        r["amt"] = (50.0, 0.001, None, 0.004)[i % 4]
    flow = flow_of(spark, rows)
    kw = {"pair_factor": pair_factor, "hot_rows": hot_rows}
    rank = {r["txn_id"]: r for r in window_rank(flow, flow, "3d", "dir = 0", **kw).collect()}
    quant = {r["txn_id"]: r for r in window_quantile(flow, flow, "3d", [0.5, 0.95], "dir = 0", **kw).collect()}
    assert len(rank) == len(quant) == len(rows)
    for a in rows:
        amts = sorted(r["amt"] for r in before(rows, a, WINDOWS["3d"]) if r["dir"] == 0 and r["amt"] is not None)
        r, q = rank[a["txn_id"]], quant[a["txn_id"]]
        assert (r["n"], r["n_le"]) == (len(amts), sum(a["amt"] is not None and x <= a["amt"] for x in amts))
        for col, p in (("q0", 50), ("q1", 95)):
            assert q[col] == (amts[-(-p * len(amts) // 100) - 1] if amts else None)


def test_one_busy_account_among_many(spark):
    """The bound holds for each account: a busy one is seen however many quiet ones there are, and both plans give its rows."""
    quiet = spark.range(20_000).selectExpr("id % 10000 + 5 as acct")
    busy = quiet.unionByName(spark.range(400).selectExpr("1L as acct"))
    assert [r.acct for r in heavy_accounts(busy, busy, 64.0).collect()] == [1]
    rows = random_rows(120, seed=4)
    for r in rows[:70]:
        r["acct"] = 1
    flow = flow_of(spark, rows)
    assert heavy_accounts(flow, flow.filter("dir = 0"), 8.0).count() == 1
    kw = {"window": "3d", "where": "dir = 0"}
    for run in (lambda f: window_rank(flow, flow, pair_factor=f, **kw), lambda f: window_quantile(flow, flow, probs=[0.5, 0.9], pair_factor=f, **kw)):
        mixed, plain = ({r["txn_id"]: tuple(r) for r in run(f).collect()} for f in (8.0, 1e9))
        assert mixed == plain and len(mixed) == len(rows)


@pytest.mark.parametrize("pair_factor", [1e9, 0.0])
def test_exact_with_more_rows_than_any_sketch_holds(spark, pair_factor):
    n = 12_000
    flow = spark.range(n).selectExpr("id as txn_id", "1L as acct", "id * 1000000L as t", "0 as dir", "cast((id * 7919) % 12007 as double) / 1000 as amt")
    anchors = spark.createDataFrame([(-1, 1, n * 1_000_000, 5.0)], "txn_id long, acct long, t long, amt double")
    amts = sorted(((i * 7919) % 12007) / 1000 for i in range(n))
    rank = window_rank(anchors, flow, "14d", "dir = 0", pair_factor=pair_factor).first()
    assert (rank["n"], rank["n_le"]) == (n, sum(x <= 5.0 for x in amts))
    q = window_quantile(anchors, flow, "14d", [0.5, 0.95], "dir = 0", pair_factor=pair_factor).first()
    assert (q["q0"], q["q1"]) == (amts[n // 2 - 1], amts[n * 95 // 100 - 1])
