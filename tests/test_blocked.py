from frames import flow_of, random_rows
from pyspark.sql import functions as F

from trailmark.plans.blocked import carry_last, hot_accounts, neighbours, running_sum
from trailmark.plans.lookback import Measure, look_back
from trailmark.schema import statement_flow

ORDER = ["t", "txn_id"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_read_once_where_no_account_is_hot(spark):
    flow = flow_of(spark, random_rows(60))
    for hot_rows, joined in ((2_000_000, False), (5, True)):
        hot = hot_accounts(flow, "t", hot_rows)
        for df in (neighbours(flow, ["acct"], ORDER, hot, {"p": "amt"}, {"n": "amt"}), running_sum(flow, ["acct"], ORDER, {"s": F.col("dir")}, hot),
                   carry_last(flow, ["acct"], ORDER, {"last": F.when(F.col("dir") == 1, F.col("txn_id"))}, hot)):
            assert ("Join" in plan(df)) == joined


def test_blocks_are_not_cut_where_none_is_hot(spark):
    flow = flow_of(spark, random_rows(60))
    assert "slot" not in plan(look_back(flow, flow, [Measure("n", "count", ["1d"])]))
    assert "slot" in plan(look_back(flow, flow, [Measure("n", "count", ["1d"])], hot_rows=2))


def test_statements_parse_the_log_once(spark, sf):
    assert "get_json_object" not in plan(statement_flow(spark, sf))
