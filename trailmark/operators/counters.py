"""Windowed counters of statements: balances and shares around inflows and outflows, sequences after withdrawals and loans, remark families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.scalars import balance_parts, safe_ratio, spread_std
from trailmark.operators.sequences import with_neighbours
from trailmark.plans.lineage import settle
from trailmark.plans.lookback import Measure, look_back, look_back_days
from trailmark.schema import SECOND

# Seconds to a purchase after money came in, smallest and largest share of the balance, largest probe, day bands before the anchor's day.
WITHIN, SMALL_SHARE, LARGE_SHARE, PROBE_BELOW = 300, 0.05, 0.95, 100
BANDS = {"180d": (2, 179), "360d": (2, 359)}


def statement_counters(anchors: DataFrame, flow: DataFrame) -> DataFrame:
    """One row per anchor. ``flow`` has the text attributes of ``statements`` and ``bal``; anchors are rows of it.

    All windows of a kind come from one pass: 15 days, 3 days and 3 hours before the anchor's second, and bands of whole days.
    """
    lags = {"prev_dir": "dir", "prev_withdraw": "r_withdraw", "prev_loan": "r_loan", "prev_t": "t"}
    rows = with_neighbours(flow.withColumns(balance_parts()), lags)
    quick = (F.col("prev_dir") == 1) & (F.col("t") - F.col("prev_t") < WITHIN * SECOND) & F.expr("dir = 0 and r_goods = 1")
    rows = settle(rows.withColumns({"after_withdraw": quick & (F.col("prev_withdraw") == 1), "after_loan": quick & (F.col("prev_loan") == 1)}))
    day15, day3 = ["15d"], ["3d"]
    both = day15 + day3
    seconds = [
        Measure("max_before_in", "max", day15, "dir = 1", "before_in"), Measure("min_before_in", "min", day15, "dir = 1", "before_in"),
        Measure("max_in_share", "max", day15, "dir = 1", "in_share"), Measure("min_out_share", "min", day15, "dir = 0", "out_share"),
        Measure("bal", "spread", both, None, "bal"), Measure("out_share", "spread", day15, "dir = 0", "out_share"), Measure("in_share", "spread", day15, "dir = 1", "in_share"),
        Measure("bal_n", "count", day3, "bal is not null"), Measure("bal_s", "sum", day3, None, "bal"),
        Measure("bal_min", "min", both, None, "bal"), Measure("min_amt", "min", both, None, "amt"), Measure("in_amt", "sum", both, "dir = 1", "amt"),
        Measure("out_amt", "sum", both, "dir = 0", "amt"), Measure("ins", "count", day3, "dir = 1"), Measure("max_in", "max", day3, "dir = 1", "amt"),
        Measure("withdraw_shop", "count", day15, "after_withdraw"), Measure("loan_shop", "count", day15, "after_loan"),
        Measure("fund_amt", "sum", day15, "dir = 0 and r_fund = 1", "amt"), Measure("named_amt", "sum", day15, "other_name = 1", "amt"),
        Measure("shop_in", "count", day15, "dir = 1 and r_shop = 1"), Measure("thousands", "count", day15, "amt % 1000 = 0"),
        Measure("probes", "count", both, f"r_interbank = 1 and amt < {PROBE_BELOW}"), Measure("hundreds", "count", ["3h"], "amt % 100 = 0"),
        Measure("flat_amt", "sum", ["3h"], "floor(amt / 10) % 10 = 0 and floor(amt) % 10 = 0", "amt"),
    ]
    days = [
        Measure("min_before_out", "min", ["180d", "360d"], "dir = 0", "before_out"), Measure("share_sum", "sum", ["180d"], "dir = 0", "out_share"), Measure("outs", "count", ["180d"], "dir = 0"),
        Measure("small_out", "count", ["180d"], f"dir = 0 and out_share <= {SMALL_SHARE}"), Measure("large_out", "count", ["180d"], f"dir = 0 and out_share >= {LARGE_SHARE}"),
        Measure("all_ins", "count", ["180d"], "dir = 1"), Measure("withdraw_in", "count", ["180d"], "dir = 1 and r_withdraw = 1"), Measure("max_amt", "max", ["180d", "360d"], None, "amt"),
    ]
    got = look_back(anchors, rows, seconds).join(look_back_days(anchors, rows, days, BANDS).drop("acct", "dt"), "txn_id")
    std = lambda name, w: spread_std(F.col(f"{name}_{w}"))
    made = {
        "bal_std_15d": std("bal", "15d"), "bal_std_3d": std("bal", "3d"), "bal_avg_3d": safe_ratio("bal_s_3d", "bal_n_3d"), "out_share_std_15d": std("out_share", "15d"),
        "in_share_std_15d": std("in_share", "15d"), "in_out_ratio_15d": safe_ratio("in_amt_15d", "out_amt_15d"), "in_avg_3d": safe_ratio("in_amt_3d", "ins_3d"),
        "out_share_avg_180d": safe_ratio("share_sum_180d", "outs_180d"), "small_out_share_180d": safe_ratio("small_out_180d", "outs_180d"),
        "large_out_share_180d": safe_ratio("large_out_180d", "outs_180d"), "withdraw_in_share_180d": safe_ratio("withdraw_in_180d", "all_ins_180d"),
    }
    plain = ["max_before_in_15d", "min_before_in_15d", "max_in_share_15d", "min_out_share_15d", "bal_min_15d", "bal_min_3d", "min_amt_15d", "min_amt_3d", "in_amt_3d", "out_amt_3d", "max_in_3d",
             "withdraw_shop_15d", "loan_shop_15d", "fund_amt_15d", "named_amt_15d", "shop_in_15d", "thousands_15d", "probes_15d", "probes_3d", "hundreds_3h", "flat_amt_3h",
             "min_before_out_180d", "min_before_out_360d", "max_amt_180d", "max_amt_360d"]
    return got.select("txn_id", *plain, *[c.alias(n) for n, c in made.items()])
