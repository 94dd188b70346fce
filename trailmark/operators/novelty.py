"""First-seen values, new-member ratios and report labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.plans.blocked import HOT_ROWS
from trailmark.plans.lookback import Measure, look_back
from trailmark.plans.profile import distinct, key_profile, key_profile_band


def novel_values(
    flow: DataFrame, value: str, lo: int = 7, hi: int = 180, where: Column | None = None
) -> DataFrame:
    """(acct, value, dt) where the account shows no such value on days ``lo..hi`` before.

    Rows are first reduced to distinct days, so a window partition holds at most one row per day.
    """
    src = flow if where is None else flow.filter(where)
    days = (
        src.filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))
        .select("acct", F.col(value).alias("value"), "dt")
        .distinct()
    )
    past = Window.partitionBy("acct", "value").orderBy(F.unix_date("dt")).rangeBetween(-hi, -lo)
    return days.withColumn("seen", F.count(F.lit(1)).over(past)).filter("seen = 0").drop("seen")


def novel_values_anti(
    flow: DataFrame, value: str, lo: int = 7, hi: int = 180, where: Column | None = None
) -> DataFrame:
    """The same as an anti band join; kept as the cross-check of the window form."""
    src = flow if where is None else flow.filter(where)
    days = (
        src.filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))
        .select("acct", F.col(value).alias("value"), "dt")
        .distinct()
    )
    gap = F.datediff(F.col("n.dt"), F.col("o.dt"))
    same = (F.col("n.acct") == F.col("o.acct")) & (F.col("n.value") == F.col("o.value"))
    return days.alias("n").join(days.alias("o"), same & gap.between(lo, hi), "left_anti")


def attach_flags(flow: DataFrame, tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """0/1 flag per novelty table: {flag name: (novelty table, flow column it was built on)}."""
    out = flow
    for name, (table, value) in tables.items():
        side = table.select("acct", F.col("value").alias(value), "dt", F.lit(1).alias(name))
        out = out.join(side, ["acct", value, "dt"], "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) for name in tables}).select(*flow.columns, *tables)


def value_history(
    anchors: DataFrame, flow: DataFrame, col: str, window: str, where: Column | None = None, nulls: bool = True
) -> DataFrame:
    """How often the anchor's own value occurs in its window, and whether it is unseen.

    NULL matches NULL when ``nulls``. The value becomes part of the account key, so the count is an
    ordinary look-back over (account, value).
    """
    shape = F.struct("acct", F.coalesce(F.col(col).cast("string"), F.lit("\0")).alias("v"))
    src = flow if where is None else flow.filter(where)
    name = f"cur_{col}"
    got = look_back(
        anchors.select("txn_id", "t", shape.alias("acct")),
        src.select("t", shape.alias("acct")),
        [Measure(name, "count", [window])],
    )
    full = f"{name}_{window}"
    return got.select("txn_id", F.col(full), (F.col(full) == 0).cast("double").alias(f"{full}_unseen"))


def new_member_ratio(
    anchors: DataFrame,
    flow: DataFrame,
    col: str,
    recent: str,
    full: str,
    where: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Share of the members of the recent window that the older part of the full window lacks.

    members(recent) and members(full) are distinct counts; members(older) is the distinct count of the
    band between. New ones are ``full - older``, since full is the union of both.
    """
    src = flow if where is None else flow.filter(where)
    a = key_profile(anchors, src, [col], recent, {"m_recent": distinct}, hot_rows=hot_rows)
    b = key_profile(anchors, src, [col], full, {"m_full": distinct}, hot_rows=hot_rows)
    c = key_profile_band(anchors, src, [col], recent, full, {"m_older": distinct}, hot_rows=hot_rows)
    ratio = F.when(
        F.col("m_recent") > 0, (F.col("m_full") - F.col("m_older")).cast("double") / F.col("m_recent")
    )
    return a.join(b, "txn_id").join(c, "txn_id").withColumn("new_ratio", ratio)


def report_label(flow: DataFrame, reports: DataFrame) -> DataFrame:
    """0 no report, 1 on or before the report day, 2 after; and the rank of the distance to it.

    ``reports`` has one row per account. Ranks run over distinct (account, day), not over rows.
    """
    joined = flow.join(reports.select("acct", "report_dt"), "acct", "left")
    ahead = F.datediff("report_dt", "dt")
    label = F.when(F.col("report_dt").isNull(), 0).when(ahead >= 0, 1).otherwise(2)
    days = joined.select("acct", "dt", ahead.alias("ahead")).filter("ahead is not null").distinct()
    order = Window.partitionBy("acct").orderBy(F.when(F.col("ahead") >= 0, F.col("ahead")).asc_nulls_last())
    ranks = days.withColumn("rank", F.dense_rank().over(order)).select(
        "acct", "dt", F.when(F.col("ahead") < 0, F.col("ahead")).otherwise(F.col("rank")).alias("report_rank")
    )
    return joined.withColumns({"report_label": label, "report_days": ahead}).join(ranks, ["acct", "dt"], "left")
