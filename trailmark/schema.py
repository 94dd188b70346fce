"""Canonical frames that every operator takes, and the mapping from the source tables to them.

``flow``    txn_id, acct, t (micros since epoch), dt, hh, dir (1 in, 0 out), amt, chan, party (nullable)
``anchors`` one row per transaction to score: the same columns plus ``label`` and ``split``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.lineage import settle

SECOND = 1_000_000
DAY = 86_400 * SECOND

#: Trailing windows in seconds, by the label used in feature names.
WINDOWS = {
    "30min": 1_800,
    "2h": 7_200,
    "3h": 10_800,
    "1d": 86_400,
    "3d": 259_200,
    "7d": 604_800,
    "14d": 1_209_600,
    "15d": 1_296_000,
    "30d": 2_592_000,
    "90d": 7_776_000,
    "150d": 12_960_000,
}

#: Date-offset windows as inclusive (lo, hi) day offsets before the anchor day.
DAY_WINDOWS = {
    "15d": (0, 14),
    "180d": (0, 177),
    "360d": (0, 357),
    "gap": (14, 177),
    "150d_t2": (2, 152),
    "click_180d": (0, 179),
    "click_90d": (0, 89),
    "click_gap": (14, 179),
}


def micros(ts: str) -> Column:
    """Microseconds since the epoch of the wall-clock time in column ``ts``, whatever the session zone is."""
    return F.expr(
        f"unix_date(to_date({ts})) * 86400000000L + (hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L"
        f" + cast(date_part('SECOND', {ts}) * 1000000 as bigint)"
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-level flow derived from the ``events`` log."""
    party = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("acct"),
        micros("ts").alias("t"),
        F.to_date("ts").alias("dt"),
        F.hour("ts").alias("hh"),
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("dir"),
        F.col("value").alias("amt"),
        F.col("event_type").alias("chan"),
        F.nullif(party, F.lit("0")).alias("party"),
        F.when(F.col("event_id") % 4 == 0, 1).otherwise(0).alias("novel"),
    )


def statement_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as bank statement rows with texts: remark, summary, names, account, bank, region and city, and the page visited.

    The log has no such texts, so they are picked from short lists by the event's ids and its key ``k``. The log is stored
    with the key read out: a dozen texts ask for it, and every one of them would parse ``props`` again.
    """
    k, u, i = "cast(party as int)", "acct", "txn_id"
    return settle(event_flow(spark, sf_dir).drop("novel")).selectExpr(
        "* except (amt, party)", "round(amt * 100, 0) as amt",
        f"""get(array('跨行网银贷记', '支付宝转账', '转账', '往来款', '普通贷记来帐', '委托实时贷记', '数字人民币兑回', '微信提现', '商品购买', '商户消费',
            '基金申购', '借款发放', '贷款提前归还', '代付代付退款', '手续费', ''), cast(({i} * 7 + {u}) % 17 as int)) as remark""",
        f"get(array('转存', '现金', '取现', 'ATM取款', '冲销', '转贷记卡'), cast({i} % 9 as int)) as summary",
        f"case when {k} % 11 = 0 then '顺德贸易公司' else concat('户', {k} % 30) end as party",
        f"concat('户', {u} % 30) as own_name",
        f"""case {k} % 4 when 0 then concat('6222052', lpad(party, 9, '0')) when 1 then concat('6217', lpad(party, 15, '0'))
            when 2 then concat('2088', lpad(party, 12, '0')) else concat('8', lpad(party, 11, '0')) end as party_acct""",
        f"get(array('广东顺德农村商业银行', '北京分行', '中国银行佛山支行', '上海浦东支行', '深圳南山支行', null, '成都支行'), {k} % 7) as bank",
        f"get(array('广东', '北京', '广东', '上海', null, '四川', '广东'), {k} % 7) as region",
        f"get(array('佛山', '北京', '佛山', '上海', null, '成都', '深圳'), {k} % 7) as city",
        "case chan when 'click' then 'limit' when 'view' then 'assets' when 'error' then 'cert' when 'signup' then 'promo' end as page",
        f"20 + {u} % 60 as age", f"({u} * 37) % 2000 as open_days",
    )


def event_anchors(flow: DataFrame, chan: str = "purchase") -> DataFrame:
    """Transactions to score: one channel of the flow."""
    return flow.filter(F.col("chan") == chan).withColumn(
        "split", F.when(F.col("txn_id") % 5 == 0, "test").otherwise("train")
    )


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-level flow derived from ``orders``, with the smallest supplier as the counterparty."""
    party = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("txn_id"))
        .agg(F.min("l_suppkey").cast("string").alias("party"))
    )
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("acct"),
        micros("o_orderdate").alias("t"),
        F.to_date("o_orderdate").alias("dt"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("dir"),
        F.col("o_totalprice").alias("amt"),
        F.col("o_orderpriority").alias("chan"),
    )
    return orders.join(party, "txn_id", "left")


def account_days(flow: DataFrame, back: int = 2) -> DataFrame:
    """Account-day snapshots: distinct (account, day shifted ``back`` days into the past)."""
    return flow.select("acct", F.date_sub("dt", back).alias("snap_dt")).distinct()
