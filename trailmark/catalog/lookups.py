"""Point-in-time joins, lookups, anti and semi joins, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.catalog.base import ANCHORS, FLOW, ORDERS, SNAPS, days_hist, events, hist, query, sql
from trailmark.operators import joins as J
from trailmark.operators import ranking as R
from trailmark.plans.lookback import Measure, look_back, look_back_days
from trailmark.schema import DAY_WINDOWS, WINDOWS, account_days, event_flow, order_flow, read


@query("pit_join", "txn_id:i h_txn_id:i age:d",
       sql(FLOW, ANCHORS, hist("3d"), "select txn_id, h_id as h_txn_id, age from hist"))
def _(spark, d):
    flow, anchors = events(spark, d)
    return J.pit_join(anchors.select("txn_id", "acct", "t"), flow, WINDOWS["3d"], history=["txn_id", "t"])


@query("pit_join_band", "txn_id:i h_txn_id:i",
       sql(FLOW, ANCHORS, hist("14d"), "select txn_id, h_id as h_txn_id from hist where age > 259200"))
def _(spark, d):
    flow, anchors = events(spark, d)
    return J.pit_join(anchors.select("txn_id", "acct", "t"), flow, WINDOWS["14d"], WINDOWS["3d"], "inner", ["txn_id", "t"])


@query("pit_join_days", "acct:i snap_dt:D h_txn_id:i",
       sql(ORDERS, SNAPS, days_hist(*DAY_WINDOWS["150d_t2"]), "select acct, snap_dt, txn_id as h_txn_id from hist"))
def _(spark, d):
    flow = order_flow(spark, d)
    return J.pit_join_days(account_days(flow), flow, *DAY_WINDOWS["150d_t2"], day="snap_dt", history=["txn_id", "t", "dt"])


@query("pit_join_gap", "acct:i snap_dt:D h_txn_id:i",
       sql(ORDERS, SNAPS, days_hist(*DAY_WINDOWS["gap"]), "select acct, snap_dt, txn_id as h_txn_id from hist where txn_id is not null"))
def _(spark, d):
    flow = order_flow(spark, d)
    return J.pit_join_days(account_days(flow), flow, *DAY_WINDOWS["gap"], day="snap_dt", how="inner", history=["txn_id", "dt"])


@query("pit_inner_then_left", "txn_id:i n:i total:d",
       sql(FLOW, ANCHORS, hist("1d"),
           "agg as (select txn_id, count(*) as n, sum(amt) as total from hist where dir = 0 and h_id is not null group by 1)",
           "select a.txn_id, n, total from anchors a left join agg using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    out = F.col("dir") == 0
    w = ["1d"]
    got = look_back(anchors, flow, [Measure("n", "count", w, out), Measure("total", "sum", w, out, F.col("amt"))])
    found = got.filter("n_1d > 0").select("txn_id", F.col("n_1d").alias("n"), F.col("total_1d").alias("total"))
    return J.assemble(anchors.select("txn_id"), [found])


@query("null_safe_match", "txn_id:i same:i",
       sql(FLOW, ANCHORS, hist("14d"),
           "select txn_id, count(*) filter (where h_id is not null and party is not distinct from party0) as same from hist group by 1"))
def _(spark, d):
    from trailmark.operators.novelty import value_history

    flow, anchors = events(spark, d)
    return value_history(anchors, flow, "party", "14d").withColumnRenamed("cur_party_14d", "same")


@query("assemble_blocks", "txn_id:i amt:d out_cnt:i in_amt:d max_amt:d",
       sql(FLOW, ANCHORS, hist("7d"),
           """select txn_id, any_value(amt0) as amt, count(*) filter (where dir = 0) as out_cnt,
  coalesce(sum(amt) filter (where dir = 1), 0) as in_amt, max(amt) as max_amt from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    w = ["7d"]

    def outflow(spark, anchors, flow):
        return look_back(anchors, flow, [Measure("out_cnt", "count", w, F.col("dir") == 0)]).withColumnRenamed("out_cnt_7d", "out_cnt")

    def inflow(spark, anchors, flow):
        ms = [Measure("in_amt", "sum", w, F.col("dir") == 1, F.col("amt")), Measure("max_amt", "max", w, None, F.col("amt"))]
        return look_back(anchors, flow, ms).withColumnsRenamed({"in_amt_7d": "in_amt", "max_amt_7d": "max_amt"})

    R.register_block("outflow_7d", outflow)
    R.register_block("inflow_7d", inflow)
    blocks = R.run_blocks(spark, anchors, flow, ["outflow_7d", "inflow_7d"])
    return J.assemble(anchors.select("txn_id", "amt"), list(blocks.values()))


@query("assemble_mixed_grain", "txn_id:i prior:i active:i last15:i",
       sql(ORDERS, """h as (select a.txn_id, a.acct, a.dt as d0, f.txn_id as h, f.dt, date_diff('day', f.dt, a.dt) as off
  from flow a left join flow f on a.acct = f.acct and date_diff('day', f.dt, a.dt) between 0 and 177)""",
           """select txn_id, count(*) filter (where off between 14 and 177) as prior, count(distinct dt) as active,
  count(h) filter (where off between 0 and 14) as last15 from h group by 1"""))
def _(spark, d):
    flow = order_flow(spark, d)
    days = flow.select("acct", "dt").distinct()
    bands = {"gap": DAY_WINDOWS["gap"], "all": DAY_WINDOWS["180d"], "near": DAY_WINDOWS["15d"]}
    txn = look_back_days(flow, flow, [Measure("prior", "count", ["gap"])], bands).select("txn_id", F.col("prior_gap").alias("prior"))
    day = look_back_days(days, flow, [Measure("active", "days", ["all"]), Measure("last", "count", ["near"])], bands, keys=("acct", "dt"))
    day = day.select("acct", "dt", F.col("active_all").alias("active"), F.col("last_near").alias("last15"))
    return J.assemble_mixed(flow.select("txn_id", "acct", "dt"), [txn], [day])


PREFIX_ROWS = [("Brand#", 7, "one"), ("Brand#", 8, "two"), ("Brand#1", 8, "teens"), ("Brand#2", 7, "second"), ("Brand#13", 8, "exact")]
PREFIX_SQL = "dim(prefix, length, bank) as (values " + ", ".join(map(str, PREFIX_ROWS)) + ")"


@query("longest_prefix", "p_partkey:i p_brand:s prefix:s bank:s",
       sql(PREFIX_SQL, """m as (select p_partkey, p_brand, prefix, bank, row_number() over (partition by p_partkey order by length(prefix) desc) as rn
  from part left join dim on substr(p_brand, 1, length(prefix)) = prefix and length(p_brand) = dim.length)""",
           "select p_partkey, p_brand, prefix, bank from m where rn = 1"))
def _(spark, d):
    dim = spark.createDataFrame(PREFIX_ROWS, "prefix string, length int, bank string")
    return J.longest_prefix(read(spark, d, "part"), dim, "p_brand", sizes=[6, 7, 8])


PLACE_ROWS = [(9, "00000", "north", "a"), (9, "00001", "south", "b"), (12, "012", "east", "c"), (12, "012", "east", "d"), (9, "00003", "west", "e")]
PLACE_SQL = 'dim("start", code, province, city) as (values ' + ", ".join(map(str, PLACE_ROWS)) + ")"


@query("positional_lookup", "c_custkey:i province:s city:s",
       sql(PLACE_SQL, """m as (select c_custkey, province, city, row_number() over (partition by c_custkey order by province, city) as rn
  from customer left join dim on substr(c_name, "start" + 1, length(code)) = code)""",
           "select c_custkey, province, city from m where rn = 1"))
def _(spark, d):
    dim = spark.createDataFrame(PLACE_ROWS, "start int, code string, province string, city string")
    return J.positional_lookup(read(spark, d, "customer"), dim, "c_name", [(9, 5), (12, 3)], ["province", "city"])


@query("anti_join", "txn_id:i acct:i",
       sql(ORDERS, "select txn_id, acct from flow where acct not in (select c_custkey from customer where c_mktsegment = 'HOUSEHOLD')"))
def _(spark, d):
    exempt = read(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("acct"))
    return J.anti(order_flow(spark, d), exempt, "acct")


@query("semi_join", "txn_id:i acct:i",
       sql(FLOW, "select txn_id, acct from flow where acct in (select acct from flow where chan = 'error' and amt > 200)"))
def _(spark, d):
    flow = event_flow(spark, d)
    return J.semi(flow, flow.filter("chan = 'error' and amt > 200").select("acct").distinct(), "acct")


@query("dimension_join", "o_orderkey:i segment:s nation:s region:s",
       """select o_orderkey, c_mktsegment as segment, n_name as nation, r_name as region from orders
  left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nk"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("rk"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"))
    return J.join_dim(J.join_dim(J.join_dim(read(spark, d, "orders"), c, "o_custkey"), n, "nk"), r, "rk")


@query("journal_join", "l_orderkey:i l_linenumber:i price:m listed:i n:i",
       """select l_orderkey, l_linenumber, o_totalprice as price, case when s_suppkey is not null then 1 end as listed, count(*) as n
  from lineitem left join (select * from orders where o_orderpriority in ('1-URGENT', '2-HIGH')) on l_orderkey = o_orderkey
    and cast(l_shipdate as date) >= date '1990-01-01'
  left join (select distinct s_suppkey from supplier where s_acctbal > 0) on l_suppkey = s_suppkey group by 1, 2, 3, 4""")
def _(spark, d):
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    journal = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    org = read(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    out = J.join_journal(line, journal, {"l_orderkey": "o_orderkey"}, "o_orderpriority", ["1-URGENT", "2-HIGH"], org)
    return out.groupBy("l_orderkey", "l_linenumber", F.col("o_totalprice").alias("price"), "listed").agg(F.count(F.lit(1)).alias("n"))


@query("last_n_before", "anchor_id:i recency:i txn_id:i amt:d",
       sql(FLOW, ANCHORS, """r as (select a.txn_id as anchor_id, f.txn_id, f.amt,
  row_number() over (partition by a.txn_id order by f.t desc, f.txn_id desc) as recency
  from anchors a join flow f on a.acct = f.acct and f.t <= a.t)""",
           "select anchor_id, recency, txn_id, amt from r where recency <= 50"))
def _(spark, d):
    flow, anchors = events(spark, d)
    return R.last_n_before(anchors, flow, 50)
