"""Novelty: first-seen values, value histories, new members, recency and report labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.catalog.base import ANCHORS, FLOW, ORDERS, events, hist, query, sql
from trailmark.functions import scalars as S
from trailmark.operators import novelty as N
from trailmark.plans.lookback import Measure, look_back
from trailmark.schema import DAY, event_flow, order_flow, read


def novelty_sql(value: str, lo: int, hi: int, base: str = "flow") -> str:
    return (
        f"days as (select distinct acct, {value} as v, dt from {base} where {value} is not null and trim(cast({value} as varchar)) <> '')",
        f"""select n.acct, cast(n.v as varchar) as v, n.dt from days n left join days o on n.acct = o.acct and n.v = o.v
  and date_diff('day', o.dt, n.dt) between {lo} and {hi} where o.acct is null""",
    )


@query("novel_party", "acct:i value:s dt:D", sql(ORDERS, "x as (select * from flow)", *[
    p.replace("select n.acct, cast(n.v as varchar) as v, n.dt", "select n.acct, n.v as value, n.dt") for p in novelty_sql("party", 7, 180, "x")]))
def _(spark, d):
    return N.novel_values(order_flow(spark, d), "party", 7, 180)


@query("novel_party_long", "acct:i value:s dt:D", sql(ORDERS, "x as (select * from flow)", *[
    p.replace("select n.acct, cast(n.v as varchar) as v, n.dt", "select n.acct, n.v as value, n.dt") for p in novelty_sql("party", 7, 1095, "x")]))
def _(spark, d):
    return N.novel_values_anti(order_flow(spark, d), "party", 7, 1095)


@query("novel_channel", "acct:i value:s dt:D", sql(ORDERS, *[
    p.replace("select n.acct, cast(n.v as varchar) as v, n.dt", "select n.acct, n.v as value, n.dt") for p in novelty_sql("chan", 7, 180)]))
def _(spark, d):
    return N.novel_values(order_flow(spark, d), "chan", 7, 180)


@query("novel_hour", "acct:i value:i dt:D", sql(FLOW, *[
    p.replace("select n.acct, cast(n.v as varchar) as v, n.dt", "select n.acct, n.v as value, n.dt") for p in novelty_sql("hh", 7, 180)]))
def _(spark, d):
    return N.novel_values(event_flow(spark, d), "hh", 7, 180)


BIN = "case when amt <= 25 then '01: <=25' when amt <= 100 then '02: (25,100]' when amt <= 250 then '03: (100,250]' else '04: >250' end"


@query("novel_amount_bin", "acct:i value:s dt:D", sql(FLOW, f"x as (select *, {BIN} as bin from flow)", *[
    p.replace("select n.acct, cast(n.v as varchar) as v, n.dt", "select n.acct, n.v as value, n.dt") for p in novelty_sql("bin", 7, 180, "x")]))
def _(spark, d):
    flow = event_flow(spark, d).withColumn("bin", S.bin_label("amt", [25, 100, 250]))
    return N.novel_values(flow, "bin", 7, 180)


@query("attach_flags", "txn_id:i new_party:i new_chan:i",
       sql(FLOW, "p as (select distinct acct, party as v, dt from flow where party is not null)", "c as (select distinct acct, chan as v, dt from flow)",
           "np as (select n.* from p n left join p o on n.acct = o.acct and n.v = o.v and date_diff('day', o.dt, n.dt) between 7 and 180 where o.acct is null)",
           "nc as (select n.* from c n left join c o on n.acct = o.acct and n.v = o.v and date_diff('day', o.dt, n.dt) between 7 and 180 where o.acct is null)",
           """select txn_id, case when np.acct is not null then 1 else 0 end as new_party, case when nc.acct is not null then 1 else 0 end as new_chan
  from flow f left join np on f.acct = np.acct and f.party = np.v and f.dt = np.dt left join nc on f.acct = nc.acct and f.chan = nc.v and f.dt = nc.dt"""))
def _(spark, d):
    flow = event_flow(spark, d)
    return N.attach_flags(flow, {"new_party": (N.novel_values(flow, "party"), "party"), "new_chan": (N.novel_values(flow, "chan"), "chan")})


@query("value_history", "txn_id:i party_14d:i party_new:d chan_14d:i chan_new:d",
       sql(FLOW, ANCHORS, hist("14d"), """g as (select txn_id, count(*) filter (where h_id is not null and dir = 0 and party is not distinct from party0) as p,
  count(*) filter (where dir = 0 and chan = chan0) as c from hist group by 1)""",
           "select txn_id, p as party_14d, case when p = 0 then 1.0 else 0.0 end as party_new, c as chan_14d, case when c = 0 then 1.0 else 0.0 end as chan_new from g"))
def _(spark, d):
    flow, anchors = events(spark, d)
    out = F.col("dir") == 0
    a = N.value_history(anchors, flow, "party", "14d", out)
    b = N.value_history(anchors, flow, "chan", "14d", out)
    return a.join(b, "txn_id").withColumnsRenamed({
        "cur_party_14d": "party_14d", "cur_party_14d_unseen": "party_new", "cur_chan_14d": "chan_14d", "cur_chan_14d_unseen": "chan_new"})


@query("new_member_ratio", "txn_id:i m_recent:i new_ratio:d",
       sql(FLOW, ANCHORS, hist("14d"), "a as (select distinct txn_id, party from hist where dir = 1 and party is not null and age <= 259200)",
           "b as (select distinct txn_id, party from hist where dir = 1 and party is not null and age > 259200)",
           "g as (select a.txn_id, count(*) as n, count(*) filter (where b.txn_id is null) as fresh from a left join b using (txn_id, party) group by 1)",
           "select x.txn_id, coalesce(n, 0) as m_recent, fresh / n::double as new_ratio from anchors x left join g using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    return N.new_member_ratio(anchors, flow, "party", "3d", "14d", F.col("dir") == 1)


@query("tagged_recency", "txn_id:i first_gap:d last_gap:d recent_share:d",
       sql(FLOW, ANCHORS, hist("14d"), """select txn_id, (any_value(t0) - min(t) filter (where chan = 'error')) / 86400000000.0 as first_gap,
  (any_value(t0) - max(t) filter (where chan = 'error')) / 86400000000.0 as last_gap,
  (count(*) filter (where chan = 'error' and age <= 259200)) / nullif(count(*) filter (where chan = 'error'), 0)::double as recent_share from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    tag = F.col("chan") == "error"
    got = look_back(anchors, flow, [Measure("first", "min", ["14d"], tag, F.col("t")), Measure("last", "max", ["14d"], tag, F.col("t")),
                                    Measure("n", "count", ["3d", "14d"], tag)]).join(anchors.select("txn_id", "t"), "txn_id")
    day = F.lit(float(DAY))
    return got.select("txn_id", ((F.col("t") - F.col("first_14d")) / day).alias("first_gap"), ((F.col("t") - F.col("last_14d")) / day).alias("last_gap"),
                      S.safe_ratio("n_3d", "n_14d").alias("recent_share"))


@query("report_label", "txn_id:i report_label:i report_days:i report_rank:i",
       sql(FLOW, "rep as (select acct, min(dt) as rd from flow where chan = 'error' and amt > 300 group by 1)",
           """j as (select f.txn_id, f.acct, date_diff('day', dt, rd) as ahead, case when rd is null then 0 when dt <= rd then 1 else 2 end as label
  from flow f left join rep using (acct))""",
           """select txn_id, label as report_label, ahead as report_days, case when ahead is null then null when ahead < 0 then ahead
  else dense_rank() over (partition by acct order by case when ahead >= 0 then ahead end nulls last) end as report_rank from j"""))
def _(spark, d):
    flow = event_flow(spark, d)
    reports = flow.filter("chan = 'error' and amt > 300").groupBy("acct").agg(F.min("dt").alias("report_dt"))
    return N.report_label(flow, reports)


@query("novelty_by_segment", "segment:s rows:i",
       sql(ORDERS, "days as (select distinct acct, party as v, dt from flow where party is not null)",
           """nv as (select n.* from days n left join days o on n.acct = o.acct and n.v = o.v and date_diff('day', o.dt, n.dt) between 7 and 180 where o.acct is null)""",
           "select c_mktsegment as segment, count(*) as rows from nv join customer on acct = c_custkey group by 1"))
def _(spark, d):
    nv = N.novel_values(order_flow(spark, d), "party")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("acct"), F.col("c_mktsegment").alias("segment"))
    return nv.join(c, "acct").groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))
