"""Order-dependent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.catalog.base import ANCHORS, BALANCE, FLOW, ORDERS, SNAPS, days_hist, events, hist, inflow, outflow, query, sql
from trailmark.functions import scalars as S
from trailmark.operators import sequences as Q
from trailmark.operators.joins import lookup_self
from trailmark.operators.ranking import recency
from trailmark.plans.lookback import Measure, look_back
from trailmark.schema import account_days, event_flow, order_flow


GAPS = """g as (select *, (t - lag(t) over (partition by txn_id order by t, h_id)) / 1e6 as gap from hist where {cond})"""


@query("gap_stats", "txn_id:i gap_n:i rapid_cnt:i gap_avg:m gap_std:m gap_cv:d",
       sql(FLOW, ANCHORS, hist("14d"), GAPS.format(cond="dir = 0"), """s as (select txn_id, count(*) filter (where gap > 0) as n, count(*) filter (where gap <= 120) as r,
  avg(gap) filter (where gap > 0) as m, stddev_samp(gap) filter (where gap > 0) as sd from g group by 1)""",
           """select a.txn_id, coalesce(n, 0) as gap_n, coalesce(r, 0) as rapid_cnt, m as gap_avg, sd as gap_std, sd / m as gap_cv
  from anchors a left join s using (txn_id)"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    return Q.gap_stats(anchors, flow, "14d", outflow())


@query("gap_extremes", "txn_id:i gap_min:d gap_max:d gap_median:d",
       sql(FLOW, ANCHORS, hist("14d"), GAPS.format(cond="dir = 0"),
           "s as (select txn_id, min(gap) filter (where gap > 0) as lo, max(gap) filter (where gap > 0) as hi, quantile_disc(gap, 0.5) filter (where gap > 0) as md from g group by 1)",
           "select a.txn_id, lo as gap_min, hi as gap_max, md as gap_median from anchors a left join s using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    return Q.gap_range(anchors, flow, "14d", outflow()).join(Q.gap_median(anchors, flow, "14d", outflow()), "txn_id")


@query("rapid_burst", "txn_id:i rapid:i share:d",
       sql(FLOW, ANCHORS, hist("30d"), GAPS.format(cond="chan in ('click', 'view', 'error')").replace("1e6", "1e6 / 300"),
           "s as (select txn_id, count(*) filter (where gap <= 120) as r, count(*) as n from g group by 1)",
           "select a.txn_id, coalesce(r, 0) as rapid, r / nullif(n, 0)::double as share from anchors a left join s using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    tag = F.col("chan").isin("click", "view", "error")
    got = Q.gap_stats(anchors, flow, "30d", tag, rapid_sec=36_000)
    n = look_back(anchors, flow, [Measure("n", "count", ["30d"], tag)])
    return got.join(n, "txn_id").select("txn_id", F.col("rapid_cnt").alias("rapid"), S.safe_ratio("rapid_cnt", "n_30d").alias("share"))


@query("lag_lead", "txn_id:i prev_id:i prev_amt:d prev_chan:s next_chan:s gap:d",
       sql(FLOW, """select txn_id, lag(txn_id) over w as prev_id, lag(amt) over w as prev_amt, lag(chan) over w as prev_chan, lead(chan) over w as next_chan,
  (t - lag(t) over w) / 1e6 as gap from flow window w as (partition by acct order by t, txn_id)"""))
def _(spark, d):
    got = Q.with_neighbours(event_flow(spark, d), {"prev_id": "txn_id", "prev_amt": "amt", "prev_chan": "chan", "prev_t": "t"}, {"next_chan": "chan"})
    return got.withColumn("gap", (F.col("t") - F.col("prev_t")) / 1e6)


@query("rolling_min_balance", "txn_id:i lo_2h:d lo_7d:d",
       sql(FLOW, BALANCE, """select txn_id, min(case when dir = 1 then bal - amt end) over (partition by acct order by t range between 7200000000 preceding and current row) as lo_2h,
  min(case when dir = 1 then bal - amt end) over (partition by acct order by t range between 604800000000 preceding and current row) as lo_7d from bal"""))
def _(spark, d):
    flow = Q.running_balance(event_flow(spark, d))
    return Q.rolling_min(flow, F.col("bal") - F.col("amt"), ["2h", "7d"], "lo", inflow())


@query("rolling_counts", "txn_id:i strangers_2h:i strangers_1d:i bank_1d:i",
       sql(FLOW, """select txn_id, count(*) filter (where dir = 1 and novel = 1) over (partition by acct order by t range between 7200000000 preceding and 1 preceding) as strangers_2h,
  count(*) filter (where dir = 1 and novel = 1) over (partition by acct order by t range between 86400000000 preceding and 1 preceding) as strangers_1d,
  count(*) filter (where dir = 1 and substr(party, 1, 1) = '6') over (partition by acct order by t range between 86400000000 preceding and 1 preceding) as bank_1d from flow"""))
def _(spark, d):
    flow = event_flow(spark, d)
    got = Q.rolling_count(flow, {"strangers": inflow() & (F.col("novel") == 1)}, ["2h", "1d"])
    return got.join(Q.rolling_count(flow, {"bank": inflow() & F.col("party").startswith("6")}, ["1d"]), "txn_id")


@query("last_inflow_lookup", "txn_id:i in_id:i in_amt:d in_chan:s",
       sql(FLOW, """l as (select *, last_value(case when dir = 1 and chan <> 'error' then txn_id end ignore nulls) over (
  partition by acct order by t, txn_id rows unbounded preceding) as in_id from flow)""",
           "select l.txn_id, l.in_id, r.amt as in_amt, r.chan as in_chan from l left join flow r on l.in_id = r.txn_id"))
def _(spark, d):
    flow = Q.last_qualifying(event_flow(spark, d), inflow() & (F.col("chan") != "error"), "in_id")
    return lookup_self(flow, "in_id", ["amt", "chan"], "in_")


@query("out_follow_in_rank", "txn_id:i follow_rank:i",
       sql(FLOW, """l as (select *, last_value(case when dir = 1 and novel = 1 then txn_id end ignore nulls) over w as in_id,
  last_value(case when dir = 1 and novel = 1 then t end ignore nulls) over w as in_t from flow window w as (partition by acct order by t, txn_id rows unbounded preceding))""",
           """r as (select txn_id, row_number() over (partition by in_id order by t, txn_id) as rn from l where in_id is not null and dir = 0 and t - in_t between 0 and 86399000000)""",
           "select l.txn_id, rn as follow_rank from l left join r using (txn_id)"))
def _(spark, d):
    return Q.out_follow_in_rank(event_flow(spark, d), inflow() & (F.col("novel") == 1), outflow())


@query("day_open_close", "acct:i dt:D bal_open:d bal_close:d first_id:i last_id:i",
       sql(FLOW, BALANCE, """r as (select *, row_number() over (partition by acct, dt order by t, txn_id) as a, row_number() over (partition by acct, dt order by t desc, txn_id desc) as z from bal)""",
           """select acct, dt, max(bal) filter (where a = 1) as bal_open, max(bal) filter (where z = 1) as bal_close,
  max(txn_id) filter (where a = 1) as first_id, max(txn_id) filter (where z = 1) as last_id from r group by 1, 2"""))
def _(spark, d):
    return Q.day_open_close(Q.running_balance(event_flow(spark, d)))


@query("low_gap_average", "acct:i snap_dt:D low_gap_avg:m",
       sql(ORDERS, SNAPS, days_hist(0, 719), """g as (select *, t - lag(t) over (partition by acct, snap_dt order by t, txn_id) as gap, count(*) over (partition by acct, snap_dt) as total from hist)""",
           "r as (select *, dense_rank() over (partition by acct, snap_dt order by gap nulls last) as dk from g)",
           "select acct, snap_dt, avg(case when dk / total::double < 0.6 and dk / total::double > 0.2 then gap end) / 1e6 as low_gap_avg from r group by 1, 2"))
def _(spark, d):
    flow = order_flow(spark, d)
    return Q.low_gap_average(account_days(flow), flow, 720, 0.2, 0.6)


DAILY = """daily as (select acct, dt, arg_max(bal, (t, txn_id)) as c from bal group by 1, 2)"""
TREND = """trend as (select acct, dt, c, avg(c) over (w rows 13 preceding) as ma14, avg(c) over (w rows 11 preceding) - avg(c) over (w rows 25 preceding) as macd
  from daily window w as (partition by acct order by dt))"""


@query("balance_trend", "acct:i dt:D bal_close:d ma14:d macd:d high_close:i",
       sql(FLOW, BALANCE, DAILY, TREND.replace("over (w rows", "over (partition by acct order by dt rows").replace("\n  from daily window w as (partition by acct order by dt)", " from daily"),
           "select acct, dt, c as bal_close, ma14, macd, case when c > 1.05 * ma14 then 1 else 0 end as high_close from trend"))
def _(spark, d):
    return Q.balance_trend(Q.day_open_close(Q.running_balance(event_flow(spark, d))))


@query("trend_rollup", "acct:i snap_dt:D neg_ratio:d high_cnt:i high_ratio:d",
       sql(FLOW, SNAPS, BALANCE, DAILY, TREND.replace("over (w rows", "over (partition by acct order by dt rows").replace("\n  from daily window w as (partition by acct order by dt)", " from daily"),
           """j as (select s.acct, s.snap_dt, case when macd < 0 then 1 else 0 end as neg, case when c > 1.05 * ma14 then 1 else 0 end as high
  from snaps s left join trend t on s.acct = t.acct and date_diff('day', t.dt, s.snap_dt) between 0 and 89)""",
           "select acct, snap_dt, avg(neg) as neg_ratio, sum(high) as high_cnt, avg(high) as high_ratio from j group by 1, 2"))
def _(spark, d):
    flow = event_flow(spark, d)
    trend = Q.balance_trend(Q.day_open_close(Q.running_balance(flow)))
    return Q.trend_rollup(account_days(flow), trend)


RUNS = """c as (select *, case when dir = lag(dir) over (partition by acct, snap_dt order by t, txn_id) then 0 else 1 end as ch from hist where txn_id is not null),
g as (select *, sum(ch) over (partition by acct, snap_dt order by t, txn_id) as gid from c),
runs as (select acct, snap_dt, dir, gid, sum(amt) as run_amt, count(*) as run_cnt, max(t) as end_t from g group by 1, 2, 3, 4)"""


@query("direction_runs", "acct:i snap_dt:D dir:i run_amt:m run_cnt:i end_t:i",
       sql(ORDERS, SNAPS, days_hist(0, 179), RUNS, "select acct, snap_dt, dir, run_amt, run_cnt, end_t from runs"))
def _(spark, d):
    flow = order_flow(spark, d)
    return Q.direction_runs(account_days(flow), flow, 0, 179)


PAIRS = """p as (select *, sum(dir) over w as g1, sum(1 - dir) over w as g2 from runs window w as (partition by acct, snap_dt order by end_t, gid)),
q as (select *, max(run_amt) over (partition by acct, snap_dt, g1) as a1, max(run_amt) over (partition by acct, snap_dt, g2) as a2,
  max(run_cnt) over (partition by acct, snap_dt, g1) as c1, max(run_cnt) over (partition by acct, snap_dt, g2) as c2,
  run_amt / nullif(lag(run_amt) over (partition by acct, snap_dt, g1 order by end_t, gid), 0) as r1,
  run_amt / nullif(lag(run_amt) over (partition by acct, snap_dt, g2 order by end_t, gid), 0) as r2 from p),
z as (select acct, snap_dt, greatest(count(*) filter (where r1 between 0.8 and 1.2), count(*) filter (where r2 between 0.8 and 1.2)) as pair_cnt,
  greatest(coalesce(max(a1) filter (where r1 between 0.8 and 1.2), 0), coalesce(max(a2) filter (where r2 between 0.8 and 1.2), 0)) as pair_max_amt,
  greatest(coalesce(max(c1) filter (where r1 between 0.8 and 1.2), 0), coalesce(max(c2) filter (where r2 between 0.8 and 1.2), 0)) as pair_max_cnt,
  least(stddev_pop(r1), stddev_pop(r2)) as ratio_std, greatest(avg(r1), avg(r2)) as ratio_avg, greatest(max(r1), max(r2)) as ratio_max,
  least(min(r1), min(r2)) as ratio_min from q group by 1, 2)"""
PAIR_SPEC = "acct:i snap_dt:D pair_cnt:i pair_max_amt:m pair_max_cnt:i ratio_std:m ratio_avg:m ratio_max:m ratio_min:d"
PAIR_OUT = """select s.acct, s.snap_dt, coalesce(pair_cnt, 0) as pair_cnt, coalesce(pair_max_amt, 0) as pair_max_amt, coalesce(pair_max_cnt, 0) as pair_max_cnt,
  ratio_std, ratio_avg, ratio_max, ratio_min from snaps s left join z using (acct, snap_dt)"""


@query("equal_amount_runs", PAIR_SPEC, sql(ORDERS, SNAPS, days_hist(0, 179), RUNS, PAIRS, PAIR_OUT))
def _(spark, d):
    flow = order_flow(spark, d)
    return Q.equal_amount_runs(account_days(flow), flow, 0, 179)


@query("equal_amount_runs_short", PAIR_SPEC, sql(FLOW, SNAPS, days_hist(0, 14), RUNS, PAIRS, PAIR_OUT))
def _(spark, d):
    flow = event_flow(spark, d)
    return Q.equal_amount_runs(account_days(flow), flow, 0, 14)


@query("top_channel", "txn_id:i chan:s n:i",
       sql(FLOW, ANCHORS, hist("14d"), "k as (select txn_id, chan, count(*) as n from hist where h_id is not null group by 1, 2)",
           "r as (select *, row_number() over (partition by txn_id order by n desc, chan) as rn from k)",
           "select a.txn_id, r.chan, coalesce(r.n, 0) as n from anchors a left join r on a.txn_id = r.txn_id and rn = 1"))
def _(spark, d):
    from trailmark.operators.ranking import top_value

    flow, anchors = events(spark, d)
    return top_value(anchors, flow, "chan", "14d")


@query("with_total", "l_orderkey:i l_linenumber:i l_partkey:i total:i",
       "select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_partkey) as total from lineitem")
def _(spark, d):
    from trailmark.schema import read

    return Q.with_total(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"])


@query("follow_pattern", "txn_id:i n_14d:i",
       sql(FLOW, "m as (select *, lag(chan) over w as pc, lag(dir) over w as pd, lag(t) over w as pt from flow window w as (partition by acct order by t, txn_id))",
           """select a.txn_id, count(*) filter (where f.dir = 0 and f.chan = 'view' and f.pd = 1 and f.t - f.pt < 36000000000) as n_14d
  from flow a left join m f on a.acct = f.acct and a.t - f.t > 0 and a.t - f.t <= 1209600000000 where a.chan = 'purchase' group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    marked = Q.follow_pattern_flag(flow, inflow(), outflow() & (F.col("chan") == "view"), 36_000)
    return look_back(anchors, marked, [Measure("n", "count", ["14d"], F.col("follows") == 1)])


@query("recency", "txn_id:i since_out:d since_in:d since_view:d",
       sql(FLOW, ANCHORS, hist("14d"), """select txn_id, min(age) filter (where dir = 0) as since_out, min(age) filter (where dir = 1) as since_in,
  min(age) filter (where chan = 'view') as since_view from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    t = F.col("t")
    got = look_back(anchors, flow, [Measure("out", "max", ["14d"], outflow(), t), Measure("in", "max", ["14d"], inflow(), t), Measure("view", "max", ["14d"], F.col("chan") == "view", t)])
    last = got.withColumnsRenamed({"out_14d": "out", "in_14d": "in", "view_14d": "view"})
    return recency(anchors, last, ["out", "in", "view"])


@query("inflow_linkage", "txn_id:i in_amt:d delay:d ratio:d out_1d:d drained:d",
       sql(FLOW, """l as (select *, last_value(case when dir = 1 then amt end ignore nulls) over w as in_amt, last_value(case when dir = 1 then t end ignore nulls) over w as in_t
  from flow window w as (partition by acct order by t, txn_id rows unbounded preceding))""",
           """s as (select *, coalesce(sum(amt) filter (where dir = 0) over (partition by acct order by t range between 86400000000 preceding and 1 preceding), 0) as out_1d from l)""",
           "select txn_id, in_amt, (t - in_t) / 1e6 as delay, amt / in_amt as ratio, out_1d, round(out_1d, 2) / in_amt as drained from s where dir = 0"))
def _(spark, d):
    flow = event_flow(spark, d)
    carried = Q.carry_last(flow, ["acct"], list(Q.ORDER), {"in_amt": F.when(inflow(), F.col("amt")), "in_t": F.when(inflow(), F.col("t"))}, Q.hot_accounts(flow))
    outs = carried.filter(outflow())
    day = look_back(flow.filter(outflow()), flow, [Measure("out", "sum", ["1d"], outflow(), F.col("amt"))])
    return outs.join(day, "txn_id").select(
        "txn_id", "in_amt", ((F.col("t") - F.col("in_t")) / 1e6).alias("delay"), S.float_ratio("amt", "in_amt").alias("ratio"),
        F.col("out_1d"), S.float_ratio(S.rounded("out_1d", 2), "in_amt").alias("drained"))


@query("day_first_last", "acct:i dt:D hours:d amt_diff:d",
       sql(FLOW, """select acct, dt, (max(t) - min(t)) / 3.6e9 as hours, arg_max(amt, (t, txn_id)) - arg_min(amt, (t, txn_id)) as amt_diff from flow group by 1, 2"""))
def _(spark, d):
    flow = event_flow(spark, d)
    ends = Q.day_open_close(flow, "amt")
    times = flow.groupBy("acct", "dt").agg(((F.max("t") - F.min("t")) / 3.6e9).alias("hours"))
    return ends.join(times, ["acct", "dt"]).withColumn("amt_diff", F.col("amt_close") - F.col("amt_open"))
