"""Aggregates over trailing windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.catalog.base import ANCHORS, BALANCE, FLOW, ORDERS, SNAPS, amount, days_hist, events, hist, inflow, outflow, query, sql
from trailmark.functions import scalars as S
from trailmark.operators.cube import feature_cube
from trailmark.operators.sequences import follow_pattern_flag, running_balance
from trailmark.plans.dyadic import window_tops
from trailmark.plans.lookback import Measure, look_back, look_back_days
from trailmark.plans.profile import at_least, distinct, key_profile, key_profile_days, rows, squares, when
from trailmark.plans.quantiles import window_quantile, window_rank
from trailmark.schema import DAY_WINDOWS, WINDOWS, account_days, event_flow, order_flow

H14 = (FLOW, ANCHORS, hist("14d"))


@query("count_if", "txn_id:i out_1d:i out_14d:i in_2h:i view_7d:i",
       sql(*H14, """select txn_id, count(*) filter (where dir = 0 and age <= 86400) as out_1d, count(*) filter (where dir = 0) as out_14d,
  count(*) filter (where dir = 1 and age <= 7200) as in_2h, count(*) filter (where chan = 'view' and age <= 604800) as view_7d
  from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    return look_back(anchors, flow, [
        Measure("out", "count", ["1d", "14d"], outflow()), Measure("in", "count", ["2h"], inflow()),
        Measure("view", "count", ["7d"], F.col("chan") == "view")])


@query("sum_avg_min_max_if", "txn_id:i s:d a:d lo:d hi:d s30:d",
       sql(*H14, """select txn_id, coalesce(sum(amt) filter (where dir = 0), 0) as s, avg(amt) filter (where dir = 1 and age <= 259200) as a,
  min(amt) filter (where dir = 1) as lo, max(amt) filter (where dir = 0 and age <= 604800) as hi,
  coalesce(sum(amt) filter (where age <= 1800), 0) as s30 from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, [
        Measure("s", "sum", ["14d"], outflow(), amount()), Measure("si", "sum", ["3d"], inflow(), amount()), Measure("ni", "count", ["3d"], inflow()),
        Measure("lo", "min", ["14d"], inflow(), amount()), Measure("hi", "max", ["7d"], outflow(), amount()), Measure("sa", "sum", ["30min"], None, amount())])
    return got.select("txn_id", F.col("s_14d").alias("s"), S.positive_ratio("si_3d", "ni_3d").alias("a"), F.col("lo_14d").alias("lo"),
                      F.col("hi_7d").alias("hi"), F.col("sa_30min").alias("s30"))


def moments(name, where, windows):
    return [Measure(f"{name}_n", "count", windows, where), Measure(f"{name}_s", "sum", windows, where, amount()),
            Measure(f"{name}_ss", "sum", windows, where, amount() * amount())]


@query("sample_std_cv", "txn_id:i std:d cv:d",
       sql(*H14, """select txn_id, stddev_samp(amt) filter (where dir = 0) as std,
  case when avg(amt) filter (where dir = 0) > 0 then stddev_samp(amt) filter (where dir = 0) / avg(amt) filter (where dir = 0) end as cv
  from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, moments("o", outflow(), ["14d"]))
    n, s, ss = (F.col(f"o_{x}_14d") for x in ("n", "s", "ss"))
    std = S.sample_std(n, s, ss)
    return got.select("txn_id", std.alias("std"), S.cv(S.positive_ratio(s, n), std).alias("cv"))


@query("population_std_cv", "txn_id:i std:d cv:d",
       sql(*H14, """select txn_id, stddev_pop(amt) filter (where dir = 1) as std,
  case when count(*) filter (where dir = 1) > 1 then stddev_pop(amt) filter (where dir = 1) / avg(amt) filter (where dir = 1) end as cv
  from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, moments("i", inflow(), ["14d"]))
    n, s, ss = (F.col(f"i_{x}_14d") for x in ("n", "s", "ss"))
    std = S.population_std(n, s, ss)
    return got.select("txn_id", std.alias("std"), F.when(n > 1, S.safe_ratio(std, S.safe_ratio(s, n))).alias("cv"))


@query("skewness", "txn_id:i skew:m",
       sql(FLOW, ANCHORS, hist("30d"), """m as (select txn_id, count(amt) filter (where dir = 0) as n, avg(amt) filter (where dir = 0) as m1,
  avg(amt ** 2) filter (where dir = 0) as m2, avg(amt ** 3) filter (where dir = 0) as m3, stddev_samp(amt) filter (where dir = 0) as sd
  from hist group by 1)""",
           "select txn_id, case when sd > 0 and n >= 5 then (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / sd ** 3 end as skew from m"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, [*moments("o", outflow(), ["30d"]), Measure("o_sss", "sum", ["30d"], outflow(), amount() * amount() * amount())])
    n, s, ss, sss = (F.col(f"o_{x}_30d") for x in ("n", "s", "ss", "sss"))
    return got.select("txn_id", S.mixed_skewness(n, s, ss, sss).alias("skew"))


@query("percentiles", "txn_id:i p50:d p95:d",
       sql(*H14, "select txn_id, quantile_disc(amt, 0.5) filter (where dir = 0) as p50, quantile_disc(amt, 0.95) filter (where dir = 0) as p95 from hist group by 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = window_quantile(anchors, flow, "14d", [0.5, 0.95], outflow())
    return got.withColumnsRenamed({"q0": "p50", "q1": "p95"})


@query("distinct_if", "txn_id:i parties:i out_chans:i days:i in_parties_3d:i",
       sql(*H14, """select txn_id, count(distinct party) as parties, count(distinct chan) filter (where dir = 0) as out_chans,
  count(distinct dt) as days, count(distinct party) filter (where dir = 1 and age <= 259200) as in_parties_3d from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    a = key_profile(anchors, flow, ["party"], "14d", {"parties": distinct})
    b = key_profile(anchors, flow, ["chan"], "14d", {"out_chans": distinct}, where=outflow())
    c = key_profile(anchors, flow, ["party"], "3d", {"in_parties_3d": distinct}, where=inflow())
    e = look_back(anchors, flow, [Measure("days", "days", ["14d"])]).withColumnRenamed("days_14d", "days")
    return a.join(b, "txn_id").join(c, "txn_id").join(e, "txn_id")


@query("tag_share", "txn_id:i cnt_share:d amt_share:d",
       sql(*H14, """select txn_id, (count(*) filter (where dir = 0 and chan = 'error')) / nullif(count(*) filter (where dir = 0), 0)::double as cnt_share,
  coalesce(round(sum(amt) filter (where dir = 0 and chan = 'error'), 2), 0) / nullif(round(sum(amt) filter (where dir = 0), 2), 0) as amt_share from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    tag, w = F.col("chan") == "error", ["14d"]
    got = look_back(anchors, flow, [
        Measure("tn", "count", w, outflow() & tag), Measure("n", "count", w, outflow()),
        Measure("ta", "sum", w, outflow() & tag, amount()), Measure("a", "sum", w, outflow(), amount())])
    return got.select("txn_id", S.safe_ratio("tn_14d", "n_14d").alias("cnt_share"), S.safe_ratio(F.round("ta_14d", 2), F.round("a_14d", 2)).alias("amt_share"))


@query("per_active_day", "txn_id:i out_per_day:d tagged_days:d",
       sql(*H14, """select txn_id, (count(*) filter (where dir = 0)) / nullif(count(distinct dt) filter (where dir = 0), 0)::double as out_per_day,
  (count(distinct dt) filter (where chan = 'signup')) / nullif(count(distinct dt), 0)::double as tagged_days from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    w = ["14d"]
    got = look_back(anchors, flow, [
        Measure("n", "count", w, outflow()), Measure("od", "days", w, outflow()), Measure("sd", "days", w, F.col("chan") == "signup"), Measure("d", "days", w)])
    return got.select("txn_id", S.safe_ratio("n_14d", "od_14d").alias("out_per_day"), S.safe_ratio("sd_14d", "d_14d").alias("tagged_days"))


@query("top_share", "txn_id:i top:i share:d",
       sql(*H14, "k as (select txn_id, party, count(h_id) as n from hist where dir = 0 group by 1, 2)",
           """g as (select txn_id, max(n) as top, sum(n) as total from k group by 1)""",
           "select a.txn_id, coalesce(top, 0) as top, top / nullif(total, 0)::double as share from anchors a left join g using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = key_profile(anchors, flow, ["party"], "14d", {"total": rows}, where=outflow(), peak="top", nulls=True)
    return got.withColumn("share", S.safe_ratio("top", "total"))


@query("top_amount_share", "txn_id:i share:d sources:i",
       sql(*H14, "k as (select txn_id, party, sum(amt) as s from hist where dir = 1 and party is not null group by 1, 2)",
           "g as (select txn_id, max(s) / nullif(sum(s), 0) as share, count(*) as sources from k group by 1)",
           "select a.txn_id, share, coalesce(sources, 0) as sources from anchors a left join g using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = window_tops(anchors, flow, "party", "14d", amount(), inflow())
    return got.select("txn_id", S.safe_ratio("top", "total").alias("share"), F.col("keys").alias("sources"))


@query("repeat_share", "txn_id:i party_share:d amt_share:d",
       sql(*H14, """x as (select *, count(*) over (partition by txn_id, party) as pn, count(*) over (partition by txn_id, round(amt)) as an
  from hist where dir = 0)""",
           "g as (select txn_id, (count(*) filter (where pn >= 2)) / count(*)::double as ps, (count(*) filter (where an >= 2)) / count(*)::double as s from x group by 1)",
           "select a.txn_id, ps as party_share, s as amt_share from anchors a left join g using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    a = key_profile(anchors, flow, ["party"], "14d", {"rp": at_least(2), "n": rows}, where=outflow(), nulls=True)
    whole = flow.withColumn("whole", F.round("amt"))
    b = key_profile(anchors, whole, ["whole"], "14d", {"ra": at_least(2)}, where=outflow())
    return a.join(b, "txn_id").select("txn_id", S.safe_ratio("rp", "n").alias("party_share"), S.safe_ratio("ra", "n").alias("amt_share"))


@query("repeat_amounts", "txn_id:i max_repeat:i ratio:d",
       sql(*H14, "k as (select txn_id, round(amt) as v, count(*) as n from hist where dir = 1 group by 1, 2)",
           """g as (select txn_id, max(n) as m, (coalesce(sum(n) filter (where n >= 3), 0)) / (coalesce(sum(n) filter (where n >= 3), 0) + count(*))::double as r
  from k group by 1)""",
           "select a.txn_id, coalesce(m, 0) as max_repeat, r as ratio from anchors a left join g using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    whole = flow.withColumn("whole", F.round("amt"))
    got = key_profile(anchors, whole, ["whole"], "14d", {"r3": at_least(3), "keys": distinct}, where=inflow(), peak="max_repeat")
    return got.withColumn("ratio", F.when(F.col("keys") > 0, S.safe_ratio("r3", F.col("r3") + F.col("keys"))))


@query("daily_peak", "txn_id:i peak:i share:d",
       sql(*H14, "k as (select txn_id, dt, count(h_id) as n from hist group by 1, 2)",
           "select txn_id, max(n) as peak, max(n) / nullif(sum(n), 0)::double as share from k group by 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, [Measure("peak", "peak", ["14d"]), Measure("n", "count", ["14d"])])
    return got.select("txn_id", F.col("peak_14d").alias("peak"), S.safe_ratio("peak_14d", "n_14d").alias("share"))


@query("hour_concentration", "txn_id:i hhi:d",
       sql(*H14, "k as (select txn_id, hh, count(h_id) as n from hist group by 1, 2)",
           "g as (select txn_id, sum(n) as total, sum(n * n) as sq from k group by 1)",
           "select txn_id, coalesce(sq / nullif(total * total, 0)::double, 0) as hhi from g"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = key_profile(anchors, flow, ["hh"], "14d", {"sq": squares, "n": rows})
    return got.select("txn_id", F.coalesce(S.safe_ratio("sq", F.col("n") * F.col("n")), F.lit(0.0)).alias("hhi"))


@query("burst_ratios", "txn_id:i cnt_burst:d amt_burst:d rate_burst:d",
       sql(*H14, """select txn_id, (count(*) filter (where dir = 0 and age <= 86400)) / nullif(count(*) filter (where dir = 0), 0)::double as cnt_burst,
  coalesce(sum(amt) filter (where dir = 0 and age <= 86400), 0) / nullif(sum(amt) filter (where dir = 0), 0) as amt_burst,
  (count(*) filter (where dir = 1 and age <= 259200)) / nullif((count(*) filter (where dir = 1)) * 3.0 / nullif(count(distinct dt) filter (where dir = 1), 0), 0) as rate_burst
  from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, [
        Measure("o", "count", ["1d", "14d"], outflow()), Measure("oa", "sum", ["1d", "14d"], outflow(), amount()),
        Measure("i", "count", ["3d", "14d"], inflow()), Measure("id", "days", ["14d"], inflow())])
    daily = S.safe_ratio(F.col("i_14d") * 3.0, "id_14d")
    return got.select("txn_id", S.safe_ratio("o_1d", "o_14d").alias("cnt_burst"), S.safe_ratio("oa_1d", "oa_14d").alias("amt_burst"),
                      S.safe_ratio("i_3d", daily).alias("rate_burst"))


@query("flow_balance", "txn_id:i net:d sign:d cnt_ratio:d amt_ratio:d diff:i drain:d",
       sql(*H14, """g as (select txn_id, coalesce(sum(amt) filter (where dir = 1), 0) as ia, coalesce(sum(amt) filter (where dir = 0), 0) as oa,
  count(*) filter (where dir = 1) as ic, count(*) filter (where dir = 0) as oc from hist group by 1)""",
           """select txn_id, ia - oa as net, (ia - oa) / nullif(ia + oa, 0) as sign, oc / nullif(ic, 0)::double as cnt_ratio, oa / nullif(ia, 0) as amt_ratio,
  oc - ic as diff, (oa - ia) / nullif(ia, 0) as drain from g"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    w = ["14d"]
    got = look_back(anchors, flow, [Measure("ia", "sum", w, inflow(), amount()), Measure("oa", "sum", w, outflow(), amount()), Measure("ic", "count", w, inflow()), Measure("oc", "count", w, outflow())])
    ia, oa, ic, oc = (F.col(f"{x}_14d") for x in ("ia", "oa", "ic", "oc"))
    return got.select("txn_id", (ia - oa).alias("net"), S.safe_ratio(ia - oa, ia + oa).alias("sign"), S.safe_ratio(oc, ic).alias("cnt_ratio"),
                      S.safe_ratio(oa, ia).alias("amt_ratio"), (oc - ic).alias("diff"), S.safe_ratio(oa - ia, ia).alias("drain"))


@query("tag_counters", """txn_id:i strangers_3d:i strangers_2h:i names_30min:i late_err_15d:i err_share_15d:d err_amt_15d:d sleep_15d:d work_15d:d rest_15d:d
  late_15d:d m1000_15d:i tens_amt_3h:d m100_3h:i max_share_15d:d min_share_15d:d std_share_15d:d bal_min_3d:d bal_avg_3d:d follow_15d:i""",
       sql(FLOW, BALANCE, """marked as (select *, lag(chan) over w as pc, lag(t) over w as pt, amt / case when bal + amt > 0 then bal + amt else 0.1 end as share
  from bal window w as (partition by acct order by t, txn_id))""", "anchors as (select * from marked where chan = 'purchase')",
           """h as (select a.txn_id, f.*, (a.t - f.t) / 1e6 as age from anchors a left join (select txn_id as h_id, * exclude (txn_id) from marked) f
  on a.acct = f.acct and a.t - f.t > 0 and a.t - f.t <= 1296000000000)""",
           """select txn_id, count(*) filter (where dir = 1 and novel = 1 and age <= 259200) as strangers_3d, count(*) filter (where dir = 1 and novel = 1 and age <= 7200) as strangers_2h,
  count(distinct party) filter (where dir = 1 and novel = 1 and age <= 1800) as names_30min,
  count(*) filter (where dir = 1 and chan = 'error' and hh in (23, 0, 1, 2, 3, 4)) as late_err_15d,
  (count(*) filter (where dir = 1 and chan = 'error')) / nullif(sum(dir), 0)::double as err_share_15d,
  coalesce(sum(amt) filter (where dir = 1 and chan = 'error'), 0) as err_amt_15d,
  (count(*) filter (where hh between 0 and 3)) / nullif(count(h_id), 0)::double as sleep_15d, (count(*) filter (where hh between 8 and 18)) / nullif(count(h_id), 0)::double as work_15d,
  (count(*) filter (where hh in (4, 5, 6, 7, 19, 20, 21, 22, 23))) / nullif(count(h_id), 0)::double as rest_15d,
  (count(*) filter (where hh in (23, 0, 1, 2, 3))) / nullif(count(h_id), 0)::double as late_15d,
  count(*) filter (where amt % 10 = 0) as m1000_15d, coalesce(sum(amt) filter (where floor(amt)::bigint % 100 = 0 and age <= 10800), 0) as tens_amt_3h,
  count(*) filter (where amt % 1 = 0 and age <= 10800) as m100_3h,
  max(share) filter (where dir = 0) as max_share_15d, min(share) filter (where dir = 0) as min_share_15d, stddev_pop(share) filter (where dir = 0) as std_share_15d,
  min(bal) filter (where age <= 259200) as bal_min_3d, avg(bal) filter (where age <= 259200) as bal_avg_3d,
  count(*) filter (where dir = 0 and chan = 'view' and pc = 'click' and t - pt < 300000000) as follow_15d from h group by 1"""))
def _(spark, d):
    bal = running_balance(event_flow(spark, d)).withColumn("share", S.balance_parts()["out_share"])
    flow = follow_pattern_flag(bal, F.col("chan") == "click", outflow() & (F.col("chan") == "view"))
    anchors = flow.filter("chan = 'purchase'")
    err, stranger = inflow() & (F.col("chan") == "error"), inflow() & (F.col("novel") == 1)
    w, share = ["15d"], F.col("share")
    got = look_back(anchors, flow, [
        Measure("strangers", "count", ["3d", "2h"], stranger), Measure("late_err", "count", w, err & S.in_hours("hh", S.LATE_TEXT_HOURS)), Measure("err", "count", w, err), Measure("ins", "count", w, inflow()),
        Measure("err_amt", "sum", w, err, amount()), Measure("n", "count", w), Measure("sleep", "count", w, S.in_hours("hh", S.SLEEP_HOURS)),
        Measure("work", "count", w, S.in_hours("hh", S.WORK_HOURS)), Measure("rest", "count", w, S.in_hours("hh", S.REST_HOURS)),
        Measure("late", "count", w, S.in_hours("hh", S.LATE_HOURS)), Measure("m1000", "count", w, F.pmod("amt", F.lit(10.0)) == 0),
        Measure("tens_amt", "sum", ["3h"], S.round_amount_flags("amt")["tens_ones_zero"], amount()), Measure("m100", "count", ["3h"], F.pmod("amt", F.lit(1.0)) == 0),
        Measure("max_share", "max", w, outflow(), share), Measure("min_share", "min", w, outflow(), share), Measure("o", "count", w, outflow()),
        Measure("ss1", "sum", w, outflow(), share), Measure("ss2", "sum", w, outflow(), share * share),
        Measure("bal_min", "min", ["3d"], None, F.col("bal")), Measure("bal_sum", "sum", ["3d"], None, F.col("bal")), Measure("n3", "count", ["3d"]),
        Measure("follow", "count", w, F.col("follows") == 1)])
    names = key_profile(anchors, flow, ["party"], "30min", {"names_30min": distinct}, where=stranger)
    n = F.col("n_15d")
    got = got.withColumns({f"{b}_15d": S.safe_ratio(f"{b}_15d", n) for b in ("sleep", "work", "rest", "late")})
    got = got.withColumns({
        "err_share_15d": S.safe_ratio("err_15d", "ins_15d"), "bal_avg_3d": S.safe_ratio("bal_sum_3d", "n3_3d"),
        "std_share_15d": S.population_std(F.col("o_15d"), F.col("ss1_15d"), F.col("ss2_15d"))})
    return got.join(names, "txn_id")


@query("day_counters", "acct:i snap_dt:D ins_15d:i rows_180d:i days_180d:i max_180d:d max_in_180d:d urgent_share_180d:d high_amt_gap:m days_gap:i min_360d:d",
       sql(ORDERS, SNAPS, days_hist(0, 357), "o as (select *, date_diff('day', dt, snap_dt) as off from hist)",
           """select acct, snap_dt, count(*) filter (where dir = 1 and off < 15) as ins_15d, count(*) filter (where off < 178) as rows_180d,
  count(distinct dt) filter (where off < 178) as days_180d, max(amt) filter (where off < 178) as max_180d,
  max(amt) filter (where off < 178 and dir = 1) as max_in_180d,
  (count(*) filter (where off < 178 and dir = 0 and chan = '1-URGENT')) / nullif(count(*) filter (where off < 178 and dir = 0), 0)::double as urgent_share_180d,
  coalesce(sum(amt) filter (where off between 14 and 177 and chan = '2-HIGH'), 0) as high_amt_gap,
  count(distinct dt) filter (where off between 14 and 177) as days_gap, min(amt) as min_360d from o group by 1, 2"""))
def _(spark, d):
    flow = order_flow(spark, d)
    w = ["180d"]
    got = look_back_days(account_days(flow), flow, [
        Measure("ins", "count", ["15d"], inflow()), Measure("rows", "count", w), Measure("days", "days", ["180d", "gap"]), Measure("max", "max", w, None, amount()),
        Measure("max_in", "max", w, inflow(), amount()), Measure("urgent", "count", w, outflow() & (F.col("chan") == "1-URGENT")), Measure("outs", "count", w, outflow()),
        Measure("high_amt", "sum", ["gap"], F.col("chan") == "2-HIGH", amount()), Measure("min", "min", ["360d"], None, amount())], DAY_WINDOWS, keys=("acct", "snap_dt"))
    return got.withColumn("urgent_share_180d", S.safe_ratio("urgent_180d", "outs_180d"))


@query("day_distinct", "acct:i snap_dt:D parties_180d:i chans_gap:i",
       sql(ORDERS, SNAPS, days_hist(0, 177), """select acct, snap_dt, count(distinct party) filter (where dir = 0) as parties_180d,
  count(distinct chan) filter (where date_diff('day', dt, snap_dt) >= 14) as chans_gap from hist group by 1, 2"""))
def _(spark, d):
    flow = order_flow(spark, d)
    snaps = account_days(flow)
    kw = {"ids": ("acct", "snap_dt"), "day": "snap_dt"}
    a = key_profile_days(snaps, flow, ["party"], DAY_WINDOWS["180d"], {"parties_180d": distinct}, where=outflow(), **kw)
    b = key_profile_days(snaps, flow, ["chan"], DAY_WINDOWS["gap"], {"chans_gap": distinct}, **kw)
    return a.join(b, ["acct", "snap_dt"])


@query("percent_rank_current", "txn_id:i prank:d",
       sql(*H14, "select txn_id, (count(*) filter (where dir = 0 and amt <= amt0)) / nullif(count(*) filter (where dir = 0), 0)::double as prank from hist group by 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    return window_rank(anchors, flow, "14d", outflow()).withColumnRenamed("share", "prank")


@query("zscore_current", "txn_id:i z:m",
       sql(*H14, """select txn_id, case when stddev_samp(amt) filter (where dir = 0) > 0 then (any_value(amt0) - avg(amt) filter (where dir = 0)) / stddev_samp(amt) filter (where dir = 0) end as z
  from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, moments("o", outflow(), ["14d"])).join(anchors.select("txn_id", "amt"), "txn_id")
    n, s, ss = (F.col(f"o_{x}_14d") for x in ("n", "s", "ss"))
    return got.select("txn_id", S.positive_ratio(amount() - S.safe_ratio(s, n), S.sample_std(n, s, ss)).alias("z"))


def cube_sql():
    cols, spec = [], []
    for lab, age in (("3d", 259200), ("14d", 1209600)):
        for dname, dcond in (("in", "dir = 1"), ("out", "dir = 0"), ("all", "true")):
            for cname in ("click", "error", "purchase", "signup", "view", "all"):
                ccond = "true" if cname == "all" else f"chan = '{cname}'"
                for nname, ncond in (("novel", "novel = 1"), ("all", "true")):
                    where = f"filter (where h_id is not null and age <= {age} and {dcond} and {ccond} and {ncond})"
                    name = f"f{lab}_{dname}_{cname}_{nname}"
                    cols += [f"count(*) {where} as {name}_cnt", f"coalesce(sum(amt) {where}, 0) as {name}_sum", f"min(amt) {where} as {name}_min", f"max(amt) {where} as {name}_max",
                             f"stddev_samp(amt) {where} as {name}_std"]
                    spec.append(f"{name}_cnt:i {name}_sum:d {name}_min:d {name}_max:d {name}_std:m")
    return ", ".join(cols), " ".join(spec)


CUBE_COLS, CUBE_SPEC = cube_sql()


@query("feature_cube", "txn_id:i " + CUBE_SPEC, sql(*H14, f"select txn_id, {CUBE_COLS} from hist group by 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    return feature_cube(anchors, flow, ["3d", "14d"], {"in": inflow(), "out": outflow()}, "chan", {"novel": F.col("novel") == 1}, amount())


@query("amount_range_std", "txn_id:i f14d_in_min_amt:d f14d_in_max_amt:d f14d_all_std_amt:d",
       sql(*H14, "select txn_id, min(amt) filter (where dir = 1) as f14d_in_min_amt, max(amt) filter (where dir = 1) as f14d_in_max_amt, stddev_samp(amt) as f14d_all_std_amt from hist group by 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    w = ["14d"]
    got = look_back(anchors, flow, [Measure("lo", "min", w, inflow(), amount()), Measure("hi", "max", w, inflow(), amount()), *moments("a", None, w)])
    n, s, ss = (F.col(f"a_{x}_14d") for x in ("n", "s", "ss"))
    return got.select("txn_id", F.col("lo_14d").alias("f14d_in_min_amt"), F.col("hi_14d").alias("f14d_in_max_amt"), S.sample_std(n, s, ss).alias("f14d_all_std_amt"))


@query("hour_deviation", "txn_id:i mode_hour:i deviation:i",
       sql(*H14, "k as (select txn_id, any_value(hh0) as hh0, hh, count(*) as n from hist where dir = 0 group by txn_id, hh)",
           "r as (select *, row_number() over (partition by txn_id order by n desc, hh) as rn from k)",
           "select a.txn_id, r.hh as mode_hour, least(abs(hh0 - r.hh), 24 - abs(hh0 - r.hh)) as deviation from anchors a left join r on a.txn_id = r.txn_id and rn = 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, [Measure(f"h{h}", "count", ["14d"], outflow() & (F.col("hh") == h)) for h in range(24)])
    # Largest count, then smallest hour.
    best = F.greatest(*[F.struct(F.col(f"h{h}_14d").alias("n"), F.lit(-h).alias("neg")) for h in range(24)])
    mode = F.when(best["n"] > 0, -best["neg"])
    return got.join(anchors.select("txn_id", "hh"), "txn_id").select(
        "txn_id", mode.alias("mode_hour"), F.when(mode.isNotNull(), S.circular_hours("hh", mode)).alias("deviation"))


@query("mix_shift", "txn_id:i shift:d",
       sql(*H14, """select txn_id, (count(*) filter (where dir = 0 and chan in ('view', 'click'))) / nullif(count(*) filter (where dir = 0), 0)::double
  - (count(*) filter (where dir = 0 and chan in ('view', 'click') and age <= 259200)) / nullif(count(*) filter (where dir = 0 and age <= 259200), 0)::double as shift
  from hist group by 1"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    w = ["3d", "14d"]
    got = look_back(anchors, flow, [Measure("tag", "count", w, outflow() & F.col("chan").isin("view", "click")), Measure("n", "count", w, outflow())])
    return got.select("txn_id", (S.safe_ratio("tag_14d", "n_14d") - S.safe_ratio("tag_3d", "n_3d")).alias("shift"))


@query("repeat_party_ratio", "acct:i snap_dt:D ratio:d",
       sql(ORDERS, SNAPS, days_hist(0, 179), "k as (select acct, snap_dt, party, count(txn_id) as n from hist group by 1, 2, 3)",
           "select acct, snap_dt, avg(case when n > 1 then 1.0 else 0.0 end) as ratio from k group by 1, 2"))
def _(spark, d):
    flow = order_flow(spark, d)
    src = flow.withColumn("party", F.coalesce("party", F.lit("none")))
    snaps = account_days(flow)
    got = key_profile_days(snaps, src, ["party"], DAY_WINDOWS["click_180d"],
                           {"keys": distinct, "many": lambda c: (c >= 2).cast("long")}, per_day=False, ids=("acct", "snap_dt"), day="snap_dt")
    return got.select("acct", "snap_dt", F.when(F.col("keys") > 0, S.safe_ratio("many", "keys")).otherwise(0.0).alias("ratio"))


PAGES = ("click", "view", "error")


@query("page_ip_counts", "txn_id:i click_2h:i view_2h:i error_2h:i click_3d:i view_3d:i error_3d:i click_14d:i view_14d:i error_14d:i",
       sql(*H14, "select txn_id, " + ", ".join(
           f"count(distinct party) filter (where chan = '{p}' and age <= {WINDOWS[w]}) as {p}_{w}" for w in ("2h", "3d", "14d") for p in PAGES) + " from hist group by 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    track = flow.filter(F.col("chan").isin(*PAGES))
    out = None
    for w in ("2h", "3d", "14d"):
        # Distinct (page, ip) pairs; one pass serves all pages.
        got = key_profile(anchors, track, ["chan", "party"], w, {f"{p}_{w}": when(F.col("chan") == p, distinct) for p in PAGES})
        out = got if out is None else out.join(got, "txn_id")
    return out


@query("page_ip_counts_days", "acct:i snap_dt:D urgent_180d:i low_180d:i urgent_gap:i low_gap:i",
       sql(ORDERS, SNAPS, days_hist(0, 179), "select acct, snap_dt, " + ", ".join(
           f"count(distinct party) filter (where chan = '{p}' and date_diff('day', dt, snap_dt) >= {lo}) as {n}_{w}"
           for w, lo in (("180d", 0), ("gap", 14)) for n, p in (("urgent", "1-URGENT"), ("low", "5-LOW"))) + " from hist group by 1, 2"))
def _(spark, d):
    flow = order_flow(spark, d)
    snaps = account_days(flow)
    out = None
    for w in ("180d", "gap"):
        prof = {f"{n}_{w}": when(F.col("chan") == p, distinct) for n, p in (("urgent", "1-URGENT"), ("low", "5-LOW"))}
        got = key_profile_days(snaps, flow, ["chan", "party"], DAY_WINDOWS[f"click_{w}"], prof, ids=("acct", "snap_dt"), day="snap_dt")
        out = got if out is None else out.join(got, ["acct", "snap_dt"])
    return out


@query("window_ratio", "acct:i snap_dt:D cnt_ratio:d amt_ratio:d",
       sql(ORDERS, SNAPS, days_hist(0, 177), "o as (select *, date_diff('day', dt, snap_dt) as off from hist)",
           """select acct, snap_dt, (count(*) filter (where off < 15)) / nullif(count(*) filter (where off >= 14), 0)::double as cnt_ratio,
  coalesce(sum(amt) filter (where off < 15), 0) / nullif(sum(amt) filter (where off >= 14), 0) as amt_ratio from o group by 1, 2"""))
def _(spark, d):
    flow = order_flow(spark, d)
    w = ["15d", "gap"]
    got = look_back_days(account_days(flow), flow, [Measure("n", "count", w), Measure("a", "sum", w, None, amount())], DAY_WINDOWS, keys=("acct", "snap_dt"))
    return got.select("acct", "snap_dt", S.safe_ratio("n_15d", "n_gap").alias("cnt_ratio"), S.safe_ratio("a_15d", "a_gap").alias("amt_ratio"))
