"""Sinks read back, run log, encodings, entropy, velocity and group statistics."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from trailmark.catalog.base import ANCHORS, FLOW, LABELLED, events, hist, inflow, labelled, outflow, query, sql
from trailmark.functions import scalars as S
from trailmark.operators import encodings as E
from trailmark.operators import ranking as R
from trailmark.plans.lookback import Measure, look_back
from trailmark.plans.lineage import shared_folder
from trailmark.plans.profile import distinct, key_profile, rows, xlogx
from trailmark.plans.quantiles import window_quantile
from trailmark.schema import event_flow, read
from trailmark.sources import tables as T

H14 = (FLOW, ANCHORS, hist("14d"))


def scratch(spark, name: str) -> str:
    """A fresh folder for written tables in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(6).hex()}"


PER_ACCT = sql(FLOW, "select acct, chan, count(*) as n, round(sum(amt), 2) as total from flow group by 1, 2")
PER_ACCT_SPEC = "acct:i chan:s n:i total:d"


def per_acct(spark, d):
    return event_flow(spark, d).groupBy("acct", "chan").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 2).alias("total"))


@query("materialize", PER_ACCT_SPEC, PER_ACCT)
def _(spark, d):
    root = scratch(spark, "features")
    T.materialize(spark, lambda: per_acct(spark, d), root, "per_acct", {"sf": d})
    # The second call finds the stored result and does not build again.
    return T.materialize(spark, lambda: per_acct(spark, d).filter("false"), root, "per_acct", {"sf": d})


@query("materialize_days", "dt:D acct:i n:i total:d", sql(FLOW, "select dt, acct, count(*) as n, sum(amt) as total from flow group by 1, 2"))
def _(spark, d):
    """A table by day after one day has changed, one has come and one has gone; only those are built again."""
    root, flow = scratch(spark, "by_day"), event_flow(spark, d).select("dt", "acct", "amt")
    first, last = flow.agg(F.min("dt"), F.max("dt")).first()

    def keep(source):
        def build(days):
            return source.join(F.broadcast(days.withColumnRenamed("day", "dt")), "dt").groupBy(F.col("dt").alias("day"), "acct").agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("total"))

        return T.materialize_days(spark, source, build, root, "per_day")

    older = flow.filter((F.col("dt") != first) & ~((F.col("dt") == last) & (F.col("acct") % 2 == 0)))
    gone = flow.filter(F.col("dt") == first).withColumn("dt", F.date_sub("dt", 10))
    keep(older.unionByName(gone))
    table, days = keep(flow)
    assert days == [str(first), str(last)], days
    return table.withColumnRenamed("day", "dt")


@query("csv_sink", PER_ACCT_SPEC, PER_ACCT)
def _(spark, d):
    path = scratch(spark, "csv")
    T.write_csv(per_acct(spark, d), path)
    return T.read_csv(spark, path, "acct bigint, chan string, n bigint, total double")


@query("json_sink", PER_ACCT_SPEC, PER_ACCT)
def _(spark, d):
    path = scratch(spark, "json")
    T.write_json(per_acct(spark, d), path)
    return T.read_json(spark, path, "acct bigint, chan string, n bigint, total double")


@query("report_tables", "part:s n:i",
       sql(FLOW, "select 'accounts' as part, count(distinct acct) as n from flow union all select 'channels', count(distinct chan) from flow"))
def _(spark, d):
    root = scratch(spark, "report")
    flow = event_flow(spark, d)
    T.write_report({"accounts": flow.select("acct").distinct(), "channels": flow.select("chan").distinct()}, root)
    out = None
    for name in ("accounts", "channels"):
        part = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("run_log", "latest_run:i latest_f1:d best_run:i best_f1:d improved:i",
       sql(FLOW, "runs as (select acct as run, round(avg(amt), 4) as f1 from flow group by 1)",
           """select l.run as latest_run, l.f1 as latest_f1, b.run as best_run, b.f1 as best_f1, case when l.run = b.run then 1 else 0 end as improved
  from (select * from runs order by run desc limit 1) l, (select * from runs order by f1 desc, run limit 1) b"""))
def _(spark, d):
    path = scratch(spark, "runs")
    runs = event_flow(spark, d).groupBy(F.col("acct").alias("run")).agg(F.round(F.avg("amt"), 4).alias("f1"))
    row = runs.select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("run_at"), "run", "f1", F.lit(60).alias("best_k"),
                      F.lit(5).alias("hit_y"), F.lit(7).alias("missed_y"), F.lit(6).alias("n_features"), F.lit(1.5).alias("seconds"), F.lit("note").alias("notes"))
    T.log_run(row.filter("run % 2 = 0"), path)
    T.log_run(row.filter("run % 2 = 1"), path)
    return T.best_run(T.read_runs(spark, path))


@query("entropy", "txn_id:i chan_entropy:d party_entropy:d",
       sql(*H14, "a as (select txn_id, chan, count(h_id) as n from hist group by 1, 2)", "b as (select txn_id, party, count(h_id) as n from hist where party is not null group by 1, 2)",
           "ea as (select txn_id, sum(n) as t, sum(case when n > 0 then n * ln(n) end) as x from a group by 1)",
           "eb as (select txn_id, sum(n) as t, sum(case when n > 0 then n * ln(n) end) as x from b group by 1)",
           """select ea.txn_id, case when ea.t > 0 then ln(ea.t) - ea.x / ea.t end as chan_entropy, case when eb.t > 0 then ln(eb.t) - eb.x / eb.t end as party_entropy
  from ea left join eb using (txn_id)"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    out = anchors.select("txn_id")
    for key in ("chan", "party"):
        got = key_profile(anchors, flow, [key], "14d", {"x": xlogx, "n": rows})
        n = F.col("n").cast("double")
        h = F.when(n > 0, F.log(F.greatest(n, F.lit(1.0))) - F.col("x") / F.nullif(n, F.lit(0.0)))
        out = out.join(got.select("txn_id", h.alias(f"{key}_entropy")), "txn_id")
    return out


@query("frequency_encoding", "txn_id:i chan_freq:d",
       sql(FLOW, "select txn_id, count(*) over (partition by chan) / (select count(*) from flow)::double as chan_freq from flow"))
def _(spark, d):
    return E.freq_encode(event_flow(spark, d), "chan")


@query("target_encoding", "txn_id:i party_target:d",
       sql(FLOW, LABELLED, "f as (select *, (row_number() over (partition by label order by md5(cast(txn_id as varchar)), txn_id) - 1) % 5 as fold from labelled)",
           "c as (select party, fold, count(*) as n, sum(label) as y from f where split = 'train' group by 1, 2)", "g as (select party, sum(n) as n, sum(y) as y from c group by 1)",
           """select f.txn_id, (g.y - case when split = 'train' then coalesce(c.y, 0) else 0 end) / nullif(g.n - case when split = 'train' then coalesce(c.n, 0) else 0 end, 0)::double as party_target
  from f left join g on f.party = g.party left join c on f.party = c.party and f.fold = c.fold"""))
def _(spark, d):
    _, anchors = labelled(spark, d)
    return E.target_encode(R.stratified_folds(anchors), "party")


@query("cyclic_hour", "txn_id:i s:d c:d", sql(FLOW, "select txn_id, sin(2 * pi() * hh / 24) as s, cos(2 * pi() * hh / 24) as c from flow"))
def _(spark, d):
    s, c = S.cyclic_hour("hh")
    return event_flow(spark, d).select("txn_id", s.alias("s"), c.alias("c"))


@query("velocity", "txn_id:i v3_14:d v7_30:d today:d n_3h:i n_1d:i rate_diff:d",
       sql(FLOW, ANCHORS, hist("30d"), """g as (select txn_id, count(*) filter (where age <= 259200) as n3, count(*) filter (where age <= 604800) as n7, count(*) filter (where age <= 1209600) as n14, count(h_id) as n30,
  count(*) filter (where age <= 10800) as nh, count(*) filter (where age <= 86400) as n1 from hist group by 1)""",
           """select txn_id, n3 / nullif(n14, 0)::double as v3_14, n7 / nullif(n30, 0)::double * 30 / 7 as v7_30, n1 / nullif(n14 / 14.0, 0) as today, nh as n_3h, n1 as n_1d,
  n7 / 7.0 - n14 / 14.0 as rate_diff from g"""))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = look_back(anchors, flow, [Measure("n", "count", ["3h", "1d", "3d", "7d", "14d", "30d"])])
    c = F.col
    return got.select("txn_id", S.safe_ratio("n_3d", "n_14d").alias("v3_14"), (S.safe_ratio("n_7d", "n_30d") * 30 / 7).alias("v7_30"),
                      S.safe_ratio("n_1d", c("n_14d") / 14.0).alias("today"), c("n_3h"), c("n_1d"), (c("n_7d") / 7.0 - c("n_14d") / 14.0).alias("rate_diff"))


@query("daily_zscore", "txn_id:i z:m busiest:i",
       sql(*H14, "k as (select txn_id, dt, count(h_id) as n from hist where h_id is not null group by 1, 2)",
           "s as (select txn_id, avg(n) as m, stddev_samp(n) as sd, max(n) as hi from k group by 1)",
           "today as (select a.txn_id, count(f.txn_id) as n from anchors a left join flow f on a.acct = f.acct and f.dt = a.dt and f.t < a.t group by 1)",
           "select t.txn_id, case when sd > 0 then (t.n - m) / sd end as z, coalesce(hi, 0) as busiest from today t left join s using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    # Counts per day of the window: keys are days.
    got = key_profile(anchors, flow, ["dt"], "14d", {"days": distinct, "s": rows, "ss": lambda c: (c * c).cast("long")}, peak="busiest")
    same_day = flow.withColumn("acct", F.struct("acct", "dt"))
    today = look_back(anchors.withColumn("acct", F.struct("acct", "dt")), same_day, [Measure("today", "count", ["1d"])])
    n, s, ss = (F.col(x).cast("double") for x in ("days", "s", "ss"))
    z = S.positive_ratio(F.col("today_1d") - S.safe_ratio(s, n), S.sample_std(n, s, ss))
    return got.join(today, "txn_id").select("txn_id", z.alias("z"), "busiest")


@query("over_percentile", "txn_id:i over_p95:i",
       sql(*H14, "select txn_id, case when any_value(amt0) > quantile_disc(amt, 0.95) filter (where dir = 0) then 1 else 0 end as over_p95 from hist group by 1"))
def _(spark, d):
    flow, anchors = events(spark, d)
    got = window_quantile(anchors, flow, "14d", [0.95], outflow()).join(anchors.select("txn_id", "amt"), "txn_id")
    return got.select("txn_id", S.flag(F.col("amt") > F.col("q0")).alias("over_p95"))


@query("source_dest_ratio", "txn_id:i ratio:d top_share:d",
       sql(*H14, "k as (select txn_id, party, count(*) as n from hist where dir = 0 and party is not null group by 1, 2)", "g as (select txn_id, max(n) / sum(n)::double as s from k group by 1)",
           "r as (select txn_id, (count(distinct party) filter (where dir = 1)) / nullif(count(distinct party) filter (where dir = 0), 0)::double as ratio from hist group by 1)",
           "select r.txn_id, ratio, s as top_share from r left join g using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    i = key_profile(anchors, flow, ["party"], "14d", {"sources": distinct}, where=inflow())
    o = key_profile(anchors, flow, ["party"], "14d", {"dests": distinct, "n": rows}, where=outflow(), peak="top")
    return i.join(o, "txn_id").select("txn_id", S.safe_ratio("sources", "dests").alias("ratio"), S.safe_ratio("top", "n").alias("top_share"))


@query("shared_party", "party:s accounts:i n_rows:i",
       sql(FLOW, "select party, count(distinct acct) as accounts, count(*) as n_rows from flow where party is not null group by 1"))
def _(spark, d):
    return E.shared_party(event_flow(spark, d))


BIN_SQL = "case when amt <= 25 then '01: <=25' when amt <= 100 then '02: (25,100]' when amt <= 250 then '03: (100,250]' else '04: >250' end"


@query("bin_enumeration", "txn_id:i b1:i b2:i b3:i b4:i new_bin:i",
       sql(*H14, "b as (select txn_id, count(*) filter (where amt <= 25) as b1, count(*) filter (where amt > 25 and amt <= 100) as b2, count(*) filter (where amt > 100 and amt <= 250) as b3, count(*) filter (where amt > 250) as b4 from hist group by 1)",
           f"x as (select txn_id, {BIN_SQL} as bin from anchors)",
           "select txn_id, b1, b2, b3, b4, case when case left(bin, 2) when '01' then b1 when '02' then b2 when '03' then b3 else b4 end = 0 then 1 else 0 end as new_bin from b join x using (txn_id)"))
def _(spark, d):
    flow, anchors = events(spark, d)
    flow = flow.withColumn("bin", S.bin_label("amt", [25, 100, 250]))
    got = look_back(anchors, flow, [Measure(f"b{i}", "count", ["14d"], F.col("bin").startswith(f"{i:02d}")) for i in range(1, 5)])
    own = anchors.select("txn_id", S.bin_label("amt", [25, 100, 250]).alias("bin"))
    counts = {f"b{i}": F.col(f"b{i}_14d") for i in range(1, 5)}
    mine = F.element_at(F.array(*counts.values()), F.substring("bin", 1, 2).cast("int"))
    return got.join(own, "txn_id").select("txn_id", *[c.alias(n) for n, c in counts.items()], S.flag(mine == 0).alias("new_bin"))


@query("group_stats", "grouping:s acct:i chan:s n:i mean_v:d std_v:d min_v:d max_v:d members:i",
       sql(FLOW, " union all ".join(
           f"select '{g}' as grouping, {'acct' if 'acct' in g else 'null'} as acct, {'chan' if 'chan' in g else 'null'} as chan, count(amt) as n, round(sum(amt), 2) / count(amt) as mean_v, stddev_samp(amt) as std_v, min(amt) as min_v, max(amt) as max_v, count(distinct party) as members from flow group by {g.replace('+', ', ')}"
           for g in ("acct", "chan", "acct+chan"))))
def _(spark, d):
    return E.group_stats(event_flow(spark, d), [["acct"], ["chan"], ["acct", "chan"]], digits=2)


@query("current_amount_ratios", "txn_id:i div_max:d div_avg:d position:d interaction:d",
       sql(*H14, "g as (select txn_id, any_value(amt0) as a, max(amt) filter (where dir = 0) as hi, min(amt) filter (where dir = 0) as lo, avg(amt) filter (where dir = 0) as m, count(*) filter (where dir = 0) as n from hist group by 1)",
           "select txn_id, a / nullif(hi, 0) as div_max, a / nullif(m, 0) as div_avg, (a - lo) / nullif(hi - lo, 0) as position, a * n as interaction from g"))
def _(spark, d):
    flow, anchors = events(spark, d)
    a, w = F.col("amt"), ["14d"]
    got = look_back(anchors, flow, [Measure("hi", "max", w, outflow(), a), Measure("lo", "min", w, outflow(), a), Measure("s", "sum", w, outflow(), a), Measure("n", "count", w, outflow())])
    got = got.join(anchors.select("txn_id", "amt"), "txn_id")
    return got.select("txn_id", S.safe_ratio("amt", "hi_14d").alias("div_max"), S.safe_ratio("amt", S.safe_ratio("s_14d", "n_14d")).alias("div_avg"),
                      S.safe_ratio(a - F.col("lo_14d"), F.col("hi_14d") - F.col("lo_14d")).alias("position"), (a * F.col("n_14d")).alias("interaction"))


@query("per_segment_exposure", "segment:s parties:i total:m",
       "select c_mktsegment as segment, count(distinct l_suppkey) as parties, sum(o_totalprice) as total from customer join orders on c_custkey = o_custkey left join (select l_orderkey, min(l_suppkey) as l_suppkey from lineitem group by 1) on l_orderkey = o_orderkey group by 1")
def _(spark, d):
    from trailmark.schema import order_flow

    c = read(spark, d, "customer").select(F.col("c_custkey").alias("acct"), F.col("c_mktsegment").alias("segment"))
    return order_flow(spark, d).join(c, "acct").groupBy("segment").agg(F.count_distinct("party").alias("parties"), F.sum("amt").alias("total"))
