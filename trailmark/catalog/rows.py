"""Scans, row-level expressions, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.catalog.base import BALANCE, FLOW, ORDERS, events, query, sql
from trailmark.functions import scalars as S
from trailmark.operators import ranking as R
from trailmark.operators.joins import override_from
from trailmark.operators.sequences import dedup_first, running_balance
from trailmark.schema import event_flow, micros, order_flow, read
from trailmark.sources import tables as T


@query("scan_table", "rows:i total:m", "select count(*) as rows, sum(o_totalprice) as total from orders")
def _(spark, d):
    return T.read_table(spark, f"{d}/orders.parquet").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")
    )


@query(
    "scan_view",
    "seg:s n:i",
    "select c_mktsegment as seg, count(*) as n from customer where c_acctbal > 0 group by 1",
)
def _(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("tm_customer")
    src = T.metastore_table(spark, "tm_customer")
    return src.filter("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_by_membership",
    "part:s n:i total:m",
    sql(FLOW, """select case when chan in ('click', 'view') then 'train' else 'test' end as part, count(*) as n, sum(amt) as total
  from flow where chan in ('click', 'view', 'purchase') group by 1"""),
)
def _(spark, d):
    train, test = T.split_by(event_flow(spark, d), "chan", ["click", "view"], ["purchase"])
    both = R.stack_labelled(train, test, "part", ("train", "test"))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("total"))


@query(
    "scan_snapshot",
    "acct:i n:i amt:d",
    sql(FLOW, """select acct, count(*) as n, sum(amt) as amt from flow
  where dt between date '2024-01-10' and date '2024-01-12' group by 1"""),
)
def _(spark, d):
    days = T.scan_snapshot(event_flow(spark, d), "dt", between=(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date")))
    return days.groupBy("acct").agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("amt"))


@query(
    "staged_tables",
    "chan:s accts:i",
    sql(FLOW, """big as (select * from flow where amt > 100)""",
        "select chan, count(distinct acct) as accts from big group by 1"),
)
def _(spark, d):
    first = T.stage(event_flow(spark, d), "tm_stage_flow")
    second = T.stage(first.filter("amt > 100"), "tm_stage_big")
    return second.groupBy("chan").agg(F.count_distinct("acct").alias("accts"))


@query("canonical_flow", "txn_key:s acct:i t:i dt:D hh:i dir:i amt:d chan:s party:s",
       sql(FLOW, """select concat_ws('_', replace(cast(dt as varchar), '-', ''), cast(acct as varchar), cast(txn_id as varchar)) as txn_key,
  acct, t, dt, hh, dir, amt, trim(chan) as chan, party from flow"""))
def _(spark, d):
    day = F.regexp_replace(F.col("dt").cast("string"), "-", "")
    key = F.concat_ws("_", day, F.col("acct").cast("string"), F.col("txn_id").cast("string"))
    return event_flow(spark, d).withColumns({"txn_key": key, "chan": F.trim("chan")})


AMOUNT_BIN_SQL = """case when {c} <= 100 then 'bin_amt_le100' when {c} <= 1000 then 'bin_amt_bw_100_1k'
  when {c} <= 3000 then 'bin_amt_bw_1k_3k' when {c} <= 10000 then 'bin_amt_bw_3k_1w'
  when {c} <= 50000 then 'bin_amt_bw_1w_5w' when {c} > 50000 then 'bin_amt_gt_5w' end"""


@query("amount_bins", "bin:s n:i total:m",
       f"select {AMOUNT_BIN_SQL.format(c='l_extendedprice')} as bin, count(*) as n, sum(l_extendedprice) as total from lineitem group by 1")
def _(spark, d):
    return read(spark, d, "lineitem").groupBy(S.amount_bin("l_extendedprice").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"))


@query("override_source", "txn_id:i party:s amt:d",
       sql(FLOW, "fix as (select txn_id, party as p, amt * 2 as a from flow where chan = 'error')",
           """select f.txn_id, case when x.txn_id is not null then x.p else f.chan end as party,
  case when x.txn_id is not null then x.a else f.amt end as amt from flow f left join fix x using (txn_id)"""))
def _(spark, d):
    flow = event_flow(spark, d)
    fix = flow.filter("chan = 'error'").select("txn_id", "party", (F.col("amt") * 2).alias("amt"))
    return override_from(flow.withColumn("party", F.col("chan")), fix, "txn_id", ["party", "amt"])


@query("pick_side", "l_orderkey:i l_linenumber:i party:i n:i",
       """select l_orderkey, l_linenumber, case when l_returnflag = 'R' then l_suppkey else l_partkey end as party, count(*) as n
  from lineitem group by 1, 2, 3""")
def _(spark, d):
    side = S.pick_side(F.col("l_returnflag") == "R", "l_suppkey", "l_partkey")
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", side.alias("party")).agg(F.count(F.lit(1)).alias("n"))


@query("rule_cascade", "kind:s n:i",
       r"""select case when substr(p_type, 1, 3) = 'ECO' then 'economy' when p_name like '%ring%' then 'ring'
  when regexp_matches(p_name, '^(red|blue).*t$') then 'red_t' when length(p_name) > 10 then 'long' else 'other' end as kind,
  count(*) as n from part group by 1""")
def _(spark, d):
    kind = S.classify([
        (F.substring("p_type", 1, 3) == "ECO", "economy"),
        (F.col("p_name").like("%ring%"), "ring"),
        (F.col("p_name").rlike("^(red|blue).*t$"), "red_t"),
        (F.length("p_name") > 10, "long"),
    ], "other")
    return read(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("text_classes", "kind:s lang:s n:i quality:i",
       """select case when text like '%http%' then 'link' when regexp_matches(text, '[0-9]{4}') then 'number'
  when length(text) > 2000 then 'long' else 'plain' end as kind, lang, count(*) as n, sum(coalesce(quality, 0)) as quality
  from documents left join labels using (doc_id) group by 1, 2""")
def _(spark, d):
    kind = S.classify([
        (F.col("text").contains("http"), "link"),
        (F.col("text").rlike("[0-9]{4}"), "number"),
        (F.length("text") > 2000, "long"),
    ], "plain")
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy(kind.alias("kind"), "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("quality"))


@query("exclude_noise", "party_null:i n:i",
       sql(FLOW, """select case when party is null then 1 else 0 end as party_null, count(*) as n from flow
  where party is null or (party not like '%7%' and party not like '%13%') group by 1"""))
def _(spark, d):
    kept = S.exclude_like(event_flow(spark, d), "party", ["7", "13"])
    return kept.groupBy(S.flag(F.col("party").isNull()).alias("party_null")).agg(F.count(F.lit(1)).alias("n"))


@query("tag_families", "txn_id:i pay:i browse:i fail:i",
       sql(FLOW, """select txn_id, case when chan like '%purch%' or chan like '%sign%' then 1 else 0 end as pay,
  case when chan like '%click%' or chan like '%view%' then 1 else 0 end as browse,
  case when chan like '%err%' then 1 else 0 end as fail from flow"""))
def _(spark, d):
    return S.tag_like(event_flow(spark, d), "chan", {"pay": ["purch", "sign"], "browse": ["click", "view"], "fail": ["err"]})


@query("safe_numbers", "event_id:i v:d",
       """select event_id, case when event_id % 97 = 0 or event_id % 89 = 0 or event_id % 83 = 0 then null else value end as v from events""")
def _(spark, d):
    # Text that does not parse, NaN and infinities all become NULL.
    text = (F.when(F.col("event_id") % 97 == 0, "n/a").when(F.col("event_id") % 89 == 0, "NaN")
            .when(F.col("event_id") % 83 == 0, "Infinity").otherwise(F.col("value").cast("string")))
    return S.to_numeric(read(spark, d, "events").withColumn("v", text), ["v"])


@query("hour_bands", "band:s night:i n:i",
       sql(FLOW, """select case when hh between 0 and 3 then 'sleep' when hh between 8 and 18 then 'work' else 'rest' end as band,
  case when hh >= 22 or hh <= 5 then 1 else 0 end as night, count(*) as n from flow group by 1, 2"""))
def _(spark, d):
    return event_flow(spark, d).groupBy(S.hour_band("hh").alias("band"), S.flag(S.is_night("hh")).alias("night")).agg(
        F.count(F.lit(1)).alias("n"))


@query("round_amounts", "l_orderkey:i m1000:i m100:i tens:i near_a:i near_b:i under:i",
       """select l_orderkey, sum(case when v % 1000 = 0 then 1 else 0 end) as m1000, sum(case when v % 100 = 0 then 1 else 0 end) as m100,
  sum(case when floor(v)::bigint % 100 = 0 then 1 else 0 end) as tens,
  sum(case when round(v, -2) % 5000 = 0 then 1 else 0 end) as near_a,
  sum(case when round(v, -3) % 5000 = 0 then 1 else 0 end) as near_b,
  sum(case when round(v, -3) - v >= 0 then 1 else 0 end) as under
  from (select l_orderkey, l_quantity * 100 + l_linenumber * 250 as v from lineitem) group by 1""")
def _(spark, d):
    v = F.col("l_quantity") * 100 + F.col("l_linenumber") * 250
    rows = read(spark, d, "lineitem").select("l_orderkey", v.alias("v"))
    f = S.round_amount_flags("v")
    names = dict(zip(["m1000", "m100", "tens", "near_a", "near_b", "under"], f.values()))
    return rows.groupBy("l_orderkey").agg(*[F.count_if(p).alias(n) for n, p in names.items()])


@query("balance_parts", "txn_id:i bal:d before_out:d before_in:d out_share:d in_share:d",
       sql(FLOW, BALANCE, """select txn_id, bal, case when bal + amt > 0 then bal + amt else 0.1 end as before_out,
  case when bal - amt > 0 then bal - amt else 0.1 end as before_in,
  amt / case when bal + amt > 0 then bal + amt else 0.1 end as out_share,
  amt / case when bal - amt > 0 then bal - amt else 0.1 end as in_share from bal"""))
def _(spark, d):
    return running_balance(event_flow(spark, d)).withColumns(S.balance_parts())


@query("differing_party", "c_custkey:i differs:i differs_prefixed:i",
       """select c_custkey, case when length(c_mktsegment) between 8 and 9 and c_name <> c_mktsegment then 1 else 0 end as differs,
  case when length(c_mktsegment) between 8 and 9 and c_name <> c_mktsegment and substr(c_mktsegment, 1, 1) = 'M' then 1 else 0 end as differs_prefixed
  from customer""")
def _(spark, d):
    differs = S.differing_party("c_name", "c_mktsegment", 8, 9)
    return read(spark, d, "customer").select(
        "c_custkey", S.flag(differs).alias("differs"),
        S.flag(differs & F.col("c_mktsegment").startswith("M")).alias("differs_prefixed"))


@query("account_shape", "shaped:i mark:i n:i",
       """select case when substr(k, 1, 2) = 'Cu' and length(k) in (18, 19) then 1 else 0 end as shaped,
  case when substr(k, 5, 3) = 'ome' then 1 else 0 end as mark, count(*) as n
  from (select c_name as k from customer union all select s_name from supplier) group by 1, 2""")
def _(spark, d):
    k = read(spark, d, "customer").select(F.col("c_name").alias("k")).unionByName(
        read(spark, d, "supplier").select(F.col("s_name").alias("k")))
    return k.groupBy(S.flag(S.acct_shape("k", "Cu", [18, 19])).alias("shaped"),
                     S.flag(F.substring("k", 5, 3) == "ome").alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@query("offsite_flag", "offsite:i n:i",
       """select case when r_name <> 'ASIA' then 1 when r_name is not null then 0 end as offsite, count(*) as n
  from customer left join (select * from nation where n_nationkey % 6 <> 0) on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey group by 1""")
def _(spark, d):
    nation = read(spark, d, "nation").filter("n_nationkey % 6 <> 0")
    c = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.groupBy(S.offsite_flag("r_name", "ASIA").alias("offsite")).agg(F.count(F.lit(1)).alias("n"))


@query("composite_flags", "txn_id:i small_in:d novel_night:d",
       sql(FLOW, """select txn_id, case when amt <= 100 and dir = 1 and party < '5' then 1.0 else 0.0 end as small_in,
  case when novel = 1 and (hh >= 22 or hh <= 5) then 1.0 else 0.0 end as novel_night from flow"""))
def _(spark, d):
    c = F.col
    return event_flow(spark, d).select(
        "txn_id",
        S.composite_flag([c("amt") <= 100, c("dir") == 1, c("party") < "5"]).alias("small_in"),
        S.composite_flag([c("novel") == 1, S.is_night("hh")]).alias("novel_night"))


@query("fill_zero", "o_custkey:i orders:i spent:m",
       """select c_custkey as o_custkey, coalesce(n, 0) as orders, coalesce(s, 0) as spent from customer
  left join (select o_custkey, count(*) as n, sum(o_totalprice) as s from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey""")
def _(spark, d):
    o = read(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(o, "o_custkey", "left")
    return S.fill_zero(c, ["orders", "spent"])


@query("tenure", "acct:i days:i years:d",
       sql(ORDERS, """select acct, date_diff('day', min(dt), max(dt)) as days, date_diff('day', min(dt), max(dt)) / 365.0 as years
  from flow group by 1"""))
def _(spark, d):
    spans = order_flow(spark, d).groupBy("acct").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return spans.select("acct", S.tenure_days("a", "b").alias("days"), S.tenure_years("a", "b").alias("years"))


@query("safe_ratio", "acct:i out_in:d pos:d",
       sql(FLOW, """select acct, o / nullif(i, 0) as out_in, case when e > 0 then o / e end as pos
  from (select acct, count(*) filter (where dir = 0)::double as o, (count(*) filter (where dir = 1 and hh = 3))::double as i,
        (count(*) filter (where chan = 'error' and hh < 2))::double as e from flow group by 1)"""))
def _(spark, d):
    c = F.col
    g = event_flow(spark, d).groupBy("acct").agg(
        F.count_if(c("dir") == 0).alias("o"), F.count_if((c("dir") == 1) & (c("hh") == 3)).alias("i"),
        F.count_if((c("chan") == "error") & (c("hh") < 2)).alias("e"))
    return g.select("acct", S.safe_ratio("o", "i").alias("out_in"), S.positive_ratio("o", "e").alias("pos"))


@query("anchor_flags", "txn_id:i is_cross:i is_error_party:i night:i",
       sql(FLOW, """select txn_id, case when dir = 1 then 1 else 0 end as is_cross, case when party is null then 1 else 0 end as is_error_party,
  case when hh >= 22 or hh <= 5 then 1 else 0 end as night from flow where chan = 'purchase'"""))
def _(spark, d):
    _, anchors = events(spark, d)
    return anchors.select("txn_id", S.flag(F.col("dir") == 1).alias("is_cross"),
                          S.flag(F.col("party").isNull()).alias("is_error_party"), S.flag(S.is_night("hh")).alias("night"))


@query("bin_labels", "label:s n:i",
       sql(FLOW, """select case when amt <= 25 then '01: <=25' when amt <= 100 then '02: (25,100]' when amt <= 250 then '03: (100,250]' else '04: >250' end as label,
  count(*) as n from flow group by 1"""))
def _(spark, d):
    return event_flow(spark, d).groupBy(S.bin_label("amt", [25, 100, 250]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("scalar_functions",
       "o_orderkey:i s1:s s2:s s3:s s4:i s5:s s6:i bits:i d1:D d2:i d3:s d4:D m1:d m2:d m3:d m4:d m5:d m6:d c1:i c2:s c3:d",
       r"""select o_orderkey, trim('  ' || o_orderpriority || ' ') as s1, substr(o_orderpriority, 3, 4) as s2, left(o_orderpriority, 3) as s3,
  length(o_orderpriority) as s4, replace(o_orderpriority, '-', '_') as s5,
  case when regexp_matches(o_orderpriority, '^[1-3]') and not regexp_matches(o_orderpriority, 'HIGH') then 1 else 0 end as s6,
  bit_length(o_orderpriority) as bits,
  cast(o_orderdate as date) as d1, date_diff('day', cast(o_orderdate as date), date '2002-01-01') as d2,
  strftime(o_orderdate, '%Y-%m-%d') as d3, cast(o_orderdate - interval 2 day as date) as d4,
  round(o_totalprice, -2) as m1, floor(o_totalprice / 10) % 10 as m2, abs(o_totalprice - 150000) as m3,
  sqrt(o_totalprice) as m4, least(o_totalprice, 100000) as m5, ln(greatest(o_totalprice, 1)) as m6,
  coalesce(nullif(o_custkey % 7, 0), -1) as c1, case when o_orderstatus like 'F%' then 'f' else 'x' end as c2,
  try_cast(substr(o_orderpriority, 1, 2) as double) as c3 from orders""")
def _(spark, d):
    c = F.col
    p = c("o_orderpriority")
    return read(spark, d, "orders").select(
        "o_orderkey", F.trim(F.concat(F.lit("  "), p, F.lit(" "))).alias("s1"), F.substring(p, 3, 4).alias("s2"),
        F.left(p, F.lit(3)).alias("s3"), F.length(p).alias("s4"), F.replace(p, F.lit("-"), F.lit("_")).alias("s5"),
        S.flag(p.rlike("^[1-3]") & ~p.rlike("HIGH")).alias("s6"), F.bit_length(p).alias("bits"),
        F.to_date("o_orderdate").alias("d1"), F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("d2"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d3"), F.date_sub(F.to_date("o_orderdate"), 2).alias("d4"),
        F.round("o_totalprice", -2).alias("m1"), F.pmod(F.floor(c("o_totalprice") / 10), F.lit(10)).alias("m2"),
        F.abs(c("o_totalprice") - 150000).alias("m3"), F.sqrt("o_totalprice").alias("m4"),
        F.least("o_totalprice", F.lit(100000.0)).alias("m5"), F.log(F.greatest("o_totalprice", F.lit(1.0))).alias("m6"),
        F.coalesce(F.nullif(c("o_custkey") % 7, F.lit(0)), F.lit(-1)).alias("c1"),
        F.when(c("o_orderstatus").like("F%"), "f").otherwise("x").alias("c2"),
        F.expr("try_cast(substring(o_orderpriority, 1, 2) as double)").alias("c3"))


@query("epoch_round_trip", "txn_id:i t:i secs:i day:D",
       "select event_id as txn_id, epoch_us(ts) as t, epoch_us(ts) // 1000000 as secs, cast(ts as date) as day from events")
def _(spark, d):
    t = micros("ts")
    return read(spark, d, "events").select(
        F.col("event_id").alias("txn_id"), t.alias("t"), F.expr("0L").alias("z"), F.to_date("ts").alias("day")
    ).withColumn("secs", F.expr("t div 1000000"))


@query("dedup_first", "l_orderkey:i l_linenumber:i l_partkey:i l_extendedprice:d",
       """select l_orderkey, l_linenumber, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn = 1""")
def _(spark, d):
    return dedup_first(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                       ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("collapse_max", "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_quantity:d",
       "select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey, max(l_quantity) as l_quantity from lineitem group by 1, 2")
def _(spark, d):
    return R.collapse_max(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("distinct_keys", "o_custkey:i", "select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 100000 group by 1")
def _(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_custkey").distinct()


@query("union_distinct", "k:i", "select o_custkey as k from orders union select c_custkey from customer where c_acctbal > 5000")
def _(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = read(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return R.union_distinct(a, b)


@query("set_difference", "k:i", "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def _(spark, d):
    return R.set_diff(read(spark, d, "customer").select(F.col("c_custkey").alias("k")),
                      read(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey"))


@query("set_intersection", "k:i", "select c_custkey as k from customer where c_acctbal > 0 intersect select o_custkey from orders where o_orderstatus = 'P'")
def _(spark, d):
    return R.set_intersect(read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")),
                           read(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey"))


@query("stack_labelled", "source:i n:i total:m",
       sql(FLOW, "select case when txn_id % 5 = 0 then 0 else 1 end as source, count(*) as n, sum(amt) as total from flow group by 1"))
def _(spark, d):
    flow = event_flow(spark, d)
    both = R.stack_labelled(flow.filter("txn_id % 5 <> 0"), flow.filter("txn_id % 5 = 0"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("total"))


@query("enumerated_counts", "acct:i n_click:i n_error:i n_purchase:i n_signup:i n_view:i",
       sql(FLOW, """select acct, count(*) filter (where chan = 'click') as n_click, count(*) filter (where chan = 'error') as n_error,
  count(*) filter (where chan = 'purchase') as n_purchase, count(*) filter (where chan = 'signup') as n_signup,
  count(*) filter (where chan = 'view') as n_view from flow group by 1"""))
def _(spark, d):
    flow = event_flow(spark, d)
    values = R.enumerate_values(flow, "chan")
    return flow.groupBy("acct").agg(*[F.count_if(F.col("chan") == v).alias(f"n_{v}") for v in values])


@query("top_n", "o_orderkey:i o_totalprice:d",
       "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def _(spark, d):
    return R.top_n(read(spark, d, "orders"), 15, "o_totalprice", "o_orderkey")


@query("rank_desc", "l_suppkey:i revenue:m",
       "select l_suppkey, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem group by 1")
def _(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return R.rank_desc(g, "revenue", "l_suppkey")
