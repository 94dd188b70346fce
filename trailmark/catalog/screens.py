"""Feature screening, folds, ranking, evaluation and model training."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.catalog.base import FLOW, LABELLED, hist, labelled, query, sql
from trailmark.catalog.blocks import EXTRA, FAMILIES
from trailmark.catalog.extras import scratch
from trailmark.experiment import run_experiment
from trailmark.operators import evaluation as V
from trailmark.operators import modeling as M
from trailmark.operators import ranking as R
from trailmark.operators import screening as L
from trailmark.plans.lineage import settle
from trailmark.plans.lookback import Measure, look_back
from trailmark.schema import read
from trailmark.sources import tables as T

FEATS = ["out_cnt", "in_cnt", "out_amt", "max_amt", "errors", "views_3d"]

WIDE = (FLOW, LABELLED, hist("14d", "labelled"),
        """wide as (select txn_id, count(*) filter (where dir = 0)::double as out_cnt, count(*) filter (where dir = 1)::double as in_cnt,
  round(coalesce(sum(amt) filter (where dir = 0), 0), 2) as out_amt, max(amt) as max_amt, count(*) filter (where chan = 'error')::double as errors,
  count(*) filter (where chan = 'view' and age <= 259200)::double as views_3d from hist group by 1)""",
        "feats as (select l.txn_id, l.acct, l.t, l.dt, l.label, l.split, out_cnt, in_cnt, out_amt, max_amt, errors, views_3d from labelled l join wide using (txn_id))")


def feature_frame(spark, d):
    """A small labelled wide frame, stored once: many screening and training jobs read it."""
    flow, anchors = labelled(spark, d)
    amt = F.col("amt")
    got = look_back(anchors, flow, [
        Measure("out_cnt", "count", ["14d"], F.col("dir") == 0), Measure("in_cnt", "count", ["14d"], F.col("dir") == 1),
        Measure("out_amt", "sum", ["14d"], F.col("dir") == 0, amt), Measure("max_amt", "max", ["14d"], None, amt),
        Measure("errors", "count", ["14d"], F.col("chan") == "error"), Measure("views", "count", ["3d"], F.col("chan") == "view")])
    wide = anchors.select("txn_id", "acct", "t", "dt", "label", "split").join(got, "txn_id").select(
        "txn_id", "acct", "t", "dt", "label", "split",
        *[F.col(f"{n}_14d").cast("double").alias(n) for n in ("out_cnt", "in_cnt")],
        F.round("out_amt_14d", 2).alias("out_amt"), F.col("max_amt_14d").alias("max_amt"),
        F.col("errors_14d").cast("double").alias("errors"), F.col("views_3d").cast("double").alias("views_3d"))
    return settle(wide)


def long_sql(source: str, feats=FEATS, keep: str = "label") -> str:
    return " union all ".join(f"select '{f}' as feature, {f} as value, {keep} from {source}" for f in feats)


CUTS = """cuts as (select feature, list_sort(list_distinct(list_transform(quantile_cont(value, [0.2, 0.4, 0.6, 0.8]), lambda x: round(x, 3)))) as c from {src} group by 1)"""
BINNED = """binned as (select l.feature, label, case when value is null then 'Missing'
  else lpad(cast(len(list_filter(c, lambda x: x < value)) + 1 as varchar), 2, '0') end as bin from {src} l join cuts using (feature))"""
WOE = """cells as (select feature, bin, count(*) as n, sum(label) as bad from binned group by 1, 2),
tot as (select feature, sum(n) as tn, sum(bad) as tb from cells group by 1),
woe as (select feature, bin, n, bad, bad * 100.0 / n as bad_rate, n * 100.0 / tn as pct, (bad + 0.0001) / tb * 100 as bad_pct,
  (n - bad + 0.0001) / (tn - tb) * 100 as good_pct, ln(((bad + 0.0001) / tb) / ((n - bad + 0.0001) / (tn - tb))) as woe,
  ((bad + 0.0001) / tb - (n - bad + 0.0001) / (tn - tb)) * ln(((bad + 0.0001) / tb) / ((n - bad + 0.0001) / (tn - tb))) as iv from cells join tot using (feature))"""
TRAIN = (*WIDE, "train as (select * from feats where split = 'train')")


@query("iv_quantile", "feature:s bin:s n:i bad:i bad_rate:d pct:d bad_pct:d good_pct:d woe:d iv:d",
       sql(*TRAIN, f"long as ({long_sql('train')})", CUTS.format(src="long"), BINNED.format(src="long"), WOE, "select * from woe"))
def _(spark, d):
    return L.iv_quantile(feature_frame(spark, d).filter("split = 'train'"), FEATS, "label")


@query("iv_quantile_lines", "feature:s bin:s n:i bad:i woe:d iv:d",
       sql("src as (select l_quantity, l_discount, l_extendedprice, case when l_quantity < 25 then l_tax end as tax, 1.0 as constant, case when l_returnflag = 'R' then 1 else 0 end as label from lineitem)",
           f"long as ({long_sql('src', ['l_quantity', 'l_discount', 'tax', 'constant'])})", CUTS.format(src="long"), BINNED.format(src="long"), WOE,
           "select * from woe"))
def _(spark, d):
    src = read(spark, d, "lineitem").select("l_quantity", "l_discount", F.when(F.col("l_quantity") < 25, F.col("l_tax")).alias("tax"), F.lit(1.0).alias("constant"),
                                            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    return L.iv_quantile(src, ["l_quantity", "l_discount", "tax", "constant"], "label")


@query("iv_category", "feature:s bin:s n:i bad:i woe:d iv:d",
       sql("src as (select lang, source, coalesce(quality, 0) as label from documents left join labels using (doc_id))",
           "long as (select 'lang' as feature, lang as value, label from src union all select 'source', source, label from src)",
           "binned as (select feature, label, coalesce(value, 'Missing') as bin from long)", WOE, "select * from woe"))
def _(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return L.iv_category(docs.select("lang", "source", F.coalesce("quality", F.lit(0)).alias("label")), ["lang", "source"], "label")


@query("iv_ordered", "feature:s bin:s place:i n:i bad:i bad_rate:d pct:d woe:d iv:d",
       sql("src as (select lang, source, coalesce(quality, 0) as label from documents left join labels using (doc_id))",
           "tot as (select count(*) as tn, sum(label) as tb from src)",
           "listed as (select unnest(['fr', 'en', 'xx']) as bin, unnest([1, 2, 3]) as place)",
           "cells as (select 'lang' as feature, bin, place, count(label) as n, coalesce(sum(label), 0) as bad from listed left join src on lang = bin group by 1, 2, 3 "
           "union all select 'source', coalesce(source, 'Missing'), null, count(*), sum(label) from src group by 2)",
           "share as (select *, (bad + 0.0001) / tb as pb, (n - bad + 0.0001) / (tn - tb) as pg from cells, tot)",
           "select feature, bin, place, n, bad, bad * 100.0 / nullif(n, 0) as bad_rate, n * 100.0 / tn as pct, ln(pb / pg) as woe, (pb - pg) * ln(pb / pg) as iv from share"))
def _(spark, d):
    """Categories in a given order, one of them without rows, beside a feature without an order."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("lang", "source", F.coalesce("quality", F.lit(0)).alias("label"))
    return L.iv_category(docs, ["lang", "source"], "label", {"lang": ["fr", "en", "xx"]})


@query("iv_filter", "feature:s iv:d",
       sql(*TRAIN, f"long as ({long_sql('train')})", CUTS.format(src="long"), BINNED.format(src="long"), WOE,
           "select feature, sum(iv) as iv from woe group by 1 having sum(iv) >= 0.005"))
def _(spark, d):
    iv = L.iv_total(L.iv_quantile(feature_frame(spark, d).filter("split = 'train'"), FEATS, "label"))
    return L.keep_iv(iv, 0.005)


@query("drift_iv", "feature:s drift:d status:s",
       sql(*WIDE, "mem as (select *, case when split = 'train' then 1 else 0 end as member from feats)",
           f"long as ({long_sql('mem', keep='member as label')})", CUTS.format(src="long"), BINNED.format(src="long"), WOE,
           """select feature, sum(iv) as drift, case when sum(iv) < 0.1 then 'Stable' when sum(iv) < 0.25 then 'Slight' else 'SIGNIFICANT' end as status from woe group by 1"""))
def _(spark, d):
    f = feature_frame(spark, d)
    return L.drift_iv(f.filter("split = 'train'"), f.filter("split = 'test'"), FEATS)


@query("population_stability", "feature:s psi:d",
       sql(*WIDE, "mem as (select *, case when split = 'train' then 1 else 0 end as member from feats)",
           f"long as ({long_sql('mem', keep='member as label')})", CUTS.format(src="(select * from long where label = 1)"), BINNED.format(src="long"), WOE,
           "select feature, sum(iv) as psi from woe group by 1"))
def _(spark, d):
    f = feature_frame(spark, d)
    return L.psi(f.filter("split = 'train'"), f.filter("split = 'test'"), FEATS)


def corr_sql() -> str:
    parts = [f"select '{a}' as f1, '{b}' as f2, abs(corr({a}, {b})) as r from train" for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
    return " union all ".join(parts)


@query("corr_pairs", "f1:s f2:s r:d", sql(*TRAIN, corr_sql()))
def _(spark, d):
    return L.corr_pairs(feature_frame(spark, d).filter("split = 'train'"), FEATS)


DROPPED = """iv as (select feature, sum(iv) as iv from woe group by 1),
pl as (select feature, row_number() over (order by iv desc, feature) as p from iv), pr as ({corr}),
hp as (select row_number() over (order by least(a.p, b.p), greatest(a.p, b.p)) as k, case when a.p < b.p then a.feature else b.feature end as good,
  case when a.p < b.p then b.feature else a.feature end as bad from pr join pl a on f1 = a.feature join pl b on f2 = b.feature where r >= 0.6),
walk as (select 0::bigint as k, []::varchar[] as gone union all
  select h.k, case when list_contains(gone, good) or list_contains(gone, bad) then gone else list_append(gone, bad) end from walk join hp h on h.k = walk.k + 1)"""


@query("drop_correlated", "feature:s",
       sql(*TRAIN, f"long as ({long_sql('train')})", CUTS.format(src="long"), BINNED.format(src="long"), WOE, DROPPED.format(corr=corr_sql()),
           "select feature from pl where not list_contains((select gone from walk order by k desc limit 1), feature)").replace("with ", "with recursive ", 1))
def _(spark, d):
    train = feature_frame(spark, d).filter("split = 'train'")
    iv = L.iv_total(L.iv_quantile(train, FEATS, "label"))
    gone = L.drop_correlated(L.corr_pairs(train, FEATS), iv, 0.6)
    return spark.createDataFrame([(f,) for f in FEATS if f not in gone], "feature string")


@query("stratified_folds", "txn_id:i label:i fold:i",
       sql(FLOW, LABELLED, """select txn_id, label, (row_number() over (partition by label order by md5(cast(txn_id as varchar)), txn_id) - 1) % 5 as fold from labelled"""))
def _(spark, d):
    return R.stratified_folds(labelled(spark, d)[1])


SCORED = "scored as (select txn_id, acct, t, label, round((errors * 3 + out_cnt) / (1 + in_cnt), 1) as score, out_cnt, in_cnt, out_amt, max_amt, errors, views_3d from feats)"
RANKED = "ranked as (select *, row_number() over (order by score desc, md5(cast(txn_id as varchar)), txn_id) as rank from scored)"


def scored_frame(spark, d):
    f = feature_frame(spark, d)
    return f.withColumn("score", F.round((F.col("errors") * 3 + F.col("out_cnt")) / (1 + F.col("in_cnt")), 1))


@query("score_rank", "txn_id:i score:d rank:i", sql(*WIDE, SCORED, RANKED, "select txn_id, score, rank from ranked"))
def _(spark, d):
    return R.score_rank(scored_frame(spark, d))


TOPK = """topk as (select rank as top_k, sum(label) over (order by rank rows unbounded preceding) as hits, score as s, (select sum(label) from scored) as t from ranked),
tab as (select top_k, hits, round(hits / top_k::double, 4) as precision, round(case when t > 0 then hits / t::double else 0 end, 4) as recall,
  round(case when hits > 0 then 2.0 * hits / (top_k + t) else 0 end, 4) as f1, round(s, 6) as score_at_k from topk where top_k % 10 = 0 and top_k <= 1000)"""


@query("topk_table", "top_k:i hits:i precision:d recall:d f1:d score_at_k:d",
       sql(*WIDE, SCORED, RANKED, TOPK, "select * from tab"))
def _(spark, d):
    return V.topk_table(scored_frame(spark, d))


@query("best_k", "top_k:i f1:d hits:i", sql(*WIDE, SCORED, RANKED, TOPK, "select top_k, f1, hits from tab order by f1 desc, top_k limit 1"))
def _(spark, d):
    return V.best_k(V.topk_table(scored_frame(spark, d)))


@query("missed_positives", "txn_id:i acct:i score:d rank:i",
       sql(*WIDE, SCORED, RANKED, "select txn_id, acct, score, rank from ranked where label = 1 and rank > 100"))
def _(spark, d):
    return V.missed_positives(R.score_rank(scored_frame(spark, d)), 100)


def gaps_sql() -> str:
    return " union all ".join(
        f"select '{f}' as feature, avg({f}) filter (where rank <= 100) as hit_mean, avg({f}) filter (where rank > 100) as miss_mean from ranked where label = 1" for f in FEATS)


@query("feature_gaps", "feature:s hit_mean:d miss_mean:d gap:d",
       sql(*WIDE, SCORED, RANKED, f"g as ({gaps_sql()})", "select *, hit_mean - miss_mean as gap from g order by abs(hit_mean - miss_mean) desc, feature limit 4"))
def _(spark, d):
    return V.feature_gaps(R.score_rank(scored_frame(spark, d)), FEATS, 100, 4)


@query("missed_history_summary", "txn_id:i total:i out_cnt:i in_cnt:i total_amt:d out_amt:d small_out:i night:i",
       sql(*WIDE, SCORED, RANKED, "missed as (select * from ranked where label = 1 and rank > 100 order by rank limit 10)",
           """select m.txn_id, count(f.txn_id) as total, count(*) filter (where dir = 0) as out_cnt, count(*) filter (where dir = 1) as in_cnt, sum(amt) as total_amt,
  coalesce(sum(amt) filter (where dir = 0), 0) as out_amt, count(*) filter (where dir = 0 and amt <= 100) as small_out, count(*) filter (where hh >= 22 or hh <= 5) as night
  from missed m join flow f on m.acct = f.acct and f.t <= m.t group by 1"""))
def _(spark, d):
    flow, _ = labelled(spark, d)
    missed = R.top_n(V.missed_positives(R.score_rank(scored_frame(spark, d)), 100), 10, -F.col("rank"))
    return V.history_summary(missed, flow)


@query("missed_histories", "anchor_id:i recency:i txn_id:i dir:i amt:d chan:s",
       sql(*WIDE, SCORED, RANKED, "missed as (select * from ranked where label = 1 and rank > 100 order by rank limit 10)",
           """select m.txn_id as anchor_id, row_number() over (partition by m.txn_id order by f.t desc, f.txn_id desc) as recency, f.txn_id, dir, amt, chan
  from missed m join flow f on m.acct = f.acct and f.t <= m.t"""))
def _(spark, d):
    flow, _ = labelled(spark, d)
    missed = R.top_n(V.missed_positives(R.score_rank(scored_frame(spark, d)), 100), 10, -F.col("rank"))
    return R.last_n_before(missed, flow, None)


@query("feature_gate", "n_new:i passed:i",
       """select count(*) as n_new, case when count(*) > 0 then 1 else 0 end as passed from (
  select distinct chan from (select event_type as chan from events where value > 400) except select distinct event_type from events where event_id % 3 = 0 and value > 480)""")
def _(spark, d):
    e = read(spark, d, "events")
    current = e.filter("value > 400").select(F.col("event_type").alias("feature")).distinct()
    previous = e.filter("event_id % 3 = 0 and value > 480").select(F.col("event_type").alias("feature")).distinct()
    return L.feature_gate(previous, current)


def tree_sql(folds: int = 3, leaves: int = 4) -> list[str]:
    """The supervised bins of ``long`` (feature, value, label, fold) as CTEs; ``bins`` has the table."""
    out = [f"""tr as (select feature, s, value, count(*)::double as n, sum(label)::double as b from long, (select unnest(range({folds + 1})) as s)
  where value is not null and (s = {folds} or fold <> s) and feature in (select feature from long where value is not null group by 1 having count(*) >= {folds}) group by 1, 2, 3)""",
           "onward as (select *, lead(value) over (partition by feature, s order by value) as nx from tr)",
           "cuts0 as (select feature, s, 0 as step, 0.0::double as cut, 0.0::double as nx from tr where false)"]
    for k in range(1, leaves):
        out.append(f"""at{k} as (select n.*, coalesce(len(list_filter(c, lambda x: x < value)), 0) as node from onward n
  left join (select feature, s, list(cut) as c from cuts{k - 1} group by 1, 2) using (feature, s))""")
        out.append(f"""run{k} as (select *, sum(n) over w as ln, sum(b) over w as lb, sum(n) over p as tn, sum(b) over p as tb from at{k}
  window w as (partition by feature, s, node order by value rows unbounded preceding), p as (partition by feature, s, node))""")
        out.append(f"""gain{k} as (select *, 2.0 * tb * (tn - tb) / tn - 2.0 * lb * (ln - lb) / ln - 2.0 * (tb - lb) * ((tn - ln) - (tb - lb)) / (tn - ln) as gain
  from run{k} where ln < tn and tb > 0 and tb < tn)""")
        out.append(f"""cuts{k} as (select * from cuts{k - 1} union all select feature, s, {k}, value, nx from gain{k} where gain > 1e-9
  qualify row_number() over (partition by feature, s order by gain desc, value) = 1)""")
    last = f"cuts{leaves - 1}"
    out += [
        f"sizes as (select unnest(range(2, {leaves + 1})) as m)",
        f"marks as (select feature, s, m, list(cut) filter (where step < m) as c, list((cut + nx) / 2) filter (where step < m) as t from {last}, sizes group by 1, 2, 3)",
        f"every as (select distinct feature, s, m from tr, sizes where s < {folds})",
        """rates as (select e.feature, e.s, e.m, coalesce(len(list_filter(c, lambda x: x < value)), 0) as leaf, sum(b) / sum(n) as rate
  from every e join tr using (feature, s) left join marks k on (k.feature, k.s, k.m) = (e.feature, e.s, e.m) group by 1, 2, 3, 4)""",
        """held as (select e.feature, e.s, e.m, coalesce(len(list_filter(t, lambda x: x < value)), 0) as leaf, sum(label) as b, count(*) - sum(label) as g
  from every e join long l on l.feature = e.feature and l.fold = e.s and l.value is not null left join marks k on (k.feature, k.s, k.m) = (e.feature, e.s, e.m) group by 1, 2, 3, 4)""",
        "ranked as (select r.feature, r.s, r.m, rate, sum(coalesce(b, 0)) as b, sum(coalesce(g, 0)) as g from rates r left join held h on (h.feature, h.s, h.m, h.leaf) = (r.feature, r.s, r.m, r.leaf) group by 1, 2, 3, 4)",
        """below as (select *, coalesce(sum(g) over (partition by feature, s, m order by rate rows between unbounded preceding and 1 preceding), 0) as low,
  sum(b) over (partition by feature, s, m) as tb, sum(g) over (partition by feature, s, m) as tg from ranked)""",
        "areas as (select feature, s, m, case when any_value(tb) = 0 or any_value(tg) = 0 then 0.5 else sum(b * (low + g / 2.0)) / any_value(tb * tg) end as area from below group by 1, 2, 3)",
        """best as (select feature, m from (select feature, m, round(avg(area), 9) as mean, round(stddev_pop(area), 9) as spread from areas group by 1, 2)
  qualify row_number() over (partition by feature order by mean desc, spread, m) = 1)""",
        f"""leaf as (select l.*, case when value is null then null when best.m is null then -1 else coalesce(len(list_filter(c, lambda x: x < value)), 0) end as leaf
  from long l left join best using (feature) left join marks k on k.feature = l.feature and k.s = {folds} and k.m = best.m)""",
        """bins as (select feature, min(value) as lo, max(value) as hi, count(*) as n, sum(label) as bad from leaf
  group by feature, leaf, case when leaf = -1 then value end)""",
        """stats as (select *, sum(n) over f as tn, sum(bad) over f as tb, (bad + 0.0001) / sum(bad) over f as pb, (n - bad + 0.0001) / (sum(n) over f - sum(bad) over f) as pg
  from bins window f as (partition by feature))""",
    ]
    return out


TREE = "select feature, lo, hi, n, bad, bad * 100.0 / n as bad_rate, n * 100.0 / tn as pct, ln(pb / pg) as woe, (pb - pg) * ln(pb / pg) as iv from stats"
TREE_SPEC = "feature:s lo:d hi:d n:i bad:i bad_rate:d pct:d woe:d iv:d"


def fold_sql(source: str, id_col: str) -> str:
    return f"select *, (row_number() over (partition by label order by md5(cast({id_col} as varchar)), {id_col}) - 1) % 3 as fold from {source}"


@query("iv_tree", TREE_SPEC, sql(*TRAIN, f"folded as ({fold_sql('train', 'txn_id')})", f"long as ({long_sql('folded', keep='label, fold')})", *tree_sql(), TREE))
def _(spark, d):
    return L.iv_tree(feature_frame(spark, d).filter("split = 'train'"), FEATS, "label")


ORDERS = ["o_totalprice", "customer", "priority", "constant", "few", "gone"]


@query("iv_tree_orders", TREE_SPEC,
       sql("""src as (select o_orderkey, o_totalprice, o_custkey::double as customer, case when o_totalprice < 200000 then cast(left(o_orderpriority, 1) as double) end as priority, 1.0 as constant,
  case when o_orderkey <= 2 then o_totalprice end as few, null::double as gone, case when o_totalprice % 50000 < 9000 or o_custkey % 100 > 90 then 1 else 0 end as label from orders)""",
           f"folded as ({fold_sql('src', 'o_orderkey')})", f"long as ({long_sql('folded', ORDERS, 'label, fold')})", *tree_sql(), TREE))
def _(spark, d):
    """Columns of many distinct values, of a few, of one, of two rows and of none."""
    price = F.col("o_totalprice")
    src = read(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("customer"), F.when(price < 200000, F.substring("o_orderpriority", 1, 1).cast("double")).alias("priority"),
        F.lit(1.0).alias("constant"), F.when(F.col("o_orderkey") <= 2, price).alias("few"), F.lit(None).cast("double").alias("gone"),
        F.when((price % 50000 < 9000) | (F.col("o_custkey") % 100 > 90), 1).otherwise(0).alias("label"))
    return L.iv_tree(src, ORDERS, "label", id_col="o_orderkey")


QUICK = {"maxIter": 3, "maxDepth": 3}


# Trained models have no SQL twin. The queries return what must hold of their results whatever the model is.


@query("oof_scores", "txn_id:i label:i fold:i times:i in_range:i",
       sql(*TRAIN, """select txn_id, label, (row_number() over (partition by label order by md5(cast(txn_id as varchar)), txn_id) - 1) % 3 as fold,
  1 as times, 1 as in_range from train"""))
def _(spark, d):
    folds = R.stratified_folds(feature_frame(spark, d).filter("split = 'train'"), k=3)
    scored = M.oof_scores(folds, FEATS, folds=3, params=QUICK)[0]
    return scored.groupBy("txn_id", "label", "fold").agg(F.count("score").alias("times"), F.min(F.col("score").between(0, 1).cast("int")).alias("in_range"))


@query("model_persistence", "n:i differing:i", sql(*TRAIN, "select count(*) as n, 0 as differing from train"))
def _(spark, d):
    """Scores of a model and of its stored copy."""
    train, path = feature_frame(spark, d).filter("split = 'train'"), scratch(spark, "model")
    model = M.fit(train, FEATS, params=QUICK)
    M.save_model(model, path)
    mine, again = (M.score(m, train, FEATS).select("txn_id", "score") for m in (model, M.load_model(path)))
    both = mine.join(again.withColumnRenamed("score", "again"), "txn_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("score") - F.col("again")) > 0).alias("differing"))


@query("importance_report", "feature:s in_range:i total:d",
       " union all ".join(f"select '{f}' as feature, 1 as in_range, 1.0 as total" for f in FEATS))
def _(spark, d):
    train = feature_frame(spark, d).filter("split = 'train'")
    got = M.importance_report(M.importance(spark, M.fit(train, FEATS, params=QUICK), FEATS))
    total = got.agg(F.sum("importance").alias("total"))
    return got.crossJoin(F.broadcast(total)).select("feature", F.col("importance").between(0, 1).cast("int").alias("in_range"), "total")


@query("importance_screen", "kept:i known:i", "select 4 as kept, 4 as known")
def _(spark, d):
    train = feature_frame(spark, d).filter("split = 'train'")
    kept = spark.createDataFrame([(f,) for f in M.importance_screen(train, FEATS, 4, params=QUICK)], "feature string")
    return kept.agg(F.count_distinct("feature").alias("kept"), F.count_if(F.col("feature").isin(FEATS)).alias("known"))


#: Trees of a trial in the registered queries; the library's default is 300 to 1000 in steps of 100, for 100 trials.
ITERATIONS = (6, 12, 3)
BOUNDS = """pos as (select sum(label) as p from train),
bounds as (select 'num_leaves' as name, 6::double as lo, least(31, greatest(8, p // 3))::double as hi from pos union all select 'learning_rate', 0.01, 0.1 union all select 'n_estimators', 6, 12
  union all select 'min_child_samples', greatest(3, greatest(1, p // 2) // 4), greatest(greatest(3, greatest(1, p // 2) // 4) + 10, greatest(1, p // 2)) from pos
  union all select 'max_depth', 3, 8 union all select 'feature_fraction', 0.2, 0.8 union all select 'bagging_fraction', 0.6, 0.95
  union all select 'lambda_l1', 0.01, 1 union all select 'lambda_l2', 0.01, 1)"""


@query("parameter_search", "name:s lo:d hi:d rung:i trials:i inside:i falling:i stopped:i",
       sql(*TRAIN, BOUNDS, "rungs as (select unnest([0, 1]) as rung, unnest([4, 1]) as trials)",
           "select name, lo, hi, rung, trials, 1 as inside, 1 as falling, 1 as stopped from bounds, rungs"))
def _(spark, d):
    """Nine dimensions within bounds that follow the positives, four trials of which the best goes on, the least loss so far never rising."""
    folds = R.stratified_folds(feature_frame(spark, d).filter("split = 'train'"), k=2)
    positives = folds.agg(F.sum("label")).first()[0]
    space = M.search_space(int(positives), len(FEATS), 2, ITERATIONS)
    _, loss, table = M.search(folds, FEATS, folds=2, trials=4, space=space)
    ordered = Window.partitionBy("rung").orderBy("trial")
    table = table.withColumn("falls", F.coalesce(F.col("least") <= F.lag("least").over(ordered), F.lit(True)))
    long = table.unpivot(["rung", "trial", "trees", "rounds", "loss", "falls"], list(space), "name", "value")
    limits = spark.createDataFrame([(n, float(r[1]), float(r[2])) for n, r in space.items()], "name string, lo double, hi double")
    return long.join(F.broadcast(limits), "name").groupBy("name", "lo", "hi", "rung").agg(
        F.count_distinct("trial").alias("trials"), F.min(F.col("value").between(F.col("lo"), F.col("hi")).cast("int")).alias("inside"),
        F.min((F.col("falls") & (F.col("loss") >= loss - 1e-12) | (F.col("rung") == 0) & F.col("falls")).cast("int")).alias("falling"),
        F.min(F.col("rounds").between(1, F.col("trees")).cast("int")).alias("stopped"))


RUN_BLOCKS = ["sparse_probe", "inflow_burst", "channel_mix", "source_concentration"]


@query("experiment_run", "run:i positives:i f1_holds:i k_holds:i features_hold:i gate:i logged:i",
       sql(*TRAIN, """select unnest([1, 2]) as run, case when run = 1 then sum(label) end as positives, case when run = 1 then 1 end as f1_holds, case when run = 1 then 1 end as k_holds,
  case when run = 1 then 1 end as features_hold, case when run = 1 then 1 else 0 end as gate, 1 as logged from train""".replace("select unnest([1, 2]) as run, ", "select run, ").replace("from train", "from train, (select unnest([1, 2]) as run) group by run")))
def _(spark, d):
    """A run over four feature blocks with a search, and a second one over the same data that the gate stops; counts must add up, both are logged."""
    flow, anchors = labelled_rich(spark, d)
    root = scratch(spark, "experiment")
    kw = dict(tag="v1", families=FAMILIES, iv_min=0.0001, keep_top=24, folds=3, trials=2, iterations=ITERATIONS, screen_params=QUICK)
    first = run_experiment(anchors, flow, RUN_BLOCKS, root, 1, **kw)
    both = settle(first.unionByName(run_experiment(anchors, flow, RUN_BLOCKS, root, 2, **kw)))
    logged = T.read_runs(spark, f"{root}/runs").groupBy(F.col("run").alias("__run")).agg(F.count(F.lit(1)).alias("logged"))
    return both.join(logged, both["run"] == logged["__run"]).select(
        "run", (F.col("hit_y") + F.col("missed_y")).alias("positives"), F.col("f1").between(0, 1).cast("int").alias("f1_holds"),
        F.col("best_k").between(10, 1000).cast("int").alias("k_holds"), F.col("n_features").between(1, 24).cast("int").alias("features_hold"),
        F.col("gate_passed").cast("int").alias("gate"), "logged")


def labelled_rich(spark, d):
    """Labelled anchors and the flow with the extra columns of the feature blocks, stored once."""
    flow, anchors = labelled(spark, d)
    extra = {n: F.expr(e) for n, e in EXTRA.items()}
    return flow.withColumns(extra), settle(anchors.withColumns(extra))
