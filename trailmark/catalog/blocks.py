"""One query per feature block. Their SQL twins join every anchor with its whole history."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trailmark.catalog.base import FLOW, query, sql
from trailmark.operators import features as B
from trailmark.schema import WINDOWS, event_flow

# Families over the event types of the test log.
FAMILIES = {
    "topup": ["click"], "payment": ["view"], "va": ["view"], "cash_out": ["click", "view"], "edc": ["click", "error"], "edc_only": ["click"],
    "clearing": ["signup"], "atm_cash": ["error"], "withdrawal": ["error"], "atm": ["error"], "self_transfer": ["signup"],
    "own_product": ["signup", "view"], "salary": ["click"], "merchant_in": ["purchase"], "settlement": ["purchase", "signup"],
    "merchant_settle": ["purchase", "signup"], "merchant_dominant": ["purchase"], "merchant_pay": ["view"], "cash_deposit": ["click"],
    "batch_in": ["signup"], "bash": ["error"], "bash_in": ["error", "signup"], "bash_wide": ["error", "signup", "view"], "spending": ["click", "error"],
}
EXTRA = {
    "is_bash": "case when txn_id % 6 = 0 then 1 else 0 end",
    "is_cross": "case when txn_id % 7 = 0 then 1 else 0 end",
    "is_va": "case when txn_id % 8 = 0 then 1 else 0 end",
    "term": "case when txn_id % 9 = 0 then 'IB SME' else 'WEB' end",
    "midnight": "case when hh = 0 then 1 else 0 end",
}
TAGS_SQL = ", ".join("(" + " or ".join(f"chan like '%{w}%'" for w in ws) + f") as g_{n}" for n, ws in FAMILIES.items())
RICH = f"rich as (select *, round(amt, 2) as cents, {', '.join(f'{e} as {n}' for n, e in EXTRA.items())}, {TAGS_SQL} from flow)"
HIST = """hist as (select a.txn_id, a.t as t0, a.amt as amt0, a.party as party0, a.chan as chan0, f.txn_id as h_id, (a.t - f.t) / 1e6 as age, f.* exclude (txn_id)
  from (select * from rich where chan = 'purchase') a left join rich f on a.acct = f.acct and a.t - f.t > 0 and a.t - f.t <= 12960000000000)"""


def rich_flow(spark, d):
    return event_flow(spark, d).withColumns({n: F.expr(e) for n, e in EXTRA.items()})


def block_sql(name: str) -> str:
    """Plain SQL: base aggregates with FILTER, and per-key counts, over the joined history."""
    found = B.tokens([name])
    aggs, ctes, joins = [], [], []

    def side(cte: str, body: str) -> None:
        ctes.append(f"{cte} as ({body})")
        joins.append(f"left join {cte} using (txn_id)")

    for base, w in sorted(found):
        tok, inside = f"{base}_{w}", f"h_id is not null and age <= {WINDOWS[w]}"
        if base in B.MEASURES:
            kind, cond, value = B.MEASURES[base]
            where = inside if cond is None else f"{inside} and {cond}"
            if kind == "peak":
                side(tok + "_q", f"select txn_id, max(c) as {tok} from (select txn_id, dt, count(*) as c from hist where {where} group by 1, 2) group by 1")
                continue
            expr = {"count": "count(*)", "days": "count(distinct dt)", "sum": f"sum({value})", "min": f"min({value})", "max": f"max({value})"}[kind]
            expr = f"{expr} filter (where {where})"
            aggs.append(f"{f'coalesce({expr}, 0)' if kind == 'sum' else expr} as {tok}")
        elif base in B.PROFILES:
            key, cond, stat, nulls = B.PROFILES[base]
            where = f"{inside} and {cond}" + ("" if nulls else f" and {key} is not null")
            out = {"distinct": "count(*)", "peak": "max(c)", "rows": "sum(c)", "squares": "sum(c * c)", "repeat2": "sum(c) filter (where c >= 2)", "repeat3": "sum(c) filter (where c >= 3)"}[stat]
            side(tok + "_q", f"select txn_id, coalesce({out}, 0) as {tok} from (select txn_id, {key}, count(*) as c from hist where {where} group by 1, 2) group by 1")
        elif base in ("cur_party", "cur_chan"):
            col = base[4:]
            aggs.append(f"count(*) filter (where {inside} and dir = 0 and {col} is not distinct from {col}0) as {tok}")
        elif base in ("out_p50", "out_p95"):
            aggs.append(f"quantile_disc(amt, 0.{base[-2:]}) filter (where {inside} and dir = 0) as {tok}")
        elif base == "prank":
            aggs.append(f"(count(*) filter (where {inside} and dir = 0 and amt <= amt0)) / nullif(count(*) filter (where {inside} and dir = 0), 0)::double as {tok}")
        elif base in ("gap_min", "gap_max", "gap_median", "gap_cv"):
            out = {"gap_min": "min(gap)", "gap_max": "max(gap)", "gap_median": "quantile_disc(gap, 0.5)", "gap_cv": "stddev_samp(gap) / avg(gap)"}[base]
            gaps = f"select txn_id, (t - lag(t) over (partition by txn_id order by t, h_id)) / 1e6 as gap from hist where {inside} and dir = 0"
            side(tok + "_q", f"select txn_id, {out} as {tok} from ({gaps}) where gap > 0 group by 1")
        elif base == "atm_rapid":
            gaps = f"select txn_id, (t - lag(t) over (partition by txn_id order by t, h_id)) / 1e6 as gap from hist where {inside} and dir = 0 and g_atm_cash"
            side(tok + "_q", f"select txn_id, count(*) filter (where gap <= 120) as {tok} from ({gaps}) group by 1")
        elif base == "source_top_share":
            keys = "select txn_id, party, sum(amt::decimal(26,6)) as s from hist where h_id is not null and dir = 1 and party is not null group by 1, 2"
            side(tok + "_q", f"select txn_id, max(s) / nullif(sum(s), 0) as {tok} from ({keys}) group by 1")
        else:
            raise ValueError(f"no SQL for token {tok} of {name}")
    for word, key, cond, lo in (("sources_older14", "party", "dir = 1", 1_209_600), ("out_chans_older3", "chan", "dir = 0", 259_200)):
        if B.uses([name], word):
            aggs.append(f"count(distinct {key}) filter (where {cond} and age > {lo}) as {word}")
    for n, cond in (("out", "dir = 0"), ("in", "dir = 1")):
        if B.uses([name], f"last_{n}_older3"):
            aggs.append(f"max(t) filter (where {cond} and age > 259200) as last_{n}_older3")
    if B.uses([name], "mode_hour"):
        ranked = "select txn_id, hh, row_number() over (partition by txn_id order by count(*) desc, hh) as rn from hist where h_id is not null and dir = 0 group by txn_id, hh"
        side("mode_q", f"select txn_id, hh as mode_hour from ({ranked}) where rn = 1")
    zero = [f"{b}_{w}" for b, w in found if (b in B.PROFILES) or b in ("peak", "atm_rapid")]
    formulas = []
    for feat, f in B.BLOCKS[name].items():
        for z in zero:
            f = re.sub(rf"\b{z}\b", f"coalesce({z}, 0)", f)
        formulas.append(f"{f} as {feat}")
    base = f"agg as (select txn_id, {', '.join(aggs) if aggs else 'count(*) as unused'} from hist group by 1)"
    body = f"select txn_id, {', '.join(formulas)} from (select * from rich where chan = 'purchase') join agg using (txn_id) {' '.join(joins)}"
    return sql(FLOW, RICH, HIST, base, *ctes, body)


def spec(name: str) -> str:
    whole = re.compile(r"_cnt$|_nunique$|_days$|_flag$|^f_|^evt_|unseen|_rare$|sources$|max_repeat$|party_out$|activity_sum")
    coarse = re.compile(r"zscore|skewness|gap_sec|max_gap|median_gap|min_gap|dispersion")
    real = ("d_last_out_gap_days", "d_first_bash_out_gap_days", "d_dormancy_out_gap_days", "d_dormancy_in_gap_days",
            "d_small100_over_sqrt_cnt", "d_in_amt_uniformity_x_sources")
    kinds = dict.fromkeys(real, "d")
    out = []
    for feat in B.BLOCKS[name]:
        kind = kinds.get(feat) or ("m" if coarse.search(feat) else "i" if whole.search(feat) else "d")
        out.append(f"{feat}:{kind}")
    return "txn_id:i " + " ".join(out)


def register(name: str) -> None:
    @query(f"{name}_block", spec(name), block_sql(name))
    def _(spark, d):
        flow = rich_flow(spark, d)
        return B.build(flow.filter("chan = 'purchase'"), flow, [name], FAMILIES)


for _name in B.BLOCKS:
    register(_name)
