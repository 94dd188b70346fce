"""Candidates, the wide rule row, the 37 alert rules and the exempted alerts, on statements with texts.

The SQL twins are written from the definitions, not from the specifications of the Spark side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.catalog.base import FLOW, SNAPS, days_hist, query, sql
from trailmark.catalog.sequence import PAIRS, RUNS
from trailmark.operators import rulerow as W
from trailmark.operators import rules as M
from trailmark.operators import sequences as Q
from trailmark.operators.counters import statement_counters
from trailmark.operators.statements import with_text_flags
from trailmark.plans.lineage import settle
from trailmark.schema import read, statement_flow


def statements(spark, d):
    """Statements with the attributes of their texts and a running balance."""
    return Q.running_balance(with_text_flags(statement_flow(spark, d)))


def frame(spark, d, predicates):
    flow = settle(W.marked(W.of_interest(statements(spark, d))))
    return W.rule_row(settle(W.chosen(flow)), flow, predicates)


def any_like(text: str, words: str) -> str:
    return "(" + " or ".join(f"{text} like '%{w}%'" for w in words.split()) + ")"


def bit(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


STATEMENTS = (
    FLOW.replace("flow as", "log as"),
    """raw as (select * exclude (amt, novel, party), round(amt * 100, 0) as amt, party as p, cast(party as int) as k,
  ['跨行网银贷记', '支付宝转账', '转账', '往来款', '普通贷记来帐', '委托实时贷记', '数字人民币兑回', '微信提现', '商品购买', '商户消费', '基金申购', '借款发放', '贷款提前归还', '代付代付退款', '手续费', ''][(txn_id * 7 + acct) % 17 + 1] as remark,
  ['转存', '现金', '取现', 'ATM取款', '冲销', '转贷记卡'][txn_id % 9 + 1] as summary from log)""",
    """texts as (select *, case when k % 11 = 0 then '顺德贸易公司' else '户' || (k % 30) end as party, '户' || (acct % 30) as own_name,
  case k % 4 when 0 then '6222052' || lpad(p, 9, '0') when 1 then '6217' || lpad(p, 15, '0') when 2 then '2088' || lpad(p, 12, '0') else '8' || lpad(p, 11, '0') end as party_acct,
  ['广东顺德农村商业银行', '北京分行', '中国银行佛山支行', '上海浦东支行', '深圳南山支行', null, '成都支行'][k % 7 + 1] as bank,
  ['广东', '北京', '广东', '上海', null, '四川', '广东'][k % 7 + 1] as region, ['佛山', '北京', '佛山', '上海', null, '成都', '深圳'][k % 7 + 1] as city,
  case chan when 'click' then 'limit' when 'view' then 'assets' when 'error' then 'cert' when 'signup' then 'promo' end as page,
  20 + acct % 60 as age, (acct * 37) % 2000 as open_days from raw)""",
    f"""flagged as (select *, {bit("length(party) between 1 and 4 and own_name <> party")} as other_name,
  {bit("own_name <> party and length(party) between 2 and 4")} as unlike_name, {bit("length(party) in (2, 3)")} as person,
  {bit("summary like '%冲销%'")} as reversed, case when region <> '广东' then 1 when region = '广东' then 0 end as offsite,
  {bit(any_like("remark", "跨行网银贷记 转账 数字人民币兑回 往来款 委托实时贷记 普通贷记来帐"))} as tr_any,
  {bit(any_like("remark", "跨行网银贷记 转账 数字人民币兑回 往来款 委托实时贷记"))} as tr_short, {bit("remark = ''")} as no_remark,
  case when remark like '%普通贷记来帐%' then 1 when remark is not null then 0 end as r_std, {bit("remark like '%支付宝%'")} as r_wallet,
  case when remark like '%贷款提前归还%' or remark like '%还款%' then 1 when remark is not null then 0 end as r_repay,
  {bit("remark like '%跨行网银贷记%'")} as r_interbank, case when remark like '%委托实时贷记%' then 1 when remark is not null then 0 end as r_entrusted,
  {bit("summary = '现金'")} as cash_only, {bit("summary like '%现金%' or summary like '%取现%'")} as cash, {bit("summary like '%转贷记卡%'")} as to_credit,
  {bit("left(party_acct, 2) = '62' and length(party_acct) in (16, 19)")} as card, {bit("substr(party_acct, 5, 3) = '052'")} as acct_mark,
  {bit("left(party_acct, 2) = '62' or left(party_acct, 4) = '2088'")} as pay_acct,
  {bit("bank like '%顺德%' or bank like '%佛山%' or city = '佛山'")} as near_bank,
  case when {any_like("bank", "广东 顺德 佛山 江门 东莞 深圳 广州 肇庆 珠海 中山 湛江 云浮 惠州")} then 1 when bank is not null then 0 end as near_region from texts)""",
    "named as (select distinct acct, party, dt from flagged where own_name <> party and length(trim(party)) between 2 and 4)",
    """fresh as (select * from named n where not exists (select 1 from named o where o.acct = n.acct and o.party = n.party and date_diff('day', o.dt, n.dt) between 7 and 180))""",
    """bal as (select f.*, case when n.dt is null then 0 else 1 end as novel, round(1000 + sum(case when dir = 1 then amt else -amt end) over (partition by f.acct order by t, txn_id rows unbounded preceding), 2) as bal
  from flagged f left join fresh n on n.acct = f.acct and n.party = f.party and n.dt = f.dt)""",
    """prev as (select *, lag(dir) over w as prev_dir, lag(amt) over w as prev_amt, lag(remark) over w as prev_remark, (t - lag(t) over w) / 1e6 as since_prev, lead(reversed) over w as next_reversed,
  last_value(case when dir = 1 and reversed = 0 then txn_id end ignore nulls) over (partition by acct order by t, txn_id rows unbounded preceding) as in_id
  from bal window w as (partition by acct order by t, txn_id))""",
    """linked as (select p.*, i.dir as in_dir, i.novel as in_novel, i.other_name as in_other_name, i.unlike_name as in_unlike_name, i.r_interbank as in_interbank, i.near_bank as in_near_bank,
  i.bal - i.amt as in_before, (p.t - i.t) / 1e6 as since_in from prev p left join bal i on i.txn_id = p.in_id)""",
    """numbered as (select txn_id, row_number() over (partition by acct, in_id order by t, txn_id) as out_number from linked
  where dir = 0 and reversed = 0 and coalesce(next_reversed, 0) = 0 and in_unlike_name = 1 and in_novel = 1 and since_in between 0 and 86399)""",
    "marked as (select l.*, out_number from linked l left join numbered using (txn_id))",
    """roll as (select *, count(*) filter (where dir = 1 and other_name = 1 and novel = 1) over (partition by acct order by t range between 86400000000 preceding and 1 preceding) as strangers_1d,
  min(case when dir = 1 then bal - amt end) over (partition by acct order by t range between 7200000000 preceding and current row) as min_before_2h,
  min(case when dir = 1 then bal - amt end) over (partition by acct order by t range between 1800000000 preceding and current row) as min_before_30min from marked)""",
    """cand as (select * from roll where (reversed = 0 and in_dir = 1 and since_in between 0 and 7200 and in_unlike_name = 1 and in_novel = 1 and (tr_any = 1 or remark = '' or card = 1)
  and (out_number = 1 or out_number is null)) or (reversed = 0 and dir = 0 and strangers_1d > 0))""",
)
IN_STRANGER, OUT_STRANGER = "dir = 1 and other_name = 1 and novel = 1", "dir = 0 and other_name = 1 and novel = 1"
BOUGHT = "dir = 0 and remark like '%商品%' and prev_remark like '%提现%' and prev_dir = 1 and since_prev < 300"
SHOP = "(remark like '%商品%' or remark like '%商户%')"
TAKEN = "(summary like '%取款%' or summary like '%现金%')"
PAGES = ("limit", "assets", "cert", "promo")


def by_age(seconds: int, condition: str, what: str = "count(*)") -> str:
    return f"{what} filter (where age <= {seconds} and {condition})"


def by_day(low: int, high: int, condition: str, what: str = "count(*)") -> str:
    return f"{what} filter (where off between {low} and {high} and {condition})"


H2, MIN30, D3, D14, D15 = 7200, 1800, 259200, 1209600, 1296000
SECONDS_SQL = {
    "strangers_3d": by_age(D3, IN_STRANGER), "off_strangers_3d": by_age(D3, f"{IN_STRANGER} and region <> '广东'"),
    "bank_in_2h": by_age(H2, f"{IN_STRANGER} and card = 1"), "interbank_2h": by_age(H2, f"{IN_STRANGER} and remark like '%跨行网银贷记%'"),
    "probes_3d": by_age(D3, "remark like '%跨行网银贷记%' and amt < 100"), "probes_15d": by_age(D15, "remark like '%跨行网银贷记%' and amt < 100"),
    "funds_3d": by_age(D3, "dir = 0 and remark like '%基金%'"), "funds_15d": by_age(D15, "dir = 0 and remark like '%基金%'"),
    "withdraw_amt_15d": f"coalesce({by_age(D15, 'dir = 1 and remark like ' + repr('%提现%'), 'sum(amt)')}, 0)",
    "late_withdraw_15d": by_age(D15, "dir = 1 and remark like '%提现%' and hh in (23, 0, 1, 2, 3, 4)"), "withdraw_shop_15d": by_age(D15, BOUGHT),
    "rows_15d": by_age(D15, "true"), "ins_15d": by_age(D15, "dir = 1"),
    "person_in_15d": f"coalesce({by_age(D15, 'dir = 1 and length(party) between 2 and 3', 'sum(amt)')}, 0)",
    "in_sum_15d": f"coalesce({by_age(D15, 'dir = 1', 'sum(amt)')}, 0)", "out_sum_15d": f"coalesce({by_age(D15, 'dir = 0', 'sum(amt)')}, 0)",
    "late_15d": by_age(D15, "hh in (23, 0, 1, 2, 3)"),
    "off_names_2h": by_age(H2, f"{IN_STRANGER} and region <> '广东'", "count(distinct party)"),
    "off_names_30min": by_age(MIN30, f"{IN_STRANGER} and region <> '广东'", "count(distinct party)"),
    "stranger_names_30min": by_age(MIN30, IN_STRANGER, "count(distinct party)"),
    **{f"p_{p}_{w}": by_age(s, f"page = '{p}'", "count(distinct party)") for p in PAGES for w, s in (("2h", H2), ("3d", D3), ("14d", D14))},
}
DAYS_SQL = {
    "late_withdraw_180d": by_day(2, 179, "remark like '%提现%' and hh in (23, 0, 1, 2, 3, 4)"), "withdraw_all_180d": by_day(2, 179, "remark like '%提现%'"),
    "withdraw_in_180d": by_day(2, 179, "remark like '%提现%' and dir = 1"), "withdraw_shop_180d": by_day(2, 179, BOUGHT),
    "rows_180d": by_day(2, 179, "true"), "days_180d": by_day(2, 179, "true", "count(distinct dt)"), "days_gap": by_day(16, 179, "true", "count(distinct dt)"),
    "in_strangers_180d": by_day(2, 179, IN_STRANGER), "in_others_180d": by_day(2, 179, "dir = 1 and other_name = 1"),
    "out_strangers_180d": by_day(2, 179, f"{OUT_STRANGER} and pay_acct = 1"), "out_others_180d": by_day(2, 179, "dir = 0 and other_name = 1 and pay_acct = 1"),
    "dawn_out_180d": by_day(2, 179, "dir = 0 and other_name = 1 and pay_acct = 1 and hh between 1 and 5"),
    "dawn_180d": by_day(2, 179, "hh between 1 and 5"), "shop_out_180d": by_day(2, 179, f"dir = 0 and {SHOP}"), "outs_180d": by_day(2, 179, "dir = 0"),
    "shop_in_180d": by_day(2, 179, f"dir = 1 and {SHOP}"), "ins_180d": by_day(2, 179, "dir = 1"), "cash_out_180d": by_day(2, 179, f"dir = 0 and {TAKEN}"),
    "cash_out_amt_180d": f"coalesce({by_day(2, 179, f'dir = 0 and {TAKEN}', 'sum(amt)')}, 0)", "refunds_180d": by_day(2, 179, "remark like '%代付代付退款%'"),
    "novel_in_names_180d": by_day(2, 179, IN_STRANGER, "count(distinct party)"),
    "novel_out_names_180d": by_day(2, 179, f"{OUT_STRANGER} and region <> '广东'", "count(distinct party)"),
    "novel_out_parties_180d": by_day(2, 179, f"{OUT_STRANGER} and pay_acct = 1", "count(distinct party)"),
    **{f"p_{p}_180d": by_day(2, 181, f"page = '{p}'", "count(distinct party)") for p in PAGES},
}
SHARES_SQL = {
    "person_in_share_15d": "person_in_15d / nullif(in_sum_15d, 0)", "in_out_ratio_15d": "in_sum_15d / nullif(out_sum_15d, 0)",
    "late_share_15d": "late_15d / nullif(rows_15d, 0)", "withdraw_share_180d": "withdraw_all_180d / nullif(rows_180d, 0)",
    "novel_share_180d": "in_strangers_180d / nullif(in_others_180d, 0)", "novel_out_share_180d": "out_strangers_180d / nullif(out_others_180d, 0)",
    "dawn_share_180d": "dawn_out_180d / nullif(out_others_180d, 0)", "shop_out_share_180d": "shop_out_180d / nullif(outs_180d, 0)",
    "shop_in_share_180d": "shop_in_180d / nullif(ins_180d, 0)", "cash_out_share_180d": "cash_out_180d / nullif(outs_180d, 0)",
}


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns.items())


WIDE_SQL = (
    *STATEMENTS,
    "sh as (select c.txn_id as cid, (c.t - f.t) / 1e6 as age, f.* exclude (age) from cand c join marked f on c.acct = f.acct and c.t - f.t > 0 and c.t - f.t <= 1296000000000)",
    f"sagg as (select c.txn_id as cid, {listed(SECONDS_SQL)} from (select txn_id from cand) c left join (select * rename (txn_id as h_id) from sh) sh on sh.cid = c.txn_id group by 1)",
    "dh as (select c.txn_id as cid, date_diff('day', f.dt, c.dt) as off, f.* from cand c join marked f on c.acct = f.acct and date_diff('day', f.dt, c.dt) between 2 and 181)",
    f"dagg as (select c.txn_id as cid, {listed(DAYS_SQL)} from (select txn_id from cand) c left join (select * rename (txn_id as h_id) from dh) dh on dh.cid = c.txn_id group by 1)",
    SNAPS.replace("from flow", "from cand"),
    days_hist(0, 14).replace("from snaps s left join flow f", "from snaps s left join marked f"), RUNS, PAIRS,
    "joined as (select c.*, sagg.* exclude (cid), dagg.* exclude (cid), coalesce(z.pair_cnt, 0) as pairs_15d from cand c join sagg on c.txn_id = sagg.cid join dagg on c.txn_id = dagg.cid "
    "left join z on c.acct = z.acct and cast(c.dt - 2 as date) = z.snap_dt)",
    f"wide as (select *, {listed(SHARES_SQL)} from joined)",
)


@query("statement_flags", "txn_id:i other_name:i reversed:i offsite:i tr_any:i tr_short:i r_std:i r_repay:i cash:i card:i pay_acct:i acct_mark:i near_bank:i near_region:i novel:i bal:d",
       sql(*STATEMENTS, "select txn_id, other_name, reversed, offsite, tr_any, tr_short, r_std, r_repay, cash, card, pay_acct, acct_mark, near_bank, near_region, novel, bal from bal"))
def _(spark, d):
    """Attributes of remark, summary, name, account, bank and region texts, and new counterparties."""
    return statements(spark, d)


@query("candidates", "txn_id:i acct:i since_in:d in_before:d out_number:i", sql(*STATEMENTS, "select txn_id, acct, since_in, in_before, out_number from cand"))
def _(spark, d):
    return W.chosen(settle(W.marked(W.of_interest(statements(spark, d)))))


@query("statement_counters",
       "txn_id:i max_before_in_15d:d min_before_in_15d:d max_in_share_15d:d min_out_share_15d:d bal_min_15d:d bal_min_3d:d min_amt_15d:d min_amt_3d:d in_amt_3d:d out_amt_3d:d max_in_3d:d "
       "withdraw_shop_15d:i loan_shop_15d:i fund_amt_15d:d named_amt_15d:d shop_in_15d:i thousands_15d:i probes_15d:i probes_3d:i hundreds_3h:i flat_amt_3h:d min_before_out_180d:d "
       "min_before_out_360d:d max_amt_180d:d max_amt_360d:d bal_std_15d:m bal_std_3d:m bal_avg_3d:d out_share_std_15d:m in_share_std_15d:m in_out_ratio_15d:d in_avg_3d:d out_share_avg_180d:d "
       "small_out_share_180d:d large_out_share_180d:d withdraw_in_share_180d:d",
       sql(*STATEMENTS,
           """parts as (select *, case when bal + amt > 0 then bal + amt else 0.1 end as d_ye, case when bal - amt > 0 then bal - amt else 0.1 end as c_ye,
  amt / case when bal + amt > 0 then bal + amt else 0.1 end as d_part, amt / case when bal - amt > 0 then bal - amt else 0.1 end as c_part from prev)""",
           "scored as (select * from parts where chan = 'purchase')",
           "sh as (select c.txn_id as cid, (c.t - f.t) / 1e6 as age, f.* rename (txn_id as h_id, age as years) from scored c left join parts f on c.acct = f.acct and c.t - f.t > 0 and c.t - f.t <= 1296000000000)",
           f"""a as (select cid, max(c_ye) filter (where dir = 1) as max_before_in_15d, min(c_ye) filter (where dir = 1) as min_before_in_15d, max(c_part) filter (where dir = 1) as max_in_share_15d,
  min(d_part) filter (where dir = 0) as min_out_share_15d, min(bal) as bal_min_15d, min(bal) filter (where age <= 259200) as bal_min_3d, min(amt) as min_amt_15d, min(amt) filter (where age <= 259200) as min_amt_3d,
  coalesce(sum(amt) filter (where dir = 1 and age <= 259200), 0) as in_amt_3d, coalesce(sum(amt) filter (where dir = 0 and age <= 259200), 0) as out_amt_3d, max(amt) filter (where dir = 1 and age <= 259200) as max_in_3d,
  count(*) filter (where {BOUGHT}) as withdraw_shop_15d, count(*) filter (where {BOUGHT.replace("提现", "借款")}) as loan_shop_15d, coalesce(sum(amt) filter (where dir = 0 and remark like '%基金%'), 0) as fund_amt_15d,
  coalesce(sum(amt) filter (where other_name = 1), 0) as named_amt_15d, count(*) filter (where dir = 1 and {SHOP}) as shop_in_15d, count(*) filter (where amt % 1000 = 0) as thousands_15d,
  count(*) filter (where remark like '%跨行网银贷记%' and amt < 100) as probes_15d, count(*) filter (where remark like '%跨行网银贷记%' and amt < 100 and age <= 259200) as probes_3d,
  count(*) filter (where amt % 100 = 0 and age <= 10800) as hundreds_3h, coalesce(sum(amt) filter (where amt % 100 = 0 and age <= 10800), 0) as flat_amt_3h,
  stddev_pop(bal) as bal_std_15d, stddev_pop(bal) filter (where age <= 259200) as bal_std_3d, avg(bal) filter (where age <= 259200) as bal_avg_3d, stddev_pop(d_part) filter (where dir = 0) as out_share_std_15d,
  stddev_pop(c_part) filter (where dir = 1) as in_share_std_15d, sum(amt) filter (where dir = 1) / nullif(sum(amt) filter (where dir = 0), 0) as in_out, count(*) filter (where dir = 0) as outs,
  avg(amt) filter (where dir = 1 and age <= 259200) as in_avg_3d from sh group by 1)""",
           "dh as (select c.txn_id as cid, date_diff('day', f.dt, c.dt) as off, f.* rename (txn_id as h_id) from scored c left join parts f on c.acct = f.acct and date_diff('day', f.dt, c.dt) between 2 and 359)",
           """b as (select cid, min(d_ye) filter (where dir = 0 and off <= 179) as min_before_out_180d, min(d_ye) filter (where dir = 0) as min_before_out_360d, max(amt) filter (where off <= 179) as max_amt_180d,
  max(amt) as max_amt_360d, avg(d_part) filter (where dir = 0 and off <= 179) as out_share_avg_180d, avg(case when d_part <= 0.05 then 1 else 0 end) filter (where dir = 0 and off <= 179) as small_out_share_180d,
  avg(case when d_part >= 0.95 then 1 else 0 end) filter (where dir = 0 and off <= 179) as large_out_share_180d, avg(case when remark like '%提现%' then 1 else 0 end) filter (where dir = 1 and off <= 179) as withdraw_in_share_180d
  from dh group by 1)""",
           "select a.* exclude (cid, in_out, outs), a.cid as txn_id, b.* exclude (cid), case when outs > 0 then coalesce(in_out, 0) end as in_out_ratio_15d from a join b using (cid)"))
def _(spark, d):
    """Balances, shares and sequences of the statements before each purchase."""
    flow = settle(statements(spark, d))
    return statement_counters(flow.filter("chan = 'purchase'"), flow)


SUMS = ("withdraw_amt_15d", "person_in_15d", "in_sum_15d", "out_sum_15d", "cash_out_amt_180d")
FRAME_COLS = [
    *(f"{n}:{'d' if n in SUMS else 'i'}" for n in (*SECONDS_SQL, *DAYS_SQL)), *(f"{n}:d" for n in SHARES_SQL), "min_before_2h:d", "min_before_30min:d", "pairs_15d:i",
]
NAMES = [c.split(":")[0] for c in FRAME_COLS]


@query("rule_frame", "txn_id:i " + " ".join(FRAME_COLS), sql(*WIDE_SQL, f"select txn_id, {', '.join(NAMES)} from wide"))
def _(spark, d):
    return frame(spark, d, [F.col(n) for n in NAMES])


def rules_sql() -> str:
    """The rules as SQL, written from their definitions by condition groups."""
    before = "bal - amt"
    stranger = "dir = 1 and reversed = 0 and novel = 1 and other_name = 1"
    low = f"{stranger} and {before} < 50000"
    remark = "(tr_any = 1 or (card = 1 and r_std = 0))"
    short = "(tr_short = 1 or (card = 1 and r_std = 0))"
    chain = "reversed = 0 and dir = 0 and prev_dir = 1 and min_before_2h < 50000"
    shop = f"{stranger} and offsite = 1 and round(amt, -3) % 5000 = 0 and round(amt, -3) - amt >= 0 and {before} < 300"
    quiet = f"dir = 1 and reversed = 0 and novel = 1 and {before} < 50000 and offsite = 1 and {short}"
    rules = {
        "r1": f"{low} and {remark} and p_limit_14d > 1",
        "r2": f"{low} and {remark} and strangers_3d > 0 and r_wallet = 1 and p_assets_14d + p_limit_14d > 0",
        "r3": f"{low} and {remark} and offsite = 1 and p_assets_14d + p_limit_14d > 0",
        "r4": f"{low} and {remark} and r_wallet = 1 and acct_mark = 1",
        "r5": f"{chain} and off_names_2h > 0",
        "r6": f"{chain} and bank_in_2h > 0 and summary = '现金' and amt >= 10000 and bal < 1500 and p_assets_14d + p_limit_14d > 0",
        "r7": "reversed = 0 and dir = 0 and prev_dir = 1 and min_before_30min < 50000 and off_names_30min > 0 and since_prev < 1800 and p_limit_14d > 0 and prev_amt >= 1000 and r_repay = 0 and withdraw_amt_15d > 0",
        "r8": f"{low} and novel_share_180d > 0.33 and novel_in_names_180d > 18 and late_withdraw_180d > 3 and p_limit_180d > 0 and p_assets_180d > 30",
        "r9": f"{chain} and off_names_2h > 0 and since_prev < 1800 and prev_amt >= 1000 and r_repay = 0 and withdraw_amt_15d > 0 and p_limit_180d > 1 and round(amt, -2) % 5000 = 0 and round(prev_amt, -2) = round(amt, -2)",
        "r10": f"{low} and novel_out_share_180d > 0.7 and novel_out_names_180d > 20 and withdraw_amt_15d > 0 and offsite = 1 and {before} < 1500",
        "r11": f"{low} and offsite = 1 and p_limit_180d > 0 and probes_3d > 0 and days_gap = 0",
        "r12": f"{chain} and off_names_2h > 0 and to_credit = 1 and refunds_180d > 0",
        "r13": "reversed = 0 and cash = 1 and dir = 0 and amt >= 1000 and coalesce(in_near_bank, 0) = 0 and prev_amt >= 10000 and prev_dir = 1 and min_before_2h < 300 and interbank_2h > 0 and rows_15d < 5 and days_180d < 5 and p_assets_180d > 0",
        "r14": f"{low} and near_bank = 0 and card = 1 and p_assets_180d > 30 and dawn_share_180d > 0.2 and late_withdraw_180d >= 12 and novel_out_share_180d > 0.8",
        "r15": f"{shop} and novel_in_names_180d = 0 and p_limit_180d + p_limit_14d > 0",
        "r16": f"{shop} and shop_out_share_180d > 0.5 and shop_in_share_180d < 0.33 and p_assets_14d > 0",
        "r17": f"{shop} and shop_out_share_180d > 0.5 and shop_in_share_180d > 0 and p_assets_14d > 0 and dawn_180d > 0 and p_limit_14d > 0",
        "r18": f"{shop} and shop_in_share_180d > 0 and p_assets_14d > 0 and dawn_180d > 0 and p_limit_14d > 0",
        "r19": f"{shop} and shop_in_share_180d > 0 and p_assets_14d > 0 and dawn_180d > 0 and p_limit_14d > 0",
        "r20": f"{low} and offsite = 1 and shop_out_share_180d > 0.7 and shop_in_share_180d > 0.03 and withdraw_shop_15d > 0 and withdraw_share_180d > 0.15 and days_180d > 70 and p_cert_180d = 0",
        "r21": f"{low} and {remark} and p_limit_2h > 0 and (offsite = 1 or offsite is null) and near_region = 0 and r_entrusted = 0",
        "r22": f"{stranger} and {before} < 5000 and (tr_any = 1 or card = 1) and offsite = 1 and cash_out_amt_180d > 10000 and cash_out_180d > 1 and cash_out_share_180d > 0.3 and amt > 1000",
        "r23": f"{stranger} and {before} < 1500 and {short} and offsite = 1 and p_limit_14d + p_limit_180d > 0 and amt >= 1000 and probes_3d > 0",
        "r24": f"{stranger} and {before} < 5000 and {remark} and stranger_names_30min > 0 and late_withdraw_15d > 0 and pairs_15d > 3 and r_interbank = 1",
        "r25": f"{low} and r_interbank = 1 and cash_out_amt_180d >= 100000 and cash_out_180d >= 5 and person_in_share_15d > 0.99 and in_out_ratio_15d between 0.9 and 1.1",
        "r26": f"{low} and offsite = 1 and ins_15d = pairs_15d and ins_15d > 1 and novel_share_180d >= 0.66 and late_share_15d >= 0.34",
        "r27": f"{low} and novel_out_parties_180d > 30 and stranger_names_30min >= 2",
        "r28": f"{low} and offsite = 1 and probes_15d > 1 and withdraw_shop_180d > 0",
        "r29": f"{low} and offsite = 1 and rows_15d <= 10 and funds_3d > 1",
        "r30": "in_dir = 1 and in_before < 50000 and in_novel = 1 and in_other_name = 1 and in_interbank = 1 and dir = 0 and since_in > 0 and since_in <= 7200 and withdraw_in_180d > 1 and age > 45",
        "r31": f"{low} and offsite = 1 and p_limit_2h > 0 and p_limit_14d > 1",
        "r32": "dir = 0 and prev_dir = 1 and min_before_2h < 50000 and off_names_2h > 0 and p_limit_14d > 0 and age > 65",
        "r33": "dir = 0 and prev_dir = 1 and min_before_2h < 50000 and off_names_2h > 0 and p_limit_3d > 0 and p_limit_14d > 1",
        "r34": f"{quiet} and other_name = 1 and p_assets_14d = 0 and p_limit_14d = 0 and open_days < 1095 and age < 26 and funds_15d >= 1",
        "r35": f"{quiet} and p_assets_14d = 0 and p_limit_14d = 0 and open_days < 1095 and age < 26 and off_strangers_3d > 0",
        "r36": f"{quiet} and withdraw_shop_15d > 3 and p_promo_14d > 1",
        "r37": f"{quiet} and age < 30 and p_limit_14d > 0 and novel_out_share_180d > 0.8",
    }
    return " union all ".join(f"select txn_id, acct, '{r}' as rule_id, 1 as hit from wide where {p}" for r, p in rules.items())


HITS = (*WIDE_SQL, f"hits as ({rules_sql()})")


@query("rule_hits", "txn_id:i acct:i rule_id:s hit:i", sql(*HITS, "select * from hits"))
def _(spark, d):
    rules = M.bank_rules()
    return M.apply_rules(frame(spark, d, list(rules.values())), rules)


@query("alerts", "txn_id:i acct:i rule_id:s", sql(*HITS, "select distinct txn_id, acct, rule_id from hits where acct not in (select c_custkey from customer where c_mktsegment = 'HOUSEHOLD')"))
def _(spark, d):
    rules = M.bank_rules()
    hits = M.apply_rules(W.alert_rows(statements(spark, d), rules), rules).select("txn_id", "acct", "rule_id")
    exempt = read(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("acct"))
    return M.alerts(hits, exempt, "acct")
