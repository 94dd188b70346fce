"""The wide row that the alert rules read: candidates with just the history measures that the chosen rules ask for.

``MEASURES`` states every measure once: kind, window, condition. ``planned`` reads the columns of the predicates and picks the
measures behind them, shares included; ``rule_row`` then fills all counts and sums of a window kind in one pass and all distinct counts, whatever
their window and condition, in one tagged change stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators import sequences as Q
from trailmark.operators.rules import candidates
from trailmark.plans.lineage import settle
from trailmark.plans.lookback import Measure, look_back, look_back_days
from trailmark.plans.profile import KeyMeasure, distinct, key_profiles
from trailmark.plans.prune import relevant_history
from trailmark.schema import SECOND, account_days

# What counts as a stranger, night hours, seconds between a withdrawal and the purchase after it, largest probe amount.
STRANGER = "dir = 1 and other_name = 1 and novel = 1"
STRANGER_OUT = "dir = 0 and other_name = 1 and novel = 1"
LATE, DAWN = "hh in (23, 0, 1, 2, 3, 4)", "hh in (1, 2, 3, 4, 5)"
SHOP_WITHIN, PROBE_BELOW = 300, 100
#: Day bands (days before the anchor's day).
BANDS = {"180d": (2, 179), "gap": (16, 179), "pages": (2, 181)}
#: The last inflow's attributes that candidates and rules read.
LAST = ("dir", "novel", "other_name", "unlike_name", "r_interbank", "near_bank")
#: Pages of the application by the name that rules use.
PAGES = ("limit", "assets", "cert", "promo")


@dataclass(frozen=True)
class Wanted:
    """One measure: ``kind`` count, sum, days (active days), min (including the row itself) or names (distinct counterparties)."""

    kind: str
    window: str
    where: str
    value: str | None = None


def measures(shop_within: int = SHOP_WITHIN, probe_below: float = PROBE_BELOW) -> dict[str, Wanted]:
    """Every measure by the name of its column."""
    shopped = f"dir = 0 and r_goods = 1 and prev_withdraw = 1 and prev_dir = 1 and since_prev < {shop_within}"
    probe, withdrawn = f"r_interbank = 1 and amt < {probe_below}", "dir = 1 and r_withdraw = 1"
    out = {
        "strangers_3d": Wanted("count", "3d", STRANGER),
        "off_strangers_3d": Wanted("count", "3d", f"{STRANGER} and offsite = 1"),
        "bank_in_2h": Wanted("count", "2h", f"{STRANGER} and card = 1"),
        "interbank_2h": Wanted("count", "2h", f"{STRANGER} and r_interbank = 1"),
        "probes_3d": Wanted("count", "3d", probe),
        "probes_15d": Wanted("count", "15d", probe),
        "funds_3d": Wanted("count", "3d", "dir = 0 and r_fund = 1"),
        "funds_15d": Wanted("count", "15d", "dir = 0 and r_fund = 1"),
        "withdraw_amt_15d": Wanted("sum", "15d", withdrawn, "amt"),
        "late_withdraw_15d": Wanted("count", "15d", f"{withdrawn} and {LATE}"),
        "withdraw_shop_15d": Wanted("count", "15d", shopped),
        "rows_15d": Wanted("count", "15d", "dir >= 0"),
        "ins_15d": Wanted("count", "15d", "dir = 1"),
        "person_in_15d": Wanted("sum", "15d", "dir = 1 and person = 1", "amt"),
        "in_sum_15d": Wanted("sum", "15d", "dir = 1", "amt"),
        "out_sum_15d": Wanted("sum", "15d", "dir = 0", "amt"),
        "late_15d": Wanted("count", "15d", "hh in (23, 0, 1, 2, 3)"),
        "late_withdraw_180d": Wanted("count", "180d", f"r_withdraw = 1 and {LATE}"),
        "withdraw_all_180d": Wanted("count", "180d", "r_withdraw = 1"),
        "withdraw_in_180d": Wanted("count", "180d", withdrawn),
        "withdraw_shop_180d": Wanted("count", "180d", shopped),
        "rows_180d": Wanted("count", "180d", "dir >= 0"),
        "days_180d": Wanted("days", "180d", "dir >= 0"),
        "days_gap": Wanted("days", "gap", "dir >= 0"),
        "in_strangers_180d": Wanted("count", "180d", STRANGER),
        "in_others_180d": Wanted("count", "180d", "dir = 1 and other_name = 1"),
        "out_strangers_180d": Wanted("count", "180d", f"{STRANGER_OUT} and pay_acct = 1"),
        "out_others_180d": Wanted("count", "180d", "dir = 0 and other_name = 1 and pay_acct = 1"),
        "dawn_out_180d": Wanted("count", "180d", f"dir = 0 and other_name = 1 and pay_acct = 1 and {DAWN}"),
        "dawn_180d": Wanted("count", "180d", DAWN),
        "shop_out_180d": Wanted("count", "180d", "dir = 0 and r_shop = 1"),
        "outs_180d": Wanted("count", "180d", "dir = 0"),
        "shop_in_180d": Wanted("count", "180d", "dir = 1 and r_shop = 1"),
        "ins_180d": Wanted("count", "180d", "dir = 1"),
        "cash_out_180d": Wanted("count", "180d", "dir = 0 and cash_out = 1"),
        "cash_out_amt_180d": Wanted("sum", "180d", "dir = 0 and cash_out = 1", "amt"),
        "refunds_180d": Wanted("count", "180d", "r_refund = 1"),
        "off_names_2h": Wanted("names", "2h", f"{STRANGER} and offsite = 1"),
        "off_names_30min": Wanted("names", "30min", f"{STRANGER} and offsite = 1"),
        "stranger_names_30min": Wanted("names", "30min", STRANGER),
        "novel_in_names_180d": Wanted("names", "180d", STRANGER),
        "novel_out_names_180d": Wanted("names", "180d", f"{STRANGER_OUT} and offsite = 1"),
        "novel_out_parties_180d": Wanted("names", "180d", f"{STRANGER_OUT} and pay_acct = 1"),
        "min_before_2h": Wanted("min", "2h", "dir = 1", "bal - amt"),
        "min_before_30min": Wanted("min", "30min", "dir = 1", "bal - amt"),
    }
    for page in PAGES:
        for window in ("2h", "3d", "14d"):
            out[f"p_{page}_{window}"] = Wanted("pages", window, f"page = '{page}'")
        out[f"p_{page}_180d"] = Wanted("pages", "pages", f"page = '{page}'")
    return out


#: Shares: name -> (part, whole).
SHARES = {
    "person_in_share_15d": ("person_in_15d", "in_sum_15d"),
    "in_out_ratio_15d": ("in_sum_15d", "out_sum_15d"),
    "late_share_15d": ("late_15d", "rows_15d"),
    "withdraw_share_180d": ("withdraw_all_180d", "rows_180d"),
    "novel_share_180d": ("in_strangers_180d", "in_others_180d"),
    "novel_out_share_180d": ("out_strangers_180d", "out_others_180d"),
    "dawn_share_180d": ("dawn_out_180d", "out_others_180d"),
    "shop_out_share_180d": ("shop_out_180d", "outs_180d"),
    "shop_in_share_180d": ("shop_in_180d", "ins_180d"),
    "cash_out_share_180d": ("cash_out_180d", "outs_180d"),
}
PAIRS = "pairs_15d"


def planned(predicates: Iterable[Column], known: Mapping[str, Wanted]) -> tuple[dict[str, Wanted], dict[str, tuple[str, str]], bool]:
    """Measures, shares and whether equal-amount pairs are needed by these predicates."""
    words = {w for p in predicates for w in re.findall(r"\w+", str(p))}
    shares = {n: parts for n, parts in SHARES.items() if n in words}
    words |= {x for parts in shares.values() for x in parts}
    return {n: m for n, m in known.items() if n in words}, shares, PAIRS in words


def of_interest(flow: DataFrame) -> DataFrame:
    """Rows of accounts that ever had an inflow from a stranger; no other account has a candidate.

    The flow is stored first: attributes of texts and balances are computed once, and the plans of the steps below stay short.
    """
    flow = settle(flow)
    return flow.join(flow.filter(STRANGER).select("acct").distinct(), "acct", "left_semi")


def marked(flow: DataFrame) -> DataFrame:
    """Flow with its previous row, the latest inflow that is no reversal, and the number of each outflow after that inflow."""
    hot = Q.hot_accounts(flow)
    prev = {"prev_dir": "dir", "prev_amt": "amt", "prev_withdraw": "r_withdraw", "prev_t": "t"}
    flow = Q.neighbours(flow, ["acct"], list(Q.ORDER), hot, prev, {"next_reversed": "reversed"})
    row = F.struct("t", "amt", "bal", "txn_id", *LAST)
    live = F.expr("dir = 1 and reversed = 0")
    flow = Q.carry_last(flow, ["acct"], list(Q.ORDER), {"last_in": F.when(live, row)}, hot)
    flow = flow.selectExpr(
        "* except (last_in, prev_t, next_reversed)", f"(t - prev_t) / {float(SECOND)}D as since_prev", *[f"last_in.{c} as in_{c.removeprefix('r_')}" for c in LAST],
        "last_in.bal - last_in.amt as in_before", f"(t - last_in.t) / {float(SECOND)}D as since_in", "last_in.txn_id as in_id",
        "coalesce(next_reversed, 0) as next_reversed")
    follows = F.expr("dir = 0 and reversed = 0 and next_reversed = 0 and in_unlike_name = 1 and in_novel = 1 and since_in between 0 and 86399")
    number = Q.running_sum(flow.filter(follows).select("acct", "in_id", *Q.ORDER), ["acct", "in_id"], list(Q.ORDER), {"out_number": F.lit(1).cast("long")}, hot)
    return flow.join(number.select("txn_id", "out_number"), "txn_id", "left")


def chosen(flow: DataFrame, within: int = 7_200) -> DataFrame:
    """Candidates: the first outflow (or any inflow) soon after a stranger's inflow, and outflows with such inflows in the last day."""
    recent = Q.rolling_count(flow, {"strangers": F.expr(STRANGER)}, ["1d"])
    quick = F.expr(f"reversed = 0 and in_dir = 1 and since_in between 0 and {within} and in_unlike_name = 1 and in_novel = 1"
                   " and (tr_any = 1 or no_remark = 1 or card = 1) and (out_number = 1 or out_number is null)")
    risky = F.expr("reversed = 0 and dir = 0 and strangers_1d > 0")
    return candidates(flow.join(recent, "txn_id"), quick, risky).select(*flow.columns)


def rule_row(cand: DataFrame, flow: DataFrame, predicates: Iterable[Column], known: Mapping[str, Wanted] | None = None) -> DataFrame:
    """Candidates with the measures that the predicates read. ``flow`` is pruned to what the candidates can see; page visits carry ``page``."""
    wanted, shares, pairs = planned(predicates, known or measures())
    flow = relevant_history(flow, cand, days=181)

    def rows(kinds: tuple[str, ...], days: bool) -> list[Measure]:
        return [Measure(n.removesuffix(f"_{m.window}"), m.kind, [m.window], F.expr(m.where), None if m.value is None else F.expr(m.value))
                for n, m in wanted.items() if m.kind in kinds and (m.window in BANDS) == days]

    def merged(found: list[Measure]) -> list[Measure]:
        """Measures that differ in their window only are one measure with several windows."""
        by: dict[str, list[Measure]] = {}
        for m in found:
            by.setdefault(m.name, []).append(m)
        return [Measure(n, ms[0].kind, [w for m in ms for w in m.windows], ms[0].where, ms[0].value) for n, ms in by.items()]

    parts = []
    if seconds := merged(rows(("count", "sum"), False)):
        parts.append(look_back(cand, flow, seconds))
    if low := merged(rows(("min",), False)):
        parts.append(look_back(cand, flow, low, inclusive=True))
    if by_day := merged(rows(("count", "sum", "days"), True)):
        parts.append(look_back_days(cand, flow, by_day, BANDS).drop("acct", "dt"))
    keyed = [KeyMeasure({n: distinct}, ("party",) if m.kind == "names" else ("page", "party"), BANDS.get(m.window, m.window), F.expr(m.where))
             for n, m in wanted.items() if m.kind in ("names", "pages")]
    if keyed:
        parts.append(key_profiles(cand, flow, keyed))
    wide = cand
    for part in parts:  # each is a row for each candidate; stored, so that no plan grows with the number of measures
        wide = wide.join(settle(part), "txn_id")
    if pairs:
        found = Q.equal_amount_runs(account_days(cand), flow, 0, 14).selectExpr("acct", "date_add(snap_dt, 2) as dt", f"pair_cnt as {PAIRS}")
        wide = wide.join(found, ["acct", "dt"], "left").fillna(0, [PAIRS])
    return wide.selectExpr("*", *[f"{a} / nullif(cast({b} as double), 0) as {n}" for n, (a, b) in shares.items()])


def alert_rows(flow: DataFrame, rules: Mapping[str, Column], known: Mapping[str, Wanted] | None = None) -> DataFrame:
    """From statements with text attributes and balances to the wide rows of their candidates."""
    flow = settle(marked(of_interest(flow)))
    return rule_row(settle(chosen(flow)), flow, list(rules.values()), known)
