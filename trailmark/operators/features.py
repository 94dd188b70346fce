"""The behavioural feature catalogue: named feature blocks as data, built from shared scans.

A block maps feature names to SQL formulas over *tokens* such as ``out_cnt_14d``: a base aggregate and a
window. ``build`` collects the tokens of the requested blocks, computes each one once (all additive ones
in a single look-back scan, distinct and repeat counts by key profiles) and evaluates the formulas.

Flow columns beyond the canonical ones: ``novel``, ``is_bash``, ``is_cross``, ``midnight`` (booked at
00:00:00), ``term`` (terminal type). Anchors: ``novel``, ``is_bash``, ``is_cross``, ``is_va``. Channel
families are passed in; ``g_<family>`` in a condition refers to them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.scalars import contains_any
from trailmark.functions.tagsets import CHANNEL_TAGS
from trailmark.operators.novelty import value_history
from trailmark.operators.sequences import gap_median, gap_range, gap_stats
from trailmark.plans.dyadic import window_tops
from trailmark.plans.lookback import Measure, look_back
from trailmark.plans.profile import KeyMeasure, at_least, distinct, key_profile, key_profile_band, key_profiles, squares
from trailmark.plans.prune import relevant_history
from trailmark.plans.quantiles import window_quantile, window_rank
from trailmark.schema import WINDOWS

OUT, IN = "dir = 0", "dir = 1"
NAMED = "party is not null and trim(party) <> ''"
BASH = "(is_bash = 1 or g_bash)"
BASH_IN = "(is_bash = 1 or g_bash_in)"
NIGHT = "(hh >= 22 or hh <= 5)"


def _and(*conds: str) -> str:
    return " and ".join(conds)


#: base -> (kind, condition, value): additive aggregates, minima, maxima and active days.
MEASURES: dict[str, tuple[str, str | None, str | None]] = {
    "n": ("count", None, None),
    "days": ("days", None, None),
    "peak": ("peak", None, None),
    "out_cnt": ("count", OUT, None),
    "out_amt": ("sum", OUT, "amt"),
    "out_ss": ("sum", OUT, "amt * amt"),
    "out_sss": ("sum", OUT, "amt * amt * amt"),
    "out_max": ("max", OUT, "amt"),
    "out_days": ("days", OUT, None),
    "last_out": ("max", OUT, "t"),
    "in_cnt": ("count", IN, None),
    "in_amt": ("sum", IN, "amt"),
    "in_ss": ("sum", IN, "amt * amt"),
    "in_days": ("days", IN, None),
    "small100": ("count", _and(OUT, "amt <= 100"), None),
    "midnight_out": ("count", _and(OUT, "midnight = 1"), None),
    "midnight_va": ("count", _and(OUT, "midnight = 1", "g_va"), None),
    "night_cash": ("count", _and(OUT, "amt <= 100", NIGHT, "g_cash_out"), None),
    "sme_term_in": ("sum", _and(IN, "term = 'IB SME'"), "amt"),
    "topup": ("count", _and(OUT, "g_topup"), None),
    "payment": ("count", _and(OUT, "g_payment"), None),
    "edc": ("count", _and(OUT, "g_edc"), None),
    "edc_only": ("count", _and(OUT, "g_edc_only"), None),
    "clearing": ("count", _and(OUT, "g_clearing"), None),
    "atm_cash": ("count", _and(OUT, "g_atm_cash"), None),
    "va_out": ("count", _and(OUT, "g_va"), None),
    "self_out": ("count", _and(OUT, "g_self_transfer"), None),
    "salary": ("count", _and(IN, "g_salary"), None),
    "sme_days": ("days", _and(IN, "g_merchant_in"), None),
    "bash_flag_in": ("count", _and(IN, "is_bash = 1"), None),
    "bash_flag_in_max": ("max", _and(IN, "is_bash = 1"), "amt"),
    "bash_flag_in_amt": ("sum", _and(IN, "is_bash = 1"), "amt"),
    "bash_flag_out": ("count", _and(OUT, "is_bash = 1"), None),
    "bash_flag_out_amt": ("sum", _and(OUT, "is_bash = 1"), "amt"),
    "withdraw_morning": ("count", _and(OUT, "g_withdrawal", "hh between 6 and 10"), None),
    "withdraw": ("count", _and(OUT, "g_withdrawal"), None),
    "last_bash_in": ("max", _and(IN, "g_bash_in"), "t"),
    "bash_tag_in": ("count", _and(IN, "g_bash_in"), None),
    "stranger_in_amt": ("sum", _and(IN, "novel = 1"), "amt"),
    "settle_in": ("count", _and(IN, "g_settlement"), None),
    "own_out": ("count", _and(OUT, "g_own_product"), None),
    "own_in": ("count", _and(IN, "g_own_product"), None),
    "merchant_out": ("count", _and(OUT, "g_merchant_pay"), None),
    "atm_out": ("count", _and(OUT, "g_atm"), None),
    "settle_in_amt": ("sum", _and(IN, "g_merchant_settle"), "amt"),
    "deposit": ("count", _and(IN, "g_cash_deposit"), None),
    "deposit_amt": ("sum", _and(IN, "g_cash_deposit"), "amt"),
    "batch": ("count", _and(IN, "g_batch_in"), None),
    "batch_amt": ("sum", _and(IN, "g_batch_in"), "amt"),
    "bash_wide_out": ("count", _and(OUT, "(is_bash = 1 or g_bash_wide)"), None),
    "bash_out": ("count", _and(OUT, BASH), None),
    "bash_out_amt": ("sum", _and(OUT, BASH), "amt"),
    "bash_out_first": ("min", _and(OUT, BASH), "t"),
    "bash_out_max": ("max", _and(OUT, BASH), "amt"),
    "bash_in_amt": ("sum", _and(IN, BASH_IN), "amt"),
    "plain_out": ("count", _and(OUT, "is_bash = 0"), None),
    "plain_out_amt": ("sum", _and(OUT, "is_bash = 0"), "amt"),
    "merchant_in_amt": ("sum", _and(IN, "g_merchant_dominant"), "amt"),
    "spend": ("count", _and(OUT, "g_spending"), None),
    **{f"hour{h}": ("count", _and(OUT, f"hh = {h}"), None) for h in range(24)},
}

#: base -> (key, condition, statistic, NULL is a key): over the distinct keys of the window.
PROFILES: dict[str, tuple[str, str, str, bool]] = {
    "chans": ("chan", "true", "distinct", False),
    "out_chans": ("chan", OUT, "distinct", False),
    "in_chans": ("chan", IN, "distinct", False),
    "parties": ("party", "trim(party) <> ''", "distinct", False),
    "out_parties": ("party", OUT, "distinct", False),
    "sources": ("party", _and(IN, "trim(party) <> ''"), "distinct", False),
    "top_source": ("party", _and(IN, "trim(party) <> ''"), "peak", False),
    "source_rows": ("party", _and(IN, "trim(party) <> ''"), "rows", False),
    "stranger_sources": ("party", _and(IN, "novel = 1"), "distinct", False),
    "bash_sources": ("party", _and(IN, BASH_IN), "distinct", False),
    "top_party": ("party", OUT, "peak", True),
    "repeat_party": ("party", OUT, "repeat2", True),
    "repeat_amt": ("cents", OUT, "repeat2", False),
    "in_amts": ("cents", IN, "distinct", False),
    "in_amt_top": ("cents", IN, "peak", False),
    "in_amt_rep3": ("cents", IN, "repeat3", False),
    "hour_sq": ("hh", "true", "squares", False),
}
STATS = {
    "distinct": distinct, "squares": squares, "repeat2": at_least(2), "repeat3": at_least(3),
    "rows": lambda c: c.cast("long"),
}

#: base -> percentile of the outgoing amounts.
ORDERED = {"out_p50": 0.5, "out_p95": 0.95}

WINDOW_RE = "|".join(sorted(WINDOWS, key=len, reverse=True))
TOKEN = re.compile(rf"\b([a-z][a-z0-9_]*?)_({WINDOW_RE})\b")


def over(num: str, den: str) -> str:
    return f"case when {den} > 0 then cast({num} as double) / {den} end"


def std(n: str, s: str, ss: str, ddof: int = 1) -> str:
    dev = f"case when {ss} - {s} * {s} / {n} > {ss} * 1e-12 then {ss} - {s} * {s} / {n} else 0 end"
    return f"case when {n} > {ddof} then sqrt(({dev}) / ({n} - {ddof})) end"


OUT14_STD = std("out_cnt_14d", "out_amt_14d", "out_ss_14d")
OUT150_STD = std("out_cnt_150d", "out_amt_150d", "out_ss_150d")
IN150_STD = std("in_cnt_150d", "in_amt_150d", "in_ss_150d")
IN150_CV = f"({IN150_STD}) / (in_amt_150d / in_cnt_150d)"
DAY_US = "86400000000.0"

#: block -> feature -> formula.
BLOCKS: dict[str, dict[str, str]] = {
    "sparse_probe": {
        "evt_is_cross": "is_cross",
        "evt_is_bash": "is_bash",
        "evt_is_va": "is_va",
        "evt_night": f"case when {NIGHT} then 1 else 0 end",
        "f14d_out_cnt": "out_cnt_14d",
        "f14d_out_active_days": "out_days_14d",
        "f14d_out_small100_prop": over("small100_14d", "out_cnt_14d"),
        "f14d_out_recent1d_prop": over("out_cnt_1d", "out_cnt_14d"),
        "d_small100_over_sqrt_cnt": f"({over('small100_14d', 'out_cnt_14d')}) / sqrt(greatest(out_cnt_14d, 1))",
        "d_out_per_day": "out_cnt_14d / cast(greatest(out_days_14d, 1) as double)",
        "f_sparse_le2": "case when out_cnt_14d <= 2 then 1 else 0 end",
        "f_sparse_le5": "case when out_cnt_14d <= 5 then 1 else 0 end",
        "f_evt_small100_sparse_va": "case when amt <= 100 and out_cnt_14d <= 5 and is_va = 1 then 1 else 0 end",
        "f_evt_small100_sparse_cross": "case when amt <= 100 and out_cnt_14d <= 5 and is_cross = 1 then 1 else 0 end",
        "f_evt_small200_sparse_novel": "case when amt <= 200 and out_cnt_14d <= 20 and novel = 1 then 1 else 0 end",
    },
    "midnight_repeat": {
        "f14d_out_midnight_cnt": "midnight_out_14d",
        "d_14d_out_midnight_prop": over("midnight_out_14d", "out_cnt_14d"),
        "d_14d_out_top_party_prop": over("top_party_14d", "out_cnt_14d"),
        "d_14d_out_repeat_party_prop": over("repeat_party_14d", "out_cnt_14d"),
        "d_14d_out_repeat_amt_prop": over("repeat_amt_14d", "out_cnt_14d"),
    },
    "current_novelty": {
        "f14d_cur_party_hist_cnt": "cur_party_14d",
        "f150d_cur_party_hist_cnt": "cur_party_150d",
        "f14d_cur_chan_hist_cnt": "cur_chan_14d",
        "d_14d_cur_party_unseen": "case when cur_party_14d = 0 then 1 else 0 end",
        "d_150d_cur_party_unseen": "case when cur_party_150d = 0 then 1 else 0 end",
        "d_14d_cur_chan_unseen": "case when cur_chan_14d = 0 then 1 else 0 end",
        "d_cur_party_unseen_x_novel": "case when cur_party_150d = 0 then novel else 0 end",
    },
    "midnight_va": {
        "f14d_out_midnight_va_cnt": "midnight_va_14d",
        "d_14d_out_midnight_va_prop": over("midnight_va_14d", "out_cnt_14d"),
        "f14d_out_night_small_cashout_cnt": "night_cash_14d",
        "d_14d_out_night_small_cashout_prop": over("night_cash_14d", "out_cnt_14d"),
    },
    "gap_amount": {
        "d_amt_div_3d_max": over("amt", "out_max_3d"),
        "d_14d_gap_cv": "gap_cv_14d",
        "d_sme_x_amt_dispersion": f"case when out_amt_14d > 0 then (sme_term_in_150d / out_cnt_14d) * ({OUT14_STD}) / (out_amt_14d / out_cnt_14d) end",
        "f14d_min_gap_out": "gap_min_14d",
        "f14d_out_amt_cv": f"case when out_amt_14d > 0 then ({OUT14_STD}) / (out_amt_14d / out_cnt_14d) end",
    },
    "topup_payment": {
        "f150d_topup_cnt": "topup_150d",
        "d_150d_topup_out_prop": over("topup_150d", "out_cnt_150d"),
        "f150d_payment_cnt": "payment_150d",
        "d_150d_payment_out_prop": over("payment_150d", "out_cnt_150d"),
        "f150d_out_chan_nunique": "out_chans_150d",
        "d_amt_zscore_150d_out": f"case when ({OUT150_STD}) > 0 then (amt - out_amt_150d / out_cnt_150d) / ({OUT150_STD}) end",
        "d_7d_out_div_in": over("out_amt_7d", "in_amt_7d"),
        "d_7d_net_flow": "in_amt_7d - out_amt_7d",
    },
    "ratio_burst": {
        "f150d_out_in_cnt_ratio": over("out_cnt_150d", "in_cnt_150d"),
        "f150d_out_in_amt_ratio": over("out_amt_150d", "in_amt_150d"),
        "f14d_atm_rapid_burst_cnt": "atm_rapid_14d",
        "f14d_atm_rapid_burst_prop": over("atm_rapid_14d", "atm_cash_14d"),
        "f150d_same_amt_in_max_repeat": "in_amt_top_150d",
        "f150d_same_amt_in_repeat_ratio": f"case when in_amts_150d > 0 then cast(in_amt_rep3_150d as double) / (in_amt_rep3_150d + in_amts_150d) end",
        "f150d_edc_out_cnt": "edc_150d",
        "d_150d_edc_out_prop": over("edc_150d", "out_cnt_150d"),
        "f150d_clearing_cnt": "clearing_150d",
        "d_150d_clearing_out_prop": over("clearing_150d", "out_cnt_150d"),
        "f14d_va_out_cnt": "va_out_14d",
        "d_14d_va_out_prop": over("va_out_14d", "out_cnt_14d"),
        "d_150d_out_cnt_per_day": over("out_cnt_150d", "out_days_150d"),
    },
    "self_salary": {
        "f150d_self_transfer_cnt": "self_out_150d",
        "d_150d_self_transfer_prop": over("self_out_150d", "out_cnt_150d"),
        "f150d_salary_cnt": "salary_150d",
        "f150d_sme_regularity": over("sme_days_150d", "days_150d"),
        "d_amt_div_max_bash_150d": over("amt", "bash_flag_in_max_150d"),
        "f150d_bash_in_cnt": "bash_flag_in_150d",
        "d_150d_bash_in_prop": over("bash_flag_in_150d", "in_cnt_150d"),
        "f30d_out_cnt": "out_cnt_30d",
        "f30d_in_cnt": "in_cnt_30d",
        "d_30d_activity_sum": "nullif(out_cnt_30d + in_cnt_30d, 0)",
        "d_30d_vs_150d_out_freq": over("out_cnt_30d * 5.0", "out_cnt_150d"),
        "f150d_atm_morning_prop": over("withdraw_morning_150d", "withdraw_150d"),
        "d_150d_net_flow_sign": over("(in_amt_150d - out_amt_150d)", "(in_amt_150d + out_amt_150d)"),
        "f7d_distinct_party_out": "out_parties_7d",
        "d_7d_party_concentration": over("out_parties_7d", "out_cnt_7d"),
    },
    "bash_out": {
        "f150d_out_bash_cnt": "bash_flag_out_150d",
        "d_150d_out_bash_prop": over("bash_flag_out_150d", "out_cnt_150d"),
        "d_amt_vs_3d_inflow": over("amt", "in_amt_3d"),
    },
    "source_concentration": {
        "f150d_active_days": "days_150d",
        "f150d_distinct_in_sources": "sources_150d",
        "d_150d_in_src_concentration": "source_top_share_150d",
        "d_150d_in_src_cnt_conc": over("top_source_150d", "source_rows_150d"),
        "d_in_src_per_day": "case when sources_150d > 0 then cast(sources_150d as double) / days_150d end",
    },
    "inflow_burst": {
        "d_3d_in_burst_vs_150d": over("in_cnt_3d", "(in_cnt_150d * 3.0 / nullif(in_days_150d, 0))"),
        "d_last_bash_in_gap_sec": "(t - last_bash_in_150d) / 1000000.0",
    },
    "stranger_burst": {
        "d_3d_stranger_inflow_burst": "case when in_amt_3d > 0 and parties_150d > 0 then stranger_in_amt_3d / in_amt_3d * stranger_sources_3d / parties_150d end",
    },
    "settlement_rank": {
        "f150d_total_txn_cnt": "n_150d",
        "d_amt_div_150d_median_out": over("amt", "out_p50_150d"),
        "f150d_va_midnight_cnt": "midnight_va_150d",
        "d_150d_va_midnight_prop": over("midnight_va_150d", "out_cnt_150d"),
        "d_settlement_regularity": over("settle_in_150d", "days_150d"),
        "f150d_settlement_cnt": "settle_in_150d",
        "d_amt_pct_rank_150d": "prank_150d",
        "d_3d_in_surge_vs_14d": over("in_amt_3d", "(in_amt_14d / nullif(in_days_14d, 0) * 3)"),
        "d_out_amt_cv_150d": f"case when out_cnt_150d > 1 and out_amt_150d > 0 then ({std('out_cnt_150d', 'out_amt_150d', 'out_ss_150d', 0)}) / (out_amt_150d / out_cnt_150d) end",
    },
    "channel_mix": {
        "f150d_chan_nunique": "chans_150d",
        "d_150d_own_product_out_prop": over("own_out_150d", "out_cnt_150d"),
        "d_150d_own_product_in_prop": over("own_in_150d", "in_cnt_150d"),
        "d_150d_merchant_prop": over("merchant_out_150d", "out_cnt_150d"),
        "d_150d_atm_out_prop": over("atm_out_150d", "out_cnt_150d"),
        "d_150d_bash_in_out_ratio": over("bash_flag_in_amt_150d", "bash_flag_out_amt_150d"),
        "f150d_bash_out_cnt": "bash_flag_out_150d",
        "d_150d_out_txn_per_party": over("out_cnt_150d", "out_parties_150d"),
        "d_150d_daily_peak_prop": over("peak_150d", "n_150d"),
        "d_14d_settle_in_prop": over("settle_in_amt_14d", "in_amt_14d"),
        "f14d_in_chan_nunique": "in_chans_14d",
        "d_14d_out_in_cnt_ratio": over("out_cnt_14d", "in_cnt_14d"),
        "d_14d_withdraw_prop": over("withdraw_14d", "out_cnt_14d"),
        "d_14d_edc_out_prop": over("edc_only_14d", "out_cnt_14d"),
        "f3d_chan_nunique": "chans_3d",
        "d_3d_out_txn_per_party": over("out_cnt_3d", "out_parties_3d"),
        "d_3d_out_minus_in_cnt": "out_cnt_3d - in_cnt_3d",
    },
    "cash_batch": {
        "d_amt_div_90d_max_out": over("amt", "out_max_90d"),
        "d_amt_div_90d_p95_out": over("amt", "out_p95_90d"),
        "f90d_out_cnt": "out_cnt_90d",
        "d_90d_out_density": over("out_cnt_90d", "out_days_90d"),
        "f150d_cash_deposit_cnt": "deposit_150d",
        "d_150d_cash_deposit_prop": over("deposit_150d", "in_cnt_150d"),
        "d_150d_cash_deposit_amt_prop": over("deposit_amt_150d", "in_amt_150d"),
        "f150d_batch_cnt": "batch_150d",
        "d_150d_batch_in_prop": over("batch_150d", "in_cnt_150d"),
        "d_150d_batch_amt_prop": over("batch_amt_150d", "in_amt_150d"),
        "f150d_max_gap_out": "coalesce(gap_max_150d, 0)",
        "f150d_median_gap_out": "coalesce(gap_median_150d, 0)",
        "d_30d_txn_daily_rate": "case when n_30d > 0 then n_30d / 30.0 end",
        "f30d_active_days": "days_30d",
    },
    "uniform_dormant": {
        "f150d_in_amt_cv": f"case when in_amt_150d > 0 and in_cnt_150d >= 3 then {IN150_CV} end",
        "d_150d_in_uniform_flag": f"case when in_cnt_150d >= 5 and in_amt_150d > 0 and {IN150_CV} < 0.1 then 1 else 0 end",
        "f7d_distinct_in_sources": "sources_7d",
        "f3d_distinct_in_sources": "sources_3d",
        "d_in_source_burst_3d_vs_150d": over("sources_3d", "sources_150d"),
        "f150d_bash_out_total_cnt": "bash_wide_out_150d",
        "d_150d_bash_out_rare": "case when out_cnt_150d >= 5 and bash_wide_out_150d <= 1 then 1 else 0 end",
        "d_amt_div_lifetime_max_out": over("amt", "out_max_150d"),
        "d_amt_div_90d_median_out": over("amt", "out_p50_90d"),
        "d_last_out_gap_days": f"(t - last_out_150d) / {DAY_US}",
        "d_dormancy_burst": "case when days_150d > 0 then 1.0 - cast(out_days_150d as double) / days_150d end",
        "f3d_in_cnt_per_source": over("in_cnt_3d", "sources_3d"),
        "d_in_amt_uniformity_x_sources": f"case when in_amt_150d > 0 and in_cnt_150d >= 3 and sources_150d > 0 then (1.0 - least({IN150_CV}, 1.0)) * sources_150d end",
    },
    "shape_novelty": {
        "d_150d_out_amt_skewness": f"case when out_cnt_150d >= 5 and ({OUT150_STD}) > 0 then (out_sss_150d / out_cnt_150d - 3 * (out_amt_150d / out_cnt_150d) * (out_ss_150d / out_cnt_150d)"
        f" + 2 * power(out_amt_150d / out_cnt_150d, 3)) / power(({OUT150_STD}), 3) end",
        "d_150d_hour_hhi": f"coalesce({over('hour_sq_150d', '(n_150d * n_150d)')}, 0)",
        "d_14d_new_in_party_ratio": over("(sources_150d - sources_older14)", "sources_14d"),
        "d_3d_bash_in_concentration": over("bash_tag_in_3d", "bash_tag_in_150d"),
    },
    "drain_activation": {
        "d_150d_bash_out_prop": over("bash_out_150d", "out_cnt_150d"),
        "d_150d_bash_out_amt_prop": over("bash_out_amt_150d", "out_amt_150d"),
        "d_3d_bash_out_concentration": over("bash_out_3d", "bash_out_150d"),
        "d_first_bash_out_gap_days": f"(t - bash_out_first_150d) / {DAY_US}",
        "d_150d_balance_drain_ratio": over("(out_amt_150d - in_amt_150d)", "in_amt_150d"),
        "d_3d_balance_drain_ratio": over("(out_amt_3d - in_amt_3d)", "in_amt_3d"),
        "d_amt_div_150d_total_in": over("amt", "in_amt_150d"),
        "d_3d_out_chan_novelty": over("(out_chans_150d - out_chans_older3)", "out_chans_3d"),
        "d_3d_own_product_out_prop": over("own_out_3d", "out_cnt_3d"),
        "d_3d_activation_burst": over("n_3d", "(n_150d * 3.0 / nullif(days_150d, 0))"),
        "d_dormancy_out_gap_days": f"(t - last_out_older3) / {DAY_US}",
        "d_dormancy_in_gap_days": f"(t - last_in_older3) / {DAY_US}",
        "d_7d_bash_in_dominance": over("bash_in_amt_7d", "in_amt_7d"),
        "f7d_bash_in_sources": "bash_sources_7d",
        "d_mule_pattern_score": "case when in_amt_7d > 0 and out_cnt_150d > 0 then bash_in_amt_7d / in_amt_7d * (1.0 - cast(bash_out_150d as double) / out_cnt_150d) end",
    },
    "pseudo_normal": {
        "d_amt_div_nonbash_avg": "case when plain_out_amt_150d > 0 then amt / (plain_out_amt_150d / plain_out_150d) end",
        "d_bash_vs_nonbash_ratio": over("bash_out_150d", "plain_out_150d"),
        "d_sme_in_dominance_150d": over("merchant_in_amt_150d", "in_amt_150d"),
        "d_1d_out_amt_burst": over("out_amt_1d", "out_amt_14d"),
        "d_1d_out_cnt_burst": over("out_cnt_1d", "out_cnt_14d"),
        "d_1d_party_burst": over("out_parties_1d", "out_parties_14d"),
        "d_hour_deviation_from_mode": "least(abs(hh - mode_hour), 24 - abs(hh - mode_hour))",
        "d_amt_div_3d_inflow": over("amt", "in_amt_3d"),
        "f150d_lifetime_txn_cnt": "n_150d",
        "d_spending_chan_shift": "case when out_cnt_14d > 0 then cast(spend_150d as double) / out_cnt_150d - cast(spend_14d as double) / out_cnt_14d end",
        "d_amt_div_max_bash_out": over("amt", "bash_out_max_150d"),
    },
}


def tokens(blocks: Sequence[str]) -> set[tuple[str, str]]:
    text = " ".join(f for b in blocks for f in BLOCKS[b].values())
    return {(m.group(1), m.group(2)) for m in TOKEN.finditer(text)}


def uses(blocks: Sequence[str], word: str) -> bool:
    return any(re.search(rf"\b{word}\b", f) for b in blocks for f in BLOCKS[b].values())


def tag_flow(flow: DataFrame, families: Mapping[str, Sequence[str]] = CHANNEL_TAGS) -> DataFrame:
    cols = {f"g_{name}": contains_any("chan", words) for name, words in families.items()}
    return flow.withColumns({**cols, "cents": F.round("amt", 2)})


def build(
    anchors: DataFrame, flow: DataFrame, blocks: Sequence[str], families: Mapping[str, Sequence[str]] = CHANNEL_TAGS
) -> DataFrame:
    """One row per anchor with the features of ``blocks``.

    Only history that an anchor can see is read: its accounts, back to the longest window (and the three days by which
    a window of gaps may be shifted).
    """
    found = tokens(blocks)
    longest = max([WINDOWS[w] for _, w in found if w in WINDOWS] + [WINDOWS["150d"]])
    hist = tag_flow(relevant_history(flow, anchors, longest // 86_400 + 4), families)
    parts = []

    windows: dict[str, list[str]] = {}
    for base, w in sorted(found):
        if base in MEASURES:
            windows.setdefault(base, []).append(w)
    if uses(blocks, "mode_hour"):
        windows |= {f"hour{h}": ["150d"] for h in range(24)}
    if windows:
        parts.append(look_back(anchors, hist, [
            Measure(b, MEASURES[b][0], ws, None if MEASURES[b][1] is None else F.expr(MEASURES[b][1]),
                    None if MEASURES[b][2] is None else F.expr(MEASURES[b][2])) for b, ws in windows.items()]))

    runs: dict[tuple, dict[str, str]] = {}
    for base, w in sorted(found):
        if base in PROFILES:
            key, cond, stat, nulls = PROFILES[base]
            runs.setdefault((key, cond, nulls, w), {})[f"{base}_{w}"] = stat
    together, conds = [], {}
    for (key, cond, nulls, w), stats in runs.items():
        peak = next((n for n, s in stats.items() if s == "peak"), None)
        prof = {n: STATS[s] for n, s in stats.items() if s != "peak"}
        if peak:
            parts.append(key_profile(anchors, hist, [key], w, prof, where=F.expr(cond), peak=peak, nulls=nulls))
        else:
            # windows over the same rows share one condition
            together.append(KeyMeasure(prof, (key,), w, conds.setdefault(cond, F.expr(cond)), nulls))
    if together:
        parts.append(key_profiles(anchors, hist, together))
    for word, key, cond, lo in (("sources_older14", "party", _and(IN, "trim(party) <> ''"), "14d"), ("out_chans_older3", "chan", OUT, "3d")):
        if uses(blocks, word):
            parts.append(key_profile_band(anchors, hist, [key], lo, "150d", {word: distinct}, where=F.expr(cond)))

    for col in ("party", "chan"):
        for w in ("14d", "150d"):
            if ("cur_" + col, w) in found:
                parts.append(value_history(anchors, hist, col, w, F.expr(OUT)).drop(f"cur_{col}_{w}_unseen"))
    if ("gap_cv", "14d") in found:
        parts.append(gap_stats(anchors, hist, "14d", F.expr(OUT)).selectExpr("txn_id", "gap_cv as gap_cv_14d"))
    if ("atm_rapid", "14d") in found:
        parts.append(gap_stats(anchors, hist, "14d", F.expr(f"{OUT} and g_atm_cash")).selectExpr("txn_id", "rapid_cnt as atm_rapid_14d"))
    for w in ("14d", "150d"):
        want = [b for b in ("gap_min", "gap_max") if (b, w) in found]
        if want:
            parts.append(gap_range(anchors, hist, w, F.expr(OUT)).selectExpr("txn_id", *[f"{b} as {b}_{w}" for b in want]))
        if ("gap_median", w) in found:
            parts.append(gap_median(anchors, hist, w, F.expr(OUT)).selectExpr("txn_id", f"gap_median as gap_median_{w}"))
    for w in ("90d", "150d"):
        want = [b for b in ORDERED if (b, w) in found]
        if want:
            got = window_quantile(anchors, hist, w, [ORDERED[b] for b in want], F.expr(OUT))
            parts.append(got.selectExpr("txn_id", *[f"q{i} as {b}_{w}" for i, b in enumerate(want)]))
        if ("prank", w) in found:
            parts.append(window_rank(anchors, hist, w, F.expr(OUT)).selectExpr("txn_id", f"share as prank_{w}"))
    if uses(blocks, "source_top_share_150d"):
        got = window_tops(anchors, hist, "party", "150d", F.col("amt"), F.expr(_and(IN, NAMED)))
        parts.append(got.selectExpr("txn_id", "top / nullif(total, 0) as source_top_share_150d"))
    if uses(blocks, "last_out_older3"):
        # Last row at or before the start of the 3-day window, still inside 150 days of the anchor.
        back = anchors.selectExpr("txn_id", "acct", "t - 259200000000L as t", "t as t0")
        got = look_back(back, hist, [
            Measure("o", "max", ["150d"], F.expr(OUT), F.col("t")), Measure("i", "max", ["150d"], F.expr(IN), F.col("t"))])
        # The shifted window reaches 3 days further back than the anchor's own.
        keep = "case when t0 - {c}_150d <= 12960000000000L then {c}_150d end as last_{n}_older3"
        parts.append(got.join(back.select("txn_id", "t0"), "txn_id").selectExpr(
            "txn_id", keep.format(c="o", n="out"), keep.format(c="i", n="in")))

    wide = anchors
    for part in parts:
        wide = wide.join(part, "txn_id", "left")
    if uses(blocks, "mode_hour"):
        best = ", ".join(f"struct(hour{h}_150d as n, {-h} as neg)" for h in range(24))
        wide = wide.selectExpr("*", f"greatest({best}) as top_hour").selectExpr("*", "case when top_hour.n > 0 then -top_hour.neg end as mode_hour")
    exprs = [f"{formula} as {name}" for b in blocks for name, formula in BLOCKS[b].items()]
    return wide.selectExpr("txn_id", *exprs)
