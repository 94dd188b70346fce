"""Declarative alert rules: named predicates over one wide row, applied in a single pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per (transaction, matching rule).

    All predicates are evaluated on the same row and the ids of those that hold are exploded, so the
    table is read once however many rules there are.
    """
    hits = F.array_compact(F.array(*[F.when(p, F.lit(r)) for r, p in rules.items()]))
    return df.withColumn("rule_id", F.explode(hits)).withColumn("hit", F.lit(1))


def alerts(hits: DataFrame, exempt: DataFrame, on: str) -> DataFrame:
    """Distinct hits of everyone who is not on the exempt list."""
    return hits.join(exempt.select(on).distinct(), on, "left_anti").distinct()


def candidates(flow: DataFrame, quick: Column, risky: Column) -> DataFrame:
    """Union of two candidate sets of one frame: a single filter gives the distinct union of rows."""
    return flow.filter(quick | risky)


def bank_rules() -> dict[str, Column]:
    """The 37 alert rules over the wide row. All numbers below are fixed values.

    Column names: ``dir`` 1 in / 0 out, ``amt``, ``bal``, ``novel`` unseen counterparty, ``other_name``
    counterparty name differs, ``reversed`` reversal entry, ``offsite`` counterparty region is not home
    (NULL unknown), ``tr_any``/``tr_no_std`` remark families, ``card`` card-shaped account, ``p_*`` page
    visits by (page, window), and history measures named by what they count and their window.
    """
    c = F.col

    def nz(name: str) -> Column:
        return F.coalesce(c(name), F.lit(0))

    live = c("reversed") == 0
    before = c("bal") - c("amt")
    inflow, outflow = c("dir") == 1, c("dir") == 0
    stranger = inflow & live & (c("novel") == 1) & (c("other_name") == 1)
    low = stranger & (before < 50_000)
    off = c("offsite") == 1
    remark = (c("tr_any") == 1) | ((c("card") == 1) & (c("r_std") == 0))
    remark_short = (c("tr_short") == 1) | ((c("card") == 1) & (c("r_std") == 0))
    remark_card = (c("tr_any") == 1) | (c("card") == 1)
    limit_14, assets_14 = nz("p_limit_14d"), nz("p_assets_14d")
    limit_180, assets_180 = nz("p_limit_180d"), nz("p_assets_180d")
    after_in = live & outflow & (c("prev_dir") == 1)
    chain = after_in & (c("min_before_2h") < 50_000)
    off_chain = chain & (c("off_names_2h") > 0)
    quick = after_in & (c("min_before_30min") < 50_000) & (c("off_names_30min") > 0)
    no_repay = c("r_repay") == 0
    round_in = (F.pmod(F.round("amt", -3), F.lit(5000.0)) == 0) & (F.round("amt", -3) - c("amt") >= 0)
    shop = stranger & off & round_in & (before < 300)
    not_home_bank = (c("near_bank") == 0)
    young_quiet = inflow & live & (c("novel") == 1) & (before < 50_000) & off & remark_short

    rules = {
        "r1": low & remark & (limit_14 > 1),
        "r2": low & remark & (c("strangers_3d") > 0) & (c("r_wallet") == 1) & (assets_14 + limit_14 > 0),
        "r3": low & remark & off & (assets_14 + limit_14 > 0),
        "r4": low & remark & (c("r_wallet") == 1) & (c("acct_mark") == 1),
        "r5": off_chain,
        "r6": chain & (c("bank_in_2h") > 0) & (c("cash_only") == 1) & (c("amt") >= 10_000) & (c("bal") < 1_500)
        & (assets_14 + limit_14 > 0),
        "r7": quick & (c("since_prev") < 1_800) & (limit_14 > 0) & (c("prev_amt") >= 1_000) & no_repay
        & (nz("withdraw_amt_15d") > 0),
        "r8": low & (nz("novel_share_180d") > 0.33) & (nz("novel_in_names_180d") > 18)
        & (nz("late_withdraw_180d") > 3) & (limit_180 > 0) & (assets_180 > 30),
        "r9": off_chain & (c("since_prev") < 1_800) & (c("prev_amt") >= 1_000) & no_repay
        & (nz("withdraw_amt_15d") > 0) & (limit_180 > 1) & (F.pmod(F.round("amt", -2), F.lit(5000.0)) == 0)
        & (F.round("prev_amt", -2) == F.round("amt", -2)),
        "r10": low & (nz("novel_out_share_180d") > 0.7) & (nz("novel_out_names_180d") > 20)
        & (c("withdraw_amt_15d") > 0) & off & (before < 1_500),
        "r11": low & off & (limit_180 > 0) & (c("probes_3d") > 0) & (c("days_gap") == 0),
        "r12": off_chain & (c("to_credit") == 1) & (c("refunds_180d") > 0),
        "r13": live & (c("cash") == 1) & outflow & (c("amt") >= 1_000) & (nz("in_near_bank") == 0)
        & (c("prev_amt") >= 10_000) & (c("prev_dir") == 1) & (c("min_before_2h") < 300)
        & (c("interbank_2h") > 0) & (c("rows_15d") < 5) & (c("days_180d") < 5) & (assets_180 > 0),
        "r14": low & not_home_bank & (c("card") == 1) & (assets_180 > 30) & (c("dawn_share_180d") > 0.2)
        & (c("late_withdraw_180d") >= 12) & (c("novel_out_share_180d") > 0.8),
        "r15": shop & (c("novel_in_names_180d") == 0) & (limit_180 + limit_14 > 0),
        "r16": shop & (c("shop_out_share_180d") > 0.5) & (c("shop_in_share_180d") < 0.33) & (assets_14 > 0),
        "r17": shop & (c("shop_out_share_180d") > 0.5) & (c("shop_in_share_180d") > 0) & (assets_14 > 0)
        & (c("dawn_180d") > 0) & (limit_14 > 0),
        "r18": shop & (c("shop_in_share_180d") > 0) & (assets_14 > 0) & (c("dawn_180d") > 0) & (limit_14 > 0),
        "r19": shop & (c("shop_in_share_180d") > 0) & (assets_14 > 0) & (c("dawn_180d") > 0) & (limit_14 > 0),
        "r20": low & off & (c("shop_out_share_180d") > 0.7) & (c("shop_in_share_180d") > 0.03)
        & (c("withdraw_shop_15d") > 0) & (c("withdraw_share_180d") > 0.15) & (c("days_180d") > 70)
        & (nz("p_cert_180d") == 0),
        "r21": low & remark & (nz("p_limit_2h") > 0) & (F.coalesce(off, F.lit(True))) & (c("near_region") == 0)
        & (c("r_entrusted") == 0),
        "r22": stranger & (before < 5_000) & remark_card & off & (c("cash_out_amt_180d") > 10_000)
        & (c("cash_out_180d") > 1) & (c("cash_out_share_180d") > 0.3) & (c("amt") > 1_000),
        "r23": stranger & (before < 1_500) & remark_short & off & (limit_14 + limit_180 > 0) & (c("amt") >= 1_000)
        & (c("probes_3d") > 0),
        "r24": stranger & (before < 5_000) & remark & (c("stranger_names_30min") > 0) & (c("late_withdraw_15d") > 0)
        & (c("pairs_15d") > 3) & (c("r_interbank") == 1),
        "r25": low & (c("r_interbank") == 1) & (c("cash_out_amt_180d") >= 100_000) & (c("cash_out_180d") >= 5)
        & (c("person_in_share_15d") > 0.99) & c("in_out_ratio_15d").between(0.9, 1.1),
        "r26": low & off & (c("ins_15d") == c("pairs_15d")) & (c("ins_15d") > 1) & (c("novel_share_180d") >= 0.66)
        & (c("late_share_15d") >= 0.34),
        "r27": low & (c("novel_out_parties_180d") > 30) & (c("stranger_names_30min") >= 2),
        "r28": low & off & (c("probes_15d") > 1) & (c("withdraw_shop_180d") > 0),
        "r29": low & off & (c("rows_15d") <= 10) & (c("funds_3d") > 1),
        "r30": (c("in_dir") == 1) & (c("in_before") < 50_000) & (c("in_novel") == 1) & (c("in_other_name") == 1)
        & (c("in_interbank") == 1) & outflow & (c("since_in") > 0) & (c("since_in") <= 7_200)
        & (c("withdraw_in_180d") > 1) & (c("age") > 45),
        "r31": low & off & (nz("p_limit_2h") > 0) & (limit_14 > 1),
        "r32": outflow & (c("prev_dir") == 1) & (c("min_before_2h") < 50_000) & (c("off_names_2h") > 0)
        & (limit_14 > 0) & (c("age") > 65),
        "r33": outflow & (c("prev_dir") == 1) & (c("min_before_2h") < 50_000) & (c("off_names_2h") > 0)
        & (nz("p_limit_3d") > 0) & (limit_14 > 1),
        "r34": young_quiet & (c("other_name") == 1) & (assets_14 == 0) & (limit_14 == 0) & (c("open_days") < 1_095)
        & (c("age") < 26) & (c("funds_15d") >= 1),
        "r35": young_quiet & (assets_14 == 0) & (limit_14 == 0) & (c("open_days") < 1_095) & (c("age") < 26)
        & (c("off_strangers_3d") > 0),
        "r36": young_quiet & (c("withdraw_shop_15d") > 3) & (nz("p_promo_14d") > 1),
        "r37": young_quiet & (c("age") < 30) & (limit_14 > 0) & (c("novel_out_share_180d") > 0.8),
    }
    return rules
