"""One row that each rule fires on, and the row just beside its limits that it doesn't."""

import pytest
from pyspark.sql import functions as F

from trailmark.functions.tagsets import REMARK_TAGS
from trailmark.operators import rulerow as W
from trailmark.operators.rules import apply_rules, bank_rules
from trailmark.operators.statements import text_flags

#: A quiet inflow from a stranger far away on a nearly empty account, and an outflow right after one.
IN = dict(dir=1, reversed=0, novel=1, other_name=1, amt=4600.0, bal=4700.0, offsite=1, tr_any=1, tr_short=1, r_std=0, card=1, r_wallet=0, acct_mark=0, near_bank=0,
          near_region=0, r_entrusted=0, r_interbank=0, age=50, open_days=3000, p_cert_180d=1)
OUT = dict(dir=0, reversed=0, prev_dir=1, prev_amt=20000.0, amt=20000.0, bal=100.0, min_before_2h=200.0, min_before_30min=200.0, since_prev=60.0, r_repay=0, cash=0,
           cash_only=0, to_credit=0, age=30, off_names_2h=0, off_names_30min=0)
#: rule -> (row, what the rule asks beyond it, a change after which it doesn't fire)
CASES = {
    "r1": (IN, dict(p_limit_14d=2), dict(p_limit_14d=1)), "r2": (IN, dict(r_wallet=1, strangers_3d=1, p_assets_14d=1), dict(strangers_3d=0)),
    "r3": (IN, dict(p_assets_14d=1), dict(offsite=None)), "r4": (IN, dict(r_wallet=1, acct_mark=1), dict(acct_mark=0)),
    "r5": (OUT, dict(off_names_2h=1), dict(prev_dir=0)), "r6": (OUT, dict(bank_in_2h=1, cash_only=1, p_limit_14d=1), dict(bal=1500.0)),
    "r7": (OUT, dict(off_names_30min=1, p_limit_14d=1, withdraw_amt_15d=5.0), dict(r_repay=None)),
    "r8": (IN, dict(novel_share_180d=0.34, novel_in_names_180d=19, late_withdraw_180d=4, p_limit_180d=1, p_assets_180d=31), dict(novel_in_names_180d=18)),
    "r9": (OUT, dict(off_names_2h=1, withdraw_amt_15d=1.0, p_limit_180d=2), dict(prev_amt=20200.0)),
    "r10": (IN, dict(novel_out_share_180d=0.71, novel_out_names_180d=21, withdraw_amt_15d=1.0), dict(bal=6100.0)),
    "r11": (IN, dict(p_limit_180d=1, probes_3d=1, days_gap=0), dict(days_gap=1)), "r12": (OUT, dict(off_names_2h=1, to_credit=1, refunds_180d=1), dict(refunds_180d=0)),
    "r13": (OUT, dict(cash=1, interbank_2h=1, rows_15d=4, days_180d=4, p_assets_180d=1), dict(in_near_bank=1)),
    "r14": (IN, dict(p_assets_180d=31, dawn_share_180d=0.21, late_withdraw_180d=12, novel_out_share_180d=0.81), dict(near_bank=1)),
    "r15": (IN, dict(novel_in_names_180d=0, p_limit_180d=1), dict(amt=5400.0, bal=5450.0)),
    "r16": (IN, dict(shop_out_share_180d=0.51, shop_in_share_180d=0.32, p_assets_14d=1), dict(shop_in_share_180d=0.33)),
    "r17": (IN, dict(shop_out_share_180d=0.51, shop_in_share_180d=0.01, p_assets_14d=1, dawn_180d=1, p_limit_14d=1), dict(shop_out_share_180d=0.5)),
    "r18": (IN, dict(shop_in_share_180d=0.01, p_assets_14d=1, dawn_180d=1, p_limit_14d=1), dict(dawn_180d=0)),
    "r19": (IN, dict(shop_in_share_180d=0.01, p_assets_14d=1, dawn_180d=1, p_limit_14d=1), dict(p_limit_14d=0)),
    "r20": (IN, dict(shop_out_share_180d=0.71, shop_in_share_180d=0.04, withdraw_shop_15d=1, withdraw_share_180d=0.16, days_180d=71, p_cert_180d=0), dict(days_180d=70)),
    "r21": (IN, dict(p_limit_2h=1, offsite=None), dict(near_region=None)),
    "r22": (IN, dict(cash_out_amt_180d=10001.0, cash_out_180d=2, cash_out_share_180d=0.31), dict(cash_out_180d=1)),
    "r23": (IN, dict(p_limit_180d=1, probes_3d=1), dict(tr_short=0, card=0)),
    "r24": (IN, dict(stranger_names_30min=1, late_withdraw_15d=1, pairs_15d=4, r_interbank=1), dict(pairs_15d=3)),
    "r25": (IN, dict(r_interbank=1, cash_out_amt_180d=100000.0, cash_out_180d=5, person_in_share_15d=1.0, in_out_ratio_15d=1.1), dict(in_out_ratio_15d=1.11)),
    "r26": (IN, dict(ins_15d=2, pairs_15d=2, novel_share_180d=0.66, late_share_15d=0.34), dict(ins_15d=3)),
    "r27": (IN, dict(novel_out_parties_180d=31, stranger_names_30min=2), dict(stranger_names_30min=1)), "r28": (IN, dict(probes_15d=2, withdraw_shop_180d=1), dict(probes_15d=1)),
    "r29": (IN, dict(rows_15d=10, funds_3d=2), dict(rows_15d=11)),
    "r30": (OUT, dict(in_dir=1, in_before=10.0, in_novel=1, in_other_name=1, in_interbank=1, since_in=7200.0, withdraw_in_180d=2, age=46), dict(since_in=7201.0)),
    "r31": (IN, dict(p_limit_2h=1, p_limit_14d=2), dict(p_limit_2h=0)), "r32": (OUT, dict(off_names_2h=1, p_limit_14d=1, age=66), dict(age=65)),
    "r33": (OUT, dict(off_names_2h=1, p_limit_3d=1, p_limit_14d=2), dict(p_limit_14d=1)),
    "r34": (IN, dict(p_assets_14d=0, p_limit_14d=0, open_days=1000, age=25, funds_15d=1), dict(open_days=1095)),
    "r35": (IN, dict(p_assets_14d=0, p_limit_14d=0, open_days=1000, age=25, off_strangers_3d=1, other_name=0), dict(age=26)),
    "r36": (IN, dict(withdraw_shop_15d=4, p_promo_14d=2), dict(withdraw_shop_15d=3)), "r37": (IN, dict(age=29, p_limit_14d=1, novel_out_share_180d=0.81), dict(age=30)),
}


def test_every_rule_has_a_hit_and_a_miss(spark):
    known = {**W.measures(), **W.SHARES}
    names = sorted({*known, W.PAIRS, *IN, *OUT, *(k for _, a, b in CASES.values() for k in (*a, *b)), "in_near_bank", "since_in"})
    rows = []
    for rule, (base, more, less) in CASES.items():
        for hit, values in ((1, {**base, **more}), (0, {**base, **more, **less})):
            rows.append((rule, hit, *(None if values.get(n) is None else float(values[n]) for n in names)))
    df = spark.createDataFrame(rows, "want string, expect int, " + ", ".join(f"{n} double" for n in names))
    assert set(CASES) == set(bank_rules())
    found = {(r.want, r.expect) for r in apply_rules(df, bank_rules()).filter("rule_id = want").collect()}
    assert found == {(rule, 1) for rule in CASES}


def test_only_what_the_rules_read_is_planned():
    rules = bank_rules()
    wanted, shares, pairs = W.planned([rules["r26"]], W.measures())
    assert set(shares) == {"novel_share_180d", "late_share_15d"} and pairs
    assert set(wanted) == {"ins_15d", "in_strangers_180d", "in_others_180d", "late_15d", "rows_15d"}
    wanted, shares, pairs = W.planned(rules.values(), W.measures())
    assert len(shares) == len(W.SHARES) and pairs


def test_flags_of_texts(spark):
    rows = [("跨行网银贷记来款", "现金", "张三", "李四", "6217001234567890", "佛山支行", "广东", None), (None, None, None, "李四", None, None, None, None),
            ("贷款提前归还", "冲销记账", "李四", "李四", "20881234", "北京", "北京", "佛山"), ("", "取款", "某某贸易公司", "李四", "6222052000000001234", "广州", "上海", "上海")]
    df = spark.createDataFrame(rows, "remark string, summary string, party string, own_name string, party_acct string, bank string, region string, city string")
    a, b, c, d = df.withColumns(text_flags()).collect()
    assert (a.other_name, a.person, a.tr_any, a.r_interbank, a.cash_only, a.card, a.near_bank, a.near_region, a.offsite, a.reversed) == (1, 1, 1, 1, 1, 1, 1, 1, 0, 0)
    assert (b.other_name, b.tr_any, b.r_std, b.r_repay, b.near_region, b.offsite, b.reversed, b.near_bank) == (0, 0, None, None, None, None, 0, 0)
    assert (c.other_name, c.r_repay, c.reversed, c.pay_acct, c.card, c.near_bank, c.near_region, c.offsite) == (0, 1, 1, 1, 0, 1, 0, 1)
    assert (d.other_name, d.no_remark, d.cash_out, d.cash, d.acct_mark, d.near_region, d.card) == (0, 1, 1, 0, 1, 1, 1)


@pytest.mark.parametrize("name", ["transfer_in", "repay", "shopping"])
def test_tags_are_plain_words(name):
    assert REMARK_TAGS[name] and all(isinstance(w, str) for w in REMARK_TAGS[name])
