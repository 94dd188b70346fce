"""Attributes of a bank statement row from its texts: remark, summary, counterparty name and account, bank, region and city."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.scalars import acct_shape, contains_any, differing_party, flag, lacks_all, offsite_flag
from trailmark.functions.tagsets import CARD_LENGTHS, CARD_PREFIX, HOME_REGION, REMARK_TAGS
from trailmark.operators.novelty import attach_flags, novel_values

# Banks and places near home, account prefixes and marks, lengths of a person's name.
NEAR_BANKS, NEAR_CITY = ["顺德", "佛山"], "佛山"
NEAR_PLACES = ["广东", "顺德", "佛山", "江门", "东莞", "深圳", "广州", "肇庆", "珠海", "中山", "湛江", "云浮", "惠州"]
WALLET_PREFIX, MARKED = "2088", (5, 3, "052")
PERSON = (2, 3)


def known(text: str, words: Sequence[str]) -> Column:
    """1 or 0, NULL where there is no text: ``NOT LIKE`` keeps no row without a text."""
    return F.when(F.col(text).isNotNull(), flag(contains_any(text, words)))


def text_flags(
    tags: Mapping[str, Sequence[str]] = REMARK_TAGS,
    home: str = HOME_REGION,
    near_banks: Sequence[str] = tuple(NEAR_BANKS),
    near_city: str = NEAR_CITY,
    near_places: Sequence[str] = tuple(NEAR_PLACES),
) -> dict[str, Column]:
    """The attributes that candidates, measures and rules read.

    Columns: ``remark``, ``summary``, ``party`` and ``own_name`` (names), ``party_acct``, ``bank``, ``region``, ``city``.
    Attributes that a rule demands to be *absent* are NULL where the text is, as then nothing is known.
    """
    def has(word: str) -> Column:
        return F.coalesce(flag(contains_any("remark", tags[word])), F.lit(0))

    said = F.coalesce(F.col("summary"), F.lit(""))
    account = F.coalesce(F.col("party_acct"), F.lit(""))
    start, size, mark = MARKED
    return {
        "other_name": F.coalesce(flag(differing_party("own_name", "party")), F.lit(0)),
        "unlike_name": F.coalesce(flag((F.col("own_name") != F.col("party")) & F.length("party").between(2, 4)), F.lit(0)),
        "person": F.coalesce(flag(F.length("party").between(*PERSON)), F.lit(0)),
        "reversed": flag(~lacks_all("summary", tags["reversal"])),
        "offsite": offsite_flag("region", home),
        "tr_any": has("transfer_in"),
        "tr_short": has("transfer_short"),
        "no_remark": F.coalesce(flag(F.col("remark") == ""), F.lit(0)),
        "r_std": known("remark", tags["standard_credit"]),
        "r_wallet": has("wallet"),
        "r_repay": known("remark", tags["repay"]),
        "r_interbank": has("interbank"),
        "r_entrusted": known("remark", tags["entrusted"]),
        "r_withdraw": has("withdraw"),
        "r_goods": has("goods"),
        "r_shop": has("shopping"),
        "r_loan": has("loan"),
        "r_fund": has("fund"),
        "r_refund": has("refund"),
        "cash_only": flag(said.isin(tags["cash_word"])),
        "cash": flag(contains_any(said, tags["cash_taken"])),
        "cash_out": flag(contains_any(said, tags["cash"])),
        "to_credit": flag(contains_any(said, tags["to_credit_card"])),
        "card": flag(acct_shape(account, CARD_PREFIX, CARD_LENGTHS)),
        "pay_acct": flag(account.startswith(CARD_PREFIX) | account.startswith(WALLET_PREFIX)),
        "acct_mark": flag(F.substring(account, start, size) == mark),
        "near_bank": F.coalesce(flag(contains_any("bank", near_banks)), F.lit(0)).bitwiseOR(F.coalesce(flag(F.col("city") == near_city), F.lit(0))),
        "near_region": known("bank", near_places),
    }


def with_text_flags(statements: DataFrame, **places) -> DataFrame:
    """The statements with the attributes of their texts, and ``novel``: a named counterparty not seen 7 to 180 days before."""
    rows = statements.withColumns(text_flags(**places))
    named = (F.col("own_name") != F.col("party")) & F.length(F.trim("party")).between(2, 4)
    return attach_flags(rows, {"novel": (novel_values(rows, "party", 7, 180, named), "party")})
