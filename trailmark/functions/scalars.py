"""Row-level expressions: ratios, bins, bands, tags, flags and coercions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(preds: Sequence[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def all_of(preds: Sequence[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def flag(pred: Column) -> Column:
    """0/1 with NULL counted as 0."""
    return F.when(pred, 1).otherwise(0)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, NULL where the denominator is 0 or NULL."""
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


def float_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as floating-point division: infinite or NaN where the denominator is 0, NULL where either is NULL."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    at_zero = F.when(n == 0, F.lit(math.nan)).otherwise(F.signum(n) * F.lit(math.inf))
    return F.when(d == 0, at_zero).otherwise(n / F.nullif(d, F.lit(0.0)))


def rounded(c: str | Column, digits: int) -> Column:
    """To ``digits`` digits as the SQL twins round: scaled, halves away from zero, scaled back. Infinities and NaN stay."""
    x, scale = _col(c), float(10**digits)
    return F.when(F.abs(x) < 1e300, F.round(x * scale) / scale).otherwise(x)


def positive_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL unless the denominator is positive."""
    d = _col(den).cast("double")
    return F.when(d > 0, _col(num).cast("double") / d)


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coerce to double; unparsable text, NaN and infinities become NULL."""
    out = {}
    for c in cols:
        v = F.expr(f"try_cast(`{c}` as double)")
        bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        out[c] = F.when(~bad, v)
    return df.withColumns(out)


# Upper edges and labels of the amount bins.
AMOUNT_BINS = [
    (100, "bin_amt_le100"),
    (1_000, "bin_amt_bw_100_1k"),
    (3_000, "bin_amt_bw_1k_3k"),
    (10_000, "bin_amt_bw_3k_1w"),
    (50_000, "bin_amt_bw_1w_5w"),
]
AMOUNT_BIN_ABOVE = "bin_amt_gt_5w"


def amount_bin(
    c: str | Column, edges: Sequence[tuple[float, str]] = tuple(AMOUNT_BINS), above: str = AMOUNT_BIN_ABOVE
) -> Column:
    amt = _col(c)
    out = F.when(amt.isNull(), None)
    for edge, label in edges:
        out = out.when(amt <= edge, label)
    return out.otherwise(above)


def bin_label(c: str | Column, cuts: Sequence[float]) -> Column:
    """Ordered interval labels ``01: <=a``, ``02: (a,b]``, ..., ``NN: >z``."""
    v = _col(c)
    out = F.when(v.isNull(), None)
    for i, cut in enumerate(cuts):
        text = f"<={cut}" if i == 0 else f"({cuts[i - 1]},{cut}]"
        out = out.when(v <= cut, f"{i + 1:02d}: {text}")
    return out.otherwise(f"{len(cuts) + 1:02d}: >{cuts[-1]}")


# Hour bands.
SLEEP_HOURS = (0, 1, 2, 3)
WORK_HOURS = (8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18)
REST_HOURS = (4, 5, 6, 7, 19, 20, 21, 22, 23)
LATE_HOURS = (23, 0, 1, 2, 3)
LATE_TEXT_HOURS = (23, 0, 1, 2, 3, 4)
DAWN_HOURS = (1, 2, 3, 4, 5)
NIGHT_FROM, NIGHT_TO = 22, 5


def is_night(hour: str | Column) -> Column:
    h = _col(hour)
    return (h >= NIGHT_FROM) | (h <= NIGHT_TO)


def in_hours(hour: str | Column, hours: Sequence[int]) -> Column:
    return _col(hour).isin(*hours)


def hour_band(hour: str | Column, bands: Mapping[str, Sequence[int]] | None = None) -> Column:
    bands = bands or {"sleep": SLEEP_HOURS, "work": WORK_HOURS}
    out = None
    for name, hours in bands.items():
        pred = in_hours(hour, hours)
        out = F.when(pred, name) if out is None else out.when(pred, name)
    return out.otherwise("rest")


def circular_hours(a: str | Column, b: str | Column) -> Column:
    """Distance of two hours around the clock."""
    d = F.abs(_col(a) - _col(b))
    return F.least(d, F.lit(24) - d)


def cyclic_hour(hour: str | Column) -> tuple[Column, Column]:
    turn = _col(hour).cast("double") * F.lit(2 * math.pi / 24)
    return F.sin(turn), F.cos(turn)


def round_amount_flags(c: str | Column) -> dict[str, Column]:
    """Tests for round amounts, each as a boolean."""
    v = _col(c)
    return {
        "mult_1000": F.pmod(v, F.lit(1000.0)) == 0,
        "mult_100": F.pmod(v, F.lit(100.0)) == 0,
        "tens_ones_zero": F.pmod(F.floor(v), F.lit(100)) == 0,
        "near_5000_by_100": F.pmod(F.round(v, -2), F.lit(5000.0)) == 0,
        "near_5000_by_1000": F.pmod(F.round(v, -3), F.lit(5000.0)) == 0,
        "not_above_round_1000": F.round(v, -3) - v >= 0,
    }


def balance_parts(amt: str | Column = "amt", bal: str | Column = "bal", floor: float = 0.1) -> dict[str, Column]:
    """Balance before a debit (credit) and the amount's share of it; never below ``floor``."""
    a, b = _col(amt), _col(bal)
    before_out = F.when(b + a > 0, b + a).otherwise(F.lit(floor))
    before_in = F.when(b - a > 0, b - a).otherwise(F.lit(floor))
    return {
        "before_out": before_out,
        "before_in": before_in,
        "out_share": a / before_out,
        "in_share": a / before_in,
    }


def contains_any(c: str | Column, words: Sequence[str]) -> Column:
    return any_of([_col(c).contains(w) for w in words])


def tag_like(df: DataFrame, col: str, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 column per family: does the text contain one of its words?"""
    return df.withColumns({name: flag(contains_any(col, words)) for name, words in families.items()})


def lacks_all(c: str | Column, words: Sequence[str]) -> Column:
    """True where none of the words occurs or the text is NULL."""
    return F.coalesce(~contains_any(c, words), F.lit(True))


def exclude_like(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    """Drop rows whose text contains one of the words; rows without text stay."""
    return df.filter(lacks_all(col, words))


def classify(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """First matching rule wins."""
    pred, label = rules[0]
    out = F.when(pred, label)
    for pred, label in rules[1:]:
        out = out.when(pred, label)
    return out.otherwise(default)


def pick_side(cond: Column, if_true: str | Column, if_false: str | Column) -> Column:
    return F.when(cond, _col(if_true)).otherwise(_col(if_false))


def acct_shape(c: str | Column, prefix: str, lengths: Sequence[int]) -> Column:
    v = _col(c)
    return v.startswith(prefix) & F.length(v).isin(*lengths)


def differing_party(own: str, other: str, lo: int = 1, hi: int = 4) -> Column:
    """Counterparty name present, of plausible length, and not the holder's own."""
    return F.length(other).between(lo, hi) & (F.col(own) != F.col(other))


def offsite_flag(c: str | Column, home: str) -> Column:
    """1 elsewhere, 0 at home, NULL when the place is unknown."""
    v = _col(c)
    return F.when(v != home, 1).when(v.isNotNull(), 0)


def composite_flag(preds: Sequence[Column]) -> Column:
    """1.0 when every predicate holds, else 0.0 (NULL counts as not holding)."""
    return flag(all_of(preds)).cast("double")


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def tenure_days(start: str | Column, end: str | Column) -> Column:
    return F.datediff(_col(end), _col(start))


def tenure_years(start: str | Column, end: str | Column) -> Column:
    return tenure_days(start, end) / F.lit(365.0)


def cv(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, std / mean)


def sample_std(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares; NULL for fewer than two rows.

    A spread below one part in a million of the magnitude is rounding noise of the sums and is 0.
    """
    return _std(n, s, ss, n - 1)


def population_std(n: Column, s: Column, ss: Column) -> Column:
    return _std(n, s, ss, n)


def spread_std(spread: Column) -> Column:
    """Population deviation of a ``spread``: (n, mean, m2)."""
    return F.when(spread["n"] > 0, F.sqrt(spread["m2"] / F.nullif(spread["n"], F.lit(0.0))))


def _std(n: Column, s: Column, ss: Column, dof: Column) -> Column:
    n, d = n.cast("double"), dof.cast("double")
    dev = ss - s * s / F.nullif(n, F.lit(0.0))
    dev = F.when(dev > ss * 1e-12, dev).otherwise(F.lit(0.0))
    return F.when(d > 0, F.sqrt(dev / F.nullif(d, F.lit(0.0))))


def mixed_skewness(n: Column, s: Column, ss: Column, sss: Column, min_rows: int = 5) -> Column:
    """Population third central moment over the cube of the sample deviation."""
    std = sample_std(n, s, ss)
    m = s / F.nullif(n.cast("double"), F.lit(0.0))
    third = sss / F.nullif(n, F.lit(0)) - 3 * m * (ss / F.nullif(n, F.lit(0))) + 2 * m * m * m
    return F.when((n >= min_rows) & (std > 0), third / F.nullif(F.pow(std, F.lit(3.0)), F.lit(0.0)))
