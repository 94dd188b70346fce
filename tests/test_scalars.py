import pytest
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.operators import joins as J
from trailmark.operators.rules import alerts, apply_rules, bank_rules


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return tuple(df.select(*cols).first())


def test_ratios(spark):
    c = F.lit
    assert one(spark, S.safe_ratio(c(1), c(0)), S.safe_ratio(c(1), c(4)), S.positive_ratio(c(1), c(-2)), S.safe_ratio(c(3), c(-2))) == (None, 0.25, None, -1.5)


def test_circular_hours(spark):
    assert one(spark, S.circular_hours(F.lit(23), F.lit(1)), S.circular_hours(F.lit(3), F.lit(9))) == (2, 6)


def test_std_of_one_row_is_null_and_constants_are_zero(spark):
    n1 = S.sample_std(F.lit(1), F.lit(5.0), F.lit(25.0))
    same = S.sample_std(F.lit(3), F.lit(0.3), F.lit(0.03))
    assert one(spark, n1, same) == (None, 0.0)


def test_numbers_and_labels(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("-Infinity",), (None,)], "v string")
    assert [r[0] for r in S.to_numeric(df, ["v"]).collect()] == [1.5, None, None, None, None]
    bins = spark.createDataFrame([(1.0,), (5.0,), (5.1,), (None,)], "v double").select(S.bin_label("v", [1, 5]))
    assert [r[0] for r in bins.collect()] == ["01: <=1", "02: (1,5]", "03: >5", None]


def test_null_keeping_exclusion(spark):
    df = spark.createDataFrame([("fee x",), ("ok",), (None,)], "s string")
    assert [r[0] for r in S.exclude_like(df, "s", ["fee"]).collect()] == ["ok", None]
    assert one(spark, S.offsite_flag(F.lit(None).cast("string"), "home"), S.offsite_flag(F.lit("home"), "home"), S.offsite_flag(F.lit("b"), "home")) == (None, 0, 1)


def test_round_amounts(spark):
    f = S.round_amount_flags("v")
    got = spark.createDataFrame([(4_980.0,), (5_020.0,), (10_000.0,)], "v double").select(*[S.flag(p).alias(n) for n, p in f.items()]).collect()
    assert [r["near_5000_by_100"] for r in got] == [1, 1, 1]
    assert [r["not_above_round_1000"] for r in got] == [1, 0, 1]


def test_longest_prefix_prefers_longer(spark):
    dim = spark.createDataFrame([("62", 6, "a"), ("622", 6, "b"), ("6223", 7, "c")], "prefix string, length int, bank string")
    df = spark.createDataFrame([("622399",), ("621111",), ("6223999",), ("99",), (None,)], "k string")
    got = {r["k"]: r["bank"] for r in J.longest_prefix(df, dim, "k", [2, 3, 4]).collect()}
    assert got == {"622399": "b", "621111": "a", "6223999": "c", "99": None, None: None}


def test_override_uses_correction_even_when_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string")
    fix = spark.createDataFrame([(1, None)], "id long, p string")
    assert dict(map(tuple, J.override_from(df, fix, "id", ["p"]).select("id", "p").collect())) == {1: None, 2: "b"}


def test_rules_explode_and_exempt(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, 20, 50), (3, 30, 500)], "txn_id long, acct long, amt long")
    hits = apply_rules(df, {"big": F.col("amt") > 40, "huge": F.col("amt") > 400, "never": F.lit(None).cast("boolean")})
    assert sorted((r["txn_id"], r["rule_id"]) for r in hits.collect()) == [(2, "big"), (3, "big"), (3, "huge")]
    exempt = spark.createDataFrame([(30,)], "acct long")
    assert [r["txn_id"] for r in alerts(hits.unionByName(hits), exempt, "acct").collect()] == [2]


def test_rule_ids_complete(spark):
    assert list(bank_rules()) == [f"r{i}" for i in range(1, 38)]


def test_mixed_skewness_needs_five_rows(spark):
    xs = [1.0, 2.0, 3.0, 10.0]
    args = [F.lit(len(xs)), F.lit(sum(xs)), F.lit(sum(x**2 for x in xs)), F.lit(sum(x**3 for x in xs))]
    assert one(spark, S.mixed_skewness(*args)) == (None,)
    xs = xs + [20.0]
    m, n = sum(xs) / 5, 5
    sd = (sum((x - m) ** 2 for x in xs) / (n - 1)) ** 0.5
    args = [F.lit(n), F.lit(sum(xs)), F.lit(sum(x**2 for x in xs)), F.lit(sum(x**3 for x in xs))]
    assert one(spark, S.mixed_skewness(*args))[0] == pytest.approx(sum((x - m) ** 3 for x in xs) / n / sd**3)
