"""Aligned blocks and the largest key of a window, against their definitions."""

import random

from pyspark.sql import functions as F

from trailmark.operators.ranking import top_value
from trailmark.plans.dyadic import above, cover, window_tops
from trailmark.plans.profile import KeyMeasure, distinct, key_profile, key_profile_days, key_profiles, rows, squares
from trailmark.schema import DAY, SECOND

FLOW = "txn_id long, acct long, t long, dt date, party string, chan string, amt double, dir int"


def make_flow(spark, n=1500, hot=0.4, days=40, seed=3):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        t = rng.randrange(days * 86_400 // 600) * 600 * SECOND
        acct = 1 if rng.random() < hot else rng.randrange(2, 12)
        made.append((i, acct, t, rng.choice(["a", "b", "c", "d", "e", None]) if acct > 1 else f"p{rng.randrange(60)}", rng.choice("xyz"), rng.randrange(-500, 9000) / 100, rng.randrange(2)))
    df = spark.createDataFrame(made, "txn_id long, acct long, t long, party string, chan string, amt double, dir int")
    return df.withColumn("dt", F.date_from_unix_date((F.col("t") / DAY).cast("int")))


def test_blocks_cover_each_number_once(spark):
    for top in (0, 2, 5, 16):
        ranges = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(a, 75, 4)], "a long, b long")
        got = ranges.select("a", "b", F.explode_outer(cover(F.col("a"), F.col("b"), top)).alias("x")).collect()
        found = {}
        for r in got:
            spot = found.setdefault((r.a, r.b), [])
            if r.x is not None:
                spot += range(r.x.node << r.x.level, (r.x.node + 1) << r.x.level)
        assert all(sorted(v) == list(range(a, b)) for (a, b), v in found.items()) and len(found) == ranges.count()
    held = spark.range(100).select("id", F.explode(above(F.col("id"), 4)).alias("x")).collect()
    assert all(r.x.node == r.id >> r.x.level for r in held) and len(held) == 500


def windows(flow, seconds, where="true"):
    a, h = flow.alias("a"), flow.filter(where).alias("h")
    age = F.col("a.t") - F.col("h.t")
    return a.join(h, (F.col("a.acct") == F.col("h.acct")) & (age > 0) & (age <= seconds * SECOND)).select(
        F.col("a.txn_id").alias("txn_id"), *[F.col(f"h.{c}").alias(c) for c in ("party", "chan", "amt", "dt")])


def test_largest_total_of_a_key(spark):
    flow = make_flow(spark)
    for hot_rows in (100, 2_000_000):
        got = {r.txn_id: r for r in window_tops(flow, flow, "party", "7d", F.col("amt"), F.expr("dir = 1"), hot_rows=hot_rows).collect()}
        pairs = windows(flow, 604_800, "dir = 1 and party is not null").groupBy("txn_id", "party").agg(F.round(F.sum("amt"), 2).alias("s"))
        best = pairs.groupBy("txn_id").agg(F.min(F.struct((-F.col("s")).alias("m"), "party")).alias("b"), F.sum("s").alias("total"), F.count(F.lit(1)).alias("n")).collect()
        assert len(got) == flow.count()
        assert all((got[r.txn_id].party, got[r.txn_id].keys) == (r.b.party, r.n) and abs(got[r.txn_id].top + r.b.m) < 1e-9 and abs(got[r.txn_id].total - r.total) < 1e-6 for r in best)
        empty = set(got) - {r.txn_id for r in best}
        assert all(got[i].top is None and got[i].keys == 0 for i in empty)


def test_top_value_of_many_values(spark):
    flow = make_flow(spark, seed=5)
    got = {r.txn_id: (r.party, r.n) for r in top_value(flow, flow, "party", "14d").collect()}
    pairs = windows(flow, 1_209_600, "party is not null").groupBy("txn_id", "party").count()
    best = pairs.groupBy("txn_id").agg(F.min(F.struct((-F.col("count")).alias("m"), "party")).alias("b")).collect()
    assert {r.txn_id: (r.b.party, -r.b.m) for r in best} == {i: v for i, v in got.items() if v[1]}


def test_one_stream_for_many_profiles(spark):
    flow = make_flow(spark, seed=7)
    measures = [
        KeyMeasure({"a": distinct, "a_rows": rows}, ("party",), "3d"), KeyMeasure({"b": squares}, ("chan",), "14d", F.expr("dir = 1")),
        KeyMeasure({"c": distinct}, ("chan", "party"), (2, 9), F.expr("amt > 10")), KeyMeasure({"d": rows}, ("party",), "2h", nulls=True),
    ]
    for hot_rows in (100, 2_000_000):
        got = {r.txn_id: tuple(r)[1:] for r in key_profiles(flow, flow, measures, hot_rows).collect()}
        parts = [
            key_profile(flow, flow, ["party"], "3d", {"a": distinct, "a_rows": rows}), key_profile(flow, flow, ["chan"], "14d", {"b": squares}, where=F.expr("dir = 1")),
            key_profile_days(flow, flow, ["chan", "party"], (2, 9), {"c": distinct}, where=F.expr("amt > 10")), key_profile(flow, flow, ["party"], "2h", {"d": rows}, nulls=True),
        ]
        wide = parts[0]
        for part in parts[1:]:
            wide = wide.join(part, "txn_id")
        assert got == {r.txn_id: tuple(x or 0 for x in tuple(r)[1:]) for r in wide.collect()} or got == {r.txn_id: tuple(r)[1:] for r in wide.collect()}
