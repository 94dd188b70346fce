"""What the near-duplicate join sends: whole sets only where parts of them leave a link, and no shuffle files after a step."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import jaccard
from trailmark.llm.common import settled
from trailmark.plans.lineage import settle


def shuffle_blocks(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(k).name().startswith("shuffle_") for k in range(blocks.size()))


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    for store in (settle, settled):
        before = shuffle_blocks(spark)
        kept = store(spark.range(5_000).groupBy((F.col("id") % 7).alias("k")).count())
        assert kept.agg(F.sum("count")).first()[0] == 5_000
        for _ in range(50):
            if shuffle_blocks(spark) <= before + 2:  # those of the sum above
                break
            time.sleep(0.1)
        assert shuffle_blocks(spark) <= before + 2


def test_copies_and_all_texts_of_one_id_are_linked(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    rows = [(100 * r + i, t) for r in range(3) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, None), (900, None), (901, None), (5, "another text of one id that links with nothing"), (205, texts[7]), (205, texts[9] + " x"), (3, texts[3])]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    roots = {r.doc_id: r.component_id for r in got}
    joined = {5, 7, 9}  # the three texts of 205, which are one node
    assert roots == {i: None if i is None else i if i >= 900 else 5 if i % 100 in joined else i % 100 for i, _ in rows}
    assert sorted(r.n_shingles for r in got if r.doc_id == 205) == [26, 26, 27]


def test_whole_sets_only_where_parts_leave_a_link(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = words(8)
    # long texts, each found in pieces in the others, that share a passage but are not near
    far = [words(500) for _ in range(12)]
    pool = [w for t in far for w in t]
    texts = [" ".join([*common, *t]) for t in far] + [" ".join(pool[k * 400 : k * 400 + 700]) for k in range(12)]
    near = words(600)
    texts += [" ".join(near), " ".join([*near[:-3], "x", "y"])]
    sent, met = [], jaccard.met
    monkeypatch.setattr(jaccard, "met", lambda placed, *rest: sent.append({r.rep for r in placed.select("rep").distinct().collect()}) or met(placed, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(df).collect()}
    assert got == {i: i if i != 25 else 24 for i in range(26)}
    assert len(sent[0]) > 12 and {24, 25} <= sent[1] and len(sent[1]) <= 4


def test_parts_lose_no_link():
    rng = np.random.default_rng(5)
    top = np.uint64(int(jaccard.region(80) * 2**64))
    base = rng.integers(0, 2**63, 900, np.uint64) * np.uint64(2)
    sets = [np.sort(np.unique(np.concatenate([rng.permutation(base)[: rng.integers(780, 900)], rng.integers(0, 2**63, rng.integers(0, 60), np.uint64)]))) for _ in range(60)]
    sets += [np.sort(np.unique(rng.integers(0, 2**63, 850, np.uint64) * np.uint64(2))) for _ in range(60)]
    ids, side = np.arange(120), np.zeros(120, int)
    whole = jaccard.linked(ids, [s.view(np.int64) for s in sets], side, 80)
    parts = [s[s < top].astype(np.uint32) for s in sets]
    least = dict(jaccard.linked(ids, parts, side, 80, np.array([len(s) - len(p) for s, p in zip(sets, parts, strict=True)])))
    assert whole and all(least.get(a, a) == least.get(b, b) for a, b in whole)
    assert not any(i in least for i in range(60, 120))


def test_keep_one_sends_the_ids_and_not_the_texts(spark):
    texts = ["a b c d e f g h"] * 3 + ["i j k l m n o p", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = jaccard.keep_one(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
