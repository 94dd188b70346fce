"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from trailmark.llm import ann, decontam, jaccard, langid, licences, mixing, pii, quality, quotes, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, w string, size long, part long"


def docs(spark, texts, repeat=True):
    rows = [(i, t, "en", "s" if i % 2 else None, 0, 1, "x", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1] * repeat + [(None, "no id here", None, None, None, None, None, None, None)], DOCS)


TEXTS = ["one two three four five six", None, "", " \n\t ", "word " * 60_000, "äöü 漢字 \u0000 end", "!!! ???"]


def test_pii(spark):
    got = pii.scan(docs(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS) + 2 and {r.spans for r in got} == {""}
    assert pii.scan(docs(spark, []).filter("false")).count() == 0
    kept = pii.redact(docs(spark, TEXTS))
    assert kept.columns == docs(spark, TEXTS).columns and kept.filter("text is null").count() == 1


def test_jaccard(spark):
    got = jaccard.join(docs(spark, [*TEXTS, TEXTS[0]])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(TEXTS) + 3
    assert by[7].component_id == 0 and by[0].n_shingles == 2
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (1, 2, 3))
    assert by[4].n_shingles == 1 and by[None].component_id is None
    assert jaccard.join(docs(spark, []).filter("false")).count() == 0


def test_ann(spark):
    rows = [(i, [float(i), 1.0, 0.5]) for i in range(30)] + [(40, None), (60, [0.0, 0.0, 0.0]), (80, [float("nan"), 1.0, 1.0]), (100, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (3, [3.0, 1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "t": F.lit(2), "score": F.lit("x")})
    got = ann.search(df).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 20}
    assert [r.vec_id for r in got if r.query_id == 20] == list(range(29, 20, -1)) + list(range(19, 8, -1))
    assert ann.search(df.filter("false")).count() == 0
    assert ann.search(df.filter("vec_id = 20")).count() == 0


def test_mixing(spark):
    got = mixing.mix(docs(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS) + 2
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got if r.source is None) <= 3 * next(r.source_size for r in got if r.source is None)
    assert mixing.mix(docs(spark, []).filter("false")).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""], False).filter("doc_id is not null")).collect()] == [0, 0]


def test_licences(spark):
    model = licences.learn(spark, docs(spark, TEXTS))
    found = licences.scan(docs(spark, [*TEXTS, "Intro.\nReleased under the MIT License.\n\nEnd", "released, under THE mit license"]), model=model)
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found.collect()) == [(7, 1, "mit"), (8, 0, "mit")]
    assert licences.scan(docs(spark, []).filter("false"), model=model).count() == 0


def test_quotes(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(empty).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/\r\nX: y", "é" * 50_000), (3, "u", "é" * 50_000), (None, "u", "z"), (4, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(pages.withColumn("sha1", F.lit(1)).withColumn("first", F.lit(1))).collect()}
    assert got[1].record_type == "response" and got[1].payload_bytes == 0
    assert (got[4].record_type, got[4].refers_to) == ("revisit", 1)
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("revisit", 2, 100_000)
    assert got[2].payload.decode() == "é" * 50_000 and got[None].record_type == "response"
    assert warc.archive(pages.filter("false")).count() == 0


def test_quality(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(docs(spark, TEXTS), none)
    assert {r.score for r in quality.score(docs(spark, TEXTS), model).collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (6, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    model = quality.learn(docs(spark, TEXTS), labels)
    got = quality.score(docs(spark, TEXTS), model).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in got)
    assert quality.keep(docs(spark, []).filter("false"), model).columns == docs(spark, []).columns


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "short one with words"), (4, "short one with words")], "item_id long, text string")
    there = docs(spark, [*TEXTS, "so alpha beta gamma delta epsilon zeta eta theta iota kappa ends", "a short one, with words."])
    got = decontam.matches(there, items.withColumn("width", F.lit(1)))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(7, 1), (8, 4)]
    assert decontam.clean(there, items).count() == there.count() - 2
    assert decontam.matches(there, items.filter("false")).count() == 0
    assert decontam.matches(there.filter("false"), items).count() == 0


def test_language(spark):
    got = {r.doc_id: r for r in langid.predict(docs(spark, TEXTS), langid.Model([], [])).collect()}
    assert {r.lang_pred for r in got.values()} == {"und"}
    model = langid.learn(docs(spark, TEXTS), F.xxhash64("doc_id"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(spark, TEXTS), model).collect()}
    assert model.languages == ["en"] and [k for k, v in got.items() if v == "und"] == [1, 2, 3, 6]
    assert langid.predict(docs(spark, []).filter("false"), model).count() == 0


@pytest.mark.parametrize("name", ["trailmark.llm.queries", "corpus_pipeline"])
def test_modules_import(name):
    import importlib

    assert importlib.import_module(name)


@pytest.mark.parametrize("sizes", [[20] * 600, [95, 2000, 20], [1, 1, 1, 5], [64 * 40, 64 * 90, 7]])
def test_mixing_comes_near_small_targets(spark, sizes):
    rows = [(100 * s + k, "w " * n, f"s{s:04d}") for s, size in enumerate(sizes) for k, n in enumerate([size // 2, size - size // 2])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= max(1.5, 0.04 * r.target) for r in by), [r for r in by if abs(r.taken - r.target) > max(1.5, 0.04 * r.target)][:5]
    assert got.filter("taken > 3 * size").count() == 0
