"""The pipeline: every stage against its operator's own answer on the stage's input."""

import corpus_pipeline
from trailmark.llm import decontam, jaccard, pii, quality
from trailmark.llm.common import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = ({r.doc_id: r for r in x.collect()} for x in (kept, out))
        assert set(after) <= set(before)
        if name != "mixing":
            assert out.columns == columns
        if name == "quality":
            model = quality.learn(docs, quality.training_labels(table(spark, sf, "labels")))
            assert set(after) == {r.doc_id for r in quality.score(kept, model).filter("score >= 0.3").collect()}
        elif name == "near_duplicates":
            assert set(after) == {r.doc_id for r in jaccard.join(kept).filter("component_id = doc_id").collect()}
        elif name == "decontamination":
            hit = {r.doc_id for r in decontam.matches(kept, table(spark, sf, "benchmark")).collect()}
            assert set(after) == set(before) - hit
        elif name == "pii":
            assert set(after) == set(before)
            assert pii.scan(out).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
        else:
            assert all(0 < r.taken <= 3 * r.size for r in after.values())
        kept = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in kept.collect()}


def edge_tables(spark, folder, rows):
    words = "the river and the town are old but the bridge between them was built only a few years ago by people who".split()
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id long, size int, w string"
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, " ".join(words)), (1, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return words


def test_edges(spark, tmp_path):
    good = [f"Document {i} tells of place number {i * 37} where nobody has been since the year {1000 + i}. It ends here, after {i} words or so." for i in range(40)]
    rows = [(i, t if i % 4 else "!!! ### " * 20, "en", None if i % 3 else "a", len(t), 1, 2, "x") for i, t in enumerate(good)]
    leak = "the river and the town are old but the bridge between them was built only a few years ago by people who"
    odd = [
        (100, None), (101, ""), (102, " \n\t "), (103, "word " * 50_000), (104, good[1]), (1, good[1]), (None, good[2]), (None, None), (5, good[7]), (105, f"So {leak} came. {good[3]}"),
        (106, "Write to someone@example.org or call +49 30 1234567 today, said the man in the tower of the old town."),
    ]
    rows += [(i, t, None, "b", 0, None, None, None) for i, t in odd]
    edge_tables(spark, tmp_path / "odd", rows)
    docs = table(spark, str(tmp_path / "odd"), "documents")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, str(tmp_path / "odd")).write.parquet(str(tmp_path / f"out{k}"))
        kept = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert kept.columns == docs.columns
        if name == "near_duplicates":  # a copy under a larger id goes; a null id is never linked
            ids = [r.doc_id for r in kept.collect()]
            assert 104 not in ids or 1 not in ids
    ids = [r.doc_id for r in kept.collect()]
    assert 105 not in ids and 106 in ids
    assert "example.org" not in kept.filter("doc_id = 106").first().text
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path / "odd")).collect()
    assert all(0 < r.taken <= 3 * r.size for r in last)
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).filter("doc_id is not null").collect()) == sorted((r.doc_id, r.taken) for r in last if r.doc_id is not None)


def test_empty_documents(spark, tmp_path):
    edge_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
