"""Registered queries of the operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import ann, decontam, jaccard, langid, licences, mixing, pii, quality, quotes, repair, repeats, runs, warc
from trailmark.llm.common import fold, table


def op1_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.scan(table(spark, d, "documents"))


def op2_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join(table(spark, d, "documents"), width=4, percent=85)


def op3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(table(spark, d, "embeddings"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op5_licences(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(table(spark, d, "documents"))


def op6_quotations(spark: SparkSession, d: str) -> DataFrame:
    return quotes.conversations(table(spark, d, "conversations"))


def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.learn(docs, quality.training_labels(table(spark, d, "labels")))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op10_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = langid.learn(docs.filter(fold("doc_id", 4) != 2), F.xxhash64("doc_id"))
    return langid.predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove(table(spark, d, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.digests(runs.find(table(spark, d, "documents"), runs.planted))


def op13_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.report(repair.damaged(rows)).withColumnRenamed("conv_id", "__conv_id")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("__conv_id")), "left")
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OPERATORS = (
    op1_pii, op2_jaccard, op3_neighbours, op4_mixing, op5_licences, op6_quotations, op7_warc, op8_quality, op9_decontamination, op10_language,
    op11_repeats, op12_runs, op13_repair,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL: dict[str, str] = {}
