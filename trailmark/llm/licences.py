"""Licence scan with a trained paragraph classifier, in DataFrame functions and Spark ML only.

A paragraph is a line of the text, or a run of non-blank lines (hard-wrapped text) without the lines that state a
licence on their own; its number is that of its first line. Features of a paragraph are its words and word pairs, as far as they occur in the licence
templates. A multinomial logistic regression learns the families from templates and pieces of templates, and the class
``unknown`` from other paragraphs. A second regression on the margin over ``unknown`` turns it into a calibrated
probability that any family is meant; below ``LEAST`` the paragraph is unknown. A prediction is confirmed by comparison
with the templates of its family: the paragraph must hold at least ``COVER`` of one template's features, and a run as much of one's word pairs.

Scoring explodes features and joins the weights (one row per template feature, so of fixed size); only features with a
weight are grouped. The unknown class is learned from at most about ``SAMPLE`` paragraphs of the documents, by
hash (documented bound); all paragraphs of all texts are scored.

Defined cases: null and empty texts have no paragraphs; documents that share an id are told apart by their text, equal
rows count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import settled

SAMPLE, LEAST, COVER = 2000, 0.5, 0.6
UNKNOWN = "unknown"

# Statements by which texts declare their licence.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 License.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GPL v3.",
    ),
    "lgpl": ("Licensed under the GNU Lesser General Public License.", "This library is licensed under the LGPL."),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public-domain": ("This work is dedicated to the public domain.", "Released into the public domain under CC0 1.0."),
    "proprietary": ("All rights reserved.", "Copyright (c) All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Plain statements that use the same words.
OTHERS = (
    "The driver lost the license after the accident.", "A public library is open to any person free of charge.", "The general met the public in the file room.",
    "The rights of the reserved seats were released.", "Version 2.0 of the program was released in the following month.", "The work is subject to change.",
    "The terms of the project are found in the following file.", "He may not use the copy of the book.", "The source of the river is public.",
)


def grams(text: Column) -> Column:
    """Words and word pairs."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_distinct(F.concat(words, F.transform(F.slice(words, 2, F.size(words)), lambda x, i: F.concat_ws(" ", F.get(words, i), x))))


def line_lists(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, ls): the normalised lines of every text, blank ones too."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text <> ''")
    return rows.select("doc_id", F.xxhash64("text").alias("row"), F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " "), "\n").alias("ls"))


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, paragraph, words): normalised lines; several blank ones are counted too."""
    return line_lists(docs, doc_id, text).select("doc_id", "row", F.posexplode_outer("ls").alias("paragraph", "line"))


def pairs_of(words: Column | str) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def runs(lists: DataFrame) -> DataFrame:
    """(doc_id, row, ls, paragraph, line) of runs of several lines that hold ``COVER`` of one template's word pairs, so that its words stand together.

    ``paragraph`` is the first line of the run, ``line`` the whole of it.
    """
    said = [re.findall("[a-z0-9]+", x.lower()) for ts in TEMPLATES.values() for x in ts]
    wanted = [sorted({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)}) for ws in said]
    rows = lists.withColumn("ls", F.transform("ls", lambda x: F.btrim(x)))
    blank = lambda i: F.coalesce(F.get("ls", i), F.lit("")) == ""
    at = F.sequence(F.lit(0), F.size("ls") - 1)
    rows = rows.withColumn("a", F.filter(at, lambda i: ~blank(i) & blank(i - 1))).withColumn("b", F.filter(at, lambda i: ~blank(i) & blank(i + 1)))
    rows = rows.select("doc_id", "row", "ls", F.inline(F.arrays_zip("a", "b"))).filter("b > a")
    rows = rows.withColumn("line", F.array_join(F.slice("ls", F.col("a") + 1, F.col("b") - F.col("a") + 1), " "))
    vocabulary = F.array(*(F.lit(x) for x in sorted({x for xs in wanted for x in xs})))

    def covers(held: Column) -> Column:
        found = F.lit(False)
        for xs in wanted:
            found = found | (F.size(F.array_intersect(held, F.array(*(F.lit(x) for x in xs)))) >= COVER * len(xs))
        return found

    # bound by lambdas, as Spark would put the columns into the filter once for each use
    kept = F.exists(F.array(F.split("line", " ")), lambda ws: F.exists(F.array(F.array_intersect(vocabulary, pairs_of(ws))), covers))
    return rows.filter(kept).select("doc_id", "row", "ls", F.col("a").alias("paragraph"), "line")


def training(spark: SparkSession, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(family, grams): templates, their first and last parts, statements of other matters, paragraphs of the documents."""
    rows = []
    for family, templates in TEMPLATES.items():
        for t in templates:
            words = t.split()
            cuts = {0: len(words)} | ({len(words) // 5: len(words)} if len(words) > 9 else {})
            rows += [(family, " ".join(words[a:b]), 8.0) for a, b in cuts.items()]
            if len(words) > 9:
                rows.append((family, " ".join(words[: len(words) * 4 // 5]), 8.0))
            rows += [(family, f"{a} {t} {b}", 4.0) for a, b in (("Note:", ""), ("", "See above."), ("The text here is", "and more."))]
    rows += [(UNKNOWN, t, 8.0) for t in OTHERS]
    known = spark.createDataFrame(rows, "family string, t string, weight double")
    lines = paragraphs(docs, doc_id, text).filter("length(line) between 8 and 400")
    # taken evenly over the documents: one line in so many
    share = max(1, docs.count() * 4 // SAMPLE)
    other = lines.filter(F.pmod(F.xxhash64("row", "paragraph"), F.lit(share)) == 0).select("line").limit(2 * SAMPLE)
    cue = F.exists(F.array(*(F.lit(w) for w in ("licen", "rights reserved", "copyright", "public domain"))), lambda w: F.contains("line", w))
    other = other.filter(~cue).select(F.lit(UNKNOWN).alias("family"), F.col("line").alias("t"), F.lit(1.0).alias("weight"))
    return known.unionByName(other).select("family", grams(F.col("t")).alias("grams"), "weight")


def learn(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Families, the weights of every template feature, and the calibration of the margin."""
    vocabulary: CountVectorizerModel = CountVectorizer(inputCol="grams", outputCol="x", binary=True).fit(
        spark.createDataFrame([(t,) for ts in TEMPLATES.values() for t in ts], "t string").select(grams(F.col("t")).alias("grams"))
    )
    families = [*TEMPLATES, UNKNOWN]
    number = F.array_position(F.array(*(F.lit(f) for f in families)), F.col("family")) - 1
    rows = vocabulary.transform(training(spark, docs, doc_id, text)).select(number.cast("double").alias("y"), "x", "weight", "grams").cache()
    fit = LogisticRegression(labelCol="y", featuresCol="x", weightCol="weight", family="multinomial", regParam=0.002, maxIter=80, standardization=False)
    model = fit.fit(rows)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    table = [(g, [float(v) for v in weights[:, i]]) for i, g in enumerate(vocabulary.vocabulary)]
    found = {"families": families, "bias": [float(b) for b in bias], "weights": table}
    scored = rows.withColumn("at", F.monotonically_increasing_id()).select("at", "y", "weight", F.explode("grams").alias("g"))
    scored = scored.join(F.broadcast(weight_table(spark, found)), "g", "left").groupBy("at", "y", "weight").agg(*sums(len(families)))
    scored = scored.select(F.when(F.col("y") == len(families) - 1, 0.0).otherwise(1.0).alias("y"), "weight", margin(found).alias("m"))
    from pyspark.ml.feature import VectorAssembler

    line = LogisticRegression(labelCol="y", featuresCol="v", weightCol="weight", regParam=0.01).fit(VectorAssembler(inputCols=["m"], outputCol="v").transform(scored))
    found["slope"], found["shift"] = float(line.coefficients[0]), float(line.intercept)
    rows.unpersist()
    return found


def weight_table(spark: SparkSession, model: dict) -> DataFrame:
    return spark.createDataFrame(model["weights"], "g string, w array<double>")


def sums(n: int) -> list[Column]:
    return [F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in range(n)]


def margin(model: dict) -> Column:
    """Best family's score over that of ``unknown``."""
    n = len(model["families"])
    score = [F.col(f"s{k}") + model["bias"][k] for k in range(n)]
    return F.greatest(*score[:-1]) - score[-1]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """One row per paragraph that states a licence: family, probability and how much of a template it holds."""
    model = model or learn(docs.sparkSession, docs, doc_id, text)
    single = settled(stated(paragraphs(docs, doc_id, text), model))
    # runs are looked at without the lines that state a licence on their own; these end a run
    lines = single.groupBy(F.col("doc_id").alias("__d"), F.col("row").alias("__r")).agg(F.collect_set("paragraph").alias("__ps"))
    likely = runs(line_lists(docs, doc_id, text)).select("doc_id", "row", "ls").distinct()
    likely = likely.join(lines, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("row") == F.col("__r")), "left")
    left = F.transform("ls", lambda x, i: F.when(F.coalesce(F.array_contains("__ps", i), F.lit(False)), "").otherwise(x))
    wrapped = stated(runs(likely.select("doc_id", "row", left.alias("ls"))).drop("ls"), model)
    found = single.unionByName(wrapped)
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", "cover")


def stated(lines: DataFrame, model: dict) -> DataFrame:
    """(doc_id, row, paragraph, family, probability, cover) of the lines that state a licence."""
    spark = lines.sparkSession
    n = len(model["families"])
    words = lines.select("doc_id", "row", "paragraph", F.split(F.btrim("line"), " ").alias("ws"))
    pairs = pairs_of("ws")
    said = words.select("doc_id", "row", "paragraph", F.concat("ws", pairs).alias("gs")).select("doc_id", "row", "paragraph", F.explode_outer("gs").alias("g"))
    weights = weight_table(spark, model)
    met = said.join(F.broadcast(weights), "g").groupBy("doc_id", "row", "paragraph", "g").agg(F.first("w").alias("w"))
    scored = met.groupBy("doc_id", "row", "paragraph").agg(*sums(n), F.collect_set("g").alias("gs"))
    sure = 1 / (1 + F.exp(-(margin(model) * model["slope"] + model["shift"])))
    ranked = F.array(*(F.struct((F.col(f"s{k}") + model["bias"][k]).alias("s"), F.lit(model["families"][k]).alias("family")) for k in range(n - 1)))
    best = F.array_max(ranked)["family"]
    scored = scored.select("doc_id", "row", "paragraph", best.alias("family"), sure.alias("probability"), "gs").filter(F.col("probability") >= LEAST)
    templates = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, t string").select("family", grams(F.col("t")).alias("ts"))
    held = F.size(F.array_intersect("ts", "gs")) / F.size("ts")
    compared = scored.join(F.broadcast(templates), "family").groupBy("doc_id", "row", "paragraph", "family", "probability").agg(F.max(held).alias("cover"))
    return compared.filter(F.col("cover") >= COVER)
