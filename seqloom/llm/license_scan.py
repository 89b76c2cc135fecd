"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates. DataFrame and spark.ml only.

Paragraphs are blocks of lines that hold a letter or digit; comment marks are no words, so that notices in source files are
read like others. What is classified are passages: the words of each line, and those of each paragraph of several lines, joined,
so that wrapped notices are whole again; longer ones in overlapping windows of WIDTH words. Each passage becomes the set of
those of its words and word pairs that occur in a template or a near miss. A multinomial logistic regression tells licence
families from `unknown`; a second, one-dimensional one turns the margin over `unknown` into a calibrated probability that the
passage is a licence at all. It is fitted on templates and texts that the first has not seen: the first is fitted without
them, then again with them. Passages above MIN_KNOWN are compared with the templates of the predicted family: the share
of a template's word triples that the passage holds must reach CONFIRM. What isn't confirmed is unknown.

Only passages with a word that begins like one of ANCHORS are classified: no template has CONFIRM of its triples without one,
so no other can be confirmed (``free_share``).

Training rows are the templates, whole, in halves, and after words of other passages; `unknown` rows are at most about
MAX_BACKGROUND passages of BACKGROUND_DOCS documents, both picked by hashes of their texts, that share no word triple with a
template, sentences that only talk about licences, and the templates' words in alphabetical order. The model has one
weight for each known term and family, and is fitted on at most PARTS tasks at once, which bounds what is sent to the driver.

Defined cases: null and empty texts have no paragraphs and no families. Documents with one id count as one (null ids
too). Repeated paragraphs count each time. Of notices of two families in one line, or in one window, the likelier is found; of
families that are as likely the first of FAMILIES. Extra columns, whatever their names, are ignored. An empty table gives an
empty result. Long paragraphs are read whole.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

MAX_BACKGROUND, BACKGROUND_DOCS = 4_000, 1_000
MIN_KNOWN = 0.5
#: Tasks of each pass over the few thousand training rows. Every one sends a gradient to the driver.
PARTS = 4
CONFIRM = 0.6
#: Words of a window, and from the start of one to that of the next: all runs of WIDTH - STEP words are in one window.
WIDTH, STEP = 64, 24
UNKNOWN = "unknown"

#: Notices by which each family is usually declared (public licence texts, abridged).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ),
}
#: Sentences about licences that declare none.
NEAR_MISSES = (
    "His driving license was renewed at the public office.",
    "The general public was permitted to use the work of the library.",
    "A license is required to distribute copies of this magazine, the publisher said.",
    "The software company released version 2.0 of its product under pressure.",
    "She is a licensed physician at the MIT campus.",
    "All rights reserved by the author of this work.",
    "The terms of the agreement are subject to applicable law.",
    "Apache helicopters were released to the public in version two of the game.",
    "You may obtain a copy of the report at the office, free of charge.",
    "This program is broadcast under the terms of the public charter.",
)
FAMILIES = (UNKNOWN, *TEMPLATES)


def plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _plain_triples(template: str) -> set[tuple[str, ...]]:
    words = plain_words(template)
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def _free(template: str, anchors: tuple[str, ...]) -> list[tuple[str, ...]]:
    return sorted(t for t in _plain_triples(template) if not any(w.startswith(anchors) for w in t))


def _anchors() -> tuple[str, ...]:
    """Words of the templates, long ones first, until no template has CONFIRM of its triples without one."""
    found: tuple[str, ...] = ()
    for template in (t for texts in TEMPLATES.values() for t in texts):
        while len(free := _free(template, found)) >= CONFIRM * len(_plain_triples(template)):
            found += (max(sorted({w for t in free for w in t}), key=lambda w: len(w) ** 3 * sum(w in t for t in free)),)
    return found


#: A passage that holds enough of a template has a word with one of these beginnings.
ANCHORS = _anchors()


def free_share(template: str) -> float:
    """Share of a template's word triples that a passage without ANCHORS can hold."""
    return len(_free(template, ANCHORS)) / max(1, len(_plain_triples(template)))


def _known_terms() -> list[str]:
    """Words and pairs of neighbours in the templates and near misses."""
    found: set[str] = set()
    for text in (*(t for texts in TEMPLATES.values() for t in texts), *NEAR_MISSES):
        words = plain_words(text)
        found.update(words, map(" ".join, zip(words, words[1:], strict=False)))
    return sorted(found)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _terms(words: Column) -> Column:
    known = _known_terms()
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(-1)), F.lit(1)), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    every = F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)
    return F.array_distinct(F.filter(every, lambda t: t.isin(known)))


def _with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds words and terms: those of the words and pairs of neighbours that are known."""
    df = df.withColumn("words", _words(F.col(text)))
    return df.withColumn("terms", _terms(F.col("words")))


def _triples(words: str) -> Column:
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(3)]))).otherwise(F.array().cast("array<bigint>"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(FAMILIES.index(f), i, t) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "family int, number int, template string").withColumn("t_words", _words(F.col("template")))
    return df.withColumn("t_triples", F.array_distinct(_triples("t_words")))


def _paragraphs(text: Column) -> Column:
    """The blocks of lines with letters or digits."""
    found = F.split(F.coalesce(text, F.lit("")), r"(?:\r\n|\r|\n)(?:[^\p{L}\p{N}\r\n]*(?:\r\n|\r|\n))+")
    return F.filter(found, lambda p: F.regexp_like(p, F.lit(r"[\p{L}\p{N}]")))


def _passages(docs: DataFrame) -> DataFrame:
    """docs(text, ...) to a row (..., paragraph, words) for each passage."""
    keep = [c for c in docs.columns if c != "text"]
    each = docs.select(*keep, F.posexplode(_paragraphs(F.col("text"))).alias("paragraph", "block"))
    each = each.withColumn("lines", F.split("block", r"[\r\n]+"))
    units = F.when(F.size("lines") > 1, F.concat(F.array("block"), F.col("lines"))).otherwise(F.col("lines"))
    # dnl and rem begin comment lines; all other marks are no words
    bare = F.transform(units, lambda t: F.regexp_replace(t, r"(?im)^[ \t]*(?:dnl|rem)\b", ""))
    words = each.select(*keep, "paragraph", F.explode(F.transform(bare, _words)).alias("all"))
    n = F.size("all")
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(n - WIDTH, F.lit(0)) / STEP).cast("int"))
    windows = F.when(n > WIDTH, F.transform(starts, lambda i: F.slice("all", i * STEP + 1, F.lit(WIDTH)))).otherwise(F.array("all"))
    return words.filter(n > 0).select(*keep, "paragraph", F.explode(windows).alias("words"))


def _picked(rows: DataFrame, text: str, most: int) -> DataFrame:
    """About `most` rows at most, by a hash of a text: the same ones however the rows are dealt."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(text, F.lit(most)), F.lit(1_000_000_000)) < max(1, int(1e9 * most / n)))


def _training(docs: DataFrame) -> DataFrame:
    """(text, label, part): a few thousand rows; part 0 is held out for the calibration, by template and by distinct text."""
    spark = docs.sparkSession
    own = _templates(spark).withColumn("part", F.pmod(F.xxhash64("template"), F.lit(4)))
    known = [h for h in sorted({h for r in own.select("t_triples").collect() for h in r[0]})]
    passages = _passages(_picked(docs.select("text").filter(F.length("text") > 0), "text", BACKGROUND_DOCS))
    passages = passages.select(F.array_join("words", " ").alias("text"), "words").filter(~F.exists(_triples("words"), lambda h: h.isin(known)))
    background = stage(_picked(stage(passages.select("text"), "passages"), "text", MAX_BACKGROUND).distinct(), "background")

    sorted_words = own.select(F.array_join(F.array_sort("t_words"), " ").alias("text"))
    misses = spark.createDataFrame([(t,) for t in NEAR_MISSES], "text string").unionByName(sorted_words).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("r")
    unknown = background.unionByName(misses).select("text", F.lit(0.0).alias("label"), F.pmod(F.xxhash64("text"), F.lit(4)).alias("part"))
    words = F.split("template", " ")
    half = F.expr("greatest(1, size(split(template, ' ')) div 2)")
    label, repeats = F.col("family").cast("double").alias("label"), F.explode(F.array_repeat(F.lit(0), 20))
    around = background.select(F.col("text").alias("a")).orderBy(F.xxhash64("a"), "a").limit(20)
    joined = own.join(F.broadcast(around.agg(F.collect_list("a").alias("around")))).select(F.explode(F.concat(F.array(F.lit("")), F.col("around"))).alias("a"), "template", label, "part")
    joined = joined.select(F.concat_ws(" ", "a", "template").alias("text"), "label", "part")
    whole = own.select(F.col("template").alias("text"), label, "part", repeats.alias("r")).drop("r")
    parts = own.filter("size(t_words) >= 10").select(F.explode(F.array(F.array_join(F.slice(words, F.lit(1), half + 4), " "), F.array_join(F.slice(words, half - 2, F.lit(400)), " "))).alias("text"), label, "part", repeats.alias("r")).drop("r")
    return stage(unknown.unionByName(joined).unionByName(whole).unionByName(parts).repartition(4, "text"), "training")


class Classifier:
    """The two fitted models and their application."""

    def __init__(self, docs: DataFrame):
        self.vocabulary = CountVectorizerModel.from_vocabulary(_known_terms(), inputCol="terms", outputCol="features").setBinary(True)
        rows = stage(self.vocabulary.transform(_with_terms(_training(docs))).select("features", "label", "part").coalesce(PARTS), "features").coalesce(PARTS)
        fit = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, predictionCol="family", probabilityCol="p", rawPredictionCol="raw").fit
        self.model = fit(rows.filter("part > 0"))
        held = self._margins(rows.filter("part = 0")).withColumn("known", (F.col("label") > 0).cast("double"))
        self.calibration = LogisticRegression(featuresCol="m", labelCol="known", regParam=1e-3, maxIter=40, predictionCol="is_known", probabilityCol="p_known", rawPredictionCol="raw_known").fit(self._assembled(held))
        self.model = fit(rows)

    def _margins(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows).withColumn("z", vector_to_array("raw"))
        rest = F.slice("z", 2, len(FAMILIES) - 1)
        out = out.withColumn("margin", F.array_max(rest) - F.get("z", F.lit(0)))
        return out.withColumn("family", F.array_position(rest, F.array_max(rest)).cast("int"))

    def _assembled(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=["margin"], outputCol="m").transform(rows)

    def apply(self, rows: DataFrame) -> DataFrame:
        """Rows with words and terms, and for each the best family and probability, the calibrated one of any."""
        found = self._margins(self.vocabulary.transform(rows))
        w, b = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        return found.withColumn("probability", 1 / (1 + F.exp(-(F.col("margin") * w + b))))


def _anchored(words: Column) -> Column:
    return F.exists(words, lambda w: F.regexp_like(w, F.lit("^(?:" + "|".join(ANCHORS) + ")")))


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each id: n_paragraphs, licences (families in alphabetical order), n_licence_paragraphs, probability (highest)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = Classifier(docs)
    likely = docs.withColumn("rid", F.monotonically_increasing_id()).filter(F.regexp_like(F.coalesce(F.col("text"), F.lit("")), F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(ANCHORS) + ")")))
    passages = _passages(likely).filter(_anchored(F.col("words")))
    found = model.apply(passages.withColumn("terms", _terms(F.col("words")))).filter(F.col("probability") >= MIN_KNOWN).select("id", "rid", "paragraph", "family", "probability", "words")
    templates = F.broadcast(_templates(df.sparkSession).select(F.col("family").alias("t_family"), "t_triples"))  # a fixed table
    share = F.size(F.array_intersect("t_triples", "triples")) / F.greatest(F.size("t_triples"), F.lit(1))
    confirmed = (
        found.withColumn("triples", F.array_distinct(_triples("words")))
        .join(templates, F.col("family") == F.col("t_family"))
        .filter(share >= CONFIRM)
    )
    names = F.array(*[F.lit(f) for f in FAMILIES])
    # several passages of a paragraph may confirm, each several templates; the count goes by paragraphs
    hits = confirmed.groupBy("id", "rid", "paragraph").agg(F.collect_set(F.get(names, F.col("family"))).alias("f"), F.max("probability").alias("p"))
    hits = hits.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("licences"), F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    totals = docs.groupBy("id").agg(F.sum(F.size(_paragraphs(F.col("text")))).alias("n_paragraphs"))
    return totals.join(hits.withColumnRenamed("id", "h_id"), F.col("id").eqNullSafe(F.col("h_id")), "left").select(
        F.col("id").alias(id_col),
        F.col("n_paragraphs").cast("long").alias("n_paragraphs"),
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_licence_paragraphs"),
        F.coalesce("p", F.lit(0.0)).alias("probability"),
    )
