"""The queries opN_<name> over their whole tables, the pipeline, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, langid, license_scan, line_dedup, ngram_join, pii, ppm, toxicity
from .common import held_out, table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = ~held_out("doc_id", 4, 2)
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels"), usable), docs.filter(usable))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return line_dedup.drop_boilerplate(pages, line_dedup.lines_of_html(pages["html"]), line_dedup.host_of(pages["url"]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.split_training(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = ngram_join.Rule(words=3, num=90, den=100)
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), rule)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0))
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return found.withColumn("held_out", ~found["trained"]).select("doc_id", "held_out", *columns)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_line_dedup, op4_language_id, op5_exact_dedup, op6_ngram_jaccard_join, op7_benchmark_decontamination, op8_ppm_score, op9_pii_pseudonyms, op10_byte_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
