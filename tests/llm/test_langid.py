from pyspark.sql import functions as F

from seqloom.llm.langid import identify, reject
from seqloom.llm.registry import op4_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = op4_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    train = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10)]
    train = spark.createDataFrame(train, "id long, text string, lang string")
    rows = [(1, "the dog", "x"), (2, "le chien", "x"), (3, None, "x"), (4, "", "x"), (5, "123 !? ²", "x"), (6, "thedog", "x"), (1, "the dog", "x"), (None, "le chat " * 40_000, "x")]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), train).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    assert len(got) == len(rows) and by[3].score == 0
    nothing = train.filter("id < 0")
    assert {r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), nothing).collect()} == {"und"}
    assert identify(spark.createDataFrame([], "doc_id long, text string"), train).count() == 0


def test_reject_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = reject(docs)
    assert kept.columns == docs.columns
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert len(lost) < 10
    odd = docs.limit(3).withColumn("text", F.lit("0 1 2"))
    assert reject(docs.filter("doc_id >= 0").unionByName(odd.withColumn("doc_id", -F.col("doc_id") - 1))).filter("doc_id < 0").count() == 0
