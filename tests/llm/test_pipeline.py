import corpus_pipeline
from seqloom.llm.common import table
from seqloom.llm.ngram_join import Rule

from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 3

    import re

    exact = stages["exact_dedup"](spark, kept, SF)
    groups = {}
    for r in kept.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in exact.collect()} == {min(g)[1] for g in groups.values()}

    near = stages["ngram_jaccard_join"](spark, exact, SF)
    found = brute([(r.doc_id, r.text) for r in exact.collect()], Rule(5, 80, 100))
    assert {r.doc_id for r in near.collect()} == {c for _, c in found.values()}

    clean = stages["decontamination"](spark, near, SF)
    items = [re.sub(r"\s+", " ", r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {r.doc_id for r in near.collect() if any(i in re.sub(r"\s+", " ", r.text) for i in items)}
    assert not dirty & {r.doc_id for r in clean.collect()} and clean.count() >= near.count() - len(dirty) - 1
    assert clean.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in clean.collect()}


def test_empty_documents(spark):
    out = table(spark, SF, "documents").limit(0)
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, out, SF)
    assert out.count() == 0
