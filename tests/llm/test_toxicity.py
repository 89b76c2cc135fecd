import itertools
from collections import Counter

from pyspark.sql import functions as F

from seqloom.llm.registry import op1_toxicity
from seqloom.llm.toxicity import CONTEXT, EDGE, GLUE, CharModel, Restorer, decode, labelled, lattice, score, train

SF = "/root/testdata/sf0.1"
PLAIN = "you are an idiot and a worthless moron the house is green and sunny today with loose boots on the table seven stairs letter bottle".split()


def model():
    tri = Counter()
    for w in PLAIN * 20:
        s = EDGE * CONTEXT + w + EDGE
        tri.update(s[i : i + CONTEXT + 1] for i in range(len(s) - CONTEXT))
    return CharModel(tri)


def test_decoder():
    m = model()
    for seen, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("idiiiiot", "idiot"), ("w0rthl3$$", "worthless"), ("mooooron", "moron"), ("looose", "loose"), ("b00ts", "boots")):
        assert decode(seen, m) == meant
    r = Restorer(m, PLAIN)
    words = r.words("You i d i o t , a M-0-R-0-N! and 2024 plain house, w@rm 3rd")
    assert {"idiot", "moron", "house", "you"} <= words
    assert r.words(None) == r.words("") == set()


def test_spacing_and_repetition_without_bounds():
    r = Restorer(model(), PLAIN)
    for seen in ("i  d  i  o  t", "id iot", "a i d i o t", "you.are.an.1d10t", "y o u a r e a n i d i o t", "iidiot", "id" + "i" * 39 + "ot", "id" + "i" * 5000 + "ot", "idiot!!!", "**idiot", "moron/1d1ot"):
        assert "idiot" in r.words(seen), seen
    assert "moron" in r.words("mooron") and "moron" in r.words("moron/1d1ot")
    assert "worthless" in r.words("w o r t h " * 30_000 + "w o r t h l e s s")  # across parts of a long text
    assert r.words("1 0 7") == set() and "idiot" not in r.words("an id and iota")


def readings(token):
    """Every reading of a token's lattice with its cost, spelled out."""
    if not token:
        return [("", 0.0)]
    positions = []
    for t in token.split(" "):
        positions += [[(" ", 0.0), ("", GLUE)]] if positions else []
        positions += lattice(t)
    return [("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*positions)]


def test_viterbi_against_all_readings():
    m = model()
    for token in ("1d1ot", "m0r0n", "iidiot", "a b", "id iot", "b00t$", "l0o$e!", "i d i o t", "7h3"):

        def log(text):
            total = 0.0
            for w in text.split(" "):
                s = EDGE * CONTEXT + w + EDGE
                total += sum(m.log(s[i : i + CONTEXT], s[i + CONTEXT]) for i in range(len(s) - CONTEXT))
            return total

        scored = {}
        for text, cost in readings(token):
            scored[text] = max(scored.get(text, -1e9), cost + log(text))
        got = decode(token, m)
        assert scored[got] > max(scored.values()) - 1e-9, (token, got)
        # the trie accepts exactly the words that some reading spells
        for w in {x for x in scored if x and " " not in x}:
            states = frozenset((0,))
            r = Restorer(m, [w])
            for t in token.split(" "):
                states = r.spell(t, states)
            assert any(r.final[s] for s in states), (token, w)


def test_held_out_quality(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op1_toxicity(spark, SF).collect()
    held = [(r.predicted, truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    tp = sum(p and t for p, t, _ in held)
    precision, recall = tp / max(1, sum(p for p, *_ in held)), tp / sum(t for _, t, _ in held)
    print("precision", precision, "recall", recall, "of", len(held))
    assert precision > 0.75 and recall > 0.7
    assert all(0 <= s <= 1 for *_, s in held)


def test_disguised_words_count(spark):
    rows = [(i, " ".join(PLAIN[10 + i % 9 :]) + (" you idiot" if i % 4 == 0 else ""), i % 4 == 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(0, None), (999, 1)], "doc_id long, toxic int")
    m = train(labelled(docs, labels, F.lit(True)))
    probe = spark.createDataFrame([(1, "the green house i d i o t"), (2, "the green house 1d10t"), (3, "the green house"), (4, None), (5, ""), (5, ""), (None, "idioooot " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in score(probe, m, restored=True).collect()}
    assert got[1].predicted == got[2].predicted == got[None].predicted == 1
    assert got[3].predicted == 0 and got[4].score == got[5].score
    assert "idiot" in got[2].restored and got[3].restored == []
    assert score(probe.limit(0), m).count() == 0
    none = train(labelled(docs, labels.filter("doc_id < 0"), F.lit(True)))
    assert {r.predicted for r in score(probe, none).collect()} == {0}
