import random
import re

import pytest

from seqloom.llm.components import connected_components
from seqloom.llm.ngram_join import Rule, keep_one_of_each, ngram_jaccard_join


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, rule):
    """id to (size, smallest id reachable); ids are distinct."""
    sets = {i: shingles(t, rule.words) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in sets.items():
        for t in s:
            where.setdefault(t, []).append(i)
    for i, s in sets.items():
        for j in {j for t in s for j in where[t] if j < i}:
            both = len(s & sets[j])
            if rule.den * both >= rule.num * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        p = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.6:
            out[p] = f"e{rng.randrange(10**6)}"
        elif kind < 0.8:
            del out[p]
        else:
            out.insert(p, f"i{rng.randrange(10**6)}")
    return out


def corpus(seed, groups=25, copies=14):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, common = [], [rng.choice(vocab) for _ in range(50)]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 4, 7, 12, 25, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, copies, 4 * copies])):
            text = edited(base, rng.choice([0, 0, 1, 1, 2, 3, 5]), rng) if len(base) > 9 else base
            rows.append(text + (common if rng.random() < 0.2 else []))
    rng.shuffle(rows)
    return [(i, rng.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("seed", "rule"), [(1, Rule(3, 90, 100)), (2, Rule()), (3, Rule(3, 90, 100)), (4, Rule(2, 60, 100))])
def test_against_brute_force(spark, seed, rule):
    rows = corpus(seed)
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, rule)
    assert len(got) == len(rows)


def test_large_group_of_near_copies(spark):
    rng, rule = random.Random(7), Rule(3, 90, 100)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(base, rng.choice([0, 1, 1, 2, 2, 3, 4, 6]), rng))) for i in range(500)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, rule)


def test_edges(spark):
    rows = [(3, None, 1), (4, "", 2), (5, " \n", 3), (6, "One", 4), (7, "one ", 5), (8, "one two", 6), (2, "É", 7), (1, "é", 8), (9, "x " * 60_000, 9)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, n int"), Rule(3, 90, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (1, 8), 2: (1, 2), 1: (1, 1), 9: (1, 9)}
    assert sorted(r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words in this"), (None, "a b c d"), (None, "null id only here")]
    got = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90, 100)).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None)], key=repr)


def test_one_row_of_each_stays(spark):
    a, b, c = ("one two three four five six seven", "this is another text of some length", "ein dritter satz mit genug worten darin")
    rows = [(5, a), (3, b), (5, b), (None, c), (None, c.upper()), (7, b), (7, b), (8, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, th long, gone_id long")
    kept = keep_one_of_each(docs)
    got = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect()))
    assert got == sorted([(5, a), (3, b), (0, c), (8, ""), (8, "")]) and kept.columns == docs.columns


def test_one_set_in_most_rows(spark):
    """A set, and a signature, that nine rows of ten share are met by broadcast and change nothing."""
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base) if i % 10 else " ".join([*base[:59], f"x{i}"])) for i in range(3000)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, Rule(3, 90, 100))


def test_components_of_chains(spark):
    rng = random.Random(3)
    names = list(range(300))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(299) if i % 37]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    at, want = [names[0]], {}
    for i in range(300):
        if i and (i - 1) % 37 == 0 or i == 0:
            at = []
        at.append(names[i])
        for n in at:
            want[n] = min(at)
    alone = {n for n in names if n not in {x for p in links for x in p}}
    assert got == {n: m for n, m in want.items() if n not in alone}
