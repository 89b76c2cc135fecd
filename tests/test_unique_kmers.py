import random
from collections import Counter

import pytest

from seqloom.operators import kmers as K


def brute(rows, k):
    every = [(i, s[j : j + k]) for i, s in rows if s for j in range(len(s) - k + 1)]
    times = Counter(x for _, x in every)
    return {i: (sum(1 for a, _ in every if a == i), sum(1 for a, x in every if a == i and times[x] == 1)) for i in {i for i, _ in every}}


@pytest.mark.parametrize(("k", "letters"), [(18, 8_000_000), (18, 500), (9, 500), (12, 500)])
def test_unique_kmers_against_brute_force(spark, monkeypatch, k, letters):
    monkeypatch.setattr(K, "BUCKET_LETTERS", letters)
    rng = random.Random(k)
    text = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    rows = [(i, text(rng.choice([0, 5, k - 1, k, k + 1, 40, 300]))) for i in range(60)]
    rows += [(100, rows[-1][1] + text(20)), (101, "A" * 200), (102, "AC" * 60), (103, text(90, "ACGTN")), (104, text(60) + "N" + text(60)), (105, None), (106, rows[3][1]), (59, text(30)), (107, "A" * 19), (None, text(50))]
    rows += [(108, rows[62][1][5:100]), (109, "N" * 40), (110, text(25) + "R" + text(25))]
    got = {r.read_id: (r.n, r.n_unique) for r in K.unique_kmers(spark.createDataFrame(rows, "read_id long, seq string"), k).collect()}
    assert got == brute(rows, k)


def test_kmers_are_not_shuffled_one_by_one(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(2000))) for i in range(50)], "id long, s string").coalesce(1)
    sent = df.mapInArrow(K._superkmers(18, 8), "bucket int, ids binary, at binary, kmers binary").collect()
    assert len(sent) == 8 and sum(len(r.ids) + len(r.at) + len(r.kmers) for r in sent) < 2.5 * 50 * 2000
