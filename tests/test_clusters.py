import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import clusters as C

CALL = "id long, run long, x long, y long, w long, h long, from_fwd boolean, to_fwd boolean, reads long, nt long, ambiguity long, score double, inserted_size long"


def call(rng, i, side, deep=30):
    return (i, rng.randint(1, 2), rng.randrange(-20, side), rng.randrange(side), rng.randint(1, 50), rng.randrange(9), rng.random() < 0.5, True, rng.randint(1, 50), rng.randrange(900), rng.randrange(5), float(rng.randrange(60)), rng.randrange(deep))


def merged(rows, gap):
    """Transitive merging by all pairs."""
    parent = {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            if a[1] == b[1] and a[6:8] == b[6:8] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5] and abs(a[12] - b[12]) <= gap:
                i, j = find(a[0]), find(b[0])
                parent[max(i, j)] = min(i, j)
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r)
    return sorted(
        (i, min(r[2] for r in g), min(r[3] for r in g), max(r[2] + r[4] for r in g) - min(r[2] for r in g), max(r[3] + r[5] for r in g) - min(r[3] for r in g),
         sum(r[8] for r in g), sum(r[9] for r in g), max(r[10] for r in g), len(g)) for i, g in groups.items()
    )


@pytest.mark.parametrize(("n", "side", "deep"), [(300, 900, 30), (900, 150, 30), (1200, 90, 200)])
def test_combine_against_all_pairs(spark, n, side, deep):
    rng = random.Random(n)
    rows = [call(rng, i, side, deep) for i in rng.sample(range(10 * n), n)]
    rows += [(rows[0][0], *call(rng, 0, 20 * side)[1:])]  # a second box of the same call
    got = C.combine(spark.createDataFrame(rows, CALL), ["run", "from_fwd", "to_fwd"], 10)
    assert sorted(map(tuple, got.select("id", "x", "y", "w", "h", "reads", "nt", "ambiguity", "n").collect())) == merged(rows, 10)


def test_combine_keeps_unknown_values(spark):
    rows = [(1, 1, 0, 0, 5, 5, True, True, 1, None, 1, 1.0, 0), (2, 1, 3, 3, 5, 5, True, True, 1, 4, 1, 1.0, 5), (3, 1, 3, 3, None, 5, True, True, 1, 7, None, 1.0, 5)]
    got = {r.id: (r.x, r.w, r.nt, r.ambiguity, r.n) for r in C.combine(spark.createDataFrame(rows, CALL), ["run", "from_fwd", "to_fwd"], 10).collect()}
    assert got == {1: (0, 8, 4, 1, 2), 3: (3, None, 7, None, 1)}


def test_dense_calls_are_not_paired(spark):
    """100,000 calls on one spot have 5e9 pairs."""
    rows = spark.range(100_000).select("id", *[F.lit(v).cast("long").alias(c) for c, v in {"run": 1, "y": 5, "w": 50, "h": 8, "reads": 2, "nt": 3, "ambiguity": 1}.items()], (F.col("id") % 40).alias("x"), F.lit(True).alias("from_fwd"), F.lit(True).alias("to_fwd"), (F.col("id") % 30).alias("inserted_size"))
    got = C.combine(rows, ["run", "from_fwd", "to_fwd"], 10).select("id", "x", "w", "reads", "n").collect()
    assert list(map(tuple, got)) == [(0, 0, 89, 200_000, 100_000)]


def test_one_sided_against_all_pairs(spark):
    rng = random.Random(4)
    calls = [call(rng, i, 500) for i in range(400)]
    dummies = [(i, rng.randint(1, 2), rng.randrange(-40, 540), rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.9) for i in range(200)]
    want = []
    for i, run, pos, known, f, t in dummies:
        near = [c for c in calls if c[1] == run and c[11] > 5 and abs(pos - c[2 if known else 3]) <= 20 and (c[6] == f if known else c[7] == t)]
        if near:
            c = min(near, key=lambda c: (-c[11], c[0]))
            want.append((i, c[0], c[11], (pos + c[2]) // 2 if known else c[2], c[3] if known else (pos + c[3]) // 2))
    got = C.merge_one_sided(spark.createDataFrame(dummies, "id long, run long, pos long, from_known boolean, from_fwd boolean, to_fwd boolean"), spark.createDataFrame(calls, CALL), 20, 5.0)
    assert sorted(map(tuple, got.select("dummy_id", "call_id", "score", "x", "y").collect())) == want
