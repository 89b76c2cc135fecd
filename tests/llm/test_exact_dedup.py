import re

import pytest

from seqloom.llm.exact_dedup import drop_exact_copies, exact_dedup

ROWS = [
    (1, "a b", "x"), (2, "ab", "y"), (3, "a  b", "z"), (4, None, "x"), (5, "", "x"), (6, " \t\n", "x"), (7, "ab ", "x"),
    (8, "A b", "x"), (9, "q" * 50_000, "x"), (10, "q" * 50_000 + "\x0b", "x"), (None, "ab  ", "n"),
]


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    best = {k: min(v) for k, v in groups.items()}
    return sorted(((i, best[k][2], len(groups[k])) for i, t, *_ in rows for k in [re.sub(r"[\x20\x09-\x0d]", "", t or "")]), key=repr)


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    got = exact_dedup(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute(ROWS)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


@pytest.mark.parametrize("n", [3, 4000])
def test_heavy_digest(spark, n):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(n)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hot = len([i for i in range(n) if i % 3 == 0])
    assert got[0].group_size == hot and got[0].kept and (n < 4 or not got[3].kept) and got[1].group_size == 1


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, "a ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.kept for r in exact_dedup(df).collect()) == 2
    assert sorted(map(tuple, drop_exact_copies(df).collect())) == [(1, "b"), (2, "a ")]
    df = spark.createDataFrame(ROWS[:-1], "doc_id long, text string, keep_id string")
    assert sorted(r.doc_id for r in drop_exact_copies(df).collect()) == [3, 6, 7, 8, 10]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(df).count() == 0 and drop_exact_copies(df).count() == 0
