import re

from seqloom.llm.decontaminate import drop_contaminated, find

ITEM = "If Alice buys 12 apples for 3 dollars each and Bob sells 12 pears after 5 hours how much does Alice spend in total on the apples that day"
OTHER = ITEM.replace("Alice", "Maria").replace("12", "40").replace("3 dollars", "7 euros").replace("Bob", "Chen")
BROKEN = ITEM.replace("Alice buys", "Maria buys").replace("Bob", "Chen")  # Alice stands for two people
SHORT = "what is the name of"
PAD = " ".join(f"filler{i}" for i in range(60))
ROWS = [
    (1, f"{PAD} {ITEM} {PAD}", "en"), (2, f"{PAD} {OTHER}", "en"), (3, f"{BROKEN} {PAD}", "en"), (4, PAD, "en"), (5, None, "en"), (6, "", "en"),
    (7, ITEM.upper(), "en"), (8, " ".join(ITEM.split()[:6]) + " " + PAD, "en"), (9, (PAD + " ") * 900 + ITEM, "en"), (1, ITEM, "en"), (None, OTHER, "x"),
    (11, f"{PAD} {SHORT} {PAD}", "en"),
]
BENCH = [(100, ITEM), (101, SHORT), (102, None), (103, "12 3 4 5 6 7 8 9 10"), (104, "two words")]


def tables(spark, rows=ROWS, bench=BENCH):
    return spark.createDataFrame(rows, "doc_id long, text string, item string"), spark.createDataFrame(bench, "item_id long, text string")


def test_templates_and_slots(spark):
    got = {(r.doc_id, r.item_id): r for r in find(*tables(spark)).collect()}
    assert set(got) == {(1, 100), (2, 100), (7, 100), (9, 100), (None, 100), (11, 101)}
    assert got[7, 100].verbatim and got[7, 100].coverage == 1
    assert got[1, 100].verbatim and not got[2, 100].verbatim
    assert got[1, 100].coverage == 1 and got[9, 100].n_tokens == len(ITEM.split())


def test_drop_keeps_clean_rows(spark):
    docs, bench = tables(spark)
    assert sorted((r.doc_id for r in drop_contaminated(docs, bench).collect())) == [3, 4, 5, 6, 8]
    empty = spark.createDataFrame([], "doc_id long, text string, item string")
    assert find(empty, bench).count() == 0
    assert drop_contaminated(docs, bench.filter("item_id < 0")).count() == len(ROWS)


def test_planted_passages_by_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    items = bench.collect()
    want = {(r.doc_id, b.item_id) for r in docs.collect() for b in items if re.sub(r"\s+", " ", b.text) in re.sub(r"\s+", " ", r.text or "")}
    got = {(r.doc_id, r.item_id) for r in find(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 3


def test_letter_case(spark):
    """All items of the sample tables are found in lower, upper and title case."""
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    items = bench.collect()
    rows = [(f"{r.item_id} {name}", f"{PAD} {change(r.text)} {PAD}", "") for r in items for name, change in (("lower", str.lower), ("upper", str.upper), ("title", str.title))]
    got = {r.doc_id for r in find(spark.createDataFrame(rows, "doc_id string, text string, hit string"), bench).collect() if r.doc_id.split()[0] == str(r.item_id)}
    assert got == {i for i, _, _ in rows}


def test_rows_with_one_id(spark):
    rows = [(5, ITEM), (5, PAD), (None, PAD), (None, OTHER), (6, PAD), (6, PAD)]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, gone_id long, th long")
    kept = drop_contaminated(docs, tables(spark)[1])
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(5, PAD), (0, PAD), (6, PAD), (6, PAD)]) and kept.columns == docs.columns


def test_runs_by_brute_force(spark):
    """Gaps leave the longest run of equal tokens as it is: edits, partial quotes, windows with too few literals."""
    item = [f"w{i}x" for i in range(200)]
    short = item[:59]
    slots = [f"v{i}x" for i in range(10)] + [str(i) for i in range(30, 45)] + [f"u{i}x" for i in range(35)]
    edited = lambda words, at: ["changed" if i in at else w for i, w in enumerate(words)]
    people = "Alice {} Alice".format(" ".join(f"q{i}x" for i in range(24)))
    docs = [
        (1, 100, item[:70]), (2, 100, item[:70] + ["other"] * 110 + item[180:]), (3, 101, edited(short, {26, 35, 45, 56})), (4, 101, edited(short, {19, 39})),
        (5, 101, edited(short, {9, 19, 29, 39, 49})), (6, 102, slots[:28]), (7, 103, (people + " gap " + people.replace("Alice", "Maria")).split()),
        (8, 103, people.replace("Alice", "Maria", 1).split()), (9, 101, short),
    ]
    bench = [(100, item), (101, [f"s{w}" for w in short]), (102, slots), (103, (people + " between " + people).split())]
    docs = [(i, b, [f"s{w}" if b == 101 else w for w in words]) for i, b, words in docs]
    of = dict(bench)

    def longest(a, b):
        best = run = 0
        for x, y in zip(a, b, strict=False):
            run = run + 1 if x == y or {x, y} == {"Alice", "Maria"} else 0
            best = max(best, run)
        return best

    want = {}
    for i, b, words in docs:
        at = words + [""] * (len(of[b]) - len(words))
        if (n := longest(of[b], at)) >= 20 and i != 8:  # in 8, Alice stands for two people within the run
            want[i, b] = n
    got = find(*tables(spark, [(i, " ".join(w), "") for i, _, w in docs], [(b, " ".join(w)) for b, w in bench])).collect()
    assert {(1, 100), (2, 100), (3, 101), (6, 102), (7, 103), (9, 101)} <= set(want)
    assert {(r.doc_id, r.item_id): r.n_tokens for r in got if r.n_tokens >= 20} == want
    assert all(r.coverage >= 0.5 or r.n_tokens >= 20 for r in got)
