"""Near-duplicate join on word n-grams: Jaccard similarity, exact, with token-combination prefixes.

A text's tokens are its distinct word n-grams, as 64-bit hashes (of two texts, equal ones stay equal; the chance that two
different ones meet is about 1e-16 a pair). Equal sets are one node from the start.

1. Pruning. A set that has more tokens found in no other set than a link may miss has no link. Counting the tokens
   below a fixed share of the hash range is enough to see that for nearly all texts without copies; the count is a lower
   bound, so no link is lost.
2. Signatures. The tokens of what is left are ordered by frequency, rare first. Rare ones (at most FREQUENT sets) are
   indexed one by one, frequent ones in combinations of two, within hash groups that keep the number of combinations in
   proportion to the set. A class that takes combinations of k tokens yields n - k + 1 for n tokens of a prefix; the
   prefix is extended until these sum to one more than a link may miss. Two linked sets then share a signature. Sizes
   are cut into ranges, such that linked sets are in the same range or the next.
3. Verification. For each signature, every member is first compared with one pivot (the one with fewest own tokens), and
   links found that way join components. Only signatures whose members are still in different components compare the
   rest, and only pairs across components that share the signature within the prefix that their two sizes call for.
   So large groups of copies never give all their pairs, and no component is missed.

Defined cases: null and blank texts have an empty set and are linked with nothing, not even with one another. Texts with
fewer words than the n-gram have the whole sequence as one token. Ids may repeat or be null; a component's id is the
smallest non-null id in it (null if there is none). Extra columns, whatever their names, are ignored by ``ngram_jaccard_join``
and kept by ``keep_one_of_each``. Empty tables give empty results. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, small_batches, stage, text_key, without, worker_state
from .components import connected_components

#: Tokens in more sets than this are indexed in combinations of two.
FREQUENT = 32
#: Sets smaller than this are indexed by single tokens only.
SMALL = 8
#: Sets with at least 1 / MANY of all rows, and tokens in at least 1 / MANY of all sets, meet their rows by a broadcast.
MANY = 50_000


@dataclass(frozen=True)
class Rule:
    """Linked when den * intersection >= num * union, over n-grams of this many words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, a: int, b: int) -> int:
        """Tokens that linked sets of sizes a and b share at least."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def smallest(self, n: int) -> int:
        """The smallest size that can be linked with n."""
        return -(-self.num * n // self.den)

    @property
    def sample(self) -> float:
        """Share of the hash range whose tokens are counted for pruning."""
        return min(1.0, 2.0 * (self.den - self.num) / self.den)

    def ranges(self, upto: int) -> list[int]:
        """Starts of the size ranges; linked sizes are in the same range or adjacent ones."""
        starts = [1]
        while starts[-1] <= upto:
            starts.append(starts[-1] * self.den // self.num + 1)
        return starts


def tokens_of(text: str | None, words: int):
    """Sorted distinct hashes (numpy int64) of the text's word n-grams. Only A-Z are lower-cased."""
    import numpy as np
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: splits at [\x20\x09-\x0D] and lower-cases ASCII only
    if not found:
        return np.empty(0, np.int64)
    memo: dict[bytes, int] = worker_state(("word hashes",), dict)
    if len(memo) > 300_000:
        memo.clear()
    get, one = memo.get, xxhash.xxh64_intdigest
    raw = []
    for w in found:
        h = get(w)
        if h is None:
            h = memo[w] = one(w)
        raw.append(h)
    h = np.array(raw, np.uint64)
    k = min(words, len(h))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _sets(docs: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """docs(id, th, text) to (id, th, n, fp, h, tokens): all tokens if whole, else those of the sample. h: the head of fp."""
    kind = docs.schema["id"].dataType.simpleString()
    edge = int(-(2**63) + rule.sample * 2**64) if rule.sample < 1 else 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ns, fps, lists = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = tokens_of(text, rule.words)
                    ns.append(len(tokens))
                    fps.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                    lists.append(tokens if whole else tokens[: np.searchsorted(tokens, edge)])
                heads = [int.from_bytes(fp[:8], "big", signed=True) if fp else 0 for fp in fps]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))
                tokens = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ns, pa.int32()), pa.array(fps, pa.binary()), pa.array(heads, pa.int64()), tokens], names=["id", "th", "n", "fp", "h", "tokens"])

    return docs.select("id", "text", "th").mapInArrow(run, f"id {kind}, th long, n int, fp binary, h long, tokens array<long>")


def _candidates(rows: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """Nodes (fp, id, n) that have at most as many own tokens in the sample as a link may miss."""
    alone = (
        rows.filter("n > 0").select("h", F.explode("tokens").alias("t"))
        .groupBy("t").agg(F.min("h").alias("h"), F.max("h").alias("h2"))
        .filter("h = h2").groupBy("h").agg(F.count(F.lit(1)).alias("own"))
    )
    kept = groups.join(alone, "h", "left").filter(
        F.coalesce("own", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * rule.num / F.lit(rule.den))
    )
    return kept.select("fp", "id", "n")


@lru_cache(maxsize=100_000)
def _plan(n: int, rule: Rule) -> tuple[tuple[int, int, int, bool], ...]:
    """(range, hash groups or 0, tokens that may be missed, whether this is the index side), for a set of n tokens."""
    starts = rule.ranges(n)
    at = next(i for i in range(len(starts) - 1) if starts[i] <= n < starts[i + 1])

    def groups(r: int) -> int:
        return 0 if starts[r] < SMALL else max(1, (starts[r] - rule.smallest(starts[r])) // 8)

    out = [(at, groups(at), n - rule.overlap(n, n), True)]
    for r in (at, at - 1):
        if r >= 0 and starts[r + 1] - 1 >= rule.smallest(n):
            out.append((r, groups(r), n - rule.overlap(max(rule.smallest(n), starts[r]), n), False))
    return tuple(out)


def signatures_of(n: int, tokens, counts, rule: Rule) -> Iterator[tuple[int, bool, int]]:
    """(key, index side, coverage before it) of a set with n tokens.

    tokens: those in two sets or more, ordered by (count, token); counts: theirs. The coverage tells in which prefixes a
    signature lies: in that of a pair that may miss m tokens on this side if coverage <= m.
    """
    own = n - len(tokens)
    for r, groups, missed, index in _plan(n, rule):
        cover, seen = own, {}
        for t, c in zip(tokens, counts, strict=True):
            if cover > missed:
                break
            if not groups or c <= FREQUENT:
                yield hash((t, r)), index, cover
                cover += 1
            else:
                before = seen.setdefault(t % groups, [])
                for b in before:
                    yield hash((b, t, r)), index, cover
                cover += bool(before)
                before.append(t)


def _signatures(ordered: DataFrame, rule: Rule) -> DataFrame:
    """ordered(node, n, tokens, counts) to (key, index, cover, node, n, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ns = batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 64):
                which, keys, sides, covers = [], [], [], []
                part = batch.slice(at, 64)
                for i, (t, c) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True), at):
                    for key, index, cover in signatures_of(ns[i], t, c, rule):
                        which.append(i), keys.append(key), sides.append(index), covers.append(cover)
                own = np.array(ns) - np.diff(batch.column(2).offsets.to_numpy()[: batch.num_rows + 1])
                ix = np.array(which, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sides, pa.bool_()), pa.array(covers, pa.int32()), batch.column(0).take(pa.array(ix)), pa.array(np.array(ns, np.int32)[ix]), pa.array(own.astype(np.int32)[ix])],
                    names=["key", "index", "cover", "node", "n", "own"],
                )

    return ordered.select("node", "n", "tokens", "counts").mapInArrow(run, "key long, index boolean, cover int, node long, n int, own int")


def _overlap(a: str, b: str, rule: Rule):
    return F.expr(f"cast(ceil({rule.num} * ({a} + {b}) / cast({rule.num + rule.den} as double) - 1e-9) as int)")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of pairs(a, b) that are linked."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").filter(F.size(F.array_intersect("ta", "tb")) >= _overlap("na", "nb", rule)).select("a", "b")


def similar_sets(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(id, text) to its rows (id, th, n, fp), its sets (fp, id, n, h, c), with the least id and the number of rows of each,
    and the component (fp, label) of each set that has a link to another set."""
    small_batches(docs)
    docs = docs.select("id", "text", text_key(F.col("text")).alias("th"))
    rows = stage(_sets(docs, rule, False), "samples")
    groups = stage(rows.filter("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("h").alias("h"), F.count(F.lit(1)).alias("c")), "groups")
    some = stage(_candidates(rows, groups, rule), "candidates")
    n_some = some.count()
    picked = docs.join(bounded(some.select(F.col("id").alias("pick")).distinct(), 64, n_some), F.col("id").eqNullSafe(F.col("pick")), "left_semi")
    sets = _sets(picked, rule, True).join(bounded(some.select("fp"), 96, n_some), "fp", "left_semi").select("n", "fp", "tokens")
    repeats = rows.agg(F.count(F.lit(1)) != F.countDistinct("id")).first()[0]
    sets = sets.dropDuplicates(["fp"]) if repeats else sets
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    each = sets.select("node", F.explode("tokens").alias("t"))
    shared = stage(each.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    found = _by_share(each, shared, "t", F.col("c") >= max(1000, n_some // MANY)).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("o"))
    ordered = (
        found.join(sets.select("node", "n"), "node")
        .filter(F.size("o") >= F.ceil(F.col("n") * rule.num / F.lit(rule.den)))
        .select("node", "n", F.col("o.t").alias("tokens"), F.col("o.c").alias("counts"))
    )
    ordered = stage(ordered, "ordered")

    keyed = stage(_signatures(ordered, rule), "signatures")
    by_key = keyed.groupBy("key").agg(F.min(F.struct("own", "node", "n")).alias("p"), F.min("node").alias("f"), F.max("node").alias("g")).filter("f <> g")
    stars = keyed.join(by_key.select("key", "p"), "key").filter("node <> p.node").select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.n").alias("na"), "n", "own", F.col("p.own").alias("po"))
    possible = F.least(F.col("n") - F.col("own"), F.col("na") - F.col("po")) >= _overlap("n", "na", rule)
    links = stage(_verified(stars.filter(possible).select("a", "b").distinct(), ordered, rule), "stars")

    labels = connected_components(links)
    labelled = keyed.join(bounded(labels, 64).select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.max("index").alias("i")).filter("l <> m and i").select("key")
    left = labelled.join(mixed, "key", "left_semi")
    x = left.filter("index").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("cover").alias("ca"), F.col("label").alias("la"), F.col("own").alias("oa"))
    y = left.filter("not index").select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cover").alias("cb"), F.col("label").alias("lb"), F.col("own").alias("ob"))
    need = _overlap("na", "nb", rule)
    across = x.join(y, "key").filter("la <> lb and (na < nb or (na = nb and a < b))").filter((F.col("ca") <= F.col("na") - need) & (F.col("cb") <= F.col("nb") - need) & (F.col("na") - F.col("oa") >= need) & (F.col("nb") - F.col("ob") >= need))
    rest = _verified(across.select("a", "b").distinct(), ordered, rule)
    tree = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    label_of = connected_components(tree.unionByName(rest))
    named = sets.select("node", "fp").join(label_of, "node").select("fp", "label")
    return rows.select("id", "th", "n", "fp"), groups, named


def _by_share(rows: DataFrame, facts: DataFrame, key: str, frequent: Column) -> DataFrame:
    """rows joined with facts, which has one row for each key: frequent keys by a broadcast, so that none gathers in one task."""
    few = stage(facts.filter(frequent), "frequent")
    hot = rows.join(bounded(few, 64), key)
    cold = rows.join(bounded(few.select(key), 32), key, "left_anti").join(facts.filter(~frequent), key)
    return hot.unionByName(cold)


def _components(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs(id, text) to its rows (id, th, n, component_id, part): part names the component, and is null for empty sets."""
    rows, groups, labels = similar_sets(docs, rule)
    named = stage(groups.select("fp", F.col("id").alias("least"), "c").join(labels, "fp", "left"), "named")
    linked = named.filter("label is not null")
    best = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    alone = named.filter("label is null").select("fp", "c", F.col("least").alias("component_id"), F.hex("fp").alias("part"))
    of_set = stage(linked.join(best, "label").select("fp", "c", "component_id", F.col("label").cast("string").alias("part")).unionByName(alone), "components")
    found = _by_share(rows.filter("fp is not null"), of_set, "fp", F.col("c") >= max(2, rows.count() // MANY))
    empty = rows.filter("fp is null").withColumns({"component_id": F.col("id"), "part": F.lit(None).cast("string")})
    columns = ("id", "th", "n", "component_id", "part")
    return found.select(*columns).unionByName(empty.select(*columns))


def ngram_jaccard_join(df: DataFrame, rule: Rule | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_shingles, component_id."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _components(docs, rule or Rule()).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_of_each(df: DataFrame, rule: Rule | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, that with the smallest id (null ids come last); rows without words all stay.

    Rows go by id and text, so one of several rows with an id may stay. Of rows equal in both one stays.
    """
    found = stage(_components(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rule or Rule()), "joined")
    worded, first = found.filter("part is not null"), F.col("id").eqNullSafe(F.col("component_id"))
    parts, firsts = worded.agg(F.countDistinct("part"), F.coalesce(F.sum(first.cast("int")), F.lit(0))).first()
    if parts == firsts:
        return without(df, worded.filter(~first), id_col, text_col)
    # ids repeat or are null: of a component's rows with its id, the one with the least hash, once
    best = worded.filter(first).groupBy("part").agg(F.min("th").alias("best"))
    gone = worded.join(best, "part").filter(~first | (F.col("th") != F.col("best")))
    kept = without(df, gone, id_col, text_col)
    key, words = fresh(kept, "th"), F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    kept = kept.withColumn(key, text_key(F.col(text_col)))
    return kept.filter(words).dropDuplicates([id_col, key]).unionByName(kept.filter(~words)).drop(key)
