"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a context trie of order ORDER: for each context of up to ORDER bytes, the counts of the bytes that followed it
in the training texts. Only the counts of the longest contexts are gathered from the corpus (all training texts, combined
before the shuffle). A shorter context counts a follower once for each longer context in which it was seen (update
exclusion), so these counts follow from the longest ones. A byte is predicted in the longest context in which it was
seen; each longer context adds the cost of an escape. Escapes are estimated by method D (half a count of each distinct
follower), and the followers of a context are excluded from the shorter ones (symbol exclusion). The
last resort is a uniform choice among the 256 bytes and the end. Each text starts in a context of start marks, and
ends with an end mark, so that scores are probabilities of whole texts. The trie is pretrained; scoring doesn't change it.

The trie is a set of tables, one for each order (``levels``), and holds every counted pair. Each distinct (context, byte) pair
of the texts gets its log probability once by joins with them (``logs``). The MAX_NODES most frequent pairs of the texts
are looked up map-side, all others by a join on the pair; both have the same values, so the bound changes no score.

The base score is a smoothed unigram model of words; its counts cover all training tokens. The TOP most frequent words are
looked up map-side, all others by a join on the word, so that no vocabulary need fit into memory.

Defined cases: null counts as empty text, which has one token, the end. Repeated rows are scored alike, and each is
counted. Extra columns are ignored. Without training rows all counts are 0 and the model is uniform. Texts are read
whole. A NUL byte in a text is a byte as any other.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, clear_worker, small_batches, stage, worker_state

ORDER = 5
#: Pairs whose log probabilities are broadcast, and about as many counts are held by a worker.
MAX_NODES = 2_000_000
#: Words whose counts are broadcast.
TOP = 100_000
#: Symbols: bytes 0 to 255, the end mark, and the start mark (in contexts only).
END, START, BITS = 256, 257, 9
#: Bytes that are handled at once.
CHUNK = 1 << 20


def packed(texts: list[bytes]):
    """(keys, which): for each byte and end mark its ORDER symbols before it and itself, packed; the text it is in."""
    import numpy as np

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    size = lengths + ORDER + 1
    first = np.cumsum(size) - size
    symbols = np.full(int(size.sum()), START, np.int64)
    body = np.repeat(first + ORDER - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    symbols[body] = np.frombuffer(b"".join(texts), np.uint8)
    symbols[first + size - 1] = END
    keys = symbols[: len(symbols) - ORDER].copy()
    for j in range(1, ORDER + 1):
        keys <<= BITS
        keys |= symbols[j : len(symbols) - ORDER + j]
    # windows that end inside the start marks of a text are none of its symbols
    ends = np.arange(len(keys)) + ORDER
    owner = np.repeat(np.arange(len(texts)), size)[ends]
    real = ends - first[owner] >= ORDER
    return keys[real], owner[real]


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append((t or "").encode())
        size += len(chunk[-1])
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _merged(parts: list) -> tuple:
    import numpy as np

    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _partial(texts: DataFrame) -> DataFrame:
    """(key, c): counts of the symbols after their longest contexts, to be summed by key."""

    def batch_of(parts: list) -> pa.RecordBatch:
        keys, counts = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        clear_worker()
        parts, held = [], 0
        for batch in batches:
            for chunk in _chunks(batch.column(0).to_pylist()):
                parts.append(np.unique(packed(chunk)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > 2 * MAX_NODES:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                if held > MAX_NODES and len(parts) == 1:
                    yield batch_of(parts)
                    parts, held = [], 0
        if parts:
            yield batch_of(parts)

    return texts.select("text").mapInArrow(run, "key long, c long")


def gather(docs: DataFrame) -> DataFrame:
    """(key, c, n): of each pair of docs(text, trained) its counts in the training texts (0 for unseen ones) and in all texts."""
    learned = _partial(docs.filter("trained")).select("key", "c", F.col("c").alias("n"))
    others = _partial(docs.filter(~F.col("trained"))).select("key", F.lit(0).cast("long").alias("c"), F.col("c").alias("n"))
    return learned.unionByName(others).groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _low(key: str, order: int) -> Column:
    """Of a packed key, the last symbol and `order` symbols before it."""
    return F.col(key).bitwiseAND(F.lit((1 << (BITS * (order + 1))) - 1).cast("long"))


def levels(pairs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By order: pairs (key, c), and contexts (ctx, total, kinds, t, q). t and q are the occurrences and distinct followers of the
    next shorter context without the followers of ctx. pairs(key, c): those of the longest order."""
    keys = [pairs]
    for j in range(ORDER - 1, -1, -1):
        keys.insert(0, stage(keys[0].groupBy(_low("key", j).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"pairs{j}"))
    contexts: list[DataFrame] = []
    for j, k in enumerate(keys):
        own = k.withColumn("ctx", F.shiftright("key", BITS))
        if j:
            below = keys[j - 1].select(F.col("key").alias("low"), F.col("c").alias("below"))
            shorter = contexts[j - 1].select(F.col("ctx").alias("s_ctx"), F.col("total").alias("s_total"), F.col("kinds").alias("s_kinds"))
            own = own.withColumn("low", _low("key", j - 1)).join(bounded(below, 32), "low")
            own = own.groupBy("ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("below").alias("gone"))
            own = own.withColumn("s_ctx", _low("ctx", j - 2)).join(bounded(shorter, 48), "s_ctx")
            own = own.select("ctx", "total", "kinds", (F.col("s_total") - F.col("gone")).alias("t"), (F.col("s_kinds") - F.col("kinds")).alias("q"))
        else:
            none = F.lit(None).cast("long")
            own = own.groupBy("ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).withColumns({"t": none, "q": none})
        contexts.append(stage(own, f"contexts{j}"))
    return keys, contexts


def logs(counts: DataFrame) -> DataFrame:
    """(key, n, log): log10 probability of each pair's symbol after its context, for the rows of gather()."""
    keys, contexts = levels(counts.filter("c > 0").select("key", "c"))
    top = contexts[ORDER].select("ctx", "total")
    seen = counts.filter("c > 0").withColumn("ctx", F.shiftright("key", BITS)).join(bounded(top, 32), "ctx")
    seen = seen.select("key", "n", F.log10((F.col("c") - 0.5) / F.col("total")).alias("log"))
    # t and q: of the context at hand, without the followers of the longer one, if that was known
    none = F.lit(None).cast("long")
    rest = counts.filter("c = 0").select("key", "n", F.lit(0.0).alias("log"), F.lit(False).alias("found"), none.alias("t"), none.alias("q"))
    for j in range(ORDER, -1, -1):
        pair = keys[j].select(F.col("key").alias("low"), F.col("c").alias("hit"))
        ctx = contexts[j].select("ctx", "total", "kinds", F.col("t").alias("next_t"), F.col("q").alias("next_q"))
        rest = rest.withColumns({"low": _low("key", j), "ctx": F.shiftright(_low("key", j), BITS)})
        rest = rest.withColumn("hit", none) if j == ORDER else rest.join(bounded(pair, 32), "low", "left")
        t, q = F.coalesce("t", "total"), F.coalesce("q", "kinds")
        open_ = ~F.col("found") & (q > 0)  # a context whose followers are all excluded is left at no cost
        step = F.when(F.col("hit").isNotNull(), F.log10((F.col("hit") - 0.5) / t)).otherwise(F.log10(q / (2 * t)))
        rest = rest.join(bounded(ctx, 64), "ctx", "left").select(
            "key", "n", (F.col("log") + F.when(open_, step).otherwise(0.0)).alias("log"),
            (F.col("found") | F.coalesce(open_ & F.col("hit").isNotNull(), F.lit(False))).alias("found"),
            F.col("next_t").alias("t"), F.col("next_q").alias("q"),
        )
    last = math.log10(max(1, END + 1 - keys[0].count()))  # uniform over the symbols that never occurred
    return seen.unionByName(rest.select("key", "n", (F.col("log") - F.when(F.col("found"), 0.0).otherwise(last)).alias("log")))


class Trie:
    """The trie as sorted arrays in one process, which tests hold against plain Python: for each order its pairs and its contexts."""

    def __init__(self, keys, counts):
        import numpy as np

        order = np.argsort(keys)
        k, c = np.asarray(keys)[order], np.asarray(counts, np.float64)[order]
        self.keys, self.counts = [k], [c]
        for j in range(ORDER - 1, -1, -1):
            k, at = np.unique(k & self._mask(j), return_inverse=True)
            c = np.bincount(at, minlength=len(k)).astype(np.float64)
            self.keys.insert(0, k)
            self.counts.insert(0, c)
        #: By order: contexts, occurrences, distinct followers.
        self.contexts = []
        for k, c in zip(self.keys, self.counts, strict=True):
            ctx, at = np.unique(k >> BITS, return_inverse=True)
            self.contexts.append((ctx, np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx)).astype(float), at))
        #: By order: for each context of the next longer order, occurrences of its followers after the shorter context.
        self.gone = []
        for j in range(ORDER):
            ctx, _, _, at = self.contexts[j + 1]
            pair, _ = self._find(self.keys[j], self.keys[j + 1] & self._mask(j))
            self.gone.append(np.bincount(at, self.counts[j][pair], len(ctx)))

    @staticmethod
    def _mask(order: int) -> int:
        """Of a packed key, the last symbol and `order` symbols before it."""
        return (1 << (BITS * (order + 1))) - 1

    @staticmethod
    def _find(table, wanted):
        import numpy as np

        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def log10(self, keys):
        """log10 probability of each packed key's last symbol after its context."""
        import numpy as np

        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        longer = np.full(len(keys), -1, np.int64)  # the context just left, in the contexts of its order
        for j in range(ORDER, -1, -1):
            ctx, total, kinds, _ = self.contexts[j]
            if not len(ctx):
                continue
            k = keys[todo] & self._mask(j)
            c, known = self._find(ctx, k >> BITS)
            t, q = total[c], kinds[c]
            if j < ORDER and len(self.gone[j]):
                left = longer[todo]
                t = t - np.where(left >= 0, self.gone[j][left], 0.0)
                q = q - np.where(left >= 0, self.contexts[j + 1][2][left], 0.0)
            known &= q > 0  # a context whose followers are all excluded is left at no cost
            pair, seen = self._find(self.keys[j], k)
            hit, miss = known & seen, known & ~seen
            out[todo[hit]] += np.log10((self.counts[j][pair[hit]] - 0.5) / t[hit])
            out[todo[miss]] += np.log10((q / np.where(known, 2 * t, 1.0))[miss])
            longer[todo] = np.where(self._find(ctx, k >> BITS)[1], c, -1)
            todo = todo[~hit]
        out[todo] -= np.log10(max(1, END + 1 - len(self.keys[0])))  # uniform over the symbols that never occurred
        return out


class Table:
    """Log probabilities of the most frequent pairs, found by hashes."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

    def __init__(self, keys, logs):
        import numpy as np

        self.levels = []
        for m in self.MULTIPLIERS:  # keys that lose their slot to another go to the next, smaller table
            if not len(keys):
                break
            shift = 64 - max(4, len(keys).bit_length())
            at = self._slot(keys, m, shift)
            slot_key, slot_log = np.full(1 << (64 - shift), -1, np.int64), np.zeros(1 << (64 - shift), np.float32)
            slot_key[at], slot_log[at] = keys, logs
            self.levels.append((m, shift, slot_key, slot_log))
            lost = slot_key[at] != keys
            keys, logs = keys[lost], logs[lost]
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    @staticmethod
    def _slot(keys, multiplier, shift):
        import numpy as np

        return ((keys.view(np.uint64) * np.uint64(multiplier)) >> np.uint64(shift)).view(np.int64)

    def score(self, texts: list[bytes]):
        """(log10, rare, owner): for each text the log10 probability of its pairs in the table; the other pairs, the text each is in."""
        import numpy as np

        keys, which = packed(texts)
        logs, todo = np.zeros(len(keys)), np.arange(len(keys))
        for m, shift, slot_key, slot_log in self.levels:
            rest = keys[todo]
            at = self._slot(rest, m, shift)
            ok = slot_key[at] == rest
            logs[todo[ok]] = slot_log[at[ok]]
            todo = todo[~ok]
        at, ok = Trie._find(self.keys, keys[todo])
        logs[todo[ok]] = self.logs[at[ok]]
        todo = todo[~ok]
        return np.bincount(which, logs, len(texts)), keys[todo], which[todo]


def _lists(keys, owner, texts: int):
    """(ends, keys, times): for each text its distinct keys and how often each occurs; ends[i] is where text i's end."""
    import numpy as np

    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])][: len(keys)])
    return np.searchsorted(owner[new], np.arange(texts), "right"), keys[new], np.diff(np.r_[new, len(keys)])


def train(docs: DataFrame) -> tuple[tuple, DataFrame]:
    """((keys, logs), rest) for docs(text, trained): the at most MAX_NODES most frequent pairs, in one Arrow table, and all others."""
    every = stage(logs(stage(gather(docs), "counts")), "logs")
    least, held = 1, 0
    for n, pairs in sorted(every.groupBy("n").count().collect(), reverse=True):
        held += pairs
        if held > MAX_NODES:
            least = n + 1
            break
    got = every.filter(F.col("n") >= least).select("key", F.col("log").cast("float").alias("log")).toArrow()
    return (got["key"].to_numpy(), got["log"].to_numpy()), every.filter(F.col("n") < least).select("key", "log")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over texts(text): ASCII-lower-cased words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for t in batch.column(0).slice(at, 512).to_pylist():
                    counts.update((t or "").encode().lower().split())
                if len(counts) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(df: DataFrame, training: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, trained, n_tokens, n_known, train_tokens, base_score, score; training says which rows are learned from."""
    small_batches(df)
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("trained"), F.col(text_col).alias("text"))
    learned = docs.filter("trained")
    held, rest = train(docs)
    model = spark.sparkContext.broadcast(held)

    counts = stage(word_counts(learned), "word_counts")
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learned.count()
    n, v = int(words) + ends, int(kinds) + (ends > 0)
    size = n + 0.1 * (v + 1)
    frequent = counts.orderBy(F.desc("c"), "word").limit(TOP).toArrow()
    logs = [math.log10((c + 0.1) / size) for c in frequent["c"].to_pylist()]
    top = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), logs, strict=True)))
    end_log, name, kind = math.log10((ends + 0.1) / size), uuid.uuid4().hex, df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        scorer, known_logs = worker_state(("ppm", name), lambda: Table(*model.value)), top.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).to_pylist()
                n_tokens, n_known, base, rare, times, ends_at = [], [], [], [], [], [0]
                for t in texts:
                    all_, known, total = 1, int(ends > 0), end_log
                    for w, m in Counter((t or "").encode().lower().split()).items():
                        all_ += m
                        one = known_logs.get(w)
                        if one is None:
                            rare.append(w)
                            times.append(m)
                        else:
                            known += m
                            total += m * one
                    n_tokens.append(all_), n_known.append(known), base.append(total), ends_at.append(len(rare))
                found, pairs, pair_times, pairs_at = [], [], [], [np.zeros(1, np.int64)]
                for c in _chunks(texts):
                    logs_, keys, owner = scorer.score(c)
                    to, keys, m = _lists(keys, owner, len(c))
                    found.append(logs_), pairs.append(keys), pair_times.append(m), pairs_at.append(to + pairs_at[-1][-1])
                offsets, pair_offsets = pa.array(ends_at, pa.int32()), pa.array(np.concatenate(pairs_at), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(rare, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
                lists += [pa.ListArray.from_arrays(pair_offsets, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, pair_times)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(found)), *lists], names=["id", "trained", "n", "known", "base", "score", "rare", "times", "pairs", "pair_times"])

    schema = f"id {kind}, trained boolean, n long, known long, base double, score double, rare array<binary>, times array<long>, pairs array<long>, pair_times array<long>"
    rows = stage(docs.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "scores")
    each = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("rid", F.col("e.rare").alias("word"), F.col("e.times").alias("m"))
    c = F.coalesce("c", F.lit(0))
    more = (
        each.join(counts, "word", "left")
        .groupBy("rid")
        .agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("k"), F.sum(F.col("m") * F.log10((c + 0.1) / F.lit(size))).alias("b"))
    )
    each = rows.select("rid", F.explode(F.arrays_zip("pairs", "pair_times")).alias("e")).select("rid", F.col("e.pairs").alias("key"), F.col("e.pair_times").alias("m"))
    added = each.join(rest, "key").groupBy("rid").agg(F.sum(F.col("m") * F.col("log")).alias("s"))
    return rows.join(more, "rid", "left").join(added, "rid", "left").select(
        F.col("id").alias(id_col),
        "trained",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
