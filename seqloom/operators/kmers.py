"""K-mers and minimizers as rows, and counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import CHUNK, reverse_complement


def spread(df: DataFrame) -> DataFrame:
    """Long texts come in few file splits; give every core its share before they are exploded."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def kmers(df: DataFrame, k: int, seq: str = "seq", stride: int = 1, keep: list[str] | None = None) -> DataFrame:
    """One row (keep..., pos, kmer) for each k-mer. Texts are cut into overlapping pieces first: linear in their length."""
    keep = [c for c in df.columns if c != seq] if keep is None else keep
    step = CHUNK // stride * stride if stride <= CHUNK else stride
    n = F.length(seq)
    pieces = df.filter(n >= k).select(*keep, seq, F.explode(F.sequence(F.lit(0), n - k, F.lit(step))).alias("__at"))
    pieces = pieces.select(*keep, "__at", F.substr(F.col(seq), F.col("__at") + 1, F.lit(step + k - 1)).alias("__piece"))
    inner = F.explode(F.sequence(F.lit(0), F.least(F.length("__piece") - k, F.lit(step - 1)), F.lit(stride)))
    return pieces.select(*keep, "__at", "__piece", inner.alias("__j")).select(
        *keep, (F.col("__at") + F.col("__j")).cast("long").alias("pos"), F.substr(F.col("__piece"), F.col("__j") + 1, F.lit(k)).alias("kmer")
    )


def kmer_counts(df: DataFrame, k: int, by: list[str], stride: int = 1, both_strands: bool = False, seq: str = "seq") -> DataFrame:
    """(by..., kmer, n): k-mers with N are skipped; with both strands each counts with its reverse complement too."""
    rows = kmers(df, k, seq, stride, by).filter(~F.col("kmer").contains("N"))
    if both_strands:
        rows = rows.select(*by, F.explode(F.array(F.col("kmer"), reverse_complement(F.col("kmer")))).alias("kmer"))
    return rows.groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


#: Letters of text for one bucket of `unique_kmers`, and the length of the minimizers by which k-mers are dealt to buckets.
BUCKET_LETTERS, MINIMIZER = 4_000_000, 9


def unique_kmers(df: DataFrame, k: int, id_col: str = "read_id", seq: str = "seq") -> DataFrame:
    """(id, n, n_unique): k-mers of each text, and those that occur nowhere else in all texts. Texts without k-mers are left out.

    k-mers are not shuffled one by one: neighbours that share their minimizer travel as one number of 64 bits, which holds their
    letters and how many they are, in one row for each batch and bucket. What repeats within a batch is sent once. k-mers with
    other letters than ACGT are few and counted as texts.
    """
    if not MINIMIZER <= k <= 18:
        raise ValueError(f"k must be {MINIMIZER} to 18")
    rows = df.select(F.col(id_col).alias("id"), F.col(seq).alias("s")).filter(F.length("s") >= k)
    letters = df.agg(F.sum(F.length(seq).cast("long"))).first()[0] or 0
    buckets = max(8, letters // BUCKET_LETTERS)
    sent = rows.mapInArrow(_superkmers(k, buckets), "bucket int, ids binary, at binary, kmers binary")
    plain = sent.groupBy("bucket").applyInPandas(_count_unique(k), "id long, n_unique long")
    plain = plain.select(F.col("id").cast(df.schema[id_col].dataType).alias("id"), F.lit(0).cast("long").alias("n"), "n_unique")
    other = kmers(rows.filter(F.regexp_like("s", F.lit("[^ACGT]"))), k, "s", keep=["id"]).filter(F.regexp_like("kmer", F.lit("[^ACGT]")))
    other = other.groupBy("kmer").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").select("id", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("n_unique"))
    total = rows.select("id", (F.length("s") - (k - 1)).cast("long").alias("n"), F.lit(0).cast("long").alias("n_unique"))
    every = total.unionByName(plain).unionByName(other)
    return every.groupBy("id").agg(F.sum("n").alias("n"), F.sum("n_unique").alias("n_unique")).withColumnRenamed("id", id_col)


#: Stands for the text of a superkmer that came more than once in its batch.
MANY = 0xFFFF


def _superkmers(k: int, buckets: int):
    """Batches (id, s) to rows (bucket, ids, at, kmers): ids of the batch's texts in the bucket, and for each superkmer the place
    of its text in ids, or MANY, and a number: k + 9 letters of 2 bits, then 4 bits for the number of k-mers less one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        code = np.full(256, 4, np.uint8)
        code[[ord(c) for c in "ACGT"]] = range(4)
        window = k - MINIMIZER + 1
        longest = k + window - 1

        def doubled(v, op, upto):
            """op over `upto` neighbours at each place, by powers of two."""
            size = 1
            while size * 2 <= upto:
                v = op(v[:-size], v[size:])
                size *= 2
            return op(v[: len(v) - (upto - size)], v[upto - size :]) if size < upto else v

        def of_texts(ids, texts):
            raw = [t.encode("latin-1", "replace") for t in texts]
            sizes = np.array([len(t) for t in raw])
            # an unknown letter after each text keeps k-mers within it; more at the end, since superkmers are read to full length
            c = code[np.frombuffer(b"-".join(raw) + b"-" * (longest + 1), np.uint8)]
            n = len(c) - longest
            bad = np.concatenate(([0], np.cumsum(c > 3)))
            good = bad[k : k + n] == bad[:n]
            two = (c & 3).astype(np.uint32)
            word = two[: len(two) - MINIMIZER + 1].copy()
            for j in range(1, MINIMIZER):
                word = (word << np.uint32(2)) | two[j : j + len(word)]
            hashed = (word ^ np.uint32(0x2A5B3)) * np.uint32(2654435769)  # differs for different words
            keyed = (hashed.astype(np.uint64) << np.uint64(32)) | np.arange(len(word), dtype=np.uint64)
            least = doubled(keyed, np.minimum, window)[:n]
            fresh = np.ones(n, bool)
            fresh[1:] = (least[1:] != least[:-1]) | ~good[:-1]
            start = np.flatnonzero(good & fresh)
            if not len(start):
                return
            run_no = np.cumsum(good & fresh)[good]
            count = np.bincount(run_no - 1, minlength=len(start)).astype(np.uint64)
            value = np.zeros(len(start), np.uint64)
            for j in range(longest):
                value = (value << np.uint64(2)) | two[start + j].astype(np.uint64)
            gone = np.uint64(2) * (np.uint64(window) - count)  # letters after the last k-mer
            value = (((value >> gone) << gone) << np.uint64(4)) | (count - np.uint64(1))
            best = (least[start] >> np.uint64(32)).astype(np.uint32)
            bucket = ((best.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
            ends = np.cumsum(sizes + 1)
            text = np.searchsorted(ends, start, side="right")
            order = np.lexsort((value, bucket))
            bucket, value, text = bucket[order], value[order], text[order]
            first = np.ones(len(value), bool)
            first[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
            at = np.flatnonzero(first)
            times = np.diff(np.append(at, len(value)))
            bucket, value, text = bucket[at], value[at], np.where(times > 1, -1, text[at])
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            out = []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
                t = text[lo:hi]
                here, place = np.unique(t[t >= 0], return_inverse=True)
                places = np.full(hi - lo, MANY, np.uint16)
                places[t >= 0] = place
                out.append((int(bucket[lo]), ids[here].tobytes(), places.tobytes(), value[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)]], names=["bucket", "ids", "at", "kmers"])

        ids, texts, letters = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                letters += len(t)
                if letters > 2_000_000 or len(ids) >= MANY - 1:
                    yield from of_texts(np.array(ids, np.int64), texts)
                    ids, texts, letters = [], [], 0
        if ids:
            yield from of_texts(np.array(ids, np.int64), texts)

    return run


#: Stands for a missing id.
NO_ID = -(1 << 63)


def _count_unique(k: int):
    """Rows of one bucket to (id, n_unique)."""

    def run(part):
        import numpy as np
        import pandas as pd

        window = k - MINIMIZER + 1
        ids = [np.frombuffer(x, np.int64) for x in part["ids"]]
        shift, text, value = 0, [], []
        for own, at, numbers in zip(ids, part["at"], part["kmers"], strict=True):
            place = np.frombuffer(at, np.uint16).astype(np.int64)
            text.append(np.where(place == MANY, -1, place + shift))
            value.append(np.frombuffer(numbers, np.uint64))
            shift += len(own)
        ids, text, value = np.concatenate(ids), np.concatenate(text), np.concatenate(value)
        count, value = (value & np.uint64(15)).astype(np.int64) + 1, value >> np.uint64(4)
        mask, low = np.uint64((1 << 2 * k) - 1), np.uint64(64 - 2 * k)
        if shift >= 1 << int(low):
            raise ValueError("too many texts in one bucket")
        # k-mer and text in one number, filled and sorted in place
        both, done = np.empty(int(count.sum()), np.uint64), 0
        for j in range(window):
            has = np.flatnonzero(count > j)
            both[done : done + len(has)] = (((value[has] >> np.uint64(2 * (window - 1 - j))) & mask) << low) | (text[has] + 1).astype(np.uint64)
            done += len(has)
        del text, value, count
        both.sort()
        new = np.ones(len(both) + 1, bool)
        new[1:-1] = (both[1:] ^ both[:-1]) >> low != 0
        alone = (both[new[:-1] & new[1:]] & np.uint64((1 << int(low)) - 1)).astype(np.int64) - 1
        alone = alone[alone >= 0]
        per = np.bincount(alone, minlength=shift)
        at = np.flatnonzero(per)
        out = pd.DataFrame({"id": ids[at], "n_unique": per[at]}).groupby("id", as_index=False).sum()
        return out.astype({"id": "Int64"}).assign(id=lambda t: t["id"].mask(t["id"] == NO_ID))

    return run


def minimizers(df: DataFrame, k: int, w: int, by: list[str], seq: str = "seq") -> DataFrame:
    """(by..., pos, kmer): the leftmost smallest k-mer of each window of w k-mers; texts with fewer k-mers have one window."""
    rows = kmers(df, k, seq, 1, by)
    order = W.partitionBy(*by).orderBy("pos")
    best = F.min(F.struct("kmer", "pos")).over(order.rowsBetween(0, w - 1))
    room = F.count(F.lit(1)).over(order.rowsBetween(0, w - 1))
    picked = rows.withColumn("m", best).withColumn("room", room).filter((F.col("room") == w) | (F.col("pos") == 0))
    return picked.select(*by, F.col("m.pos").alias("pos"), F.col("m.kmer").alias("kmer")).distinct()


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def exact_sketch(df: DataFrame, k: int, w: int, id_col: str = "read_id", seq: str = "seq") -> DataFrame:
    """Symmetric (w, k)-minimizers over an invertible 64-bit hash masked to 2k bits: (id, pos, hash, forward).

    In each window of w k-mers the smallest hash counts, with all its equals; k-mers that equal their reverse complement
    and those with N have no strand and are skipped. pos is the last letter of the k-mer.
    """
    from collections.abc import Iterator

    import pandas as pd

    kind = df.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(i, *m) for i, s in zip(part["id"], part["s"], strict=True) for m in sketch(s or "", k, w)]
            yield pd.DataFrame(out, columns=["id", "pos", "hash", "forward"])

    rows = df.select(F.col(id_col).alias("id"), F.col(seq).alias("s"))
    return rows.mapInPandas(run, f"id {kind}, pos long, hash long, forward boolean").withColumnRenamed("id", id_col)


#: The shifts of the 64-bit mix are 21, 24, 3 and 8, 14, 2 and 4, 28, 31.
def mix(x, bits: int):
    """Invertible integer hash over `bits` bits (Thomas Wang's 64-bit mix, masked)."""
    import numpy as np

    m = np.uint64((1 << bits) - 1)
    u = np.uint64
    x = (~x + (x << u(21))) & m
    x ^= x >> u(24)
    x = (x + (x << u(3)) + (x << u(8))) & m
    x ^= x >> u(14)
    x = (x + (x << u(2)) + (x << u(4))) & m
    x ^= x >> u(28)
    return (x + (x << u(31))) & m


def sketch(s: str, k: int, w: int) -> list[tuple[int, int, bool]]:
    import numpy as np

    if len(s) < k:
        return []
    code = np.full(256, 4, np.uint8)
    for i, ch in enumerate("ACGT"):
        code[ord(ch)] = code[ord(ch.lower())] = i
    c = code[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    n = len(c) - k + 1
    fwd, rev, bad = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(k):
        part = c[j : j + n]
        bad |= part > 3
        fwd = (fwd << np.uint64(2)) | (part & 3)
        rev |= (3 - (part & 3)).astype(np.uint64) << np.uint64(2 * j)
    bad |= fwd == rev
    h = mix(np.minimum(fwd, rev), 2 * k).astype(np.int64)
    h[bad] = np.iinfo(np.int64).max
    width = min(w, n)
    least = np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)
    chosen = np.zeros(n, bool)
    for j in range(width):
        chosen[j : j + len(least)] |= (h[j : j + len(least)] == least) & ~bad[j : j + len(least)]
    at = np.flatnonzero(chosen)
    return [(int(p) + k - 1, int(h[p]), bool(fwd[p] < rev[p])) for p in at]
