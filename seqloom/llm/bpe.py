"""Byte-level BPE by recursive DuckDB queries inside each partition.

Each text is split by the tokenizer's pattern; each distinct piece is encoded once and remembered for a while. A piece that
is a token itself is that token. Any other is cut into words wherever no token holds the two bytes around the cut, so that
no merge can cross it. A DuckDB table holds one row per token of each word (word, position, token). A recursive query joins
neighbouring rows and the merge table and contracts each word's leftmost pair of minimum rank until no pair is left; an
ordered aggregation gives the ids of each piece, and the bytes of the decoded ids.

Words above LONG bytes contract all pairs of the minimum rank in one step, from left to right. That is the same as one after
the other as long as no contraction makes a pair of lower rank; a word in which that happens starts anew, one at a time.
A recursion stops after at most DEPTH steps and goes on from where it stopped, so the rows it holds stay bounded.

Defined cases: null text counts as empty and has no tokens; special tokens are ordinary text; lone surrogates cannot
occur in Spark strings. Repeated rows and ids give repeated results. Extra columns are ignored. Empty tables give empty
results. Texts are read whole, long ones in parts of PART pieces. A worker's memory grows with its longest text, and by about
300 bytes for each byte of the longest word (a run of one letter, say); all else is bounded by the constants below.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_state

#: Steps of one recursion; words with more are carried over.
DEPTH = 64
#: Bytes of new pieces in one recursion; a longer word goes alone.
CHUNK_BYTES = 200_000
#: Words with more bytes contract all pairs of minimum rank at once.
LONG = 64
#: Rows that one recursion may hold.
STATE_ROWS = 2_000_000
#: Pieces that are split off and looked up at once.
PART = 300_000
#: A worker remembers pieces of up to twice this many bytes, ids and overheads included; what it has not met for longest goes first.
REMEMBER_BYTES = 70_000_000
#: Longer pieces are not remembered beyond their part.
REMEMBER_LONGEST = 1_000
#: Memory of the DuckDB connection, and what it needs for a byte of a long word.
DB_MB, DB_BYTES_EACH = 250, 300

# Rows: word, first byte, end, token, step, state (0 live, 1 done, 2 to start anew). Bytes are numbered with a gap between words,
# so that an end meets a first byte within a word only.
_ONE = """
WITH RECURSIVE state(w, g, e, tok, d, s) AS (
  SELECT w, g, e, tok, 0, 0 FROM start
  UNION ALL
  SELECT x.w, x.g, CASE WHEN x.g = b.g THEN b.e ELSE x.e END, CASE WHEN x.g = b.g THEN b.rank ELSE x.tok END, x.d + 1,
    CASE WHEN b.w IS NULL THEN 1 ELSE 0 END
  FROM state x LEFT JOIN (
    SELECT w, (best & 4294967295)::INT AS g, (best >> 32)::INT AS rank, (ends & 4294967295)::INT AS e, (ends >> 32)::INT AS cut
    FROM (
      SELECT w, min(k) AS best, arg_min(ends, k) AS ends
      FROM (
        SELECT x.w, m.rank::BIGINT * 4294967296 + x.g AS k, x.e::BIGINT * 4294967296 + y.e AS ends
        FROM state x JOIN state y ON y.g = x.e JOIN merges m ON m.a = x.tok AND m.b = y.tok WHERE x.s = 0 AND x.d < $depth)
      GROUP BY w)) b ON b.w = x.w
  WHERE x.s = 0 AND x.d < $depth AND (b.w IS NULL OR x.g <> b.cut)
)
SELECT w, g, e, tok, -1 AS low, s FROM state WHERE s > 0 OR d = $depth
"""
_PAIRS = """
SELECT x.w, x.g, x.e - x.g AS size, y.g AS cut, y.e, m.rank, m.sound
FROM state x JOIN state y ON y.g = x.e JOIN merges m ON m.a = x.tok AND m.b = y.tok WHERE x.s = 0 AND x.d < $depth
"""
# With the rank contracted last. Pairs of one rank overlap only where a token follows itself; of such a run the odd ones are taken.
_ALL = f"""
WITH RECURSIVE state(w, g, e, tok, d, low, s) AS (
  SELECT w, g, e, tok, 0, low, 0 FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED ({_PAIRS}),
  least AS MATERIALIZED (SELECT w, min(rank) AS rank, arg_min(sound, rank) AS sound FROM pairs GROUP BY w),
  taken AS MATERIALIZED (
    SELECT g, e, cut, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY w, island ORDER BY g) % 2 = 1 AS odd FROM (
        SELECT p.*, g - size * row_number() OVER (PARTITION BY w ORDER BY g) AS island FROM pairs p JOIN least USING (w, rank)))
    WHERE odd)
  SELECT x.w, x.g, coalesce(t.e, x.e), coalesce(t.rank, x.tok), x.d + 1, coalesce(b.rank, x.low),
    CASE WHEN b.rank IS NULL THEN 1 WHEN b.rank <= x.low OR NOT b.sound THEN 2 ELSE 0 END
  FROM state x LEFT JOIN least b ON b.w = x.w LEFT JOIN taken t ON t.g = x.g LEFT JOIN taken c ON c.cut = x.g
  WHERE x.s = 0 AND x.d < $depth AND c.g IS NULL)
)
SELECT w, g, e, tok, low, s FROM state WHERE s > 0 OR d = $depth
"""
_GATHER = "SELECT p, list(tok ORDER BY g) AS toks FROM done JOIN words USING (w) GROUP BY p ORDER BY p"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes pieces with one DuckDB connection. One per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import numpy as np
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        #: Whether some token holds these two bytes side by side.
        self.joined = np.zeros((256, 256), bool)
        for t in ranks:
            self.joined[list(t[:-1]), list(t[1:])] = True
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Decoded bytes of pieces whose ids don't decode to the piece itself (with a broken rank file only).
        self.odd: dict[str, bytes] = {}
        self.held = 0
        pairs = [(x, y, r) for t, r in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
        bytes_of = {r: t for t, r in ranks.items()}
        sound = [ranks.get(bytes_of[r] + bytes_of[x], r) >= r for x, _, r in pairs]
        a, b, rank = (pa.array(c, pa.int32()) for c in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DB_MB}MB", "temp_directory": ""})
        merges = pa.table({"a": a, "b": b, "rank": rank, "sound": pa.array(sound, pa.bool_())})
        self._keep("merges", merges)
        #: By token: its number as text, and its bytes.
        self.number = pa.array(map(str, range(max(bytes_of) + 1)), pa.string())
        self.bytes_of = pa.array([bytes_of.get(r, b"") for r in range(max(bytes_of) + 1)], pa.binary())

    def _keep(self, name: str, data: pa.Table) -> None:
        self.db.register("given", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, sql: str, start: pa.Table) -> pa.Table:
        """Adds the words of start(w, g, e, tok, low) to the table done(w, g, tok); words to be started anew (w) come back."""
        again = []
        while start.num_rows:
            depth = max(1, min(DEPTH, STATE_ROWS // start.num_rows))
            self.db.register("start", start)
            self.db.register("step", self.db.sql(sql, params={"depth": depth}).to_arrow_table())
            self.db.execute("INSERT INTO done SELECT w, g, tok FROM step WHERE s = 1")
            again.append(self.db.sql("SELECT DISTINCT w FROM step WHERE s = 2").to_arrow_table())
            start = self.db.sql("SELECT w, g, e, tok, low FROM step WHERE s = 0").to_arrow_table()
            self.db.unregister("step")
            self.db.unregister("start")
        return pa.concat_tables(again) if again else pa.table({"w": pa.array([], pa.int32())})

    def _encoded(self, pieces: list[bytes]) -> tuple[list[str], list[bytes | None]]:
        """The ids of each piece, and the decoded bytes where they differ from the piece."""
        import numpy as np
        import pyarrow.compute as pc

        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.ones(len(data), bool)
        first[1:] = ~self.joined[data[:-1], data[1:]]
        first[np.cumsum(lengths)[:-1]] = True
        w = (np.cumsum(first) - 1).astype(np.int32)
        g = np.arange(len(data), dtype=np.int32) + w
        start = pa.table({"w": w, "g": g, "e": g + 1, "tok": self.byte_ids[data], "low": np.full(len(data), -1, np.int32)})
        long = np.bincount(w)[w] > LONG
        self._keep("words", pa.table({"w": np.arange(w[-1] + 1, dtype=np.int32), "p": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)[first]}))
        self.db.execute("CREATE OR REPLACE TABLE done(w INT, g INT, tok INT)")
        big = DB_MB * 1_000_000 < len(data) * DB_BYTES_EACH
        if big:
            self.db.execute(f"SET memory_limit = '{len(data) * DB_BYTES_EACH // 1_000_000}MB'")
        self._contract(_ONE, start.filter(pa.array(~long)))
        again = self._contract(_ALL, start.filter(pa.array(long)))
        if again.num_rows:
            self._contract(_ONE, start.filter(pa.array(np.isin(w, again["w"].to_numpy()))))
        toks = self.db.sql(_GATHER).to_arrow_table()["toks"].combine_chunks()
        if big:
            self.db.execute(f"CREATE OR REPLACE TABLE done(w INT, g INT, tok INT); SET memory_limit = '{DB_MB}MB'")
        ids, decoded = (pc.binary_join(pa.ListArray.from_arrays(toks.offsets, of.take(toks.values)), by) for of, by in ((self.number, " "), (self.bytes_of, b"")))
        raw = pa.array(pieces, pa.binary())
        return ids.to_pylist(), pc.if_else(pc.equal(decoded, raw), pa.scalar(None, pa.binary()), decoded).to_pylist()

    def _parts(self, piece: bytes) -> list[bytes]:
        """A long piece cut between words, into parts of at most CHUNK_BYTES or one word."""
        import numpy as np

        data = np.frombuffer(piece, np.uint8)
        cuts = np.append(np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1, len(data))
        out, at = [], 0
        while at < len(data):
            k = np.searchsorted(cuts, at + CHUNK_BYTES, "right") - 1
            end = int(cuts[k]) if k >= 0 and cuts[k] > at else int(cuts[np.searchsorted(cuts, at, "right")])
            out.append(piece[at:end])
            at = end
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode new distinct pieces and remember their ids."""
        chunk: list[str] = []
        raws: list[bytes] = []
        size = 0
        for p in [*pieces, None]:
            if chunk and (p is None or size + len(p) > CHUNK_BYTES):
                ids, odd = self._encoded(raws)
                self.known.update(zip(chunk, ids, strict=True))
                self.odd.update((c, o) for c, o in zip(chunk, odd, strict=True) if o is not None)
                chunk, raws, size = [], [], 0
            if p is None:
                break
            raw = p.encode()
            if (token := self.ranks.get(raw)) is not None:
                self.known[p] = str(token)
            elif len(raw) > CHUNK_BYTES:
                done = [(part, *self._encoded([part])) for part in self._parts(raw)]
                self.known[p] = " ".join([ids[0] for _, ids, _ in done])
                if any(odd[0] is not None for _, _, odd in done):
                    self.odd[p] = b"".join([part if odd[0] is None else odd[0] for part, _, odd in done])
            else:
                chunk.append(p)
                raws.append(raw)
                size += len(raw)

    def _split(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(text, pieces): each text at once or, if it is long, PART pieces at a time."""
        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) <= PART and not self.pattern.groups:
                yield i, self.pattern.findall(t)
            else:
                found = self.pattern.finditer(t)
                while part := [m[0] for m in islice(found, PART)]:
                    yield i, part

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """(text, ids as decimals joined by one space, decoded bytes): one or more in a row for each text that has tokens."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, pieces in self._split(texts):
            held.append((i, pieces))
            size += len(pieces)
            if size >= PART:
                yield from self._looked_up(held)
                held, size = [], 0
        yield from self._looked_up(held)

    def _looked_up(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, str, bytes]]:
        if self.held > REMEMBER_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
            self.odd = {p: o for p, o in self.odd.items() if p in self.older}
        known, older = self.known, self.older
        missing = set().union(*[pieces for _, pieces in held]) - known.keys()
        again = missing & older.keys()
        known.update((p, older[p]) for p in again)
        self.learn(list(missing - again))
        for i, pieces in held:
            odd = self.odd and [self.odd[p] if p in self.odd else p.encode() for p in pieces]
            yield i, " ".join(map(known.__getitem__, pieces)), b"".join(odd) if odd else "".join(pieces).encode()
        for p in missing:
            self.held += 250 + 2 * len(p) + len(known[p])
            if len(p) > REMEMBER_LONGEST:
                self.held -= 250 + 2 * len(p) + len(known.pop(p))


def encoder(path: str, pattern: str) -> Encoder:
    return worker_state(("bpe", path, pattern), lambda: Encoder(read_ranks(path), pattern))


def bpe(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", full: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256; with full also ids (array) and decoded (text).

    The rank file must be readable at ranks_path on every executor.
    """
    small_batches(df)
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if full else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            rows = range(batch.num_rows)
            tokens, ids_of, decoded = [0 for _ in rows], [hashlib.sha256() for _ in rows], [hashlib.sha256() for _ in rows]
            whole: list[tuple[list[int], bytearray]] = [([], bytearray()) for _ in rows] if full else []
            for i, ids, raw in enc.encode(batch.column(1).to_pylist()):
                ids_of[i].update(f" {ids}".encode() if tokens[i] else ids.encode())
                decoded[i].update(raw)
                tokens[i] += ids.count(" ") + 1
                if full:
                    whole[i][0].extend(map(int, ids.split()))
                    whole[i][1].extend(raw)
            cols = [batch.column(0), pa.array(tokens, pa.int64()), pa.array([h.hexdigest() for h in ids_of], pa.string()), pa.array([h.hexdigest() for h in decoded], pa.string())]
            if full:
                cols.append(pa.array([ids for ids, _ in whole], pa.list_(pa.int32())))
                cols.append(pa.array([raw.decode() for _, raw in whole], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
