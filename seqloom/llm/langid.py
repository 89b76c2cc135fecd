"""Language identification by words first, then ever shorter character n-grams.

A text's words are its runs of letters, in lower case. A known word adds its log frequency in each language. An unseen
word is read with its edges marked (<word>) by the longest n-grams of which the model knows at least one: LONGEST letters
first, then one fewer at a time; it adds their mean log frequency, once for every n letters. The prior adds the languages'
shares. The score is the posterior of the best language.

The model is fitted on a sample of at most about MAX_TRAIN labelled rows with MAX_CHARS characters, picked by a hash of the
id; it holds every word and n-gram that occurs often enough in them, in as many languages as they have. The sample alone
bounds what is broadcast. The text alone decides a prediction. N-grams are told apart by 64-bit hashes.

Defined cases: null, empty and letterless texts are `und` with score 0; so is every text if nothing could be learned.
Rows without a language are not learned from. Ties go to the language that comes first in alphabetical order. Repeated
rows, and rows with repeated or null ids, are each judged by their own text; extra columns, whatever their names, are ignored
by ``identify`` and kept by ``reject``. Empty tables give empty results. Whole texts are read, long ones in parts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_worker, held_out, small_batches, stage, worker_state

MAX_TRAIN, MAX_CHARS = 20_000, 100_000_000
LONGEST = 5
#: A word or n-gram is learned if it occurs this often in the training rows.
MIN_WORD, MIN_GRAM = 4, 8
#: Tokens that a worker remembers may take about this many bytes; then it forgets them all.
REMEMBER_BYTES = 80_000_000
#: Characters of a text, and tokens of several, that are read at once.
SLICE, PART = 1 << 20, 100_000
#: Smoothing of the counts.
ADD = 0.5
#: A document whose best language has a smaller posterior is rejected.
MIN_SCORE = 0.5
SPACE = re.compile(r"\s")


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(points, at, n: int):
    """Hashes of the n code points from each position of at."""
    import numpy as np

    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + points[at + j]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Model:
    """Log frequencies by language: of words, and for each length of n-grams their sorted hashes and log frequencies."""

    langs: list[str]
    prior: object
    words: dict[str, int]
    word_logs: object
    grams: dict[int, tuple]


class Scorer:
    """Sums of log frequencies, with a bounded memory of the tokens met."""

    def __init__(self, model: Model):
        import numpy as np
        import regex

        self.np, self.model = np, model
        self.runs = regex.compile(r"\p{L}+").findall
        self.most = REMEMBER_BYTES // (150 + 4 * len(model.langs))
        self.forget()

    def forget(self) -> None:
        #: Row of each token; row 0 is that of tokens without letters.
        self.at: dict[str, int] = {}
        self.used = 1
        self.rows = self.np.zeros((1024, len(self.model.langs)), self.np.float32)

    def _sums(self, values, owner, into) -> None:
        """Adds the rows of values to the rows of `into` that owner names; owner ascends."""
        if len(owner):
            first = self.np.flatnonzero(self.np.r_[True, owner[1:] != owner[:-1]])
            into[owner[first]] += self.np.add.reduceat(values, first, axis=0, dtype=into.dtype)

    def unseen(self, words: list[str]):
        """A row for each word, from its longest known n-grams."""
        np, out = self.np, self.np.zeros((len(words), len(self.model.langs)), self.np.float64)
        if not words:
            return out
        points = code_points("<" + "><".join(words) + ">")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths + 2)
        ends = np.cumsum(lengths + 2)
        open_ = np.ones(len(words), bool)
        for n in range(LONGEST, 0, -1):
            keys, logs = self.model.grams.get(n, ((), None))
            if not len(keys):
                continue
            at = np.flatnonzero(open_[owner] & (np.arange(len(points)) + n <= ends[owner]))
            h = gram_hashes(points, at, n)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            who, total = owner[at[hit]], np.zeros_like(out)
            self._sums(logs[k[hit]], who, total)
            found, times = np.unique(who, return_counts=True)
            out[found] = total[found] * (np.maximum(1.0, lengths[found] / n) / times)[:, None]
            open_[found] = False
        return out

    def learn(self, tokens: list[str]) -> None:
        """Rows for new tokens."""
        np, known = self.np, self.model.words
        runs = [self.runs(t) for t in "\n".join(tokens).lower().split("\n")] if tokens else []
        words = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(runs)))}
        at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        rows = np.zeros((len(words), len(self.model.langs)))
        rows[at >= 0] = self.model.word_logs[at[at >= 0]]
        rows[at < 0] = self.unseen([w for w, i in zip(words, at, strict=True) if i < 0])
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        number = np.cumsum(sizes > 0) - 1  # of a token among those with letters
        fresh = int((sizes > 0).sum())
        if self.used + fresh > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((self.used + fresh, self.rows.shape[1]), np.float32)])
        own = np.zeros((fresh, rows.shape[1]))
        self._sums(rows[np.fromiter((words[w] for w in chain.from_iterable(runs)), np.int64, int(sizes.sum()))], np.repeat(number, sizes), own)
        self.rows[self.used : self.used + fresh] = own
        self.at.update(zip(tokens, np.where(sizes > 0, number + self.used, 0).tolist(), strict=True))
        self.used += fresh

    def _split(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(text, tokens): whole texts, long ones in parts that end at white space."""
        for i, t in enumerate(texts):
            at = 0
            while t and at < len(t):
                end = len(t)
                if end - at > SLICE:
                    m = SPACE.search(t, at + SLICE)
                    end = m.start() if m else end
                yield i, t[at:end].split()
                at = end

    def _add(self, held: list[tuple[int, list[str]]], total, letters) -> None:
        np = self.np
        distinct = set().union(*[tokens for _, tokens in held])
        new = distinct - self.at.keys()
        if len(self.at) + len(new) > self.most:
            self.forget()
            new = distinct
        self.learn(list(new))
        sizes = np.fromiter((len(tokens) for _, tokens in held), np.int64, len(held))
        owner = np.repeat(np.fromiter((i for i, _ in held), np.int64, len(held)), sizes)
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(tokens for _, tokens in held)), np.int64, len(owner))
        letters[owner[ids > 0]] = True
        step = max(1, 8_000_000 // max(1, len(self.model.langs)))
        for k in range(0, len(ids), step):
            self._sums(self.rows[ids[k : k + step]], owner[k : k + step], total)

    def score(self, texts: list[str | None]) -> tuple[list[str], object]:
        """The language of each text, and the posterior of it."""
        np, langs = self.np, self.model.langs
        total, letters = np.tile(np.asarray(self.model.prior, np.float64), (len(texts), 1)), np.zeros(len(texts), bool)
        if not langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        held, size = [], 0
        for i, tokens in self._split(texts):
            held.append((i, tokens))
            size += len(tokens)
            if size > PART:
                self._add(held, total, letters)
                held, size = [], 0
        self._add(held, total, letters)
        best = total.argmax(axis=1)
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [langs[b] if x else "und" for b, x in zip(best, letters, strict=True)], np.where(letters, p, 0.0)


def _emit(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "key", "c"])


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        clear_worker()
        runs = regex.compile(r"\p{L}+").findall
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in runs((text or "").lower()))
            yield _emit(counts)

    return rows.select("lang", "text").mapInArrow(run, "lang string, key string, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def _gram_counts(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        counts[lang, g] += c
            yield _emit(counts)

    return words.select("lang", "key", "c").mapInArrow(run, "lang string, key string, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, least: int, langs: list[str]):
    """The keys that occur at least so often in the sample, in order, and a matrix of their counts by language."""
    import numpy as np

    per = counts.groupBy("key").agg(F.sum("c").alias("n"), F.collect_list("lang").alias("l"), F.collect_list("c").alias("c"))
    got = per.filter(F.col("n") >= least).select("key", "l", "c").toArrow()
    at = {x: j for j, x in enumerate(langs)}
    keys = got["key"].to_pylist()
    table = np.zeros((len(keys), len(langs)), np.float64)
    for i, (ls, cs) in enumerate(zip(got["l"].to_pylist(), got["c"].to_pylist(), strict=True)):
        for x, c in zip(ls, cs, strict=True):
            table[i, at[x]] = c
    return keys, table


def train(rows: DataFrame) -> Model:
    """rows(id, lang, text), all with a language, to a model."""
    import numpy as np

    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = min(1.0, MAX_TRAIN / max(1, n), MAX_CHARS / max(1, chars))
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < int(1e9 * share))
    prior = {r["lang"]: r["c"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()}
    langs = sorted(prior)
    words = stage(_word_counts(rows), "words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("c").alias("n")).collect()}

    def logs(table, totals):
        return np.log((table + ADD) / (totals + ADD * len(table))).astype(np.float32)

    known, table = _frequent(words, MIN_WORD, langs)
    word_logs = logs(table, np.array([totals.get(x, 0) for x in langs], np.float64))
    parts, table = _frequent(_gram_counts(words), MIN_GRAM, langs)
    lengths, by_length = np.fromiter(map(len, parts), np.int64, len(parts)), {}
    for k in range(1, LONGEST + 1):
        if len(own := np.flatnonzero(lengths == k)):
            hashes = gram_hashes(code_points("".join(parts[i] for i in own)), np.arange(len(own)) * k, k)
            order = np.argsort(hashes)
            by_length[k] = hashes[order], np.log((table[own] + ADD) / (table[own].sum(axis=0) + ADD * len(parts))).astype(np.float32)[order]
    share_of = np.log(np.array([prior[x] for x in langs], np.float64) / max(1, sum(prior.values())))
    return Model(langs, share_of, {k: i for i, k in enumerate(known)}, word_logs, by_length)


def _scorer(df: DataFrame, training: DataFrame):
    """A function that gives the worker's scorer."""
    model = df.sparkSession.sparkContext.broadcast(train(training.filter(F.col("lang").isNotNull())))
    name = uuid.uuid4().hex
    small_batches(df)
    return lambda: worker_state(("langid", name), lambda: Scorer(model.value))


def identify(df: DataFrame, training: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """id, lang_pred, score for each row of df. training has the columns id, lang and text; without it, all of df."""
    if training is None:
        training = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    scorer, kind = _scorer(df, training), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = scorer().score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def split_training(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows (id, lang, text) that may be learned from: crc32 of the id modulo 4 is not 2, and the language is known."""
    return df.filter(~held_out(id_col, 4, 2)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def reject(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose language is found with a score of MIN_SCORE or more. Each row is judged as it is read: no join."""
    scorer, at = _scorer(df, split_training(df, text_col, id_col, lang_col)), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = scorer().score(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= MIN_SCORE for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
