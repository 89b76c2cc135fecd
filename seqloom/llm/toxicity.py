"""Toxicity scores of restored text: a noisy-channel decoder undoes leetspeak, spacing and repetition first.

Decoder. A text's tokens are what stands between white space and any of ``._-/,;:``. One token, or several in a row,
are a lattice: each character may stand for itself, for a letter it looks like, or for nothing; a run of a letter, however
long, for one or two of it; a gap between tokens for a word border or for nothing. Viterbi search finds the reading of highest
probability under a character model with word edges, the channel's costs included. A lattice is decoded if one of its paths
spells a strong word, one that alone brings a text's score to the threshold, that it doesn't show as it stands; a walk
through a trie of these words, from each token on, tells. Elsewhere tokens are taken as they are.

Score. A logistic regression over the words of the restored text, learned from labelled training rows: the words that are
most associated with either label (by log odds against their own uncertainty), each counted once per text. It is fitted on
texts as they stand, so that strong words are known before anything is restored.

The classifier is fitted on at most MAX_TRAIN labelled rows, picked by a hash of the id, which bounds its vocabulary too. The
character model covers all texts that may be learned from; it tells a to z, any other letter and the word edge, so it has
at most 28 ** (CONTEXT + 1) counts. Labels, languages, sources and ids are never inputs of a score.

Defined cases: null and empty texts have no words and get the score of the intercept. Rows without a label, and labels
without a row, are not learned from; of several labels of one id the largest counts. If only one label or none was
learned, every score is the share of label 1 (0 if there was none). Of readings that are as likely the first in alphabetical
order is taken. Repeated rows are scored alike; extra columns are ignored. Empty tables give empty results. Whole texts are
read, long ones in parts that overlap by OVERLAP tokens.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_worker, small_batches, stage, worker_state

MAX_TRAIN = 20_000
#: A word needs this many training texts, and log odds this many standard errors from 0, to become a feature.
MIN_TEXTS, MIN_Z = 4, 3.0
#: Weight of the squares of the weights, against the mean loss of a row.
RIDGE = 4e-6
THRESHOLD = 0.3
#: Letters that a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "abcdefghijklmnopqrstuvwxyz"}
#: Natural logs of the channel: a substitution, a character that stands for nothing (at a token's ends, and within), a run of
#: three or more cut down, a pair cut down to one, a gap that stands for nothing.
SWAP, EDGE_DROP, DROP, SHRINK, HALVE, GLUE = -1.0, -0.5, -8.0, -0.3, -0.7, -2.0
#: The character model looks at this many letters before each.
CONTEXT = 3
EDGE, GAP = "\x02", " "
OTHER = "\x03"
SEPARATORS = "._-/,;:"
#: Tokens that a worker remembers may take about this many bytes; then it forgets them all.
REMEMBER_BYTES = 60_000_000
#: Characters of a text, and tokens of several, that are read at once; tokens that two parts of a long text share.
SLICE, PART, OVERLAP = 1 << 20, 100_000, 64
SPACE = re.compile(r"\s")


def symbol(ch: str) -> str:
    """What the character model knows of a character."""
    return ch if "a" <= ch <= "z" or ch == EDGE else OTHER


@dataclass
class CharModel:
    """Interpolated character n-grams over words with edges, from counts of (CONTEXT letters, letter)."""

    grams: Counter = field(default_factory=Counter)
    memo: dict = field(default_factory=dict)

    def __post_init__(self):
        self.counts = [Counter() for _ in range(CONTEXT + 1)]
        self.totals = [Counter() for _ in range(CONTEXT + 1)]
        for gram, n in self.grams.items():
            gram = "".join(map(symbol, gram))
            for j in range(CONTEXT + 1):
                self.counts[j][gram[CONTEXT - j :]] += n
                self.totals[j][gram[CONTEXT - j : CONTEXT]] += n

    def log(self, before: str, letter: str) -> float:
        """Of the letter after the CONTEXT characters before it. The memo has an entry for each key at most: 28 ** (CONTEXT + 1)."""
        key = "".join(map(symbol, before + letter))
        if (got := self.memo.get(key)) is None:
            p = 1 / (len(self.counts[0]) + 50)
            for j in range(CONTEXT + 1):
                tail = key[CONTEXT - j : CONTEXT]
                p = (self.counts[j][tail + key[-1]] + 4 * p) / (self.totals[j][tail] + 4)
            got = self.memo[key] = math.log(p)
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each position (a run of one character) the readings with their costs."""
    out, i = [], 0
    letters = [k for k, ch in enumerate(token) if ch.isalpha()] or [0, len(token)]
    first, last = letters[0], letters[-1]
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        ch, run = token[i], j - i
        stands = [(x, SWAP) for x in LEET.get(ch, "")]
        if ch.isalpha():
            stands.append((ch, 0.0))
        readings = [(x, c + (SHRINK if run > 2 else HALVE if run > 1 else 0.0)) for x, c in stands]
        readings += [(x * 2, c + (SHRINK if run > 2 else 0.0)) for x, c in stands] if run > 1 else []
        if not ch.isalpha():
            readings.append(("", EDGE_DROP if i < first or i > last else DROP))
        out.append(readings)
        i = j
    return out


def decode(token: str, model: CharModel) -> str:
    """The most probable reading of a token, or of tokens with a blank between each two (Viterbi over the lattice; a state is
    the last CONTEXT characters). Blanks of the reading are word borders."""
    positions: list[list[tuple[str, float]]] = []
    for t in token.split(GAP):
        positions += [[(GAP, 0.0), ("", GLUE)]] if positions else []
        positions += lattice(t)
    best: dict[str, tuple[float, str]] = {EDGE * CONTEXT: (0.0, "")}
    for readings in positions:
        step: dict[str, tuple[float, str]] = {}
        for before, (score, text) in best.items():
            for reading, cost in readings:
                s, state = score + cost, before
                for ch in reading:
                    s += model.log(state, EDGE if ch == GAP else ch)
                    state = EDGE * CONTEXT if ch == GAP else state[1:] + ch
                new = (s, text + reading)
                if state not in step or (-new[0], new[1]) < (-step[state][0], step[state][1]):
                    step[state] = new
        best = step
    return min((-(s + model.log(state, EDGE)), t) for state, (s, t) in best.items())[1]


ROOT, NOWHERE = frozenset((0,)), frozenset()


class Restorer:
    """Words of a vocabulary in restored texts, with a bounded memory of the tokens met. strong: those that are looked for in
    disguise, all by default."""

    def __init__(self, model: CharModel, vocabulary: Iterable[str], strong: Iterable[str] | None = None):
        import regex

        self.model, self.vocabulary = model, frozenset(vocabulary)
        self.strong = self.vocabulary if strong is None else frozenset(strong)
        self.letters = regex.compile(r"\p{L}+").findall
        #: A trie: for each state its successors by letter, and whether a word ends there. State 0 is the root.
        self.next: list[dict[str, int]] = [{}]
        self.final = [False]
        for w in sorted(self.strong):
            at = 0
            for ch in w:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.final.append(False)
                at = self.next[at][ch]
            self.final[at] = True
        self.inner = frozenset(range(1, len(self.next)))
        #: The states of `inner` that a first letter leads to.
        self.after: dict[str, frozenset[int]] = {}
        for ch in {ch for n in self.next for ch in n}:
            self.after[ch] = frozenset(self.next[s][ch] for s in self.inner if ch in self.next[s])
        self.forget()

    def forget(self) -> None:
        #: For each token 0, or what is known of it: vocabulary words in it, states after it from the root, whether it can go on a word.
        self.at: dict[str, int] = {}
        self.facts: list[tuple[tuple[str, ...], frozenset[int]]] = [((), frozenset())]
        self.worded, self.starts, self.goes_on = bytearray(1), bytearray(1), bytearray(1)
        self.read: dict[tuple[str, ...], tuple[str, ...]] = {}
        self.steps: dict[tuple[str, frozenset[int]], frozenset[int]] = {}
        self.held = 0

    def _letter(self, states: frozenset[int], ch: str) -> set[int]:
        if states is self.inner:
            return set(self.after.get(ch, ()))
        return {self.next[s][ch] for s in states if ch in self.next[s]}

    def spell(self, token: str, states: frozenset[int]) -> frozenset[int]:
        """The states of the trie that the lattice of a token leads to."""
        i = 0
        while i < len(token) and states:
            ch, j = token[i], i + 1
            while j < len(token) and token[j] == ch:
                j += 1
            if states is self.inner and not ch.isalpha():  # whatever the character stands for leads to inner states
                i = j
                continue
            out: set[int] = set() if ch.isalpha() else set(states)
            for x in LEET.get(ch, "") + (ch if ch.isalpha() else ""):
                one = self._letter(states, x)
                out |= one
                if j - i > 1:
                    out |= self._letter(frozenset(one), x)
            states, i = frozenset(out), j
        return states

    def _read(self, tokens: tuple[str, ...]) -> tuple[str, ...]:
        """The vocabulary words in the best reading of tokens."""
        if (got := self.read.get(tokens)) is None:
            got = tuple(w for w in self.letters(decode(GAP.join(tokens), self.model)) if w in self.vocabulary)
            if sum(map(len, tokens)) < 200:
                self.held += 300
                self.read[tokens] = got
        return got

    def learn(self, tokens: Iterable[str]) -> None:
        for t in tokens:
            runs = self.letters(t)
            words = tuple(w for w in runs if w in self.vocabulary)
            start = self.spell(t, ROOT) if t[0] in self.next[0] or not t[0].isalpha() else NOWHERE
            if runs and not self.strong.intersection(words) and any(self.final[s] for s in start):
                words = self._read((t,))
            goes_on = bool(self.spell(t, self.inner))
            self.held += 150 + len(t)
            if words or start or goes_on:
                self.at[t] = len(self.facts)
                self.facts.append((words, start))
                self.worded.append(bool(words)), self.starts.append(bool(start)), self.goes_on.append(goes_on)
                self.held += 300
            else:
                self.at[t] = 0

    def _spaced(self, tokens: list[str], k: int) -> Iterator[tuple[str, ...]]:
        """Readings of two or more tokens from the k-th on that may spell one word."""
        states, j = self.facts[self.at[tokens[k]]][1], k + 1
        while states and j < len(tokens) and self.goes_on[self.at[tokens[j]]]:
            key = (tokens[j], states)
            if (after := self.steps.get(key)) is None:
                after = self.steps[key] = self.spell(tokens[j], states)
                self.held += 400
            states, j = after, j + 1
            if any(self.final[s] for s in states) and any(ch.isalpha() for t in tokens[k:j] for ch in t):
                yield self._read(tuple(tokens[k:j]))

    def _parts(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(text, tokens): whole texts, long ones in parts that end at white space and overlap."""
        for i, t in enumerate(texts):
            at, before = 0, []
            while t and at < len(t):
                end = len(t)
                if end - at > SLICE:
                    m = SPACE.search(t, at + SLICE)
                    end = m.start() if m else end
                low = t[at:end].lower()
                for ch in SEPARATORS:
                    low = low.replace(ch, " ")
                tokens = before + low.split()
                yield i, tokens
                at, before = end, tokens[-OVERLAP:]

    def _add(self, held: list[tuple[int, list[str]]], out: list[set[str]]) -> None:
        import numpy as np

        distinct = set().union(*[tokens for _, tokens in held])
        if self.held > REMEMBER_BYTES:
            self.forget()
        self.learn(distinct - self.at.keys())
        worded, starts, goes_on = (np.frombuffer(bytes(x), bool) for x in (self.worded, self.starts, self.goes_on))
        for i, tokens in held:
            ids = np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
            for k in set(ids[worded[ids]].tolist()):
                out[i].update(self.facts[k][0])
            for k in np.flatnonzero(starts[ids[:-1]] & goes_on[ids[1:]]).tolist():
                for words in self._spaced(tokens, k):
                    out[i].update(words)

    def words_of(self, texts: list[str | None]) -> list[set[str]]:
        """For each text its restored words that are in the vocabulary."""
        out: list[set[str]] = [set() for _ in texts]
        held, size = [], 0
        for i, tokens in self._parts(texts):
            held.append((i, tokens))
            size += len(tokens)
            if size > PART:
                self._add(held, out)
                held, size = [], 0
        self._add(held, out)
        return out

    def words(self, text: str | None) -> set[str]:
        return self.words_of([text])[0]

    def shown(self, text: str | None) -> set[str]:
        """The words that a text shows as it stands."""
        return set(self.letters((text or "").lower()))


def _emit(counts: Counter, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=names)


def _char_model(texts: DataFrame) -> CharModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        clear_worker()
        letters, other = regex.compile(r"\p{L}+").findall, re.compile(r"[^a-z\x02]")
        words: Counter = Counter()
        counts: Counter = Counter()

        def flush() -> None:
            for w, c in words.items():
                s = EDGE * CONTEXT + other.sub(OTHER, w) + EDGE
                for i in range(len(s) - CONTEXT):
                    counts[s[i : i + CONTEXT + 1], 0] += c
            words.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words.update(letters((t or "").lower()))
                if len(words) > 200_000:
                    flush()
        flush()
        yield _emit(counts, ["key", "label", "c"])

    found = texts.select("text").mapInArrow(run, "key string, label int, c long").groupBy("key").agg(F.sum("c").alias("c"))
    got = found.toArrow()  # at most 28 ** (CONTEXT + 1) rows
    return CharModel(Counter(dict(zip(got["key"].to_pylist(), got["c"].to_pylist(), strict=True))))


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    bias: float

    @property
    def strong(self) -> list[str]:
        """Words that bring a text without others to the threshold."""
        return sorted(w for w in self.weights if self.score({w}) >= THRESHOLD)

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(words) if w in self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: list[list[int]], y: list[int], n: int) -> tuple[list[float], float]:
    """L2-regularised logistic regression by accelerated gradient steps; x lists the features of each row. Each feature's step
    is bounded by the curvature that its rows can have."""
    import numpy as np

    sizes = np.array([len(f) for f in x])
    row = np.repeat(np.arange(len(x)), sizes)
    col = np.array([c for f in x for c in f], np.int64)
    target = np.array(y, float)
    w, b = np.zeros(n), math.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))
    curve, curve_b = np.bincount(col, (sizes + 1.0)[row], n) / (4 * len(x)) + RIDGE, (sizes + 1.0).mean() / 4
    v, vb, t = w, b, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], len(x)) + vb, -30, 30)))
        err = (p - target) / len(x)
        w_new, b_new = v - (np.bincount(col, err[row], n) + RIDGE * v) / curve, vb - err.sum() / curve_b
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w.tolist(), float(b)


def train(rows: DataFrame, corpus: DataFrame | None = None) -> Model:
    """rows(id, text, toxic) with labels 0 and 1 to a model; the character model is counted over corpus(text), or rows."""
    spark = rows.sparkSession
    small_batches(rows)
    chars = _char_model(rows if corpus is None else corpus)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        clear_worker()
        letters = regex.compile(r"\p{L}+").findall
        for batch in batches:
            counts: Counter = Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((w, y) for w in set(letters((t or "").lower())))
            yield _emit(counts, ["key", "label", "c"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model(chars, {}, math.log((share + 1e-9) / (1 - share + 1e-9)))
    words = rows.select("text", "toxic").mapInArrow(shown, "key string, label int, c long").groupBy("key").agg(
        F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("label") == 0, F.col("c")).otherwise(0)).alias("c0")
    )
    odds = F.log((F.col("c1") + 0.5) / F.lit(n1 + 1)) - F.log((F.col("c0") + 0.5) / F.lit(n0 + 1))
    sure = F.abs(odds) / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    picked = words.filter((F.col("c0") + F.col("c1") >= MIN_TEXTS) & (sure >= MIN_Z)).select("key")
    names = sorted(picked.toArrow()["key"].to_pylist())  # words of at most about MAX_TRAIN texts
    shared = spark.sparkContext.broadcast(names)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letters, at = regex.compile(r"\p{L}+").findall, {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            found = [sorted(at[w] for w in set(letters((t or "").lower())) if w in at) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["x", "y"])

    got = rows.select("text", "toxic").mapInArrow(features, "x array<int>, y int").toArrow()  # MAX_TRAIN rows or so
    w, b = _fit(got["x"].to_pylist(), got["y"].to_pylist(), len(names))
    return Model(chars, dict(zip(names, w, strict=True)), b)


def labelled(documents: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Training rows (id, text, toxic): at most about MAX_TRAIN, so the labels that are joined are few enough to broadcast."""
    from .common import bounded

    known = labels.filter(usable & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > MAX_TRAIN:
        known = known.filter(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < int(1e6 * MAX_TRAIN / n))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(docs.join(bounded(known, 64), F.col("id") == F.col("l_id")).select("id", "text", "toxic"), "labelled")


def score(documents: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", restored: bool = False) -> DataFrame:
    """id, score, predicted for each row; with restored also the vocabulary words that were restored from disguises."""
    small_batches(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    name, kind = uuid.uuid4().hex, documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = worker_state(("toxicity", name), lambda: Restorer(m.chars, m.weights, m.strong))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = restorer.words_of(texts)
            scores = [m.score(w) for w in words]
            cols = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            names = ["id", "score", "predicted"]
            if restored:
                cols.append(pa.array([sorted(w - restorer.shown(t)) for w, t in zip(words, texts, strict=True)], pa.list_(pa.string())))
                names.append("restored")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {kind}, score double, predicted int" + (", restored array<string>" if restored else "")
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
