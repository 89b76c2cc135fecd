"""Sequential rules over the seeds of one read: Arrow batches of reads, each with the list of its seeds.

A seed is a tuple (contig_id, fwd, q, len, r). A read's seeds are bounded by its length times its matches, so a list for each
read is a small group; reads are dealt out like any rows. Orders are total, so results do not depend on partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seeds import KEY

FIELDS = ["contig_id", "fwd", "q", "len", "r"]
SCHEMA = "read_id long, contig_id long, fwd boolean, q long, len long, r long"
Seed = tuple[int, bool, int, int, int]
#: Letters that a part of a seed must have to be kept when the rest of it is covered.
LEAST_PART = 16


def _lists(seeds: DataFrame, keys: list[str]) -> DataFrame:
    return seeds.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("seeds"))


def _run(rows: DataFrame, keys: list[str], rule: Callable[[list[Seed], pd.Series], list[Seed]], columns: list[str], schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for _, row in part.iterrows():
                found = [tuple(s[f] for f in FIELDS) for s in row["seeds"]]
                out += [(row["read_id"], *s) for s in rule(found, row)]
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, schema)


def per_read(seeds: DataFrame, rule: Callable[[list[Seed]], list[Seed]]) -> DataFrame:
    """The seeds that a rule makes of each read's seeds."""
    return _run(_lists(seeds, ["read_id"]), ["read_id"], lambda s, _: rule(s), ["read_id", *FIELDS], SCHEMA)


def max_spanning(seeds: list[Seed]) -> list[Seed]:
    """From left to right, always the longest seed over the next uncovered query position, with its equals elsewhere."""
    todo = sorted(seeds, key=lambda s: (s[2], -s[3], s))
    active: list[tuple[int, Seed]] = []
    out, i, x = [], 0, 0
    while i < len(todo) or active:
        while i < len(todo) and todo[i][2] <= x:
            heapq.heappush(active, (-todo[i][3], todo[i]))
            i += 1
        active = [a for a in active if a[1][2] + a[1][3] > x]
        heapq.heapify(active)
        if not active:
            if i == len(todo):
                break
            x = todo[i][2]
            continue
        longest = -active[0][0]
        places, best = set(), sorted(s for n, s in active if -n == longest)
        for s in best:
            if (s[0], s[4]) not in places:
                places.add((s[0], s[4]))
                out.append(s)
        x = best[0][2] + longest
    return out


def part_of(s: Seed, start: int, end: int) -> Seed:
    """The part of a seed over [start, end) of the query."""
    shift = start - s[2]
    return (s[0], s[1], start, end - start, s[4] + shift if s[1] else s[4] - shift)


def cut_overlaps(seeds: list[Seed]) -> list[Seed]:
    """The parts of seeds that no other seed covers on the query: whole seeds, or parts of more than LEAST_PART letters."""
    marks: dict[int, int] = {}
    for _, _, q, n, _ in seeds:
        marks[q] = marks.get(q, 0) + 1
        marks[q + n] = marks.get(q + n, 0) - 1
    points, depth, level = sorted(marks), {}, 0
    for p in points:
        level += marks[p]
        depth[p] = level
    at = {p: i for i, p in enumerate(points)}
    out = []
    for s in seeds:
        start, end = s[2], s[2] + s[3]
        free = None
        for p in points[at[start] : at[end]] + [end]:
            single = p < end and depth[p] == 1
            if single and free is None:
                free = p
            if not single and free is not None:
                if p - free > LEAST_PART or (free, p) == (start, end):
                    out.append(part_of(s, free, p))
                free = None
    return sorted(out)


def resolve_overlaps(seeds: list[Seed], least: int = 5) -> list[Seed]:
    """Pairwise, in query order: of enclosed seeds the longer stays; others that overlap are both cut at the overlap's centre,
    unless fewer than `least` letters of one would be left: then the shorter goes."""
    todo, done = sorted(seeds, key=lambda s: (s[2], -s[3], s)), []
    for s in todo:
        while done and s is not None:
            last = done[-1]
            lo, hi = s[2], min(last[2] + last[3], s[2] + s[3])
            if lo >= hi:
                break
            if hi == s[2] + s[3]:
                s = None
                break
            centre = (lo + hi) // 2
            if centre - last[2] < least or s[2] + s[3] - centre < least:
                if last[3] >= s[3]:
                    s = None
                    break
                done.pop()
                continue
            done[-1] = part_of(last, last[2], centre)
            s = part_of(s, centre, s[2] + s[3])
            break
        if s is not None:
            done.append(s)
    return done


def _not_enclosing(intervals: list[tuple[int, int, float, Seed]]) -> list[Seed]:
    """Of (start, end, distance, seed): of intervals that enclose one another the one with the smallest distance stays."""
    kept: list[tuple[int, int, float, Seed]] = []
    for one in sorted(intervals, key=lambda t: (t[0], -t[1], t[2], t[3])):
        around = [i for i, k in enumerate(kept) if k[1] >= one[1]]
        if not around:
            kept.append(one)
        elif all(kept[i][2] > one[2] for i in around):
            kept = [k for k in kept if k[1] < one[1]]
            kept.append(one)
    return [k[3] for k in kept]


def harmonize(seeds: list[Seed]) -> list[Seed]:
    """For each contig and strand the seeds that are consistent with one another: two sweeps, over the shadows to the left
    and then to the right; conflicts go to the seed nearer to the 45 degree line through the median seed."""
    out = []
    for key in sorted({(s[0], s[1]) for s in seeds}):
        own = sorted((s for s in seeds if (s[0], s[1]) == key), key=lambda s: (s[2], s))
        flip = -1 if not key[1] else 1
        place = {s: flip * s[4] for s in own}
        middle = own[len(own) // 2]
        line = place[middle] - middle[2]
        far = {s: abs(place[s] - s[2] - line) / 2**0.5 for s in own}
        left = _not_enclosing([(s[2], place[s] + s[3], far[s], s) for s in own])
        out += _not_enclosing([(place[s], s[2] + s[3], far[s], s) for s in left])
    return sorted(out)


def soc_stack(placed: DataFrame, least: int = 24) -> DataFrame:
    """Strips of each read without shared seeds: (read_id, contig_id, first_delta, last_delta, score, n_seeds).

    placed has the columns of seeds, delta and q_len. Strips begin at each seed; where two strips share seeds the one with
    the higher score takes them all, and what is left of the other stays if it has `least` letters.
    """
    fields = ["delta", "contig_id", "len", "q", "r", "fwd"]
    rows = placed.groupBy("read_id").agg(F.max("q_len").alias("q_len"), F.sort_array(F.collect_list(F.struct(*fields))).alias("seeds"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for _, row in part.iterrows():
                found = [(s["delta"], s["contig_id"], s["len"]) for s in row["seeds"]]
                out += [(row["read_id"], *t) for t in stack(found, (2 * int(row["q_len"]) - 4) // 200, least)]
            yield pd.DataFrame(out, columns=["read_id", "contig_id", "first_delta", "last_delta", "score", "n_seeds"])

    return rows.mapInPandas(run, "read_id long, contig_id long, first_delta long, last_delta long, score long, n_seeds long")


def stack(seeds: list[tuple[int, int, int]], width: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """Over (delta, contig, len) in order of delta."""
    total = [0]
    for s in seeds:
        total.append(total[-1] + s[2])
    strips: list[list[int]] = []  # first and past-last seed
    end = 0
    for start in range(len(seeds)):
        end = max(end, start)
        while end < len(seeds) and seeds[end][0] <= seeds[start][0] + width and seeds[end][1] == seeds[start][1]:
            end += 1
        a, b = start, end
        while strips and a < b and strips[-1][1] > a:
            last = strips[-1]
            if total[last[1]] - total[last[0]] < total[b] - total[a]:
                last[1] = a
                if total[last[1]] - total[last[0]] < max(1, least):
                    strips.pop()
                else:
                    break
            else:
                a = last[1]
                break
        if a < b and total[b] - total[a] >= max(1, least):
            strips.append([a, b])
    return [(seeds[a][1], seeds[a][0], seeds[b - 1][0], total[b] - total[a], b - a) for a, b in strips]


def _with_texts(seeds: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    rows = _lists(seeds, ["read_id", "contig_id"])
    return rows.join(reads.select("read_id", F.col("seq").alias("query")), "read_id").join(contigs.select("contig_id", F.col("seq").alias("reference")), "contig_id")


_PAIR = str.maketrans("ACGT", "TGCA")


def grown(s: Seed, query: str, reference: str) -> Seed:
    """The seed extended at both ends as long as letters match."""
    c, fwd, q, n, r = s
    step = 1 if fwd else -1
    same = (lambda a, b: a == b) if fwd else (lambda a, b: a == b.translate(_PAIR))
    while q > 0 and 0 <= r - step < len(reference) and same(query[q - 1], reference[r - step]):
        q, r, n = q - 1, r - step, n + 1
    while q + n < len(query) and 0 <= r + step * n < len(reference) and same(query[q + n], reference[r + step * n]):
        n += 1
    return (c, fwd, q, n, r)


def extend(seeds: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Seeds extended to maximal matches, each once."""
    rule = lambda s, row: sorted({grown(x, row["query"], row["reference"]) for x in s})
    return _run(_with_texts(seeds, reads, contigs), [*KEY], rule, ["read_id", *FIELDS], SCHEMA)


def kmer_size(w: int, h: int, t: float) -> int:
    """The smallest k >= 2 for which random texts of these lengths share no k-mer with probability 1 - t, else min + 1."""
    return next((k for k in range(2, min(w, h) + 1) if (1 - 0.25**k) ** ((w - k + 1) * (h - k + 1)) >= 1 - t), min(w, h) + 1)


def _matches(query: str, reference: str, contig: int, q0: int, q1: int, r0: int, r1: int, k: int) -> set[Seed]:
    """Maximal matches of at least k letters that begin within a rectangle, on both strands."""
    places: dict[str, list[tuple[bool, int]]] = {}
    for r in range(r0, r1 - k + 1):
        word = reference[r : r + k]
        places.setdefault(word, []).append((True, r))
        places.setdefault(word.translate(_PAIR)[::-1], []).append((False, r + k - 1))
    found = set()
    for q in range(q0, q1 - k + 1):
        for fwd, r in places.get(query[q : q + k], ()):
            found.add(grown((contig, fwd, q, k, r), query, reference))
    return found


def fill_gaps(seeds: list[Seed], query: str, reference: str, t: float = 0.05, most: int = 400, rounds: int = 1000) -> list[Seed]:
    """Seeds between neighbouring seeds, again and again until no new gap appears.

    A gap is the rectangle between a seed's end and the next one's start, at most `most` letters on each side; the word
    length follows from its size.
    """
    have, seen = set(seeds), set()
    for _ in range(rounds):
        order = sorted(have, key=lambda s: (s[2], s))
        fresh = []
        for a, b in zip(order, order[1:]):
            q0, q1 = a[2] + a[3], b[2]
            ends = sorted((a[4] + a[3] if a[1] else a[4] - a[3] + 1, b[4]))
            box = (q0, q1, max(0, ends[0]), min(len(reference), ends[1]))
            if box not in seen and 2 <= box[1] - box[0] <= most and 2 <= box[3] - box[2] <= most:
                fresh.append(box)
        if not fresh:
            break
        for box in fresh:
            seen.add(box)
            k = kmer_size(box[1] - box[0], box[3] - box[2], t)
            have |= _matches(query, reference, seeds[0][0], *box, k)
    return sorted(have)


def reseed(seeds: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    rule = lambda s, row: fill_gaps(s, row["query"], row["reference"])
    return _run(_with_texts(seeds, reads, contigs), [*KEY], rule, ["read_id", *FIELDS], SCHEMA)
