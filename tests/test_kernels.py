"""Sequential kernels against plain brute force."""

import random

import numpy as np
import pytest

from seqloom.operators import align as A
from seqloom.operators import clusters as C
from seqloom.operators import evaluate as E
from seqloom.operators import kmers as K
from seqloom.operators import seed_kernels as S


def brute_score(q, r, s):
    """Plain dynamic programming with all gap lengths."""
    n, m = len(q), len(r)
    best = [[-(10**9)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + (s.match if q[i - 1] == r[j - 1] != "N" else -s.mismatch))
            for g in range(1, i + 1):
                best[i][j] = max(best[i][j], best[i - g][j] - s.gap_cost(g))
            for g in range(1, j + 1):
                best[i][j] = max(best[i][j], best[i][j - g] - s.gap_cost(g))
    return best[n][m]


@pytest.mark.parametrize("seed", range(12))
def test_alignment(seed):
    rng, s = random.Random(seed), A.Scoring(gap2=9)
    q = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 30)))
    r = q[: rng.randrange(len(q) + 1)] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 18))) + q[rng.randrange(len(q)) :]
    score, ops = A.align(q, r, s)
    assert score == brute_score(q, r, s)
    assert sum(n for o, n in ops if o in "=XI") == len(q) and sum(n for o, n in ops if o in "=XD") == len(r)
    i = j = total = 0
    for o, n in ops:
        if o in "=X":
            assert all((q[i + k] == r[j + k] != "N") == (o == "=") for k in range(n))
        total += s.match * n if o == "=" else -s.mismatch * n if o == "X" else -s.gap_cost(n)
        i, j = i + (n if o != "D" else 0), j + (n if o != "I" else 0)
    assert total == score


def test_alignment_edges():
    assert A.align("", "") == (0, []) and A.align("ACG", "")[1] == [("I", 3)] and A.align("", "AC")[1] == [("D", 2)]
    assert A.align("ACGT" * 50, "ACGT" * 50, band=3)[0] == 400
    assert A.best_local([("X", 5), ("=", 10), ("X", 1), ("=", 4), ("D", 50)]) == (24, 1, 3)
    assert A.printed("ACGT", "ACT").split("\n") == ["ACGT", "|| |", "AC-T"]


@pytest.mark.parametrize("size", [100, 300])
def test_inversion_is_found(size):
    """Random letters lose about half a point each, so a short inversion needs a smaller drop than the default of 100."""
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(900))
    part = text[250 : 250 + size].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    found = A.inversions(text[:250] + part + text[250 + size :], text, z_drop=size // 4)
    assert len(found) == 1 and abs(found[0][0] - 250) < 15 and abs(found[0][1] - 250 - size) < 15
    assert A.inversions(text, text) == []


def seeds(rng, n):
    return [(0, rng.random() < 0.5, rng.randrange(200), rng.randrange(5, 60), rng.randrange(100, 900)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_seed_rules(seed):
    rng = random.Random(seed)
    given = seeds(rng, 25)
    covers = lambda s, x: s[2] <= x < s[2] + s[3]
    want, x = [], 0
    while x < 300:
        over = [s for s in given if covers(s, x)]
        if not over:
            x += 1
            continue
        longest = max(s[3] for s in over)
        best = sorted(s for s in over if s[3] == longest)
        want += [s for i, s in enumerate(best) if (s[0], s[4]) not in {(b[0], b[4]) for b in best[:i]}]
        x = best[0][2] + longest
    assert S.max_spanning(given) == want

    for part in S.cut_overlaps(given):
        sources = [s for s in given if s[1] == part[1] and covers(s, part[2]) and S.part_of(s, part[2], part[2] + part[3]) == part]
        assert sources and all(sum(covers(s, p) for s in given) == 1 for p in range(part[2], part[2] + part[3]))
    done = S.resolve_overlaps(given)
    assert all(a[2] + a[3] <= b[2] for a, b in zip(done, done[1:]))
    kept = S.harmonize(given)
    assert set(kept) <= set(given)
    for a in kept:
        assert not any(b != a and b[:2] == a[:2] and b[2] <= a[2] and b[2] + b[3] >= a[2] + a[3] and (b[4] if b[1] else -b[4]) <= (a[4] if a[1] else -a[4]) and (b[4] if b[1] else -b[4]) + b[3] >= (a[4] if a[1] else -a[4]) + a[3] for b in kept)


def test_strips():
    strips = S.stack([(0, 0, 20), (5, 0, 20), (8, 0, 20), (40, 0, 50), (41, 1, 9)], 10, 15)
    assert strips == [(0, 0, 8, 60, 3), (0, 40, 40, 50, 1)]
    assert S.stack([], 5, 1) == []


def test_fill_gaps_finds_what_was_missed():
    rng = random.Random(9)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    read = text[:100] + "T" + text[101:300]
    got = S.fill_gaps([(0, True, 0, 60, 0), (0, True, 150, 150, 150)], read, text)
    assert any(s[1] and s[2] <= 60 and s[2] + s[3] >= 100 for s in got)
    assert all(read[q : q + n] == text[r : r + n] for _, fwd, q, n, r in got if fwd)


@pytest.mark.parametrize("seed", range(6))
def test_touching_boxes(seed):
    rng = random.Random(seed)
    boxes = [(rng.randrange(60), rng.randrange(60), rng.randrange(7), rng.randrange(7)) for _ in range(60)]
    label = list(range(60))
    for _ in range(60):
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                if a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]:
                    label[i] = label[j] = min(label[i], label[j])
    assert sorted(map(tuple, C.touching(boxes))) == sorted(tuple(i for i in range(60) if label[i] == k) for k in set(label))


def test_columns_do_not_overlap():
    spans = [(0, 5), (1, 3), (4, 9), (30, 31), (30, 40)]
    cols = E.columns_of(spans, 1)
    assert all(cols[i] != cols[j] or spans[i][1] + 1 <= spans[j][0] for i in range(5) for j in range(i + 1, 5)) and max(cols) == 1


def test_sketch_is_symmetric():
    rng = random.Random(4)
    s = "".join(rng.choice("ACGT") for _ in range(400))
    rc = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    one = {(h, f, p) for p, h, f in K.sketch(s, 15, 10)}
    two = {(h, not f, 400 - p - 1 + 14) for p, h, f in K.sketch(rc, 15, 10)}
    assert one == two and K.sketch("ACG", 15, 10) == [] and K.sketch("N" * 50, 15, 10) == []
    assert len(set(K.mix(np.arange(4096, dtype=np.uint64), 12).tolist())) == 4096
