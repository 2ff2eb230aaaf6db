import random
from collections import Counter

import numpy as np
import pytest

from seriesmill.llm import neardup

from .conftest import frame, words


def shingle_sets(t):
    w = (t or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, threshold=0.8):
    """class of each (doc_id, text): the smallest doc_id reachable over similar texts; rows of equal text are one."""
    sets = [shingle_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] or not sets[j] or rows[i][0] is None or rows[j][0] is None:
                continue
            if rows[i][1] == rows[j][1] or sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values()) >= threshold:
                a, b = find(i), find(j)
                if a != b:
                    lo, hi = sorted((a, b), key=lambda k: (rows[k][0], k))
                    parent[hi] = lo
    return [rows[find(i)][0] if sets[i] else rows[i][0] for i in range(len(rows))]


def key(x):
    return tuple((v is None, v or 0) for v in x)


def check(spark, rows):
    got = neardup.classes(frame(spark, rows)).collect()
    want = Counter((i, c) for (i, _), c in zip(rows, brute(rows)))
    assert Counter((r.doc_id, r.class_id) for r in got) == want


def test_against_brute_force(spark, texts):
    check(spark, texts)


def test_family_around_a_base(spark):
    """Copies with different edits resemble the base, but often not each other; some resemble nothing any more."""
    rng = random.Random(5)
    base = words(rng, 150).split()
    rows = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = "e%d" % rng.randrange(10**9)
        rows.append((k, " ".join(copy)))
    second = list(base)
    for i in range(0, 40):
        second[i] = "s%d" % i  # another base within the family's reach
    for k in range(30):
        copy = list(second)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(150)] = "f%d" % rng.randrange(10**9)
        rows.append((100 + k, " ".join(copy)))
    check(spark, rows)


def test_weights_count(spark):
    a, b = "a b c d e f " * 20, "a b c d e f " * 9
    rows = [(1, a), (2, b), (3, a + "a b c d e f")]
    check(spark, rows)


def test_edges(spark):
    check(spark, [(7, "x y z"), (7, "p q r"), (3, "x y z"), (None, "x y z"), (None, None), (9, None), (9, None), (5, ""), (6, " \n")])
    assert neardup.classes(frame(spark, [])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng, errors = np.random.default_rng(1), []
    for _ in range(150):
        h = rng.integers(0, 2**63, 60).astype(np.uint64)
        a = rng.integers(0, 4, 60).astype(float)
        b = a.copy()
        k = rng.integers(0, 15)
        b[:k] = rng.integers(0, 4, k)
        sig = neardup.signatures(np.r_[h[a > 0], h[b > 0]], np.r_[a[a > 0], b[b > 0]], np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], 2)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.07


def test_parity_bound_never_rules_out_a_similar_pair():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(5, 300)
        a = np.array([rng.randrange(2**63) for _ in range(n)], np.uint64)
        b = a.copy()
        k = rng.randint(0, n)
        b[:k] = [rng.randrange(2**63) for _ in range(k)]
        bits = neardup.parity(np.r_[np.zeros(n, int), np.ones(n, int)], np.r_[a, b], np.ones(2 * n), 2)
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in bits[0] ^ bits[1])
        assert differ <= 2 * k


@pytest.mark.parametrize("fill", [[(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "q r s t u v")]])
def test_keep_one(spark, fill):
    df = frame(spark, fill)
    out = neardup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "q r s t u v")], key=str)


def test_keep_one_with_repeated_ids(spark):
    a, near, b, c = " ".join("w%d" % i for i in range(60)), " ".join("w%d" % i for i in range(61)), "q r s t u v", "k l m n o p"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (1, near), (None, c), (None, c), (4, None), (4, None)]
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(frame(spark, rows)).collect()), key=str)
    first = a if (1, a) in kept else near
    assert kept == sorted([(1, first), (2, b), (3, c), (None, c), (None, c), (4, None), (4, None)], key=str)
