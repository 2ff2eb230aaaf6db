import random

import numpy as np
import pytest

from seriesmill.llm import substring

from .conftest import frame, words


def brute(rows, w=50):
    first = {}
    for i, t in rows:
        x = (t or "").encode().split()
        for k in range(len(x) - w + 1):
            if i is not None:
                first[tuple(x[k : k + w])] = min(first.get(tuple(x[k : k + w]), 1 << 62), i)
    out = []
    for i, t in rows:
        x = (t or "").encode().split()
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if i is not None and first[tuple(x[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out.append((i, len(x), sum(gone), b" ".join(a for a, g in zip(x, gone) if not g).decode()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(frame(spark, rows), **options).collect()), key=str)


@pytest.mark.parametrize("limit", [20_000, 2])
def test_against_brute_force(spark, texts, limit):
    assert run(spark, texts, bucket_strings=limit) == brute(texts)


def test_overlapping_passages_and_order(spark):
    rng = random.Random(8)
    pool = [words(rng, 70) for _ in range(4)]
    rows = [(i, " ".join([words(rng, rng.randint(0, 60)), *rng.sample(pool, rng.randint(0, 3)), words(rng, rng.randint(0, 60))])) for i in rng.sample(range(1000), 40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, window=10) == brute(rows, 10)


def test_windows_of_large_buckets_in_several_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_STRINGS", 5)
    monkeypatch.setattr(substring, "PART_WINDOWS", 100)
    rng = random.Random(10)
    p = words(rng, 55)
    rows = [(i, " ".join([words(rng, rng.randint(0, 40)), p, rng.choice(["", p, words(rng, 30)])])) for i in rng.sample(range(1000), 60)]
    assert run(spark, rows, bucket_strings=3) == brute(rows)
    assert run(spark, rows, bucket_strings=3, window=12) == brute(rows, 12)


def test_edges(spark):
    rng = random.Random(9)
    p = words(rng, 60)
    rows = [(1, p), (1, p), (None, p), (2, p + " x"), (0, "a " * 500), (3, "a " * 60), (4, None), (5, ""), (6, p[: len(p) // 2])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_sliding_min_and_super_kmers_cover_every_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 500).astype(np.uint64)
    for n in (1, 2, 7, 43):
        assert (substring.sliding_min(h, n) == [h[i : i + n].min() for i in range(500 - n + 1)]).all()
