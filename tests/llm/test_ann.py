import numpy as np
import pytest

from seriesmill.llm import ann


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    rows = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), d[i]) for i in rows]


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int, rank int")


@pytest.mark.parametrize("n,d,clusters", [(1500, 32, 10), (600, 20, 600)])
def test_recall_and_order(spark, n, d, clusters):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)
    ids = np.arange(n)
    df = frame(spark, ids.tolist(), x.tolist())
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        want = brute(x.astype(float), ids, q, 10)
        hits += len({w[0] for w in want} & {r[1] for r in rows})
        for _, v, s in rows:
            assert s == pytest.approx(np.sqrt(((x[v].astype(float) - x[q]) ** 2).sum()), abs=1e-12)
    assert hits / (10 * len(got)) >= 0.9 and len(got) == n // 50


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    codes = ann.learn(x[:1000], 5)
    index = ann.MultiIndex(codes, np.arange(3000), x)
    for radius in (1, 3, 8, 14, 22):
        masks = [ann.probes(r) for r in ann.radii(radius, 4)]
        for q in range(5):
            near = np.flatnonzero(ann.hamming(index.codes[q], index.codes) <= radius)
            assert index.within(index.codes[q], radius, masks).tolist() == near.tolist()


def test_share_of_rows_met():
    """Where near rows have near codes, probing meets a small part of the rows and the radius still holds the neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))[rng.integers(0, 300, 12_000)] + 0.25 * rng.normal(size=(12_000, 64))
    codes = ann.learn(x[:4000], 10)
    index, masks = ann.MultiIndex(codes, np.arange(len(x)), x), [ann.probes(r) for r in ann.radii(codes.radius, 4)]
    met = hits = 0
    for q in range(0, 12_000, 400):
        met += len(index.met(index.codes[q], masks)) / len(x) / 30
        hits += len({i for i, _ in brute(x, np.arange(len(x)), q, 10)} & set(index.search(x[q], q, 10, index.codes[q], codes.radius, masks)[0].tolist())) / 300
    assert met < 0.2 and hits >= 0.9


def test_queries_with_too_few_rows_within_the_radius(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    df = frame(spark, list(range(300)), x.tolist())
    learn = ann.learn

    def narrow(*args):
        codes = learn(*args)
        codes.radius = 2
        return codes

    monkeypatch.setattr(ann, "learn", narrow)
    monkeypatch.setattr(ann, "INDEXED", 1000)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), block=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert len(got) == 15
    for q, rows in got.items():
        assert [v for _, v in sorted(rows)] == [i for i, _ in brute(x.astype(float), np.arange(300), q, 10)]


def test_bad_vectors_ties_and_small_tables(spark):
    x = [[1.0, 0.0]] * 4 + [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None, [None, 1.0], [0.0, 1.0], [1.0, 2.0, 3.0]]
    df = frame(spark, list(range(len(x))), x)
    rows = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df).collect())
    assert [r for r in rows if r[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 9)]
    assert {r[0] for r in rows} == {0, 1, 2, 3, 9}
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0
    many = ann.nearest(df, df, block=2)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in many.collect()) == rows
