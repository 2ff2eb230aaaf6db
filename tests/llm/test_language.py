import random
import zlib

import numpy as np
import pyarrow as pa

from seriesmill.llm import language as lg

from .conftest import frame

SYLLABLES = {"aa": "ba da ga la ma na ra sa".split(), "oo": "bor dor gor lor mor nor ror sor".split(), "üü": "bü dü gü lü mü nü rü sü".split()}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return rows


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "x") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_held_out_accuracy_and_flags(spark):
    rows = corpus()
    got = {r.doc_id: r for r in lg.identify(docs(spark, rows), steps=200).collect()}
    test = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == g for i, g in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learns_only_from_rows_that_are_not_held_out(spark):
    rows = corpus(200)
    poisoned = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 3 == 1 else g) for i, t, g in rows]
    a = lg.identify(docs(spark, rows), steps=60).orderBy("doc_id").collect()
    b = lg.identify(docs(spark, poisoned), steps=60).orderBy("doc_id").collect()
    assert a == b and "wrong" not in {r.lang_pred for r in b}


def test_edges(spark):
    rows = corpus(150) + [(900, None, "aa"), (901, "", None), (902, "12 !? \n", "oo"), (903, "ba" * 20_000, None), (904, "1 b", None), (None, "ba da", "aa"), (5, "sor", None)]
    got = lg.identify(docs(spark, rows), steps=60)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert by[903].lang_pred == "aa" and by[904].lang_pred != "und" and by[None].held_out is False
    assert lg.identify(docs(spark, [])).count() == 0
    alone = lg.identify(docs(spark, [(1, "ba", None)])).collect()
    assert alone[0].lang_pred == "und" and alone[0].score == 0


def test_score_is_the_mean_over_all_positions():
    rng = np.random.default_rng(0)
    net = lg.ByteGru(["a", "b", "c"], 6)
    text = "Wörter und " + "x" * 50 + " ende. wörter und"
    total, count = net.score(pa.array([text, None, "ende."]))
    want, n = np.zeros(3), 0
    for w in text.encode().split():
        for i in range(0, len(w), lg.SEGMENT):
            p = net.probabilities(np.frombuffer(w[i : i + lg.SEGMENT], np.uint8)[None])
            want, n = want + p[0].sum(0), n + p.shape[1]
    assert np.allclose(total[0], want, atol=1e-4) and count.tolist() == [n, 0, 5]
    assert rng is not None


def test_gradients_by_differences():
    net = lg.ByteGru(["a", "b"], 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y = np.array([[1, 2, 3], [2, 2, 1]], np.uint8), np.array([0, 1])
    _, g = net.gradients(x, y)
    for k in ("V", "Uf", "Ub", "Ef", "Eb", "c"):
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = net.gradients(x, y)[0]
        net.p[k][i] = old - 1e-3
        down = net.gradients(x, y)[0]
        net.p[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3 * max(1, abs(g[k][i])), k


def test_stage_keeps_columns_and_clean_rows(spark):
    rows = corpus(150) + [(900, None, "aa"), (902, "12 !?", "oo")]
    df = docs(spark, rows).selectExpr("*", "doc_id * 2 as lang_pred", "doc_id as Score_1")
    out = lg.keep_identified(df, steps=60)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in df.where("doc_id < 150").collect())
    plain = frame(spark, [(1, "ab"), (2, "12")]).drop("lang", "score").selectExpr("*", "cast(null as string) as lang")
    assert [r.doc_id for r in lg.keep_identified(plain).collect()] == [1]
