import random

from seriesmill.llm import decontam

from .conftest import frame, words


def shingles(t, n):
    w = (t or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, threshold=0.8):
    out = set()
    for d, t in docs:
        for i, q in items:
            n = min(5, len((q or "").split()))
            own = shingles(q, n) if n else set()
            if own and len(own & shingles(t, n)) / len(own) >= threshold - 1e-9:
                out.add((d, i))
    return out


def build():
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(6, 60))) for i in range(40)] + [(90, "only three words"), (91, None), (92, ""), (93, "word")]
    docs = [(i, words(rng, rng.randint(1, 400))) for i in range(30)]
    for k in range(25):
        q = items[k][1].split()
        if k % 3 == 1:
            q = q[1:]
        if k % 3 == 2 and len(q) > 30:
            q[len(q) // 2] = "other"
        docs.append((100 + k, words(rng, 200) + " " + " ".join(q) + " " + words(rng, 50)))
    docs += [(200, " ".join(q for _, q in items[:40])), (201, None), (202, ""), (203, "we say only three words here"), (None, items[0][1]), (204, words(rng, 30000) + " " + items[5][1])]
    return docs, items


def items_frame(spark, items):
    return spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")


def test_against_brute_force(spark):
    docs, items = build()
    got = decontam.contained(frame(spark, docs), items_frame(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert all(0.8 - 1e-9 <= r.containment <= 1 and r.shared == round(r.containment * r.item_shingles) for r in got)


def test_blocks_do_not_matter(spark, monkeypatch):
    docs, items = build()
    want = {(r.doc_id, r.item_id) for r in decontam.contained(frame(spark, docs), items_frame(spark, items)).collect()}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert {(r.doc_id, r.item_id) for r in decontam.contained(frame(spark, docs), items_frame(spark, items)).collect()} == want
    kept = decontam.decontaminate(frame(spark, docs), items_frame(spark, items))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in {x for x, _ in want}), key=str)


def test_bands_keep_their_promise():
    for item in (4, 11, 30):
        for most in (item, 2 * item, 10 * item):
            r = decontam.rows_for(item, most, 0.8)
            if r:
                j = 0.8 * item / (most + item * 0.2)
                assert (1 - j**r) ** (decontam.HASHES // r) <= decontam.MISS
    assert decontam.rows_for(10, 20000, 0.8) == 0


def test_empty(spark):
    docs, items = build()
    assert decontam.contained(frame(spark, []), items_frame(spark, items)).count() == 0
    assert decontam.contained(frame(spark, docs), items_frame(spark, [])).count() == 0
    df = frame(spark, docs)
    assert decontam.decontaminate(df, items_frame(spark, [])).count() == len(docs)
    assert decontam.decontaminate(df, items_frame(spark, items)).columns == df.columns
