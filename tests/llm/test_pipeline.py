import random

import corpus_pipeline
from seriesmill.llm import registry

from .conftest import words
from .test_decontam import shingles
from .test_neardup import brute as classes
from .test_pii import brute as private


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, words(rng, 30)) for i in range(5)]
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(20, 150)), "en") for i in range(60)]
    rows += [(100 + k, base + " end%d" % (k % 2), "en") for k in range(6)]
    rows += [(200, words(rng, 50) + " " + items[2][1], "en"), (201, words(rng, 30) + " mail a@b.cc 1.2.3.4", None), (202, "12 34", "en"), (203, None, None)]
    docs = [(i, t, g, "s%d" % (i % 3), len(t or "")) for i, t, g in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet("%s/documents.parquet" % tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet("%s/benchmark.parquet" % tmp_path)
    d, kept = spark.read.parquet("%s/documents.parquet" % tmp_path), {}
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect() or [], stage(spark, d, str(tmp_path)).schema)
        kept[name] = d.collect()
        if name != "packing":
            assert d.columns == before.columns
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert ids("language_id") == {i for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    left = [(r.doc_id, r.text) for r in sorted(kept["language_id"], key=lambda r: r.doc_id)]
    assert ids("near_duplicates") == {i for (i, _), c in zip(left, classes(left)) if i == c}
    assert ids("near_duplicates") - ids("decontamination") == {200} == {i for i, t in left if shingles(items[2][1], 5) <= shingles(t, 5)}
    assert ids("personal_data") == ids("decontamination")
    assert all(not private(r.text) for r in kept["personal_data"])
    assert {r.doc_id for r in kept["packing"]} == ids("personal_data")
    out = corpus_pipeline.run(spark, str(tmp_path))
    # where a text is cut depends on the rows that share its partition; that all of it is there does not
    total = lambda rows: {d: (sum(r.length for r in rows if r.doc_id == d), max(r.doc_tokens for r in rows if r.doc_id == d)) for d in {r.doc_id for r in rows}}
    assert total(out.collect()) == total(kept["packing"])


def test_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == ["op%d" % k for k in range(1, 11)] + ["pipeline"]
    assert set(registry.oracle_sql()) <= set(names)
