import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from seriesmill.llm import packing, tokens

from .conftest import frame


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(tokens.default_path())


def test_ids_equal_those_of_tokenizers(texts, slow):
    enc = tokens.encoder()
    for t in [t for _, t in texts if t] + ["<|endoftext|> a<|endoftext|>", "  a  b\n\n c   d", "it's 12345 中文 \U0001f600"]:
        assert enc.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [7, 64, 1024])
def test_every_id_once_and_gapless(spark, docs, texts, slow, capacity):
    rows = packing.pack(docs, capacity).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, t in texts:
        ids = np.array([*(slow.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_little_padding():
    p = packing.Packer(1024, 0)
    rng, total = np.random.default_rng(0), 0
    for k in range(3000):
        n = int(rng.integers(1, 3000))
        total += n
        p.add(k, np.zeros(n, np.uint32))
    p.finish()
    assert total / (p.next * 1024) > 0.98


def test_classes_hold_a_fixed_number():
    p = packing.Packer(1024, 0)
    out = [r for k in range(500) for r in p.add(k, np.zeros(200, np.uint32))]
    for seq in {r[4] for r in out}:
        lengths = {len(r[2]) for r in out if r[4] == seq}
        assert len({1024 // n for n in lengths}) == 1
        assert len([r for r in out if r[4] == seq]) == 1024 // max(lengths)


def test_edges(spark):
    rows = packing.pack(frame(spark, [(None, "a b"), (1, None), (1, "")])).collect()
    assert sorted(r.doc_tokens for r in rows) == [1, 1, 3]
    assert packing.pack(frame(spark, [])).count() == 0
    assert "ids" in packing.pack(frame(spark, [(1, "a")]), with_ids=True).columns


def test_ids_equal_those_of_the_library_on_all_documents():
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    texts = [t or "" for t in pq.read_table(path, columns=["text"])["text"].to_pylist()]
    slow, fast = Tokenizer.from_file(tokens.default_path()), tokens.encoder()
    for i in range(0, len(texts), 1000):
        part = texts[i : i + 1000]
        for t, e in zip(part, slow.encode_batch(part, add_special_tokens=False)):
            assert fast.ids(t).tolist() == e.ids
