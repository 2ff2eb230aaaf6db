import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seriesmill.llm import registry, shards, tokens

from .conftest import frame


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4097])
def test_permutation(n):
    p = shards.permute(np.arange(n), n, 5)
    assert sorted(p) == list(range(n)) and (shards.unpermute(p, n, 5) == np.arange(n)).all()
    if n > 50:
        assert (p != np.arange(n)).mean() > 0.9 and (p != shards.permute(np.arange(n), n, 6)).any()


def test_round_trip_through_shards(spark, docs, texts, tmp_path):
    rows = shards.ordered(docs, length=64, shard_sequences=16).cache()
    got = rows.orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got)))
    slow = Tokenizer.from_file(tokens.default_path())
    parts = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 128 and len(ids) == r.n_ids == sum(p.n_tokens for p in r.pieces)
        for p in r.pieces:
            parts.setdefault(p.doc_id, []).append((p.start, ids[p.offset : p.offset + p.n_tokens]))
    for i, t in texts:
        ids = [*(slow.encode(t, add_special_tokens=False).ids if t else []), 50256]
        assert sum((x for _, x in sorted(parts[i])), []) == ids
    assert sum(r.n_ids for r in got) > 0.95 * 64 * len(got)
    uri = "file://%s" % tmp_path
    files = shards.write_shards(rows, uri, length=64).orderBy("shard").collect()
    assert sum(f.sequences for f in files) == len(got) and all((tmp_path / ("shard-%08d.bin" % f.shard)).stat().st_size == f.bytes for f in files)
    assert all(zlib.crc32((tmp_path / ("shard-%08d.bin" % f.shard)).read_bytes()) == f.crc32 for f in files)
    for r in got[:: max(1, len(got) // 20)]:
        back = shards.read_slot(uri, r.slot, 64, 16)
        assert len(back) == 64 and back[: r.n_ids].tolist() == np.frombuffer(r.ids, "<u2").tolist() and set(back[r.n_ids :]) <= {50256}


@pytest.mark.parametrize("block_bytes", [1, 700, 5000])
def test_blocks_of_any_size_give_the_same_rows(spark, docs, block_bytes):
    def rows(**options):
        return shards.ordered(docs.repartition(3), length=64, shard_sequences=16, **options).select("slot", "shard", "byte_offset", "n_ids", "ids").collect()

    got = rows(block_bytes=block_bytes)
    assert [(r.shard, r.byte_offset) for r in got] == [(r.slot // 16, r.slot % 16 * 128) for r in got]
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(len(r.ids) == 2 * r.n_ids for r in got)
    assert all(a.slot < b.slot for a, b in zip(got, got[1:]) if a.shard == b.shard)
    whole = rows()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))


def test_edges(spark):
    assert shards.ordered(frame(spark, [])).count() == 0
    rows = shards.digest(shards.ordered(frame(spark, [(None, "a"), (1, None), (1, "b")]))).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 1), (False, 2), (True, 2)]


def test_ids_are_as_wide_as_the_vocabulary_needs(monkeypatch):
    assert shards.width(0) == 2 and shards.width(70_000) == 4
    monkeypatch.setattr(tokens, "largest_id", lambda path: 100_000)
    assert shards.width(0) == 4


def test_query_writes_and_reads_back_its_shards(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(registry, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    got = registry.op9_training_order(spark, str(tmp_path / "in")).orderBy("slot", "offset").collect()
    plain = shards.digest(shards.ordered(spark.read.parquet(str(tmp_path / "in" / "documents.parquet"))))
    assert plain.columns == list(got[0].asDict()) and plain.orderBy("slot", "offset").collect() == got
    files = {f.name: f.read_bytes() for f in (tmp_path / "shared").glob("shards-*/shard-*.bin")}
    assert sum(map(len, files.values())) == len({r.slot for r in got}) * 1024 and len(got) > 0
    for r in got:
        row = files["shard-%08d.bin" % r.shard][r.byte_offset : r.byte_offset + 1024]
        assert zlib.crc32(row[2 * r.offset : 2 * (r.offset + r.n_tokens)]) == r.ids_crc32


def test_written_digest_edges(spark, tmp_path):
    rows = shards.ordered(frame(spark, [(i, "a b c") for i in range(70)]), length=8, shard_sequences=16)
    got = shards.written_digest(rows, f"file://{tmp_path}", length=8).orderBy("slot", "offset").collect()
    assert got == shards.digest(rows).orderBy("slot", "offset").collect()
    assert len(list(tmp_path.glob("shard-*.bin"))) == 1 + max(r.slot for r in got) // 16
    assert shards.written_digest(shards.ordered(frame(spark, [])), f"file://{tmp_path}/none").count() == 0
