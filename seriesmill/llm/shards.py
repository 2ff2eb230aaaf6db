"""Token sequences in training order, in binary shards of fixed stride.

Documents are packed into sequences of LENGTH ids by the harmonic packer of each worker, so that the fixed stride holds
little padding. A first pass writes them with their place (partition, position) to the shared folder; the partitions' counts give every sequence a dense number. A keyed Feistel network over the
next even number of bits, walked along its cycle until it lands below the number of sequences, permutes the numbers:
that is the sequence's global slot, computed from key and number alone. Shard s holds slots s*SIZE to (s+1)*SIZE - 1 in
order, each in exactly stride bytes, so a reader finds any slot by a multiplication and resumes anywhere. To the range
partitions the sequences travel in compressed blocks: what a worker holds for the same group of consecutive slots is one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, mix, written
from .packing import Packer

LENGTH, SHARD_SEQUENCES, ROUNDS = 512, 4096, 6
#: Bytes that a worker holds to make blocks of, and bytes of a group of consecutive slots that it opens at once.
BLOCK_BYTES = 16_000_000
ZSTD_LEVEL = 6
_U = np.uint64


def round_keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(key % 2**64))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1 at `numbers`."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift, keys = _U((1 << half) - 1), _U(half), round_keys(key)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = x = (left << shift) | right
        todo = todo[x >= _U(n)]  # outside: the cycle goes on
    return out.astype(np.int64)


def unpermute(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse: which number has a slot."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift, keys = _U((1 << half) - 1), _U(half), round_keys(key)
    out = slots.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
        out[todo] = x = (left << shift) | right
        todo = todo[x >= _U(n)]
    return out.astype(np.int64)


_PIECES = "array<struct<doc_id:bigint,start:bigint,n_tokens:int,offset:int>>"


def sequences(docs: DataFrame, length: int = LENGTH, end_id: int = 50256, tokenizer: str | None = None) -> DataFrame:
    """part, pos, n_ids, pieces (what of which document stands where), ids (little-endian uint16 or uint32, unpadded) of
    every sequence."""
    schema = f"part int, pos long, n_ids int, pieces {_PIECES}, ids binary"
    size = width(end_id, tokenizer)
    piece = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("offset", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, packer = tokens.encoder(tokenizer), TaskContext.get().partitionId(), Packer(length, 0)
        end, rows = np.array([end_id], np.uint32), []

        def out() -> pa.RecordBatch:
            number = np.array([r[4] for r in rows])
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            edges = np.r_[first, len(rows)].astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*((r[0], r[1], len(r[2]), r[5]) for r in rows)), (f.type for f in piece))], fields=list(piece))
            ids = [np.concatenate([r[2] for r in rows[i:j]]).astype(f"<u{size}") for i, j in zip(edges, edges[1:])]
            columns = [pa.array([part] * len(first), pa.int32()), pa.array(number[first], pa.int64()), pa.array(list(map(len, ids)), pa.int32()), pa.ListArray.from_arrays(pa.array(edges), flat), pa.array([x.tobytes() for x in ids], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "pos", "n_ids", "pieces", "ids"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += packer.add(doc, np.concatenate([enc.ids(text.as_py()), end]))
                if len(rows) >= 4000:
                    yield out()
                    rows = []
        rows += packer.finish()
        if rows:
            yield out()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def width(end_id: int, tokenizer: str | None = None) -> int:
    """Bytes an id: two if the vocabulary and the closing id fit."""
    return 2 if max(end_id, tokens.largest_id(tokenizer)) < 65536 else 4


def ordered(docs: DataFrame, key: int = 20240501, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, end_id: int = 50256, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """slot, shard, byte_offset, n_ids, pieces, ids of every sequence, range-partitioned and sorted by slot.

    A null or empty text is the closing id alone. A null or repeated doc_id is kept as it is. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = written(sequences(docs, length, end_id, tokenizer), "shards-sequences", level=9)
    spark = docs.sparkSession
    counts = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    total, before = 0, []
    for part, n in counts:
        before.append((part, total))
        total += n
    if not total:
        return spark.createDataFrame([], f"slot long, shard long, byte_offset long, {_ROW}")
    stride = length * width(end_id, tokenizer)
    # Slots are dense, so equal ranges of shards are equal amounts of work: no sampling is needed to find their edges, and
    # a range's number is its partition.
    shards = -(-total // shard_sequences)
    wanted = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    group = max(1, block_bytes // stride)
    blocks = arrow_map(rows, _blocks(dict(before), total, key, shard_sequences, shards, wanted, group, block_bytes), _BLOCK)
    dealt = blocks.repartitionById(wanted, F.col("range")).sortWithinPartitions("grp")
    out = arrow_map(dealt, _opened(width(end_id, tokenizer)), f"slot long, {_ROW}")
    return out.select("slot", F.expr(f"slot div {shard_sequences}").alias("shard"), ((F.col("slot") % shard_sequences) * stride).alias("byte_offset"), "n_ids", "pieces", "ids")


_ROW = f"n_ids int, pieces {_PIECES}, ids binary"
_BLOCK = f"range int, grp long, slots array<bigint>, n_ids array<int>, pieces array<{_PIECES}>, ids binary"


def _blocks(offsets: dict[int, int], total: int, key: int, shard_sequences: int, shards: int, wanted: int, group: int, block_bytes: int) -> Callable:
    """Rows of `sequences` to rows of _BLOCK: their slots, and the ids of all of a range and group under one compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held = pa.Codec("zstd", compression_level=ZSTD_LEVEL), []

        def out() -> pa.RecordBatch:
            slots = np.concatenate([h[0] for h in held])
            order = np.argsort(slots)
            slots = slots[order]
            n_ids, pieces, ids = (pa.concat_arrays(c).take(pa.array(order)) for c in list(zip(*held))[1:])
            ranges, groups = slots // shard_sequences * wanted // shards, slots // group
            first = np.flatnonzero(np.r_[True, (np.diff(ranges) != 0) | (np.diff(groups) != 0)])
            edges = np.r_[first, len(slots)].astype(np.int32)
            at, data = np.r_[0, np.cumsum(pc.binary_length(ids).to_numpy())], memoryview(b"".join(ids.to_pylist()))
            packed = [codec.compress(data[at[i] : at[j]], asbytes=True) for i, j in zip(edges, edges[1:])]
            lists = [pa.ListArray.from_arrays(pa.array(edges), c) for c in (pa.array(slots), n_ids, pieces)]
            columns = [pa.array(ranges[first], pa.int32()), pa.array(groups[first], pa.int64()), *lists, pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["range", "grp", "slots", "n_ids", "pieces", "ids"])

        for b in batches:
            if b.num_rows:
                part = b.column(0).to_numpy()
                values, inverse = np.unique(part, return_inverse=True)
                number = np.array([offsets[int(p)] for p in values], np.int64)[inverse] + b.column(1).to_numpy()
                held.append((permute(number, total, key), *b.columns[2:]))
            if sum(h[3].nbytes for h in held) >= block_bytes:
                yield out()
                held = []
        if held:
            yield out()

    return run


def _opened(size: int) -> Callable:
    """Rows of _BLOCK sorted by group to rows of slot, n_ids, pieces and ids in the order of slots; one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, now = pa.Codec("zstd"), [], None

        def out() -> Iterator[pa.RecordBatch]:
            slots, n_ids, pieces = (pa.concat_arrays([h[k].values for h in held]) for k in range(3))
            ids = []
            for h in held:
                counts = h[1].values.to_numpy()
                data, end = codec.decompress(h[3].as_buffer(), int(counts.sum()) * size, asbytes=True), np.cumsum(counts) * size
                ids += [data[i:j] for i, j in zip(np.r_[0, end[:-1]], end)]
            order = np.argsort(slots.to_numpy())
            for i in range(0, len(order), 1000):
                take = order[i : i + 1000]
                at = pa.array(take)
                yield pa.RecordBatch.from_arrays([slots.take(at), n_ids.take(at), pieces.take(at), pa.array([ids[x] for x in take], pa.binary())], ["slot", "n_ids", "pieces", "ids"])

        for b in batches:
            for row in zip(*b.columns[1:]):
                if held and row[0].as_py() != now:
                    yield from out()
                    held = []
                now = row[0].as_py()
                held.append(row[1:])
        if held:
            yield from out()

    return run


def _stored(batches: Iterator[pa.RecordBatch], uri: str, length: int, pad_id: int, size: int) -> Iterator[tuple[int, str, int, int, list[pa.RecordBatch]]]:
    """Write batches of shard, ids and further columns as files; shard, path, sequences, crc32 and the further columns of
    each, once it stands under its own name."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    pad = np.array([pad_id] * length, f"<u{size}").tobytes()
    attempt = TaskContext.get().taskAttemptId()
    now, stream, temporary, n, crc, rest = None, None, "", 0, 0, []

    def close() -> tuple[int, str, int, int, list[pa.RecordBatch]]:
        stream.close()
        path = f"{root}/shard-{now:08d}.bin"
        store.move(temporary, path)
        return now, path, n, crc, rest

    for b in batches:
        shards, ids = b.column(0).to_numpy(), b.column(1)
        others = b.select(b.schema.names[2:])
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else []
        for i, j in zip(edges, edges[1:]):
            if shards[i] != now:
                if now is not None:
                    yield close()
                now, n, crc, rest = int(shards[i]), 0, 0, []
                temporary = f"{root}/.shard-{now:08d}-{attempt}"
                stream = store.open_output_stream(temporary)
            for row in ids.slice(i, j - i).to_pylist():
                row += pad[len(row) :]
                stream.write(row)
                crc = zlib.crc32(row, crc)
            n += j - i
            rest.append(others.slice(i, j - i))
    if now is not None:
        yield close()


def write_shards(sequences_in_order: DataFrame, uri: str, length: int = LENGTH, pad_id: int = 50256, tokenizer: str | None = None) -> DataFrame:
    """Write `ordered` rows as files shard-%08d.bin under uri (a folder that all executors reach); returns shard, path,
    sequences, bytes, crc32 of each. A shard is written under another name first and then moved, so that a repeated
    task replaces it as a whole. Rows of a shard must stand together, as `ordered` leaves them."""
    schema, size = "shard long, path string, sequences long, bytes long, crc32 long", width(pad_id, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, path, n, crc, _ in _stored(batches, uri, length, pad_id, size):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, path, n, n * length * size, crc), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "path", "sequences", "bytes", "crc32"])

    return arrow_map(sequences_in_order.select("shard", "ids"), run, schema)


_DIGEST = "slot long, shard long, byte_offset long, doc_id long, start long, n_tokens int, offset int, ids_crc32 long"


def written_digest(sequences_in_order: DataFrame, uri: str, length: int = LENGTH, pad_id: int = 50256, tokenizer: str | None = None) -> DataFrame:
    """Write `ordered` rows as `write_shards` does, read each shard back once it stands, and return the rows of `digest`
    with the CRC-32 of the ids found in the file. A place without the row's ids and padding raises."""
    size = width(pad_id, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        stride, pad = length * size, np.array([pad_id] * length, f"<u{size}").tobytes()
        for shard, path, n, _, rest in _stored(batches, uri, length, pad_id, size):
            with store.open_input_file(path) as f:
                if f.size() != n * stride:
                    raise OSError(f"{path} has {f.size()} bytes, not {n} x {stride}")
                for b in rest:
                    rows = []
                    for slot, at, k, pieces in zip(*(c.to_pylist() for c in b.columns)):
                        row = f.read_at(stride, at)
                        if row[k * size :] != pad[k * size :]:
                            raise OSError(f"{path} has no sequence of {k} ids at {at}")
                        rows += [(slot, shard, at, p["doc_id"], p["start"], p["n_tokens"], p["offset"], zlib.crc32(row[p["offset"] * size : (p["offset"] + p["n_tokens"]) * size])) for p in pieces]
                    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _DIGEST.split(", ")])

    return arrow_map(sequences_in_order.select("shard", "ids", "slot", "byte_offset", "n_ids", "pieces"), run, _DIGEST)


def read_slot(uri: str, slot: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, pad_id: int = 50256, tokenizer: str | None = None) -> np.ndarray:
    """The padded ids of one slot, by seeking."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    size = width(pad_id, tokenizer)
    with store.open_input_file(f"{root}/shard-{slot // shard_sequences:08d}.bin") as f:
        f.seek((slot % shard_sequences) * length * size)
        return np.frombuffer(f.read(length * size), f"<u{size}")


def digest(ordered_rows: DataFrame, tokenizer: str | None = None, end_id: int = 50256) -> DataFrame:
    """slot, shard, byte_offset, doc_id, start, n_tokens, offset and ids_crc32 of every piece of a document: where its
    sequence stands, which of the document's ids it is and where in the sequence, and the CRC-32 of the ids' bytes."""
    size = width(end_id, tokenizer)
    each = ordered_rows.select("slot", "shard", "byte_offset", F.explode("pieces").alias("p"), "ids").select("slot", "shard", "byte_offset", "p.*", "ids")
    ids = F.expr(f"substring(ids, offset * {size} + 1, n_tokens * {size})")
    return each.select("slot", "shard", "byte_offset", "doc_id", "start", "n_tokens", "offset", F.crc32(ids).alias("ids_crc32"))
