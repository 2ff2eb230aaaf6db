"""Exact removal of word windows that an earlier document has too, by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash among its MMER-word runs, so equal windows
have equal minimisers. Consecutive windows of a text with the same minimiser form a super-k-mer and travel as one
packed string of words to the minimiser's bucket, where sorting finds for each window the smallest doc_id that has it.

Equal texts are one text from the start (all but the first lose everything). Minimisers that only one document has
cannot hold a repeated window; only the super-k-mers of the others travel, and equal packed strings are combined
before they do. The windows of a bucket of more than BUCKET_STRINGS distinct strings are dealt out anew by
hash, in blocks, and hot minimisers and strings stay with their rows, so that a hot passage never meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, arrow_map, chunks, discard, join_by_key, ngrams, text_buffer, written

WINDOW, MMER = 50, 8
#: Windows in a super-k-mer at most; a longer run with one minimiser is several.
RUN = 64
BUCKET_STRINGS = 512
#: Strings of large buckets in a block, and windows that a part of them takes, about.
BLOCK_STRINGS, PART_WINDOWS = 2000, 1 << 18


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size, out = 1, h
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - n + 1], out[n - size : n - size + len(h) - n + 1]) if len(h) >= n else h[:0]


def super_kmers(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word within the text, windows, minimiser) of every super-k-mer."""
    m = min(MMER, window)
    if len(words.hash) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = sliding_min(ngrams(words.hash, m), window - m + 1)
    at = np.flatnonzero(words.doc[: len(least)] == words.doc[window - 1 :])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    doc, least = words.doc[at], least[at]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])]
    begin = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    first = np.flatnonzero(nth % RUN == 0)
    return doc[first], at[first] - words.first[doc[first]], np.diff(np.r_[first, len(at)]), least[first]


def _sketch(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, t1, t2, and arrays start, n, mini of the super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(3))
            for i, j in chunks(offsets):
                o = offsets[i : j + 1]
                doc, *found = super_kmers(Words(raw[o[0] : o[-1]], o - o[0]), window)
                edges = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=j - i))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (found[0].astype(np.int32), found[1].astype(np.int32), found[2].astype(np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), *lists], ["doc_id", "t1", "t2", "start", "n", "mini"])

    return arrow_map(docs.select("doc_id", "t1", "t2", "text"), run, "doc_id long, t1 long, t2 long, start array<int>, n array<int>, mini array<long>")


def _packed(rows: DataFrame, window: int) -> DataFrame:
    """The packed strings of rows (doc_id, t1, text, hits: array<struct<start, n, mini>>), with a digest of each."""
    schema = "doc_id long, t1 long, start int, n int, mini long, p1 long, p2 long, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(3)
            edge, flat = hits.offsets.to_numpy(), hits.values
            start, n, mini = (flat.field(k).to_numpy() for k in range(3))
            out, size = [], 0
            for doc, t, text, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), edge[:-1].tolist(), edge[1:].tolist()):
                words = text.as_py().encode().split()
                for x, k, m in zip(start[lo:hi].tolist(), n[lo:hi].tolist(), mini[lo:hi].tolist()):
                    packed = b" ".join(words[x : x + k + window - 1])
                    d = hashlib.blake2b(packed, digest_size=16).digest()
                    out.append((doc, t, x, k, m, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), packed))
                    size += len(packed)
                    if size > CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return arrow_map(rows, run, schema)


def _windows(packed: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string number, hash, second hash) of every window of an array of packed strings, in order."""
    raw, offsets = text_buffer(packed.cast(pa.string()))
    w = Words(raw, offsets, 2)
    a, b = ngrams(w.hashes[0], window), ngrams(w.hashes[1], window, 1)
    whole = w.doc[: len(a)] == w.doc[window - 1 :] if len(a) else np.zeros(0, bool)
    return w.doc[: len(a)][whole], a[whole], b[whole]


def _earliest_in_bucket(strings: DataFrame, window: int) -> DataFrame:
    """mini, p1, p2, firsts: of each window of a string the smallest doc_id; strings of a bucket stand together."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        of, a, b = _windows(t["packed"].combine_chunks(), window)
        ids = t["least"].to_numpy()[of]
        order = np.lexsort((ids, b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(of) else np.zeros(0, bool)
        first = np.empty(len(of), np.int64)
        first[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(of) else 0
        edges = np.searchsorted(of, np.arange(len(t) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("mini", "p1", "p2")), pa.ListArray.from_arrays(pa.array(edges), pa.array(first))], ["mini", "p1", "p2", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            mini = b.column(0).to_numpy()
            cut = int(np.searchsorted(mini, mini[-1])) if mini[0] != mini[-1] else 0  # the last bucket may go on
            if cut:
                yield solve(pa.Table.from_batches([*kept, b.slice(0, cut)]))
                kept = []
            kept.append(b.slice(cut))
        if kept:
            yield solve(pa.Table.from_batches(kept))

    dealt = strings.select("mini", "p1", "p2", "least", "packed").repartition("mini").sortWithinPartitions("mini")
    return arrow_map(dealt, run, "mini long, p1 long, p2 long, firsts array<long>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The consecutive rows that share their first column, one table a value."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy()
        for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1) if len(key) else []:
            if kept and kept[-1].column(0)[0].as_py() != key[part[0]]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(part[0], len(part)))
    if kept:
        yield pa.Table.from_batches(kept)


def _cut(lists: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(lists, kind))


def _earliest_by_window(strings: DataFrame, window: int) -> DataFrame:
    """The same for the strings of large buckets: their windows are dealt out by hash, in blocks.

    A block holds each window of up to BLOCK_STRINGS strings once, sorted by part and hash. A part gets one row from
    each block and answers with one, so a passage that all strings have counts once a block. Rows number at most the
    windows and fall short of them as long as blocks hold more windows than there are parts.
    """
    parts = (strings.agg(F.sum("n")).first()[0] or 0) // PART_WINDOWS + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_STRINGS):
                s = b.slice(i, BLOCK_STRINGS)
                of, x, y = _windows(s.column(4), window)
                if not len(of):
                    continue
                least, part = s.column(3).to_numpy()[of], (x >> np.uint64(20)) % np.uint64(parts)
                order = np.lexsort((least, y, x, part))
                new = np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]
                at = np.empty(len(of), np.int64)
                at[order] = np.cumsum(new) - 1
                once = order[new]
                begin = np.flatnonzero(np.r_[True, part[once][1:] != part[once][:-1]])
                # First the block's own row (part -1: its strings, and which window is which), then a row a part.
                own, rest = np.r_[0, len(s)], np.r_[0, 0, begin[1:], len(once)]
                head = [_cut(v, np.r_[own, np.full(len(begin), own[1])], pa.int64()) for v in (s.column(k).to_numpy() for k in range(3))]
                head += [_cut(np.bincount(of, minlength=len(s)), np.r_[own, np.full(len(begin), own[1])], pa.int32()), _cut(at, np.r_[0, np.full(len(begin) + 1, len(at))], pa.int32())]
                keys = [pa.array(np.full(len(begin) + 1, block)), pa.array(np.r_[-1, part[once][begin].astype(np.int64)], pa.int32())]
                yield pa.RecordBatch.from_arrays([*keys, *head, *[_cut(v[once], rest, pa.int64()) for v in (x.view(np.int64), y.view(np.int64), least)]], names)
                block += 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            a, b, least = (t[c].combine_chunks().flatten().to_numpy() for c in ("w1", "w2", "least"))
            order = np.lexsort((least, b, a))
            new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
            first = np.empty(len(a), np.int64)
            first[order] = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            edges = np.r_[0, np.cumsum(pc.list_value_length(t["w1"]).to_numpy())]
            yield pa.RecordBatch.from_arrays([t["block"].combine_chunks(), t["part"].combine_chunks(), _cut(first, edges, pa.int64())], ["block", "part", "firsts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            own = t.slice(0, 1).combine_chunks()
            n, at = (own[c].combine_chunks().flatten().to_numpy() for c in ("n", "at"))
            firsts = t["firsts"].combine_chunks().flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([*(own[c].combine_chunks().flatten() for c in ("mini", "p1", "p2")), _cut(firsts[at], np.r_[0, np.cumsum(n)], pa.int64())], ["mini", "p1", "p2", "firsts"])

    schema = "block long, part int, mini array<long>, p1 array<long>, p2 array<long>, n array<int>, at array<int>, w1 array<long>, w2 array<long>, least array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    each = written(arrow_map(strings.select("mini", "p1", "p2", "least", "packed"), blocks, schema), "substring-blocks")
    dealt = each.where("part >= 0").select("part", "block", "w1", "w2", "least").repartition("part").sortWithinPartitions("part", "block")
    firsts = arrow_map(dealt, solve, "block long, part int, firsts array<long>")
    heads = each.where("part < 0").select("block", "part", "mini", "p1", "p2", "n", "at")
    return arrow_map(heads.unionByName(firsts, True).repartition("block").sortWithinPartitions("block", "part"), gather, "mini long, p1 long, p2 long, firsts array<long>")


def repeated_windows(docs: DataFrame, window: int = WINDOW, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """docs (doc_id, t1, t2, text; no null ids) as doc_id, t1, whole, runs: what of each text earlier documents have.

    whole: an earlier document has the same text; runs: array<struct<start, firsts>>, the super-k-mers with, for each
    window, the smallest doc_id that has it. Texts without either are left out.
    """
    signed = written(_sketch(docs, window), "substring-signed")
    texts = signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"), *[F.first(c).alias(c) for c in ("start", "n", "mini")])
    texts = written(texts, "substring-texts")
    each = texts.select(F.col("rep").alias("doc_id"), "t1", F.explode(F.arrays_zip("start", "n", "mini")).alias("x")).select("doc_id", "t1", "x.*")
    shared = each.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi").select("mini", "k")
    shared = written(shared, "substring-shared")
    hits = join_by_key(each, shared, ["mini"], "k").groupBy("doc_id", "t1").agg(F.collect_list(F.struct("start", "n", "mini")).alias("hits"))
    packed = written(_packed(docs.join(hits, ["doc_id", "t1"]).select("doc_id", "t1", "text", "hits"), window), "substring-packed")
    discard(shared)
    strings = packed.groupBy("mini", "p1", "p2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("packed").alias("packed"))
    strings = written(strings, "substring-strings")
    large = strings.groupBy("mini").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > bucket_strings).select("mini")
    if large.isEmpty():
        first = _earliest_in_bucket(strings, window)
    else:
        large = written(large, "substring-large")
        first = _earliest_in_bucket(strings.join(large, "mini", "left_anti"), window).unionByName(_earliest_by_window(strings.join(large, "mini", "left_semi"), window))
    # A string that one document has, and whose windows it has first, repeats nothing.
    ends = strings.select("mini", "p1", "p2", "least", "most", "k")
    first = first.join(ends, ["mini", "p1", "p2"]).where((F.col("least") < F.col("most")) | (F.array_min("firsts") < F.col("least")))
    first = written(first.select("mini", "p1", "p2", "firsts", "k"), "substring-first")
    members = join_by_key(packed.drop("packed", "n"), first, ["mini", "p1", "p2"], "k").where(F.array_min("firsts") < F.col("doc_id"))
    runs = members.groupBy("doc_id", "t1").agg(F.collect_list(F.struct("start", "firsts")).alias("runs"))
    copied = written(texts.where("n_rows > 1").select("t1", "t2", "rep", "n_rows"), "substring-copied")
    whole = join_by_key(signed.select("doc_id", "t1", "t2"), copied, ["t1", "t2"], "n_rows").where("doc_id > rep").select("doc_id", "t1").distinct()
    out = written(runs.select("doc_id", "t1", F.lit(False).alias("whole"), "runs").unionByName(whole.select("doc_id", "t1", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<start:int,firsts:array<bigint>>>").alias("runs"))), "substring-found")
    discard(signed, texts, packed, strings, first, copied)
    return out


def deduplicate(docs: DataFrame, window: int = WINDOW, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows
    are those of the input. Words are runs of bytes other than ASCII white space. A null text has no words. A row
    without a doc_id, or a repeat of a doc_id, has no smaller one on its account and is judged like any other row (a
    null doc_id keeps all). Other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(29), text).alias("t2"), F.coalesce(text, F.lit("")).alias("text"))
    found = repeated_windows(base.where(F.col("doc_id").isNotNull()), window, bucket_strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, count, gone, kept = b.column(0), [], [], []
            for doc, text, whole, runs in zip(ids.to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                words = text.as_py().encode().split()
                count.append(len(words))
                if whole and len(words) >= window:
                    words = []
                elif runs.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    for r in runs.as_py():
                        at = r["start"] + np.flatnonzero(np.array(r["firsts"]) < doc)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + window, -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [w for w, s in zip(words, stay) if s]
                gone.append(count[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return arrow_map(base.join(found.hint("merge"), ["doc_id", "t1"], "left").select("doc_id", "text", "whole", "runs"), run, "doc_id long, n_words long, n_removed long, kept string")
