"""Benchmark decontamination: containment search for short test items inside long documents.

The items of one block (bounded, so that it can go to every worker) define a universe of n-word shingles. A document
is reduced to its shingles within that universe, which leaves every item's containment as it is. Reduced documents and
items are partitioned by size; for each pair of size classes the Jaccard similarity that a containment of the
threshold implies at least gives the MinHash banding (the most selective one that misses less than MISS), and what
shares a band is verified by exact shingle containment. Where no banding of HASHES values can promise that (a document
holding many times the item's shingles), the pairs are counted exactly through the shingles' own postings.
Nothing is shuffled: the work is one pass over the documents for each block of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, mix, ngrams, text_buffer

SHINGLE, THRESHOLD = 5, 0.8
HASHES, MISS = 128, 1e-4
#: A block of items takes at most this many rows and bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16_000_000
_SEEDS = np.random.Generator(np.random.PCG64(99)).integers(0, 2**64, HASHES, np.uint64)


def signatures(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(sets, HASHES) minima of non-empty consecutive sets; edges are their starts."""
    out = np.empty((len(edges), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(mix(hashes ^ _SEEDS[k]), edges)
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets, HASHES // rows) keys."""
    out = sig[:, ::rows].copy()
    for j in range(1, rows):
        out = mix(out) ^ sig[:, j::rows]
    return mix(out)


def rows_for(item: int, most: int, threshold: float) -> int:
    """Rows a band for an item of at least `item` shingles in a document of at most `most`; 0 if none keeps the promise."""
    j = threshold * item / (most + item * (1 - threshold))
    return next((r for r in (8, 4, 2, 1) if (1 - j**r) ** (HASHES // r) <= MISS), 0)


@dataclass
class Index:
    """One block's items of one shingle length n: sorted distinct shingles of each, in one array."""

    n: int
    ids: list
    hashes: np.ndarray
    edges: np.ndarray  # len(ids) + 1
    threshold: float

    def prepare(self) -> "Index":
        self.size = np.diff(self.edges)
        self.universe, inverse = np.unique(self.hashes, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.posting = np.repeat(np.arange(len(self.ids)), self.size)[order]
        self.posting_edge = np.searchsorted(inverse[order], np.arange(len(self.universe) + 1))
        bits = max(16, int(len(self.universe) * 32).bit_length())
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        self.filter = np.zeros(int(self.mask) + 1, bool)
        self.filter[(self.universe & self.mask).astype(np.int64)] = True
        self.sig = signatures(self.hashes, self.edges[:-1])
        self.level = np.floor(np.log2(self.size)).astype(int)
        self.tables: dict = {}
        return self

    def reduced(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, place in the universe) of the shingles within the universe."""
        near = np.flatnonzero(self.filter[(h & self.mask).astype(np.int64)])
        at = np.searchsorted(self.universe, h[near])
        at[at == len(self.universe)] = 0
        good = self.universe[at] == h[near]
        key = np.unique(doc[near][good].astype(np.int64) * len(self.universe) + at[good])
        return key // len(self.universe), key % len(self.universe)

    def table(self, level: int, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if (level, rows) not in self.tables:
            own = np.flatnonzero(self.level == level)
            b = bands(self.sig[own], rows)
            orders = np.argsort(b, axis=0, kind="stable")
            self.tables[level, rows] = [(b[orders[:, j], j], own[orders[:, j]]) for j in range(b.shape[1])]
        return self.tables[level, rows]

    def matches(self, doc: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, shared shingles) where an item's containment reaches the threshold."""
        doc, at = self.reduced(doc, h)
        if not len(doc):
            return
        texts, start, size = np.unique(doc, return_index=True, return_counts=True)
        sig = signatures(self.universe[at], start)
        level = np.floor(np.log2(size)).astype(int)
        found: set[tuple[int, int]] = set()
        for p in np.unique(level):
            mine = np.flatnonzero(level == p)
            exact = False
            for a in np.unique(self.level):
                if self.threshold * (1 << a) > (2 << p):
                    continue  # smaller than what the threshold asks for
                rows = rows_for(1 << a, 2 << p, self.threshold)
                if not rows:
                    exact = True
                    continue
                keys = bands(sig[mine], rows)
                for j, (sorted_keys, items) in enumerate(self.table(a, rows)):
                    lo, hi = np.searchsorted(sorted_keys, keys[:, j]), np.searchsorted(sorted_keys, keys[:, j], "right")
                    for x in np.flatnonzero(hi > lo):
                        found.update((int(mine[x]), int(i)) for i in items[lo[x] : hi[x]])
            if exact:
                for x in mine:
                    for u in at[start[x] : start[x] + size[x]]:
                        found.update((int(x), int(i)) for i in self.posting[self.posting_edge[u] : self.posting_edge[u + 1]])
        for x, i in sorted(found):
            own = self.hashes[self.edges[i] : self.edges[i + 1]]
            shared = int(np.isin(own, self.universe[at[start[x] : start[x] + size[x]]], assume_unique=True).sum())
            if shared >= self.threshold * len(own) - 1e-9:
                yield int(texts[x]), i, shared


def indexes(items: list[tuple], threshold: float = THRESHOLD) -> list[Index]:
    """An index for each shingle length: SHINGLE words, or all words of a shorter item."""
    raw, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
    w = Words(raw, offsets)
    count = np.diff(w.first)
    out = []
    for n in sorted(set(np.minimum(count, SHINGLE)) - {0}):
        own = np.flatnonzero(np.minimum(count, SHINGLE) == n)
        sets = [np.unique(ngrams(w.hash[w.first[i] : w.first[i + 1]], int(n))) for i in own]
        out.append(Index(int(n), [items[i][0] for i in own], np.concatenate(sets), np.cumsum([0, *map(len, sets)]), threshold))
    return out


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) in bounded blocks, one after another on the driver."""
    block, size = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(r.text) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def found_in(index: list[Index], texts: pa.Array) -> Iterator[tuple[int, Index, int, int]]:
    """(row, index, item number, shared) for all rows of a batch."""
    raw, offsets = text_buffer(texts)
    for i, j in chunks(offsets):
        o = offsets[i : j + 1]
        w = Words(raw[o[0] : o[-1]], o - o[0])
        for x in index:
            h = ngrams(w.hash, x.n)
            whole = w.doc[: len(h)] == w.doc[x.n - 1 :] if len(h) else np.zeros(0, bool)
            for d, item, shared in x.matches(w.doc[: len(h)][whole], h[whole]):
                yield i + d, x, item, shared




def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of each item found in a document.

    An item is found if at least `threshold` of its distinct five-word shingles (of all its words, if fewer) are among
    the document's. Null or empty texts hold and are nothing; null or repeated ids stay as they are, one row for each
    pair of rows; other columns are ignored; empty tables give no rows.
    """
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    out = None
    for block in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = [x.prepare() for x in indexes(block, threshold)]
            for b in batches:
                ids, rows = b.column(0), []
                for d, x, item, shared in found_in(index, b.column(1)):
                    n = int(x.size[item])
                    rows.append((ids[d].as_py(), x.ids[item], shared, n, shared / n))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.float64(),))], schema.replace(" long", "").replace(" double", "").split(", "))

        one = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: docs without the rows whose text holds an item; columns and other rows unchanged."""
    names = docs.columns
    for block in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = [x.prepare() for x in indexes(block, threshold)]
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in found_in(index, b.column(names.index("text")))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
