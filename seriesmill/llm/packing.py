"""Harmonic packing of documents into fixed-length training sequences.

A document's ids (and a closing id) are cut into full sequences and a remainder. The remainder is cut into at most a
few pieces whose lengths lie just below a reciprocal of the capacity; a piece of length in (C/(j+1), C/j] belongs to
class j, and a class-j sequence takes exactly j pieces. Each worker fills its own classes' sequences and never talks to
another one, so there is no shuffle; what its open sequences hold at the end is cut freely into full sequences, so that
a worker leaves at most one sequence with real padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map

#: Cost, in tokens of padding, of one more cut; no piece shorter than SHORTEST is cut off.
CUT_COST, SHORTEST = 6.0, 16


@lru_cache(maxsize=8)
def cut_table(capacity: int) -> tuple[tuple[int, ...], ...]:
    """For each remainder 0..capacity-1 the piece lengths with the least padding plus cost of cuts."""
    cost, first = [0.0] * capacity, [0] * capacity
    sizes = sorted({capacity // j for j in range(2, capacity + 1)} - {0})
    for r in range(1, capacity):
        best, take = capacity / (capacity // r) - r, r
        for s in sizes:
            if s > r - SHORTEST:
                break
            if s >= SHORTEST and (c := CUT_COST + capacity / (capacity // s) - s + cost[r - s]) < best - 1e-9:
                best, take = c, s
        cost[r], first[r] = best, take
    out: list[tuple[int, ...]] = [()]
    for r in range(1, capacity):
        out.append((first[r], *out[r - first[r]]))
    return tuple(out)


class Packer:
    """One worker's open sequences by class. add() and finish() return pieces as rows of `fields`."""

    fields = ("doc", "start", "ids", "doc_tokens", "sequence", "offset")

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.cuts = cut_table(capacity)
        self.open: dict[int, list] = defaultdict(list)

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, pieces: list) -> list[tuple]:
        out, at, k = [], 0, self._sequence()
        for doc, start, ids, total in pieces:
            out.append((doc, start, ids, total, k, at))
            at += len(ids)
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        c, total, out = self.capacity, len(ids), []
        full = total // c
        for i in range(full):
            out.append((doc, i * c, ids[i * c : (i + 1) * c], total, self._sequence(), 0))
        at = full * c
        for n in self.cuts[total - at]:
            j = c // n
            self.open[j].append((doc, at, ids[at : at + n], total))
            at += n
            if len(self.open[j]) == j:
                out += self._close(self.open.pop(j))
        return out

    def finish(self) -> list[tuple]:
        """The open classes' pieces one after another, cut where a sequence is full."""
        out, now, used = [], [], 0
        for j in sorted(self.open):
            for doc, start, ids, total in self.open[j]:
                while len(ids):
                    n = min(len(ids), self.capacity - used)
                    now.append((doc, start, ids[:n], total))
                    start, ids, used = start + n, ids[n:], used + n
                    if used == self.capacity:
                        out += self._close(now)
                        now, used = [], 0
        self.open.clear()
        return out + (self._close(now) if now else [])


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array<int>) if with_ids.
    A null or empty text is the closing id alone. A null or repeated id is kept as it is, one set of pieces a row.
    Other columns are left out, whatever their names. An empty table gives no rows.
    tokenizer: path of a byte-level BPE JSON file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, at = zip(*rows)
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                flat = np.concatenate(ids).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        end, rows = np.array([end_id], np.uint32), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += packer.add(doc, np.concatenate([enc.ids(text.as_py()), end]))
                if len(rows) >= 5000:
                    yield out(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield out(rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
