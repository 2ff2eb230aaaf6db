"""Nearest neighbours with multi-index hashing over learned rotated binary codes.

Learning (on a bounded sample, on the driver): centre, principal directions, and an orthogonal rotation found by
iterative quantisation. A vector's code is the signs of its rotated components, TABLES substrings of SUB bits each.
Each worker indexes all of its rows by every substring, INDEXED components at a time. A query probes each table within
that table's own radius; the radii add up to radius - TABLES + 1, so by the pigeonhole principle every code within the
Hamming radius is met (were all substrings farther away than their radii, the code would be farther than the radius).
What is met is checked on whole codes, and its original vectors are ranked by Euclidean distance in double precision.
The radius is the distance that TARGET of the true neighbours within the sample have at most. Queries for which fewer
than k rows lie within it are searched again without a bound, so that every query gets k neighbours if there are so many.

Queries go to the workers in blocks of bounded size, one pass over the vectors a block; each worker answers with its k
best a query, and a grouped top-k joins the answers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written

SUB = 16
#: Rows to learn from, queries in a block, and the share of true sample neighbours that the radius must cover.
SAMPLE, BLOCK, TARGET = 4000, 4096, 0.95
#: Components of the vectors that a worker indexes at once.
INDEXED = 4_000_000


@dataclass
class Codes:
    """Mean and projection (dimensions x bits) of the binary codes, and the Hamming radius to search."""

    mean: np.ndarray
    project: np.ndarray
    radius: int = 0

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) substrings of SUB bits."""
        bits = ((x - self.mean) @ self.project) > 0
        packed = np.packbits(bits, axis=1, bitorder="little")
        return packed.view(np.uint16)


def learn(x: np.ndarray, k: int, rounds: int = 30, seed: int = 1) -> Codes:
    """Codes of as many bits as there are dimensions, rounded up to whole substrings."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    bits = -(-d // SUB) * SUB
    mean = x.mean(0)
    c = x - mean
    _, vectors = np.linalg.eigh(c.T @ c)
    basis = vectors[:, ::-1]
    if bits > d:  # directions beyond the dimensions are random mixtures of them
        extra = rng.standard_normal((d, bits - d))
        basis = np.concatenate([basis, extra / np.linalg.norm(extra, axis=0)], 1)
    v = c @ basis
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):  # iterative quantisation: signs for a rotation, the rotation for signs
        b = np.where(v @ r > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    codes = Codes(mean, basis @ r)
    q = rng.choice(n, min(n, 200), replace=False)
    own, near = codes.of(x), []
    for i in q:
        dist = ((x - x[i]) ** 2).sum(1)
        dist[i] = np.inf
        best = np.argsort(dist, kind="stable")[: min(k, n - 1)]
        near.append(hamming(own[i], own[best]))
    codes.radius = int(np.quantile(np.concatenate(near), TARGET)) if near and len(near[0]) else bits
    return codes


def hamming(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1)


def probes(radius: int) -> np.ndarray:
    """All SUB-bit masks with at most `radius` bits; none below 0."""
    if radius >= SUB:
        return np.arange(1 << SUB, dtype=np.uint16)
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(SUB), r)], np.uint16)


def radii(radius: int, tables: int) -> list[int]:
    """Of each table; they add up to radius - tables + 1."""
    each, more = divmod(radius - tables + 1, tables)
    return [each + (t < more) for t in range(tables)]


class MultiIndex:
    """Rows of one worker, found by any of their code's substrings."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes.of(x)
        self.tables = []
        for t in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, t], kind="stable")
            edge = np.searchsorted(self.codes[order, t], np.arange((1 << SUB) + 1))
            self.tables.append((order, edge))

    def met(self, code: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
        """Rows that share a probed substring with the code."""
        met = np.zeros(len(self.ids), bool)
        for t, (order, edge) in enumerate(self.tables):
            values = (code[t] ^ masks[t]).astype(np.int64)
            lo, n = edge[values], edge[values + 1] - edge[values]
            full = n > 0
            lo, n = lo[full], n[full]
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]] if len(n) else lo, n) + np.arange(n.sum())
            met[order[at]] = True
        return np.flatnonzero(met)

    def within(self, code: np.ndarray, radius: int, masks: list[np.ndarray]) -> np.ndarray:
        """Rows whose code lies within the Hamming radius."""
        rows = self.met(code, masks)
        return rows[hamming(code, self.codes[rows]) <= radius]

    def search(self, q: np.ndarray, own: int, k: int, code: np.ndarray, radius: int, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row ids, distances) of the k nearest rows within the radius that are not the query's own id."""
        rows = self.within(code, radius, masks) if radius < 8 * code.nbytes else np.arange(len(self.ids))
        rows = rows[self.ids[rows] != own]
        diff = self.x[rows] - q
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        best = np.lexsort((self.ids[rows], d))[:k] if len(d) <= 4 * k else self._top(d, self.ids[rows], k)
        return self.ids[rows][best], d[best]

    @staticmethod
    def _top(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        edge = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= edge)  # all ties of the k-th stay in
        return near[np.lexsort((ids[near], d[near]))[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): rows with an id whose vector is not null, empty or zero and has only finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row the k nearest other rows found, nearest first.

    vectors, queries: vec_id, embedding. score is the Euclidean distance of the original vectors in double precision;
    ties go to the smaller vec_id. Rows without an id, and vectors that are null, empty, zero or hold a null or
    non-finite component, take no part. Vectors meet those of the same number of dimensions only. Rows that repeat an
    id are all candidates, but none of a query with that id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    base, asked = usable(vectors), usable(queries)
    out = []
    dims = [r.d for r in base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").collect()]
    for d in dims:
        rows, wanted = base.where(F.size("v") == d), asked.where(F.size("v") == d)
        chosen = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
        codes = learn(np.unique(matrix(chosen, d), axis=0), k)
        parts = max(1, -(-wanted.count() // block))
        for p in range(parts):
            got = (wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(parts)) == p)).toArrow()
            if not got.num_rows:
                continue
            ids, q = np.asarray(got["vec_id"]), matrix(got["v"].combine_chunks(), d)
            found = written(_best(_answers(rows, codes, ids, q, k, codes.radius), k), "ann-found")
            out.append(found)
            # The driver holds the ids of one block's queries that have too few neighbours within the radius.
            enough = {r.query_id for r in found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id").collect()}
            few = np.flatnonzero([i not in enough for i in ids.tolist()])
            if len(few):
                asked_again = spark.createDataFrame([(i,) for i in sorted(set(ids[few].tolist()))], "query_id long")
                out[-1] = found.join(F.broadcast(asked_again), "query_id", "left_anti")
                out.append(written(_best(_answers(rows, codes, ids[few], q[few], k, 8 * codes.of(q[:1]).nbytes), k), "ann-again"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(rows: DataFrame, codes: Codes, ids: np.ndarray, queries: np.ndarray, k: int, radius: int) -> DataFrame:
    """query_id, vec_id, score: each worker's k best rows within the radius for every query of a block."""
    packed, d = pickle.dumps((codes, ids, queries)), queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, qid, q = pickle.loads(packed)
        qcode = codes.of(q)
        masks = [probes(r) for r in radii(radius, qcode.shape[1])]
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        ids, xs, size = [], [], 0

        def answer() -> None:
            index = MultiIndex(codes, np.concatenate(ids), np.concatenate(xs))
            for i in range(len(q)):
                near = [np.concatenate(c) for c in zip(best[i], index.search(q[i], qid[i], k, qcode[i], radius, masks))]
                first = np.lexsort(near)[:k]
                best[i] = near[0][first], near[1][first]

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(np.asarray(b.column(0)))
            xs.append(matrix(b.column(1), d))
            size += b.num_rows * d
            if size >= INDEXED:
                answer()
                ids, xs, size = [], [], 0
        if size:
            answer()
        for i in range(0, len(q), 1000):
            some = best[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[i : i + 1000], [len(x[0]) for x in some])), pa.array(np.concatenate([x[0] for x in some])), pa.array(np.concatenate([x[1] for x in some]))], ["query_id", "vec_id", "score"])

    return arrow_map(rows, run, "query_id long, vec_id long, score double")
