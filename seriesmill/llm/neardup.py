"""Near-duplicate classes by weighted Jaccard similarity of five-word shingles, with DartMinHash signatures.

A text is the multiset of its shingles (a text of one to four words is one shingle). Darts fall on every shingle's
region of the plane of weight and rank as a Poisson process that depends on the shingle's hash alone; a dart counts
for a text if its weight lies below the shingle's weight there. Each dart belongs to one of HASHES coordinates, and a
text's signature keeps each coordinate's earliest dart. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity. Weights are cut into dyadic strips; within a strip darts are thrown in the order of their
ranks (exponential gaps), so a strip without a dart below the text's rank bound costs one hash and one comparison.

Steps: equal texts become one (an aggregation with map-side combining); signatures become BANDS band keys; of every
key with several texts one text is the centre, and the others are compared with it exactly. A key whose texts are in
one class then is done, so a group of n copies costs n comparisons rather than n*n. The others go on without the
texts that provably resemble nothing: a shingle that no other open text has can't be shared, which bounds every
similarity of its text. A second centre, the text farthest from the first, is compared with the rest, and then every
pair of different classes that shares a key and that no bound rules out: the triangle inequality (one less the
weighted Jaccard similarity is a metric) with both centres, and parity bitmaps of the shingles, whose bits that differ
are at most as many as the shingles that differ. So no link between texts that share a key is lost that could join two
classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, discard, fresh, join_by_key, mix, shingles, text_buffer, written

SHINGLE, THRESHOLD = 5, 0.8
#: Texts of similarity 0.8 share no band with probability (1 - 0.8**4)**15, 4 in 10,000.
BANDS, ROWS = 15, 4
HASHES = BANDS * ROWS
#: Pairs of a centre that are compared in one piece, and texts of a key in a block of the last step.
SLICE, BLOCK = 128, 512
#: Longs in a text's parity bitmap.
BITMAP = 8
#: Expected darts below rank bound 1: a coordinate stays empty with probability exp(-DARTS / HASHES), then the bound grows.
DARTS = HASHES * (np.log(HASHES) + 2)
_U = np.uint64


def _unit(h: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((h >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def darts(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, coordinate, rank, id) of all darts of rank below bound[owner] within the elements' weights."""
    out = []
    low, width, strip = 0.0, 1.0, 0
    live = np.arange(len(element))
    while len(live):
        rate = DARTS * width
        seed = mix(element[live] ^ _U(0xA5A5A5A5 + 0x1000193 * strip))
        at, rank, left, n = live, np.zeros(len(live)), seed, 0
        while len(at):
            gap = mix(left ^ _U(0x51ED270B * (n + 1)))
            # rank + gap < bound, tested on the hash before the logarithm is taken of the few that pass
            close = _unit(gap) > np.exp(-(bound[owner[at]] - rank) * rate)
            at, left, gap, rank = at[close], left[close], gap[close], rank[close]
            rank = rank - np.log(_unit(gap)) / rate
            h = mix(gap ^ _U(0x2545F4914F6CDD1D))
            inside = low + width * _unit(mix(h ^ _U(0x9E3779B9))) <= weight[at]
            out.append((owner[at][inside], (h[inside] % _U(HASHES)).astype(np.int64), rank[inside], h[inside]))
            n += 1
        low, width, strip = low + width, (width if strip == 0 else 2 * width), strip + 1
        live = live[weight[live] > low]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, np.uint64))


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, HASHES) dart ids. owner: the set's number of each (element, weight), every set non-empty."""
    sig = np.zeros((n, HASHES), np.uint64)
    if not n:
        return sig
    total = np.bincount(owner, weight, n)
    todo, theta = np.arange(n), 1.0
    while len(todo):
        bound = np.zeros(n)
        bound[todo] = theta / total[todo]
        mine = np.isin(owner, todo) if len(todo) < n else slice(None)
        own, coordinate, rank, ids = darts(element[mine], weight[mine], owner[mine], bound)
        order = np.lexsort((rank, own * HASHES + coordinate))
        key = (own * HASHES + coordinate)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        full = np.bincount(key[first] // HASHES, minlength=n) == HASHES
        done = full[key[first] // HASHES]
        sig.reshape(-1)[key[first][done]] = ids[order][first][done]
        todo, theta = todo[~full[todo]], theta + 1.0
    return sig


def weighted_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted, of the texts in a buffer."""
    doc, h = shingles(Words(raw, offsets), SHINGLE)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, int)
    return doc[first], h[first], np.diff(np.r_[first, len(h)]).astype(float)


def parity(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(n, BITMAP) longs: every copy of a shingle flips one bit of its text's bitmap."""
    out = np.zeros((n, BITMAP), np.int64)
    for i in range(0, n, 2000):
        lo, hi = np.searchsorted(doc, (i, min(n, i + 2000)))
        k = count[lo:hi].astype(np.int64)
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        at = mix(np.repeat(h[lo:hi], k) ^ (nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))) % _U(64 * BITMAP)
        m = min(n, i + 2000) - i
        odd = np.bincount(np.repeat(doc[lo:hi] - i, k) * 64 * BITMAP + at.astype(np.int64), minlength=m * 64 * BITMAP) & 1
        out[i : i + m] = np.packbits(odd.astype(bool).reshape(m, -1), axis=1, bitorder="little").view(np.int64)
    return out


def band_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text's 128-bit digest (t1, t2), size (total weight), bits array<long> (its parity
    bitmap), keys array<long> of BANDS band keys; no keys for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(3))
            for i, j in chunks(offsets):
                o = offsets[i : j + 1]
                doc, h, count = weighted_sets(raw[o[0] : o[-1]], o - o[0])
                texts, owner = np.unique(doc, return_inverse=True)
                sig = signatures(h, count, owner, len(texts)).reshape(len(texts), BANDS, ROWS)
                k = np.zeros((len(texts), BANDS), np.uint64)
                for r in range(ROWS):
                    k = mix(k ^ sig[:, :, r])
                k = mix(k ^ np.arange(1, BANDS + 1, dtype=np.uint64))
                has = np.isin(np.arange(j - i), texts, assume_unique=True)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has) * BANDS].astype(np.int32)), pa.array(k.view(np.int64).reshape(-1)))
                bits = pa.FixedSizeListArray.from_arrays(pa.array(parity(doc, h, count, j - i).reshape(-1)), BITMAP).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), pa.array(np.bincount(doc, count, j - i).astype(float)), bits, lists], ["doc_id", "t1", "t2", "size", "bits", "keys"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), text).alias("t2"), text.alias("text"))
    return arrow_map(rows, run, "doc_id long, t1 long, t2 long, size double, bits array<long>, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(centre, node, similarity) of distinct pairs (centre, node), a written table, computed exactly from the nodes'
    texts (node, text).

    The pairs of a centre are dealt out in slices of about SLICE. A slice's rows follow its centre's text, so a worker
    holds one centre's shingles and hashes each other text once, and no text is repeated for a pair but the centre's for
    a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_h, head_c, size = np.zeros(0, np.uint64), np.zeros(0), 0.0
        for b in batches:
            raw, offsets = text_buffer(b.column(3))
            other = b.column(2).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                o = offsets[i : j + 1]
                doc, h, c = weighted_sets(raw[o[0] : o[-1]], o - o[0])
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                total, shared = np.bincount(doc, c, j - i).astype(float), np.zeros(j - i)
                heads = np.flatnonzero(~other[i:j])
                starts = np.r_[0, heads] if not len(heads) or heads[0] else heads
                for x, y in zip(starts, np.r_[starts[1:], j - i]):
                    if not other[i + x]:
                        head_h, head_c = h[edge[x] : edge[x + 1]].copy(), c[edge[x] : edge[x + 1]].copy()
                        size = head_c.sum()
                    lo, hi = edge[x], edge[y]
                    if len(head_h) and hi > lo:
                        at = np.minimum(np.searchsorted(head_h, h[lo:hi]), len(head_h) - 1)
                        both = np.where(head_h[at] == h[lo:hi], np.minimum(head_c[at], c[lo:hi]), 0.0)
                        shared[x:y] = np.bincount(doc[lo:hi] - x, both, y - x)
                    total[x:y] += size - shared[x:y]
                rows = pa.array(i + np.flatnonzero(other[i:j]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array((shared / np.maximum(total, 1))[other[i:j]])], ["centre", "node", "similarity"])

    counts = written(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n")), "neardup-centres")
    sliced = join_by_key(pairs, counts, ["centre"]).select("centre", "node", F.expr(f"cast(pmod(xxhash64(node), ceil(n / {SLICE})) as int)").alias("slice"))
    texts = texts.hint("merge")
    members = sliced.join(texts, "node").select("centre", "slice", "node", F.lit(True).alias("other"), "text")
    heads = sliced.select("centre", "slice").distinct().join(texts.withColumnRenamed("node", "centre"), "centre").select("centre", "slice", F.col("centre").alias("node"), F.lit(False).alias("other"), "text")
    dealt = heads.unionByName(members).repartition("centre", "slice").sortWithinPartitions("centre", "slice", "other")
    return arrow_map(dealt.select("centre", "node", "other", "text"), run, f"centre {_NODE}, node {_NODE}, similarity double")


#: A node is a text: the smallest doc_id that has it, and a digest that tells apart texts of a repeated doc_id.
_NODE = "struct<id:bigint,t:bigint>"


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node of links (a, b): the smallest node it is connected with.

    All steps are joins of written tables; labels are followed twice a step, so that the number of steps grows with
    the logarithm of the longest path.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    both = written(both.distinct(), "neardup-edges")
    label = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("class")), "neardup-labels")
    while True:
        around = both.join(label.select(F.col("node").alias("to"), "class"), "to").groupBy("node").agg(F.min("class").alias("near"))
        step = label.join(around, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("mid"))
        jump = step.join(label.select(F.col("node").alias("mid"), F.col("class").alias("far")), "mid", "left")
        new = written(jump.select("node", F.least("mid", F.coalesce("far", "mid")).alias("class"), "old"), "neardup-labels")
        label = new.select("node", "class")
        if new.where(F.col("class") != F.col("old")).isEmpty():
            return label


def unshared(open_nodes: DataFrame, body: DataFrame) -> DataFrame:
    """(node, alone): the weight of those shingles of each open text that no other open text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for i, j in chunks(offsets):
                o = offsets[i : j + 1]
                doc, h, w = weighted_sets(raw[o[0] : o[-1]], o - o[0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + doc)), pa.array(h.view(np.int64)), pa.array(w)], ["node", "h", "w"])

    each = body.join(open_nodes.hint("merge"), "node", "left_semi").select("node", "text")
    each = arrow_map(each, run, f"node {_NODE}, h long, w double")
    single = each.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.max("w").alias("w")).where("node = other")
    return single.groupBy("node").agg(F.sum("w").alias("alone"))


def _relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Classes (node, class) after more links between nodes."""
    if links.isEmpty():
        return label
    if label is None:
        return components(links)
    at = lambda c: label.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class"))
    joined = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).where("a != b").distinct()
    if joined.isEmpty():
        return label
    moved = components(joined).select(F.col("node").alias("class"), F.col("class").alias("new"))
    known = label.unionByName(moved.select(F.col("class").alias("node"), "class")).distinct()
    return written(known.join(moved, "class", "left").select("node", F.coalesce("new", "class").alias("class")).distinct(), "neardup-labels")


def _open(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows (band, key, node, ...) of keys whose texts are in several classes, with the class of each row, and the
    number of rows and the smallest size of each key."""
    rows = rows.withColumn("class", F.col("node")) if label is None else rows.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    rows = written(rows, "neardup-rows")
    keys = rows.groupBy("band", "key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("size").alias("least"), F.count(F.lit(1)).alias("n"))
    keys = written(keys.where("lo != hi").select("band", "key", "least", "n"), "neardup-keys")
    out = written(join_by_key(rows, keys, ["band", "key"]), "neardup-open")
    discard(rows, keys)
    return out


def _met(state: DataFrame, best: DataFrame, body: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of state other than their key's centre (band, key, centre, n) with the similarity to it as column `name`,
    and all (centre, node, similarity) that were computed for that."""
    best = written(best, "neardup-best")
    rows = written(join_by_key(state, best, ["band", "key"]).where("node != centre").drop("n"), "neardup-met")
    pairs = written(rows.select("centre", "node").distinct(), "neardup-pairs")
    known = written(similar(pairs, body), "neardup-similar")
    out = written(rows.join(known.withColumnRenamed("similarity", name), ["centre", "node"]).drop("centre"), "neardup-compared")
    discard(best, rows, pairs)
    return out, known


def text_classes(texts: DataFrame, base: DataFrame, threshold: float) -> DataFrame | None:
    """(node, class) of the texts that are linked with others. texts: node, size, bits, keys; base: node, text of them at
    least. None if there is no link."""
    linked = lambda known: known.where(F.col("similarity") >= threshold - 1e-12).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    keyed = texts.select("node", "size", F.posexplode("keys").alias("band", "key"))
    sizes = written(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "neardup-sizes")
    state = written(join_by_key(keyed, sizes, ["band", "key"]), "neardup-members")
    # The best centre is the text that shares most keys with most texts: of a base and its edited copies, the base.
    degree = written(state.groupBy("node").agg(F.sum("n").alias("degree")), "neardup-degree")
    body = written(base.join(degree.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "neardup-bodies")
    best = state.join(degree, "node").groupBy("band", "key").agg(F.max_by("node", F.struct("degree", (-F.col("node.id")).alias("i"), F.col("node.t"))).alias("centre"), F.max("n").alias("n"))
    rest, known = _met(state.drop("n"), best, body, "s1")
    discard(sizes, state, degree)
    label = _relabelled(None, linked(known))
    state = _open(rest, label)
    if state.isEmpty():
        return label
    # Texts whose shareable weight is too small for any partner of their key leave.
    share = state.join(unshared(state.select("node").distinct(), body), "node", "left").withColumn("share", F.col("size") - F.coalesce("alone", F.lit(0.0)))
    limit = threshold - 1e-9
    able = share.where(F.col("share") >= limit * (F.greatest("least", "share") + F.col("size") - F.col("share"))).drop("alone", "least", "class", "n")
    state = _open(able, label)
    if state.isEmpty():
        return label
    best = state.groupBy("band", "key").agg(F.min_by("node", F.struct("s1", "node")).alias("centre"), F.max("n").alias("n"))
    rest, known = _met(state.drop("class", "least", "n"), best, body, "s2")
    label = _relabelled(label, linked(known))
    state = _open(rest, label)
    if state.isEmpty():
        return label
    # A key's texts are cut into blocks; every pair of blocks is a group of its own, of at most about 2 * BLOCK texts.
    state = state.join(texts.select("node", "bits", "keys"), "node").withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)"))
    state = state.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    side = lambda x, at: state.select("band", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "class", "size", "bits", "keys", "s1", "s2")]).withColumnsRenamed(at)
    near = lambda c: F.abs(F.col(f"{c}_x") - F.col(f"{c}_y")) <= 1 - limit
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col("bits_x")[k].bitwiseXOR(F.col("bits_y")[k])) for k in range(BITMAP)])
    common = (F.col("size_x") + F.col("size_y") - differ) / 2
    # A pair meets in the first of the keys that it shares only; where it is missing there, it has been compared with a
    # centre or ruled out.
    before = reduce(lambda a, b: a | b, [(F.col("band") > k) & (F.col("keys_x")[k] == F.col("keys_y")[k]) for k in range(BANDS - 1)])
    possible = (F.col("node_x") < F.col("node_y")) & (F.col("class_x") != F.col("class_y")) & near("s1") & near("s2") & (common >= limit * (F.col("size_x") + F.col("size_y") - common)) & ~before
    x = side("x", {"block": "block_x", "to": "block_y"})
    y = side("y", {"block": "block_y", "to": "block_x"})
    pairs = x.join(y, ["band", "key", "block_x", "block_y"]).where(possible).select(F.col("node_x").alias("centre"), F.col("node_y").alias("node")).distinct()
    known = written(similar(written(pairs, "neardup-pairs"), body), "neardup-similar")
    return _relabelled(label, linked(known))


def _classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, t1, t2, copies and class (id and t1 of the class's first text) of the rows that are compared; doc_id of the others."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(band_keys(base), "neardup-signed")
    compared = signed.where((F.size("keys") > 0) & F.col("doc_id").isNotNull())
    # One row for each text: equal texts have equal keys, and the aggregation combines before its shuffle.
    texts = compared.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    texts = written(texts.withColumn("node", F.struct(F.col("rep").alias("id"), F.col("t1").alias("t"))), "neardup-texts")
    nodes = base.where(F.col("doc_id").isNotNull()).select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("node"), "text")
    label = text_classes(texts.select("node", "size", "bits", "keys"), nodes, threshold)
    found = texts.select("t1", "t2", "node", "copies")
    if label is not None:
        found = found.join(label, "node", "left").select("t1", "t2", "copies", F.coalesce("class", "node").alias("class"))
    else:
        found = found.select("t1", "t2", "copies", F.col("node").alias("class"))
    found = written(found, "neardup-found")
    rows = join_by_key(compared.select("doc_id", "t1", "t2"), found, ["t1", "t2"], "copies")
    return rows, signed.where((F.size("keys") <= 0) | F.col("doc_id").isNull()).select("doc_id")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copies of every row: its class, and the number of rows with the same text.

    class_id is the smallest doc_id with which a document is linked, directly or not. Texts without words (null,
    empty, white space) are not compared: each such row is its own class, with copies 1. A row that repeats a doc_id
    is judged by its own text. A row without a doc_id takes no part and has a null class. Other columns are ignored;
    an empty table gives no rows.
    """
    rows, others = _classed(docs, threshold)
    alone = others.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return rows.select("doc_id", F.col("class").getField("id").alias("class_id"), "copies").unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: one row of each class, the one with the smallest doc_id; columns unchanged.

    A row is judged by its doc_id and text, so rows that only share a doc_id don't touch each other. Rows that have no
    words or no doc_id stay.
    """
    rows, _ = _classed(docs, threshold)
    *keys, stay = (fresh(docs, f"_neardup_{c}") for c in ("id", "t1", "t2", "stays"))
    stays = (F.col("doc_id") == F.col("class").getField("id")) & (F.col("t1") == F.col("class").getField("t"))
    found = rows.groupBy("doc_id", "t1", "t2").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1")
    found = written(found.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "t1", "t2"), keys)], F.col("stays").alias(stay)), "neardup-found")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns(dict(zip(keys, (F.col("doc_id").cast("long"), F.xxhash64(text), F.xxhash64(F.lit(17), text)))))
    kept = keyed.join(found.hint("merge"), keys, "left_anti")
    again = found.where(F.col(stay)).select(*keys)
    if not again.isEmpty():
        kept = kept.unionByName(keyed.join(again, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*docs.columns)
