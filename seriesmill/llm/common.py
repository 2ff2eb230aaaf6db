"""Helpers shared by the training-data operators: written intermediate tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text taken at once in a worker; a longer document is taken alone.
CHUNK_BYTES = 500_000
#: Bytes or words hashed at once; a longer word is taken alone.
HASH_BLOCK = 1 << 17
#: Bytes that Spark hands to a worker at once, where the session has Spark's own default.
BATCH_BYTES, UNSET_BYTES = "4m", "67108864b"
#: A key is hot if it has more than this share of all rows, so fewer than HOT_KEYS keys are.
HOT_KEYS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of its own only where none is set and Spark runs on this machine, as
    in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='seriesmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, once nothing unwritten reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by bytes, as rows may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == UNSET_BYTES:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def join_by_key(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with keys, a written table of one short row a key with the number of its rows in column n.

    The rows of hot keys stay where they are and meet their key by a broadcast of fewer than HOT_KEYS rows; the others
    meet in an exchange, where no key has more than a HOT_KEYS-th of all rows.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    hot = keys.where(F.col(n) > total / HOT_KEYS)
    if hot.isEmpty():
        return rows.join(keys.hint("merge"), on)
    few = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(few, on, "left_anti").join(keys.where(F.col(n) <= total / HOT_KEYS).hint("merge"), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}" if k else name).lower() not in taken)


# --------------------------------------------------------------------------- text buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without a copy, and n+1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; every row is in exactly one."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --------------------------------------------------------------------------- hashing

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = [_rng.integers(0, 2**64, 256, np.uint64) | _U(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves about half of the output bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    size = 1 << max(16, int(n).bit_length())
    key = (base, size)
    if key not in _powers:
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, _U(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size <= 2 * HASH_BLOCK:
            _powers[key] = tuple(out)
        return tuple(out)
    return _powers[key]


class Words:
    """Words (runs of bytes that are not ASCII white space) of consecutive texts in one buffer.

    start, end: byte positions; doc: the text's number; first: of each text, its first word (n+1 long);
    hash: 64-bit value of each word's bytes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, hashes: int = 1):
        n = len(raw)
        inside = ~_SPACE[raw]
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            cut = offsets[:-1][(offsets[:-1] < offsets[1:])]
            begins[cut] |= inside[cut]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:] | False
            last = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
            ends[last] |= inside[last]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hashes = [self._hash(raw, k) for k in range(hashes)]
        self.hash = self.hashes[0] if hashes else None

    def _hash(self, raw: np.ndarray, k: int) -> np.ndarray:
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + HASH_BLOCK, "right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            begin, end = self.start[i:j] - lo, self.end[i:j] - lo
            up, down = powers(_BASE[k], hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[k][raw[lo:hi]] * up[: hi - lo], out=total[1:])
            out[i:j] = mix((total[end] - total[begin]) * down[begin])
            i = j
        return out


def ngrams(words: np.ndarray, n: int, k: int = 0) -> np.ndarray:
    """Hash of the n words from each position that has n words after it, without regard to texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            out *= _U(_BASE[1 - k])
            out += words[j : len(words) - n + 1 + j]
        return mix(out)
    out = np.empty(len(words) - n + 1, np.uint64)
    for i in range(0, len(out), HASH_BLOCK):
        part = words[i : i + HASH_BLOCK + n - 1]
        up, down = powers(_BASE[1 - k], len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[i : i + HASH_BLOCK] = mix((total[n:] - total[:-n]) * down[: len(part) - n + 1])
    return out


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every n-word shingle; a text of 1 to n-1 words has one shingle of all its words."""
    h = ngrams(words.hash, n)
    count = np.diff(words.first)
    whole = words.doc[: len(h)] == words.doc[n - 1 :] if len(h) else np.zeros(0, bool)
    docs, out = words.doc[: len(h)][whole], h[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for x, d in enumerate(short):
            extra[x] = ngrams(words.hash[words.first[d] : words.first[d + 1]], int(count[d]))[0] ^ _U(count[d])
        docs, out = np.concatenate([docs, short]), np.concatenate([out, extra])
        order = np.argsort(docs, kind="stable")
        docs, out = docs[order], out[order]
    return docs, out
