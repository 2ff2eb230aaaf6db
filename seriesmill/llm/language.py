"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of one segment (a word, or SEGMENT bytes of a longer run) in both directions from a zero
state, and labels every position; a document's probabilities are the mean over all its positions. As a segment's
labels depend on its bytes alone, a worker runs the network once for each distinct segment of a batch of documents
and weights the result by its count. Training is backpropagation through time in numpy on the driver, on a bounded,
hash-chosen sample of labelled documents, with segments drawn evenly over each whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, fresh, text_buffer

SEGMENT = 24
#: Bytes of text of which equal segments are read once.
SCORED = 4_000_000
UNKNOWN = "und"


class ByteGru:
    """Weights of both directions and the output layer; `langs` are the labels in order."""

    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        u = lambda *s, k: rng.uniform(-k, k, s).astype(np.float32)
        k = 1 / np.sqrt(hidden)
        self.p = {"V": u(2 * hidden, len(langs), k=k), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p["E" + d], self.p["U" + d] = u(256, 3 * hidden, k=k), u(hidden, 3 * hidden, k=k)

    # Gate order in E and U: update z, reset r, candidate n.
    def _states(self, x: np.ndarray, d: str, keep: bool = False):
        n, T = x.shape
        H, E, U = self.hidden, self.p["E" + d], self.p["U" + d]
        h, out, saved = np.zeros((n, H), np.float32), np.empty((T, n, H), np.float32), {}
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a, b = E[x[:, t]], h @ U
            g = a[:, : 2 * H]
            g += b[:, : 2 * H]
            g *= 0.5
            np.tanh(g, out=g)  # sigmoid(v) = (1 + tanh(v / 2)) / 2
            g += 1
            g *= 0.5
            z, r, un = g[:, :H], g[:, H:], b[:, 2 * H :]
            c = a[:, 2 * H :]
            c += r * un
            np.tanh(c, out=c)
            if keep:
                saved[t] = (h, z, r, c, un)
            h = c + z * (h - c)
            out[t] = h
        return out, saved

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(segments, length, languages) for equally long segments."""
        both = np.concatenate([self._states(x, "f")[0], self._states(x, "b")[0]], 2)
        s = both @ self.p["V"] + self.p["c"]
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        return (s / s.sum(2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions of equally long segments, and its gradient."""
        n, T = x.shape
        H = self.hidden
        kept = {d: self._states(x, d, True) for d in "fb"}
        both = np.concatenate([kept["f"][0], kept["b"][0]], 2)
        s = both @ self.p["V"] + self.p["c"]
        s -= s.max(2, keepdims=True)
        q = np.exp(s)
        q /= q.sum(2, keepdims=True)
        loss = float(-np.log(q[:, np.arange(n), y] + 1e-9).mean())
        q[:, np.arange(n), y] -= 1
        q /= n * T
        g = {"V": np.tensordot(both, q, ((0, 1), (0, 1))), "c": q.sum((0, 1))}
        dboth = q @ self.p["V"].T
        for d in "fb":
            E, U = self.p["E" + d], self.p["U" + d]
            dE, dU, dh = np.zeros_like(E), np.zeros_like(U), np.zeros((n, H), np.float32)
            part = dboth[:, :, :H] if d == "f" else dboth[:, :, H:]
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                h0, z, r, c, un = kept[d][1][t]
                dh = dh + part[t]
                da = np.empty((n, 3 * H), np.float32)
                da[:, 2 * H :] = dh * (1 - z) * (1 - c * c)
                da[:, :H] = dh * (h0 - c) * z * (1 - z)
                da[:, H : 2 * H] = da[:, 2 * H :] * un * r * (1 - r)
                db = da.copy()
                db[:, 2 * H :] *= r
                np.add.at(dE, x[:, t], da)
                dU += h0.T @ db
                dh = dh * z + db @ U.T
            g["E" + d], g["U" + d] = dE, dU
        return loss, g

    def fit(self, segments: list[bytes], labels: np.ndarray, steps: int = 600, batch: int = 256, rate: float = 0.02, seed: int = 11) -> "ByteGru":
        """Adam over batches of equally long segments; labels are drawn evenly within a length."""
        rng = np.random.default_rng(seed)
        groups = by_length(segments)
        weight = np.array([len(i) * n for n, (i, _) in groups.items()], float)
        lengths, m, v = list(groups), {}, {}
        for step in range(1, steps + 1):
            at, x = groups[lengths[rng.choice(len(lengths), p=weight / weight.sum())]]
            y = labels[at]
            share = 1 / np.bincount(y, minlength=len(self.langs)).clip(1)[y]
            take = rng.choice(len(at), min(batch, len(at)), p=share / share.sum())
            _, g = self.gradients(x[take], y[take])
            lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, d in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed position probabilities (texts, languages), and the number of positions of each text."""
        raw, offsets = text_buffer(texts)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for i, j in chunks(offsets, SCORED):
            o = offsets[i : j + 1]
            doc, start, size, key = segments_of(raw[o[0] : o[-1]], o - o[0])
            if not len(doc):
                continue
            _, one, back = np.unique(key, return_index=True, return_inverse=True)
            part = np.zeros((len(one), len(self.langs)), np.float32)
            for n in np.unique(size[one]):
                at = np.flatnonzero(size[one] == n)
                for k in range(0, len(at), 4096):
                    a = at[k : k + 4096]
                    x = raw[o[0] : o[-1]][start[one[a]][:, None] + np.arange(n)]
                    part[a] = self.probabilities(x).sum(1)
            for k in range(len(self.langs)):
                total[i:j, k] = np.bincount(doc, part[back, k], j - i)
            count[i:j] = np.bincount(doc, size, j - i)
        return total, count


def by_length(segments: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(s) for s in segments])
    return {int(n): ((at := np.flatnonzero(sizes == n)), np.frombuffer(b"".join(segments[i] for i in at), np.uint8).reshape(-1, n)) for n in np.unique(sizes) if n}


def segments_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and a key of the bytes, for every segment."""
    w = Words(raw, offsets, 0)
    size = w.end - w.start
    parts = -(-size // SEGMENT)
    of = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = w.start[of] + nth * SEGMENT
    end = np.minimum(start + SEGMENT, w.end[of])
    cut = Words.__new__(Words)
    cut.start, cut.end = start, end
    return w.doc[of], start, end - start, cut._hash(raw, 0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_segments(labelled: DataFrame, docs_a_lang: int, segments_a_doc: int, seed: int) -> tuple[list[str], list[bytes], np.ndarray]:
    """Segments and labels of a sample of labelled (doc_id, text, lang) rows, and the labels' names.

    About docs_a_lang documents of each language are chosen by a hash of the id, and from each of them at most
    segments_a_doc segments, spread evenly over the whole text: the driver gets a bounded number of short strings.
    """
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], [], np.zeros(0, int)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_a_lang / n)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(0))
            langs, out = b.column(1).to_pylist(), ([], [])
            for i, j in chunks(offsets):
                o = offsets[i : j + 1]
                doc, start, size, _ = segments_of(raw[o[0] : o[-1]], o - o[0])
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    n = edge[d + 1] - edge[d]
                    for s in edge[d] + np.unique(np.linspace(0, n - 1, min(n, segments_a_doc)).astype(int)) if n else ():
                        out[0].append(langs[i + d])
                        out[1].append(raw[o[0] + start[s] : o[0] + start[s] + size[s]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["lang", "seg"])

    # A fraction of the sum hash decides, so the sample is the same on every run and for every partitioning.
    chosen = labelled.where((F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) / 1_000_003) < share[F.col("lang")])
    rows = arrow_map(chosen.select("text", "lang"), run, "lang string, seg binary").distinct().toArrow().sort_by([("lang", "ascending"), ("seg", "ascending")])
    langs = sorted(sizes)
    at = {k: i for i, k in enumerate(langs)}
    return langs, [bytes(x) for x in rows["seg"].to_pylist()], np.array([at[k] for k in rows["lang"].to_pylist()], int)


def train(labelled: DataFrame, docs_a_lang: int = 300, segments_a_doc: int = 60, most_labels: int = 12_000, steps: int = 600, hidden: int = 16, seed: int = 5) -> ByteGru | None:
    """A network fitted to rows (doc_id, text, lang) with neither text nor lang null; None without such rows.

    The sample is bounded by docs_a_lang documents a language (fewer when there are over 40 languages, so that about
    most_labels documents are read at most) and segments_a_doc segments a document.
    """
    n = max(1, labelled.select("lang").distinct().count())
    langs, segs, labels = training_segments(labelled, min(docs_a_lang, max(1, most_labels // n)), segments_a_doc, seed)
    if not len(segs):
        return None
    return ByteGru(langs, hidden).fit(segs, labels, steps)


def predict(docs: DataFrame, model: ByteGru | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds pred_col and score_col to (all columns of) docs.

    score is the mean probability of the predicted language over all byte positions of the whole text. A text that is
    null or has no letter is 'und' with score 0, as is every text without a model. Ties go to the first language by
    name. Columns of the input keep their names; columns named like the new ones are replaced.
    """
    docs = docs.drop(pred_col, score_col)
    names = docs.columns
    raw_model = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteGru | None = pickle.loads(raw_model)
        for b in batches:
            text = b.column(names.index(text_col))
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if net is None:
                best, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            else:
                total, count = net.score(text)
                k = total.argmax(1)
                best = np.where(letter, np.array(net.langs, object)[k], UNKNOWN)
                score = np.where(letter, np.clip(total[np.arange(len(k)), k] / np.maximum(count, 1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(best), pa.string()), pa.array(score, pa.float64())], [*names, pred_col, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{fields}, `{pred_col}` string, `{score_col}` double")


def labelled_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: not held out, with text and lang."""
    return docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the labelled rows that are not held out."""
    model = train(labelled_rows(docs), **options)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """Pipeline stage: the rows whose language is recognised with a score of `least` or more, columns unchanged.

    Rejected are 'und' rows and rows of which the network is unsure at most positions. Without any labelled row
    there is no model, and only rows without a letter go.
    """
    model = train(labelled_rows(docs), **options)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = predict(docs, model, pred_col=pred, score_col=score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
