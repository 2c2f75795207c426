"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Tokens are runs of letters and digits, of other signs, or of line ends; their hash picks one of ``2**bits`` vectors, so the
table of vectors has one size whatever the corpus. One pass over all documents adds to a token's vector the sparse
random index vectors of the tokens up to ``reach`` away and its own. A document is the mean and the spread of its
tokens' vectors. A two-layer network learns the labels of a sample of ``most`` rows (those with the smallest hash of
their id; the only bound on what is learnt from), and a temperature fitted on a fifth of the sample calibrates it.

Defined cases: null and empty texts have all-zero features and get the network's score for those; repeated rows are
scored each; several labels of one id count by their mean, and of several texts of one id that with the least features is learnt from;
without usable labels every score is 0.5; an empty table gives no rows; texts of any length are pooled whole; input columns other
than doc_id and text are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prosegrain.llm import common

_CLASS = np.full(256, 2, np.uint8)  # 0 separates, 1 letters and digits, 2 other signs, 3 line ends
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[0, 9, 11, 12, 32]] = 0
_CLASS[[10, 13]] = 3


@dataclass(frozen=True)
class Setting:
    bits: int = 13
    dims: int = 32
    reach: int = 2
    nonzero: int = 2
    hidden: int = 16
    most: int = 20_000
    epochs: int = 60
    threshold: float = 0.3


def index_vectors(s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """For each table row the places of its random index vector's nonzeros, and their signs."""
    rng = np.random.default_rng(7)
    n = 1 << s.bits
    return rng.integers(0, s.dims, (s.nonzero, n)), rng.choice([-1.0, 1.0], (s.nonzero, n))


def _tokens(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the tokens of some documents, and the offsets of each document's tokens."""
    starts, ends = common.runs(_CLASS[data], off)
    return (common.run_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(starts, off)


def _contexts(batches: Iterator[pa.RecordBatch], s: Setting) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors(s)
    total = np.zeros(s.dims << s.bits)
    for batch in batches:
        data, off = common.utf8(batch.column(0))
        for i, j in common.chunks(off):
            row, at = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], s.bits)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for o in range(s.reach + 1):
                a, b = row[: len(row) - o], row[o:]
                same = doc[: len(row) - o] == doc[o:]
                a, b = a[same], b[same]
                for k in range(s.nonzero):
                    total += np.bincount(a * s.dims + place[k, b], sign[k, b], len(total))
                    if o:
                        total += np.bincount(b * s.dims + place[k, a], sign[k, a], len(total))
    sums = total.astype(np.int64).reshape(-1, s.dims)
    used = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, d]) for d in range(s.dims))], names=["row", *(f"c{d}" for d in range(s.dims))])


def word_vectors(docs: DataFrame, s: Setting) -> np.ndarray:
    """The table of word vectors over all documents: unit rows about the table's mean."""
    names = [f"c{d}" for d in range(s.dims)]
    parts = docs.select("text").mapInArrow(lambda b: _contexts(b, s), "row long, " + ", ".join(f"{c} long" for c in names))
    summed = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # at most 2**bits rows
    out = np.zeros((1 << s.bits, s.dims))
    out[summed["row"].to_numpy(np.int64)] = summed[names].to_numpy(float)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)
    out -= out[summed["row"].to_numpy(np.int64)].mean(0) if len(summed) else 0
    return out.astype(np.float32)


def pooled(data: np.ndarray, off: np.ndarray, vectors: np.ndarray, bits: int) -> np.ndarray:
    """Mean and spread of the word vectors of each document; zeros without tokens."""
    out = np.zeros((len(off) - 1, 2 * vectors.shape[1]))
    for i, j in common.chunks(off):
        row, at = _tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
        n = np.diff(at)
        full = np.flatnonzero(n)
        if len(full):
            v = vectors[row]
            mean = np.add.reduceat(v, at[full], axis=0, dtype=float) / n[full, None]
            square = np.add.reduceat(v * v, at[full], axis=0, dtype=float) / n[full, None]
            out[i + full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    bits: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Weights of a tanh layer and a logistic output, by Adam on the log loss with a little weight decay."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 128):
            xb, yb = x[order[s : s + 128]], y[order[s : s + 128]]
            h = np.tanh(xb @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500))) - yb) / len(xb)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads = [xb.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, z := logits / t) - y * z) for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(y) else 1.0


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, s: Setting = Setting()) -> Model:
    """A model of ``labels.quality`` from the texts of ``docs``; only labels that ``may_learn`` (of doc_id) holds for are used."""
    vectors = word_vectors(docs, s)
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.where(may_learn) if may_learn is not None else known
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def features(batches):
        for b in batches:
            x = pooled(*common.utf8(b.column(1)), vectors, s.bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = chosen.mapInArrow(features, "doc_id long, y double, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    d = 2 * s.dims
    if got.empty:
        return Model(vectors, np.zeros(d), np.ones(d), (np.zeros((d, 1)), np.zeros(1), np.zeros(1), np.zeros(1)), 1.0, s.bits)
    x, y = np.stack(got["x"]), got["y"].to_numpy()
    shift, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    held = np.random.default_rng(1).random(len(x)) < 0.2
    if held.all() or not held.any():
        held = np.zeros(len(x), bool)
    layers = train((x[~held] - shift) / scale, y[~held], s.hidden, s.epochs)
    raw = Model(vectors, shift, scale, layers, 1.0, s.bits)
    return Model(vectors, shift, scale, layers, _temperature(raw.logits(x[held]), y[held]), s.bits)


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with one more column, the score of each row's text."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(pooled(*common.utf8(b.column(at)), model.vectors, model.bits)), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def learnable():
    """Rows that the contract lets labels be learnt from."""
    return common.crc_mod("doc_id", 5) != 0


def op1_quality_network(spark, sf_dir: str) -> DataFrame:
    docs, s = common.table(spark, sf_dir, "documents", "doc_id", "text"), Setting()
    model = fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality"), learnable(), s)
    return scored(docs, model, "score").select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
