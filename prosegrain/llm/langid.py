"""Language identification by a bidirectional gated recurrent network over bytes.

Two small networks read windows of a text's UTF-8 bytes, one from either end, and label every byte; a document's
probabilities are the means over its bytes. Windows start afresh, so a text of any length is read whole in bounded memory.
The network is trained here, by backpropagation through time, on ``pieces`` windows spread over each of at most ``most``
documents (those with the smallest hash of their id) of each of the ``labels`` most frequent languages: the only bounds on what is
learnt from. A text that is shorter than a window fills one by repetition. Only the windows travel.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing can be learnt;
rows without lang are not learnt from; repeated rows are labelled each; an empty table gives no rows; lang is read for learning only, other columns not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrain.llm import common

SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass(frozen=True)
class Setting:
    hidden: int = 8
    window: int = 64
    most: int = 1500
    labels: int = 64
    pieces: int = 4
    steps: int = 1000
    batch: int = 64
    rate: float = 0.01


def start(hidden: int, labels: int, seed: int = 0) -> list[np.ndarray]:
    """For each direction a row of gate inputs for every byte, and the recurrent weights; then the output layer."""
    rng = np.random.default_rng(seed)
    one = lambda: [rng.normal(size=(256, 3 * hidden)) * 0.3, rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)]
    return [a.astype(np.float32) for a in [*one(), *one(), rng.normal(size=(2 * hidden, labels)) / np.sqrt(2 * hidden), np.zeros(labels)]]


def states(b: np.ndarray, x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step, (steps, rows, hidden), for bytes b (steps, rows); what the gradient needs goes to ``keep``."""
    n, rows = u.shape[0], b.shape[1]
    h = np.zeros((rows, n), np.float32)
    out = np.empty((*b.shape, n), np.float32)
    g, a, gates = (np.empty((rows, k), np.float32) for k in (3 * n, 3 * n, 2 * n))
    for t in range(len(b)):
        np.take(x, b[t], axis=0, out=g, mode="clip")
        np.matmul(h, u, out=a)
        if keep is not None:
            gates = np.empty_like(gates)
        np.add(g[:, : 2 * n], a[:, : 2 * n], out=gates)
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :n], gates[:, n:]
        new = r * a[:, 2 * n :]
        new += g[:, 2 * n :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((h, z, r, new, a[:, 2 * n :].copy()))
        np.subtract(h, new, out=out[t])
        out[t] *= z
        out[t] += new
        h = out[t]
    return out


def gradients(b: np.ndarray, x: np.ndarray, u: np.ndarray, keep: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from those of the states, back through time."""
    n = u.shape[0]
    dx, du, dh = np.zeros_like(x), np.zeros_like(u), np.zeros_like(dout[0])
    for t in range(len(b) - 1, -1, -1):
        h, z, r, new, a = keep[t]
        dh = dh + dout[t]
        dnew = dh * (1 - z) * (1 - new * new)
        dz, dr = dh * (h - new) * z * (1 - z), dnew * a * r * (1 - r)
        np.add.at(dx, b[t], np.hstack([dz, dr, dnew]))
        da = np.hstack([dz, dr, dnew * r])
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dx, du


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(windows: np.ndarray, y: np.ndarray, labels: int, s: Setting) -> list[np.ndarray]:
    """Weights from full windows of bytes (rows, steps) and their languages; every position is trained to the window's label."""
    rng, p = np.random.default_rng(0), start(s.hidden, labels)
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    while step < s.steps:
        order = rng.permutation(len(windows))
        for k in range(0, min(len(order), (s.steps - step) * s.batch), s.batch):
            b, want = windows[order[k : k + s.batch]].T, y[order[k : k + s.batch]]
            kf, kb = [], []
            f, r = states(b, p[0], p[1], kf), states(b[::-1], p[2], p[3], kb)[::-1]
            both = np.concatenate([f, r], axis=2)
            d = _softmax(both @ p[4] + p[5])
            d[:, np.arange(len(want)), want] -= 1
            d /= d.shape[0] * d.shape[1]
            dboth = d @ p[4].T
            gf = gradients(b, p[0], p[1], kf, dboth[..., : s.hidden])
            gb = gradients(b[::-1], p[2], p[3], kb, dboth[::-1, :, s.hidden :])
            grads = [*gf, *gb, np.tensordot(both, d, ([0, 1], [0, 1])), d.sum((0, 1))]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = (p[i] - s.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def window_sums(b: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
    """For bytes (steps, rows) the sums over the steps of each row's label probabilities."""
    hidden, labels = p[1].shape[0], p[4].shape[1]
    f, r = states(b, p[0], p[1]), states(b[::-1], p[2], p[3])[::-1]
    out = f.reshape(-1, hidden) @ p[4][:hidden]
    out += r.reshape(-1, hidden) @ p[4][hidden:]
    out += p[5]
    np.clip(out, -60, 60, out=out)
    np.exp(out, out=out)
    out /= out.sum(1, keepdims=True)
    return out.reshape(*b.shape, labels).sum(0)


def document_probabilities(data: np.ndarray, off: np.ndarray, p: list[np.ndarray], window: int, rows: int = 1024) -> np.ndarray:
    """Mean over its bytes of each document's label probabilities; zeros for empty documents."""
    n, labels = np.diff(off), p[4].shape[1]
    per = -(-n // window)
    doc = np.repeat(np.arange(len(n)), per)
    first = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * window
    size = np.minimum(off[1:][doc] - first, window)  # the last window of a document may be shorter
    total = np.zeros((len(n), labels))
    order = np.argsort(-size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order])) + 1 if len(order) else []
    for same in np.split(order, edges):
        for k in range(0, len(same), rows):
            at = same[k : k + rows]
            sums = window_sums(data[first[at] + np.arange(size[at[0]])[:, None]], p)
            for c in range(labels):
                total[:, c] += np.bincount(doc[at], sums[:, c], len(n))
    return total / np.maximum(n, 1)[:, None]


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: list[np.ndarray]
    window: int


def _pieces(batches: Iterator[pa.RecordBatch], s: Setting) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lang) to (doc_id, lang, pieces): up to ``s.pieces`` windows of each text, end to end; a text that is shorter than a
    window is read round and round until it fills one."""
    for batch in batches:
        data, off = common.utf8(batch.column(1))
        pieces = []
        for i in range(batch.num_rows):
            text = data[off[i] : off[i + 1]]
            size = len(text) - s.window
            spots = sorted({int(x) for x in np.linspace(0, size, s.pieces)}) if size >= 0 else []
            pieces.append(b"".join(text[x : x + s.window].tobytes() for x in spots) if spots else np.resize(text, s.window if len(text) else 0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pieces, pa.binary())], names=["doc_id", "lang", "pieces"])


def fit(docs: DataFrame, may_learn: Column | None = None, s: Setting = Setting()) -> Model:
    """A model of ``lang`` from ``text``; only rows that ``may_learn`` holds for are used."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "lang").where("lang is not null and octet_length(text) > 0")
    known = known.where(may_learn) if may_learn is not None else known
    cut = known.mapInArrow(lambda b: _pieces(b, s), "doc_id long, lang string, pieces binary")
    # Hash groups within a language choose first, so that no task ranks all of a frequent one; a task ranks its own rows before that.
    chosen = cut.withColumn("part", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 64)
    for by in (["lang", "part"], ["lang"]):
        w = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id", "pieces")
        chosen = chosen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= s.most).drop("place")
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.labels).select("lang")
    got = chosen.join(F.broadcast(frequent), "lang").select("doc_id", "lang", "pieces").toPandas().sort_values(["doc_id", "pieces"])
    labels = sorted(got["lang"].unique()) if len(got) else []
    if not labels:
        return Model([], [], s.window)
    y = np.repeat(np.searchsorted(labels, got["lang"]), got["pieces"].map(len) // s.window)
    windows = np.frombuffer(b"".join(got["pieces"]), np.uint8).reshape(-1, s.window)
    return Model(labels, train(windows, y, len(labels), s), s.window)


def _labelled(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool) & bool(model.labels)
        data, off = common.utf8(batch.column(1))
        p = np.zeros((len(texts), max(1, len(model.labels))))
        for i, j in common.chunks(off, 1 << 22):  # so that the short windows of many documents run together
            if model.labels:
                p[i:j] = document_probabilities(data[off[i] : off[j]], off[i : j + 1] - off[i], model.weights, model.window)
        best = p.argmax(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.labels[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], pa.string()), pa.array(np.where(letters, np.minimum(p.max(1), 1), 0.0), pa.float64())], names=[c.split()[0] for c in SCHEMA.split(", ")])


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(lambda b: _labelled(b, model), SCHEMA)


def learnable():
    """Rows that the contract lets languages be learnt from."""
    return common.crc_mod("doc_id", 3) != 1


def op9_byte_gru(spark, sf_dir: str) -> DataFrame:
    model = fit(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang"), learnable())
    out = label(common.table(spark, sf_dir, "documents", "doc_id", "text"), model)
    return out.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")
