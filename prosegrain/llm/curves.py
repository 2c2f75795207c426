"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors on its own random directions, shifts and quantizes them, and numbers the
cells along a Hilbert curve. Spark cuts every ordering at its quantiles into key ranges. A query searches the ranges
around its own key on each curve by exact distance; the ranges' best meet in one ranking.

Nearly isotropic vectors have no order that keeps neighbours close, so a window is a share of the rows: with the
defaults 7 ranges of 32 on each of 7 curves, about 1.5 times the distances of a full scan. Tables of up to ``width``
ranges' smallest size are searched whole. Means and spreads for the quantization come from ``fit`` rows at most, those
with the smallest hash of their id; every row is indexed.

Rows of one vector would all have one key, so they are told apart by their id: only the k + 1 smallest ids of equal
vectors can be among anyone's k nearest, and only those enter.

Defined cases: see ``vectors.usable``; zero vectors take no part; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrain.llm import common, vectors

U64 = np.uint64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places along the Hilbert curve of cells with coordinates below 2**bits, one row each; at most 63 bits in all.

    Axes become a transposed place by undoing, from the highest bit down, the reflections and exchanges of the curve.
    """
    x = [cells[:, i].astype(U64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = U64((1 << bit) - 1)
        for i in range(len(x)):
            up = (x[i] >> U64(bit)) & U64(1) == 1
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(up, x[i], x[i] ^ swap)
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> U64(bit)) & U64(1) == 1, flip ^ U64((1 << bit) - 1), flip)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for a in x:
            key = (key << U64(1)) | (((a ^ flip) >> U64(bit)) & U64(1))
    return key


def directions(curve: int, d: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A curve's orthonormal directions, as columns, and its shifts in cells' widths of the unit cube."""
    rng = np.random.default_rng([curve, d])
    m = min(dims, d)
    return np.linalg.qr(rng.normal(size=(d, d)))[0][:, :m], rng.uniform(-0.5, 0.5, m)


def _keyed(batches: Iterator[pa.RecordBatch], curves: int, dims: int, bits: int, fitted: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        lengths = t["d"].to_numpy()
        for d in np.unique(lengths):
            part = t.filter(pa.array(lengths == d))
            vec, (mean, spread) = vectors.matrix(part), fitted[int(d)]
            for c in range(curves):
                way, shift = directions(c, int(d), dims)
                at = ((vec - mean) @ way / np.maximum(np.sqrt((spread**2) @ (way**2)), 1e-300) + 3 + shift) / 6
                cells = np.clip(at * (1 << bits), 0, (1 << bits) - 1)
                key = hilbert_keys(cells, bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part["vec_id"].combine_chunks(), part["d"].combine_chunks(), pa.array(np.full(len(part), c, np.int32)), pa.array(key)], names=["vec_id", "d", "curve", "key"])


def nearest_tile(k: int):
    def search(qid, q, rid, r):
        out = []
        norms = (r * r).sum(1)
        for s in range(0, len(qid), 256):
            part = q[s : s + 256]
            near = norms - 2 * (part @ r.T)  # squared distances less the query's own norm, nearly
            near[qid[s : s + 256, None] == rid] = np.inf
            slack = 1e-9 * (norms.max() + (part * part).sum(1) + 1)
            bound = (np.partition(near, k - 1, axis=1)[:, k - 1] if len(rid) > k else np.full(len(part), np.inf)) + slack
            for i in range(len(part)):
                live = np.flatnonzero((near[i] <= bound[i]) & (rid != qid[s + i]))
                exact = np.sqrt(((r[live] - part[i]) ** 2).sum(1))
                top = np.lexsort((rid[live], exact))[:k]
                out.append((np.full(len(top), qid[s + i]), rid[live[top]], exact[top]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    return search


def nearest(embeddings: DataFrame, is_query, k: int = 10, curves: int = 7, ranges: int = 32, width: int = 3, dims: int = 10, bits: int = 6, fit: int = 20_000, tile: int = 8192, least: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k smallest Euclidean distances found for the rows that ``is_query`` holds for."""
    rows = common.stored(vectors.usable(embeddings, zero=False))
    same = Window.partitionBy("vec").orderBy("vec_id")
    index = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    queries = rows.where(is_query)
    n, nq = rows.count(), queries.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).toPandas() if n else None
    fitted = {}
    if n:
        for d in [int(r[0]) for r in rows.select("d").distinct().collect()]:  # one entry for each length of vectors
            m = np.stack(sample.vec[sample.d == d]) if (sample.d == d).any() else np.zeros((1, d))
            fitted[d] = m.mean(0), np.maximum(m.std(0), 1e-12)
    cut = int(min(ranges, max(1, n // least)))

    def keyed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda b: _keyed(b, curves, dims, bits, fitted), "vec_id long, d int, curve int, key long")

    keys = keyed(index)
    quantiles = F.percentile_approx("key", [i / cut for i in range(1, cut)] or [0.5], 10_000)
    bounds = {(r[0], r[1]): r[2] for r in keys.groupBy("d", "curve").agg(quantiles).collect()} if cut > 1 else {}
    bound_rows = [(d, c, list(map(int, b))) for (d, c), b in bounds.items()]  # curves times lengths, each with under ``ranges`` numbers
    bounds_df = embeddings.sparkSession.createDataFrame(bound_rows, "d int, curve int, bounds array<long>")

    def ranged(df: DataFrame) -> DataFrame:
        at = F.coalesce(F.size(F.filter("bounds", lambda x: x < F.col("key"))), F.lit(0))
        return keyed(df).join(F.broadcast(bounds_df), ["d", "curve"], "left").withColumn("at", F.when(F.col("bounds").isNull(), 0).otherwise(at)).select("vec_id", "curve", "at").join(df, "vec_id")

    tr, tq = vectors.salted(n, cut * tile), vectors.salted(nq * min(cut, 2 * width + 1), cut * tile // 2)
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.least(F.lit(cut - 1 - 2 * width), F.col("at") - width)), F.least(F.lit(cut - 1), F.greatest(F.lit(2 * width), F.col("at") + width))))
    a = vectors.spread(vectors.salt(ranged(queries).withColumn("at", around), "qt", tq), "rt", tr)
    b = vectors.spread(vectors.salt(ranged(index), "rt", tr), "qt", tq)
    found = vectors.tiles(a, b, ["d", "curve", "at", "qt", "rt"], nearest_tile(k), "double")
    return vectors.ranked(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, nearest=True)


def op4_shifted_hilbert(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.expr("vec_id % 100 = 0"))
