"""Exact top-k inner products by columnar branch and bound.

Vectors lie in tiles of bounded size, stored by dimension. For each query, scores accumulate block of dimensions by
block. After a block the product of the remaining norms bounds what is still to come, from above and from below: rows
that cannot reach the k-th best lower bound go, and the survivors' columns are compacted. Query tiles meet row tiles
on equal keys, so both sides are read in blocks and no task holds more than one tile of each.

Defined cases: see ``vectors.usable``; repeated rows of an id count once; fewer candidates than k give fewer rows; an
empty table gives none. Scores are exact 64-bit integers; sums below 2**53 are formed in floating point, where they are
exact, larger ones in integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.llm import common, vectors

BLOCK = 16


def search_tile(k: int):
    """The k highest inner products of each query of a tile, but for rows with its own id."""

    def search(qid, q, rid, r):
        largest = np.sqrt((q * q).sum(1).max()) * np.sqrt((r * r).sum(1).max())
        kind = np.float64 if largest < 2**52 else np.int64
        order = np.argsort(-(r * r).sum(0), kind="stable")  # dimensions with most mass first, so that bounds tighten soon
        columns, q = np.ascontiguousarray(r[:, order].T).astype(kind), q[:, order].astype(kind)
        starts = range(0, len(order), BLOCK)
        mass = lambda m: np.sqrt(np.cumsum((m[:, ::-1].astype(float)) ** 2, axis=1)[:, ::-1]) * (1 + 1e-9)
        rest_r, rest_q = np.ascontiguousarray(mass(r[:, order]).T), mass(q)
        out = []
        for i in range(len(qid)):
            live = np.flatnonzero(rid != qid[i])
            score = np.zeros(len(live), kind)
            for s in starts:
                block = columns[s : s + BLOCK]
                block = block if len(live) == len(rid) else block[:, live]
                score = score + q[i, s : s + BLOCK] @ block
                e = s + BLOCK
                if e < len(order) and len(live) > k:
                    bound = rest_q[i, e] * rest_r[e, live] + 1e-6
                    least = np.partition(score - bound, len(live) - k)[len(live) - k]
                    stay = score + bound >= least
                    live, score = live[stay], score[stay]
            top = np.lexsort((rid[live], -score))[:k]
            out.append((np.full(len(top), qid[i]), rid[live[top]], score[top].astype(np.int64)))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    return search


def top_products(embeddings: DataFrame, is_query, k: int = 10, scale: int = 1024, tile: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for the rows that ``is_query`` holds for."""
    rows = vectors.usable(embeddings, zero=True).withColumn("vec", F.transform("vec", lambda x: F.floor(scale * x).cast("double")))
    n, nq = embeddings.count(), embeddings.where(is_query).count()
    tr, tq = vectors.salted(n, tile), vectors.salted(nq, tile)
    a = vectors.spread(vectors.salt(rows.where(is_query), "qt", tq), "rt", tr)
    b = vectors.spread(vectors.salt(rows, "rt", tr), "qt", tq)
    return vectors.ranked(vectors.tiles(a, b, ["d", "qt", "rt"], search_tile(k), "long"), k, nearest=False)


def op6_columnar_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.expr("vec_id % 100 = 0"))


OP6_SQL = """
WITH e AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
