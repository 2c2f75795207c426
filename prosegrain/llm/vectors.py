"""Vector rows in tiles: what the two vector searches share."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score {}"


def usable(embeddings: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, vec, d): rows with an id and finite components only; of several rows with one id, the smallest vector.

    Zero vectors stay if ``zero``. Vectors of different length (d) never meet.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    kept = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"]).where(sound & F.col("vec_id").isNotNull())
    if not zero:
        kept = kept.where(F.exists(v, lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min(v).alias("vec")).select("vec_id", "vec", F.size("vec").alias("d"))


def salted(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def spread(df: DataFrame, name: str, n: int) -> DataFrame:
    """Each row once for every value of a new column from 0 to n - 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def salt(df: DataFrame, name: str, n: int) -> DataFrame:
    """Each row in one of n groups by its id."""
    return df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))


def matrix(t: pa.Table, dtype=np.float64) -> np.ndarray:
    """The vectors of a tile, which all have one length, as rows."""
    flat = t["vec"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(flat), -1)


def ids(t: pa.Table) -> np.ndarray:
    return t["vec_id"].to_numpy()


def tiles(queries: DataFrame, rows: DataFrame, keys: list[str], search: Callable, kind: str) -> DataFrame:
    """search(query ids, query matrix, row ids, row matrix) -> (query id, row id, score) arrays, for each pair of tiles of equal keys."""

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out = search(ids(q), matrix(q), ids(r), matrix(r)) if len(q) and len(r) else [[], [], []]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64() if kind == "double" else pa.int64())})

    return queries.groupBy(keys).cogroup(rows.groupBy(keys)).applyInArrow(run, RESULT.format(kind))


def ranked(found: DataFrame, k: int, nearest: bool) -> DataFrame:
    """The k best rows of each query with their rank; ties to the smaller id."""
    best = F.col("score").asc() if nearest else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
