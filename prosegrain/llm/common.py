"""Helpers that several operators share: scratch tables, text buffers, hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Makes a query remove its shuffle files when it ends; otherwise they stay until the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation.

    What the write shuffled is deleted when it ends, so disk holds the shuffles of one write at a time.
    """
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(TIDY) if before is None else conf.set(TIDY, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, when no later job will read it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id's text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string()) if len(col) else pa.array([], pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = 1 << 20):
    """Ranges of whole documents of about ``most`` bytes, so that work arrays stay small."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_P = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd 64-bit base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _P, U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def runs(cls: np.ndarray, off: np.ndarray, none: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal class that stay inside a document; class ``none`` separates."""
    if not len(cls):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(cls), bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < len(cls)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(cls))
    keep = cls[starts] != none
    return starts[keep], ends[keep]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte run, the same wherever the run stands."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    values = data[place + np.repeat(starts, lens)].astype(U64) + U64(1)
    values *= powers(int(lens.max()))[place]
    return mix(np.add.reduceat(values, at))


#: Bytes between words: space and the five controls from tab to carriage return.
_WORD = np.ones(256, np.uint8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of documents, A-Z lower-cased, and the n + 1 offsets of each document's words."""
    starts, ends = runs(_WORD[data], off)
    return run_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, off)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, with the index of their document; a shorter document counts as one run."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    base, q = mix(h + U64(k)), powers(k + 1)[1:]
    sums = np.zeros(max(0, len(h) - k + 1), U64)
    for j in range(k):
        sums += base[j : j + len(sums)] * q[j]
    inside = doc[: len(sums)] == doc[k - 1 :] if len(sums) else np.zeros(0, bool)
    few = np.flatnonzero((n > 0) & (n < k))
    rest = np.array([int((base[at[i] : at[i + 1]] * q[: n[i]]).sum(dtype=U64)) for i in few], U64) ^ U64(k)
    return mix(np.append(sums[inside], rest)), np.append(doc[: len(sums)][inside], few)


def named(rows: DataFrame, names: DataFrame, key: str | list[str], count: str, how: str = "left", heavy: int = 10_000, merge: bool = False) -> DataFrame:
    """rows joined with names (key, count, ...), which has one row for each key of rows and how many rows have it.

    Keys that more than one in ``heavy`` rows have are fewer than ``heavy``, so these names may be broadcast; a third of all rows may
    have one key without meeting in a task. ``merge``: the others are shuffled and merged whatever their size, so that the plan does not change
    as tables grow.
    """
    total, most = names.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    least = max(total // heavy, 1)
    others = names.drop(count).hint("merge") if merge else names.drop(count)
    if most <= least:
        return rows.join(others, key, how)
    large = names.where(F.col(count) > least).drop(count)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(others, key, how)
    out = rows.join(F.broadcast(large), key)
    return out.union(rest.select(*out.columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v); root is the smallest node it can reach.

    Alternating star contraction: each round links a node's larger neighbours, then its smaller ones, to
    the smallest neighbour, until nothing changes. Every round is two joins on keys, written to the shared folder.
    """
    e = stored(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e, old = stored(small.where("u <> v").distinct()), e
        release(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()
