"""Corpus scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrain.functions import exprs as X


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Give a table of few, small files enough tasks. A table with enough splits is left alone.

    The rows are placed by key, so later windows and groups by that key need no further shuffle.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def read_corpus(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """documents(doc_id, text, …) from Parquet or from a folder of text files; blank texts are dropped.

    Text files get the hash of their path as id, which needs no numbering pass.
    """
    if format == "text":
        df = spark.read.text(path, wholetext=True).select(
            F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"), F.input_file_name().alias("path")
        )
    else:
        df = spark.read.format(format).load(path)
    return df.filter(F.col("text").rlike(r"\S"))


def write_profiles(parts: dict[str, DataFrame], path: str, mode: str = "append", partition_by=None) -> None:
    """Write each named table under ``path``; history tables are appended to."""
    for name, df in parts.items():
        w = df.write.mode(mode)
        if partition_by and all(c in df.columns for c in partition_by):
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path}/{name}")


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_id, text) of the paragraphs and headings of raw pages, tags removed."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<(?:p|h[1-6])(?:\s[^>]*)?>(.*?)(?=<(?:/p|/h[1-6]|p|h[1-6])[\s>])"), F.lit(1))
    plain = F.transform(blocks, lambda b: X.squeeze(F.regexp_replace(b, r"<[^>]*>", " ")))
    return pages.select("page_id", F.posexplode(F.filter(plain, lambda b: b != "")).alias("block_id", "text"))


__all__ = ["spread", "read_corpus", "write_profiles", "html_blocks"]
