"""Helpers on whole DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def stack(*frames: DataFrame, missing: bool = False) -> DataFrame:
    """Rows of all frames, by column name.

    Spark 4.1 may treat a union of equally partitioned inputs as partitioned although its tasks are not
    lined up; a later grouping then skips its shuffle and splits groups. The session setting below
    keeps the shuffle.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder; a temporary one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df written to the shared folder and read back; its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
