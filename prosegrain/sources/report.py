"""Tables of a report: key measures, length histogram, heat buckets and region severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = [
    ("Mean Heat", "mean_heat"), ("Register Entropy", "register_entropy"), ("Device Entropy", "device_entropy"),
    ("Length Autocorr", "autocorrelation"), ("Convergence", "convergence_slope"), ("Hot Regions", "hot_region_count"),
]


def report_tables(profile: DataFrame, s: DataFrame, regions: DataFrame | None = None) -> dict[str, DataFrame]:
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in METRICS])
    h = F.col("heat")
    bucket = F.when(h <= 0, "none").when(h <= 2, "cool").when(h <= 4, "warm").when(h <= 7, "hot").otherwise("very hot")
    one = F.lit(1)
    out = {
        "metrics": profile.select("doc_id", F.explode(cells).alias("m")).select("doc_id", "m.*"),
        "lengths": s.groupBy("doc_id", (F.floor(F.col("word_count") / 5) * 5).alias("bin")).agg(F.count(one).alias("n")),
        "heat": s.groupBy("doc_id", bucket.alias("bucket")).agg(F.count(one).alias("n")),
    }
    if regions is not None:
        out["regions"] = regions.withColumn("severity", F.when(h >= 7, "high").when(h >= 5, "moderate").otherwise("mild"))
    return out
