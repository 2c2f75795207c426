"""Places of regular expressions in texts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.functions import exprs


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once a row however often it is used after."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def matched(df: DataFrame, name: str, regex: str, may: Column, beside: Callable[..., list[Column]] | None = None) -> DataFrame:
    """df with an array of (start, end, value) of the matches in ``text``, in code points; ``may`` is a cheap test that a match needs.

    ``beside`` makes more fields from the text back to the last match, the text up to the next one, and whether there are these.
    """
    none = F.array().cast("array<string>")
    df = once(df, hits=F.when(may, F.regexp_extract_all("text", F.lit(regex), F.lit(0))).otherwise(none), gaps=F.when(may, F.split("text", regex, -1)).otherwise(none))
    df = once(df, lens=F.zip_with("hits", F.slice("gaps", F.lit(1), F.size("hits")), lambda h, g: F.length(h) + F.length(g)))
    df = once(df, sums=exprs.running(F.col("lens")))
    start = lambda i: F.get("sums", i) + F.length(F.get("gaps", i))
    more = lambda i: beside(F.get("gaps", i), F.get("gaps", i + 1), i > 0, i < F.size("hits") - 1) if beside else []
    spans = F.transform("hits", lambda h, i: F.struct(start(i).alias("start"), (F.get("sums", i) + F.get("lens", i)).alias("end"), h.alias("value"), *more(i)))
    return once(df, **{name: spans}).drop("hits", "gaps", "lens", "sums")
