"""Plug points: a user's model over batches of rows, and table functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from prosegrain.operators import split


def classify_batches(s: DataFrame, load: Callable[[], Callable[[pa.Table], dict]], schema: str, columns: list[str]) -> DataFrame:
    """Rows of ``s`` with the columns that a user's model adds.

    ``load`` runs once in a task and returns the model, a function from a batch of ``columns`` to the arrays of
    ``schema``. Batches stream through the task, so its memory holds the model and one batch.
    """
    added = s.sparkSession.createDataFrame([], schema).schema
    at = [s.columns.index(c) for c in columns]
    kinds = [(f.name, f.dataType) for f in added.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        model = load()
        for b in batches:
            out = model(pa.table([b.column(i) for i in at], names=columns))
            new = [pa.array(out[n]).cast(to_arrow_type(k)) if not isinstance(out[n], pa.ChunkedArray) else out[n].combine_chunks().cast(to_arrow_type(k)) for n, k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(n for n, _ in kinds)])

    return s.mapInArrow(run, StructType([*s.schema.fields, *added.fields]))


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession, sep: str = split.BLANK_LINE, prefix: str = "doc_") -> None:
    """Temporary table functions for SQL, for use with LATERAL: ``doc_paragraphs(text)`` gives (paragraph_id, text),
    ``doc_sentences(text)`` (sent_id, paragraph_id, text); ``sentences`` alone is a function of Spark's own. They are the splitter's rules
    as SQL, and stay inside the plan."""
    trim = lambda x: f"btrim({x}, ' \\t\\n\\u000b\\u000c\\r')"
    swap = lambda x, p, r: f"regexp_replace({x}, {_quoted(p)}, {_quoted(r)})"
    paragraphs = f"filter(transform(split(replace(_text, '\\r\\n', '\\n'), {_quoted(sep)}), p -> {trim('p')}), p -> p <> '')"
    cut = "p"
    for pattern, new in (
        (split.PROTECT_ABBR, f"$1$2{split.DOT}"), (split.PROTECT_INITIAL, f"$1$2{split.DOT}"), (split.TERMINATOR, f"$1{split.END}"), (split.OPENER, f"{split.CUT}$1"),
    ):
        cut = swap(cut, pattern, new)
    cut = f"translate({cut}, '{split.DOT}{split.END}', '.')"
    parts = f"filter(transform(split({cut}, '{split.CUT}'), s -> {trim('s')}), s -> s <> '')"
    nested = f"flatten(transform({paragraphs}, (p, i) -> transform({parts}, s -> named_struct('paragraph_id', i, 'text', s))))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}paragraphs(_text STRING) RETURNS TABLE (paragraph_id INT, text STRING) RETURN SELECT pos, col FROM (SELECT posexplode({paragraphs}))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}sentences(_text STRING) RETURNS TABLE (sent_id INT, paragraph_id INT, text STRING) RETURN SELECT pos, col.paragraph_id, col.text FROM (SELECT posexplode({nested}))")
