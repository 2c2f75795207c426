"""Text to paragraphs, sentences and tokens.

A document is split inside its own row and exploded once with its running number, so numbering
sentences over a document needs neither a shuffle nor a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.dims import fixed
from prosegrain.functions import exprs as X

BLANK_LINE = r"\n\s*\n"
ONE_LINE = r"\n"

# Private-use marks; text that already holds them is not expected.
DOT, END, CUT = "\ue000", "\ue001", "\ue002"

_ABBR = "|".join(a.replace(".", r"\.") for a in sorted(fixed.ABBREVIATIONS, key=len, reverse=True))
PROTECT_ABBR = rf"(?i)(^|\s)({_ABBR})\."
PROTECT_INITIAL = r"(^|\s)([A-Z])\."
# Both, found from the dot: it is rare, so the names are tried in few places.
PROTECT = rf"\.(?<=(?:^|\s)(?:(?i:{_ABBR})|[A-Z])\.)"
# Terminators as they are read from left to right: three dots, else one dot or a run of ! and ?,
# with the closers that follow.
TERMINATOR = "(\\.\\.\\.|(?:\\.[!?]*|[!?]+)['\")\\]\u201d\u2019]*)"
OPENER = END + "\\s*([A-Z\u201c\u201e\u2018\"(\u2014\u2013\\[])"


def paragraph_array(text: Column, sep: str = BLANK_LINE) -> Column:
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), sep)
    return F.filter(F.transform(parts, X.trim_ws), lambda p: p != "")


def sentence_array(paragraph: Column) -> Column:
    """Sentences of one trimmed paragraph."""
    t = F.regexp_replace(paragraph, PROTECT, DOT)
    t = F.regexp_replace(t, "(?=[.!?])" + TERMINATOR, f"$1{END}")
    t = F.regexp_replace(t, OPENER, f"{CUT}$1")
    t = F.replace(F.replace(t, F.lit(DOT), F.lit(".")), F.lit(END), F.lit(""))
    return F.filter(F.transform(F.split(t, CUT), X.trim_ws), lambda s: s != "")


def plain_sentence_array(paragraph: Column) -> Column:
    parts = F.regexp_extract_all(paragraph, F.lit(r"([^.!?]+[.!?]+|[^.!?]+$)"), F.lit(1))
    return F.filter(F.transform(parts, X.trim_ws), lambda s: s != "")


def split_paragraphs(docs: DataFrame, sep: str = BLANK_LINE) -> DataFrame:
    """(doc_id, paragraph_id, text) with blank paragraphs dropped, numbered from 0."""
    return docs.select("doc_id", F.posexplode(paragraph_array(F.col("text"), sep)).alias("paragraph_id", "text"))


def _numbered(docs: DataFrame, sep: str, cut) -> DataFrame:
    nested = F.flatten(
        F.transform(
            paragraph_array(F.col("text"), sep),
            lambda p, i: F.transform(cut(p), lambda s: F.struct(i.alias("paragraph_id"), s.alias("text"))),
        )
    )
    keys = [c for c in docs.columns if c != "text"]
    return docs.select(*keys, F.posexplode(nested).alias("sent_id", "s")).select(
        *keys, "sent_id", F.col("s.paragraph_id"), F.col("s.text").alias("text")
    )


def split_sentences(docs: DataFrame, sep: str = BLANK_LINE) -> DataFrame:
    """(…, sent_id, paragraph_id, text): sentences numbered from 0 over the document."""
    return _numbered(docs, sep, sentence_array)


def split_plain(docs: DataFrame, sep: str = BLANK_LINE) -> DataFrame:
    """The simple splitter: runs up to terminators, no abbreviations."""
    return _numbered(docs, sep, plain_sentence_array)


def sentences(docs: DataFrame, sep: str = BLANK_LINE) -> DataFrame:
    """Sentences with hash and word count."""
    return (
        split_sentences(docs, sep)
        .withColumn("hash", X.sentence_hash(F.col("text")))
        .withColumn("word_count", X.count_words(F.col("text")))
    )


def number_sentences(s: DataFrame) -> DataFrame:
    """Document-wide sentence ids for rows that carry only (paragraph_id, pos)."""
    w = Window.partitionBy("doc_id").orderBy("paragraph_id", "pos")
    return s.withColumn("sent_id", F.row_number().over(w) - 1)


def tokens(s: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, word): lower-cased words by white space."""
    return s.select("doc_id", "sent_id", F.posexplode(X.words(F.lower("text"))).alias("pos", "word"))


def doc_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word) numbered over the whole document, without a shuffle."""
    return docs.select("doc_id", F.posexplode(X.words(F.lower("text"))).alias("pos", "word"))


def rebuild(s: DataFrame) -> DataFrame:
    """Document text from its sentences: a space inside a paragraph, a blank line between."""
    paras = s.groupBy("doc_id", "paragraph_id").agg(
        F.array_sort(F.collect_list(F.struct("sent_id", "text"))).alias("ss")
    )
    joined = paras.select("doc_id", "paragraph_id", F.array_join("ss.text", " ").alias("p"))
    return joined.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("paragraph_id", "p"))).alias("ps")
    ).select("doc_id", F.array_join("ps.p", "\n\n").alias("text"))


def passage(s: DataFrame, start: int, end: int) -> DataFrame:
    """Text of the sentences start..end of each document."""
    part = s.filter(F.col("sent_id").between(start, end))
    return part.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("sent_id", "text"))).alias("ss")
    ).select("doc_id", F.array_join("ss.text", " ").alias("text"))
