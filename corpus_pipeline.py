"""The training-data pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all that its predecessor kept; ``run``
writes each result to the shared folder and reads it as the next one's input. Every stage but the last returns those columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrain.llm import common, jaccard, packing, pii, quality, suffixes


#: Words of the shortest repeated passage that goes: over 50.
PASSAGE = 51


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of the stage's own documents.

    Null and empty texts are scored like any other; repeated rows are judged each; without labels nothing is rejected; rows of one id are
    each judged by their own text; an empty table gives no rows.
    """
    s = quality.Setting()
    model = quality.fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality"), quality.learnable(), s)
    name = "_quality_of_" + "_".join(docs.columns)  # a name that docs doesn't have
    return quality.scored(docs, model, name).where(F.col(f"`{name}`") >= s.threshold).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id: five words, similarity 0.8 or more.

    Of rows with one id and different texts each is a document of its own; rows equal in id and text are one. Rows without an id are
    kept if their group has no other. Documents without words stay.
    """
    return jaccard.one_of_each(docs, words=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 400 bytes, or of 51 words, or more that also stand elsewhere; those of which nothing is left go."""
    clean = suffixes.cleaned(docs, words=PASSAGE)
    had = F.col("text").isNull() | (F.length("text") > 0)
    empty = docs.where(~had)
    return _counted(clean.where("text is null or length(text) > 0").union(empty))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null texts stay null; every row stays; other columns are passed on, the number of
    characters brought up to date; an empty table gives no rows."""
    return _counted(pii.masked(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences of 2048 tokens. Null and empty texts are the closing token alone; repeated rows are
    packed as often as they occur; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars brought up to date, where there is one."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", pack_sequences),
]

#: A trained network, hashed suffixes and a tokenizer's ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir: the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
