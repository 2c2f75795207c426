"""Queries on splitting and tokens (B)."""

from pyspark.sql import functions as F

from prosegrain.functions import exprs as X
from prosegrain.operators import split
from prosegrain.plans.catalog import cte, q, query


@query("b01_split_paragraphs", "SELECT doc_id, paragraph_id, text FROM paras")
def _(t):
    return split.split_paragraphs(t.docs, split.ONE_LINE)


@query("b02_split_sentences", "SELECT doc_id, sent_id, paragraph_id, text FROM sents")
def _(t):
    return split.split_sentences(t.docs, split.ONE_LINE)


@query(
    "b03_split_plain",
    r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, pos) - 1 AS sent_id, paragraph_id, s AS text FROM (
  SELECT doc_id, paragraph_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM (
    SELECT doc_id, paragraph_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN regexp_extract_all(text, '[^.!?]+[.!?]+|[^.!?]+$')] IF x <> ''] AS ss FROM paras))""",
)
def _(t):
    return split.split_plain(t.docs, split.ONE_LINE)


@query("b04_number_sentences", "SELECT doc_id, sent_id, paragraph_id, text FROM sents")
def _(t):
    cut = split.split_paragraphs(t.docs, split.ONE_LINE).select(
        "doc_id", "paragraph_id", F.posexplode(split.sentence_array(F.col("text"))).alias("pos", "text")
    )
    return split.number_sentences(cut).select("doc_id", "sent_id", "paragraph_id", "text")


@query(
    "b05_sentence_hash",
    "SELECT count(*) AS n, count(DISTINCT lower(text)) AS n_hashes, max(c) AS largest FROM (SELECT text, count(*) OVER (PARTITION BY lower(text)) AS c FROM sents)",
)
def _(t):
    s = t.sents.groupBy("hash").agg(F.count(F.lit(1)).alias("c"))
    return s.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_hashes"), F.max("c").alias("largest"))


@query(
    "b05_sentence_hash32",
    "SELECT doc_id, sent_id, lpad(printf('%x', list_reduce(list_prepend(5381::BIGINT, [unicode(c)::BIGINT FOR c IN string_split(lower(text), '')]), lambda a, b: (a * 33 + b) & 4294967295)), 8, '0') AS hash32 FROM sents",
)
def _(t):
    return t.sents.select("doc_id", "sent_id", X.sentence_hash32(F.col("text")).alias("hash32"))


@query("b06_count_words", "SELECT doc_id, sum(word_count)::BIGINT AS words, max(word_count)::BIGINT AS longest FROM sents GROUP BY doc_id")
def _(t):
    return t.sents.groupBy("doc_id").agg(F.sum("word_count").alias("words"), F.max("word_count").cast("bigint").alias("longest"))


cte("stok", r"SELECT doc_id, sent_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, sent_id, regexp_extract_all(lower(text), '\S+') AS ws FROM sents)")


@query("b07_tokens", "SELECT doc_id, word, count(*) AS n, sum(sent_id)::BIGINT AS sent_sum, sum(pos)::BIGINT AS pos_sum FROM stok GROUP BY doc_id, word")
def _(t):
    return split.tokens(t.sents).groupBy("doc_id", "word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sent_id").alias("sent_sum"), F.sum("pos").alias("pos_sum")
    )


@query(
    "b08_alpha_words",
    "SELECT doc_id, sent_id, len(ws)::BIGINT AS n_words, array_to_string(ws, ' ') AS words FROM (SELECT doc_id, sent_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS ws FROM sents)",
)
def _(t):
    ws = X.alpha_words(F.col("text"))
    return t.sents.select("doc_id", "sent_id", F.size(ws).cast("bigint").alias("n_words"), F.array_join(ws, " ").alias("words"))


CONTENT_SQL = r"list_distinct([w FOR w IN regexp_extract_all(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s''-]', ' ', 'g'), '\S+') IF len(w) > 2])"


@query(
    "b09_content_words",
    f"SELECT doc_id, sent_id, len({CONTENT_SQL.format(c='text')})::BIGINT AS n_content, array_to_string(list_sort({CONTENT_SQL.format(c='text')}), ' ') AS content FROM sents",
)
def _(t):
    ws = X.content_words(F.col("text"))
    return t.sents.select("doc_id", "sent_id", F.size(ws).cast("bigint").alias("n_content"), F.array_join(F.array_sort(ws), " ").alias("content"))


@query(
    "b10_rebuild",
    "SELECT doc_id, string_agg(p, chr(10)||chr(10) ORDER BY paragraph_id) AS text FROM (SELECT doc_id, paragraph_id, string_agg(text, ' ' ORDER BY sent_id) AS p FROM sents GROUP BY ALL) GROUP BY doc_id",
)
def _(t):
    return split.rebuild(t.sents)


@query("b11_passage", "SELECT doc_id, string_agg(text, ' ' ORDER BY sent_id) AS text FROM sents WHERE sent_id BETWEEN 2 AND 5 GROUP BY doc_id")
def _(t):
    return split.passage(t.sents, 2, 5)
