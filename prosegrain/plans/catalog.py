"""Registered queries over the shared test tables, each with the SQL that must give the same rows.

The tables hold invented text without blank lines and without marker words. ``marked`` turns frequent
words into marker phrases, the same way on both sides, so that every detector fires on whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from prosegrain import dims
from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stored
from prosegrain.operators import detect, split, windows
from prosegrain.plans import analyze
from prosegrain.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql


def compose(select: str) -> str:
    """Prefix a SELECT with the shared expressions it needs, each after the ones it uses itself."""
    ordered: list[str] = []
    open_: set[str] = set()

    def visit(sql: str) -> None:
        for n, body in _CTES.items():
            if n not in open_ and re.search(rf"\b{n}\b", sql):
                open_.add(n)
                visit(body)
                ordered.append(n)

    visit(select)
    parts = [f"{n} AS MATERIALIZED ({_CTES[n]})" for n in ordered]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


def query(name: str, sql: str | None = None, once: bool = False):
    """``once``: the query uses the sentences more than once, so they are cut and matched in one pass and kept."""

    def register(fn):
        QUERIES[name] = lambda spark, path: fn((Once if once else Tables)(spark, path))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def jr(x: str, k: int) -> str:
    """SQL of rounding halves toward plus infinity, after removing noise below nine digits."""
    m = 10**k
    return f"(floor((floor(({x})*1e9+0.5)/1e9)*{m}.0+0.5)/{m}.0)"


def jr0(x: str, k: int) -> str:
    """SQL of rounding halves toward plus infinity, as is."""
    return f"(floor(({x})*{10**k}.0+0.5)/{10**k}.0)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- marked text

MARKS = [
    ("Of ", "Moreover, of "), ("And ", "Furthermore and "), ("To ", "In other words, to "), ("In ", "While in "),
    ("La ", "On the one hand, la "), ("Le ", "On the other hand, le "), ("Der ", "At first glance, der "),
    ("Is ", "At first glance, it holds. But the real opportunity is "), ("En ", "In conclusion, en "), ("De ", "Imagine de "),
    ("That ", "This is not about it. It is about "), ("It ", "It is about what is not about "),
    ("The ", "On the one hand, this holds. On the other hand, the "), ("Was ", "Throughout history was "), ("For ", "Overall, for "),
    ("Die ", "Not only can Acme "), ("On ", "Whether on "), ("By ", "- **By** : "), ("Be ", "Let me explain be "),
    (" of ", " of crucial "), (" to ", " perhaps "), (" is ", " is not about "), (" that ", " but about "),
    (" in ", " truly "), (" for ", " rather than "), (" it ", " it's not "), (" on ", " landscape "),
    (" was ", " was considered "), (" with ", " implementation "), (" be ", " leverage "), (" as ", " optimization "),
    (" by ", " in this article "), (" are ", " are significant "), (" this ", " not only "), (" at ", " while "),
    (" from ", " robust "), (" rewh ", " cutting edge "), (" thatin ", " the future looks bright "),
    (" ononst ", " do not "), (" inoran ", " don't "), (" hehely ", " which means that "),
    (" orantion ", " plays a role in "), (" der ", " — "), (" en ", " -- "), (" die ", " ; "), (" que ", ": "),
    (" le ", " fear "), (" des ", " joy "), (" und ", ", but it can also "), (" et ", " or "), (" er ", " **"),
    (" les ", " taken together "), (" an ", " data "), (" un ", " slightly "), (" es ", " three factors "),
    (" el ", " absolutely "), (" von ", " world-class "), (" den ", " commence "), (" he ", " refers to "),
    (" re ", " it's important to note "), (" nd ", " is complex "), (" ha ", " kael "), (" ti ", " elara "),
    (" st ", " whisper "), (" ed ", " shadow "), (" ou ", " certainly "), (" nt ", " always "),
]


def marked_sql(col: str) -> str:
    out = col
    for a, b in MARKS:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


_MARKS = [(a.encode(), b.encode()) for a, b in MARKS]


def _marked(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        if t is not None:
            for a, b in _MARKS:
                t = t.replace(a, b)
        out.append(t)
    return pa.array(out, pa.binary())


def marked(c: Column) -> Column:
    """The replacements in turn, on bytes: Spark's own compares the sign at every place, for each of them."""
    return F.arrow_udf(_marked, BinaryType())(c.cast("binary")).cast("string")


# Hits of the test rules: pattern type, expression, confidence.
RULES = [
    ("importance_inflation", r"\b(crucial|significant)\b", 0.85),
    ("hedging", r"\bperhaps\b", 0.6),
    ("transition_formulaic", r"^(Moreover|Furthermore|In conclusion)\b", 0.85),
    ("llm_fingerprint_word", r"\b(landscape|robust)\b", 0.5),
    ("binary_contrast", r"\bnot about\b", 0.8),
    ("negation_reframe", r"\bit's not\b", 0.7),
    ("concessive_while", r"^While\b", 0.65),
    ("clause_symmetry", r"\bwhile\b", 0.45),
    ("nominalization", r"\b(implementation|optimization)\b", 0.75),
    ("em_dash_overuse", "—", 0.9),
    ("concluding_summary", r"\b(in conclusion|taken together|overall)\b", 0.8),
    ("emotional_positivity_bias", r"\bjoy\b", 0.55),
    ("resolution_complete", r"\bdata\b", 0.7),
    ("definitional_opening", r"\brefers to\b", 0.75),
]
RULES_SQL = ", ".join(f"({i}, {q(t)}, {q('(?i)' + p)}, {c}::DOUBLE)" for i, (t, p, c) in enumerate(RULES))
REGISTRY_SQL = ", ".join(
    f"({q(r[0])}, {q(r[1])}, {q(r[2])}, {q(r[3])}, {r[4]}::DOUBLE, {q(r[5])}, {int(r[6])})" for r in fixed.REGISTRY
)
PLAY_SQL = ", ".join(
    f"({li}, {q(l)}, {q(lab)}, {q(t)})" for li, (l, lab, ts) in enumerate(fixed.PLAYBOOK_LAYERS) for t in ts.split()
)


class Tables:
    """The test tables and what Spark derives from them, built on first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def values(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def documents(self):
        return corpus.spread(self.read("documents"))

    @cached_property
    def docs(self):
        return self.documents.select("doc_id", marked(F.col("text")).alias("text"))

    @cached_property
    def docs_src(self):
        return self.documents.select("doc_id", marked(F.col("text")).alias("text"), "source", "lang")

    @cached_property
    def classified(self):
        return analyze.classify(self.docs, RULES, split.ONE_LINE)

    @cached_property
    def sents(self):
        return split.sentences(self.docs, split.ONE_LINE)

    @cached_property
    def hits(self):
        return detect.screen_lexical(self.sents, RULES)

    @cached_property
    def feats(self):
        return detect.features(self.sents)

    @cached_property
    def hot(self):
        return detect.heat(self.feats, self.hits, self.registry)

    @cached_property
    def rolling(self):
        return windows.rolling_windows(self.sents)

    @cached_property
    def tokens(self):
        return split.doc_tokens(self.docs)

    @cached_property
    def registry(self):
        return dims.registry(self.spark)


class Once(Tables):
    """The tables with one pass over the texts: classified sentences are written once, and each use reads its columns of them."""

    @cached_property
    def classified(self):
        return stored(super().classified, "classified")

    @cached_property
    def sents(self):
        return self.classified.select("doc_id", "sent_id", "paragraph_id", "text", "hash", "word_count")

    @cached_property
    def hits(self):
        return detect.explode_hits(self.classified)

    @cached_property
    def feats(self):
        return self.classified.drop("patterns", "heat")

    @cached_property
    def hot(self):
        return self.classified.drop("patterns")


# ---------------------------------------------------------------- shared SQL

cte("mdocs", f"SELECT doc_id, {marked_sql('text')} AS text, source, lang FROM documents")
cte("paras", r"""SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS paragraph_id FROM (
  SELECT doc_id, [p FOR p IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(replace(text, chr(13)||chr(10), chr(10)), chr(10))] IF p <> ''] AS ps FROM mdocs)""")


def sentence_sql(col: str) -> str:
    """SQL that cuts one trimmed paragraph into sentences."""
    d, e, c = split.DOT, split.END, split.CUT
    t = f"regexp_replace({col}, {q(split.PROTECT_ABBR)}, {q(chr(92) + '1' + chr(92) + '2' + d)}, 'g')"
    t = f"regexp_replace({t}, {q(split.PROTECT_INITIAL)}, {q(chr(92) + '1' + chr(92) + '2' + d)}, 'g')"
    t = f"regexp_replace({t}, {q(split.TERMINATOR)}, {q(chr(92) + '1' + e)}, 'g')"
    t = f"regexp_replace({t}, {q(split.OPENER)}, {q(c + chr(92) + '1')}, 'g')"
    t = f"replace(replace({t}, {q(d)}, '.'), {q(e)}, '')"
    return f"[s FOR s IN [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split({t}, {q(c)})] IF s <> '']"


cte("cut", f"SELECT doc_id, paragraph_id, unnest(ss) AS text, generate_subscripts(ss, 1) AS pos FROM (SELECT doc_id, paragraph_id, {sentence_sql('text')} AS ss FROM paras)")
cte("sents", r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, pos) - 1 AS sent_id, paragraph_id, text, len(regexp_extract_all(text, '\S+')) AS word_count FROM cut")
cte("rules", f"SELECT * FROM (VALUES {RULES_SQL}) r(pos, type, re, confidence)")
cte("registry", f"SELECT * FROM (VALUES {REGISTRY_SQL}) r(type, taxonomy_id, name, level, weight, amplification, playbook)")
cte("play", f"SELECT * FROM (VALUES {PLAY_SQL}) p(layer_pos, layer, label, type)")
cte("hits", "SELECT s.doc_id, s.sent_id, (row_number() OVER (PARTITION BY s.doc_id, s.sent_id ORDER BY r.pos) - 1) AS hit_pos, r.type, r.confidence, regexp_extract(s.text, r.re) AS evidence FROM sents s, rules r WHERE regexp_matches(s.text, r.re)")
_strong = "[" + ", ".join(q(w) for w in fixed.STRONG_WORDS) + "]"
_nominal = "[" + ", ".join(q(w) for w in fixed.NOMINAL_WORDS) + "]"
cte("feats", rf"""SELECT *, CASE WHEN clause_count >= 2 THEN 0.78 ELSE 0.5 END::DOUBLE AS clause_balance_ratio,
  CASE WHEN clause_count >= 3 THEN 'compound-complex' WHEN clause_count = 2 THEN 'compound' ELSE 'simple' END AS construction_type,
  0.62::DOUBLE AS informational, 0.1::DOUBLE AS involved, 0.05::DOUBLE AS narrative,
  CASE WHEN len(strong) > 0 THEN 0.58 ELSE 0.32 END::DOUBLE AS persuasive,
  CASE WHEN len(nominal) > 0 THEN 0.55 ELSE 0.24 END::DOUBLE AS abstract,
  CASE WHEN clause_count > 2 THEN 0.55 ELSE 0.28 END::DOUBLE AS elaborative,
  CASE WHEN sent_id = 0 THEN 'claim' WHEN regexp_matches(text, '(?i)\bdata\b|\bmethod\b|\bevidence\b') THEN 'evidence' ELSE 'development' END AS arc_role
  FROM (SELECT *, [w FOR w IN {_strong} IF contains(lower(text), w)] AS strong, [w FOR w IN {_nominal} IF contains(lower(text), w)] AS nominal,
    len(regexp_extract_all(text, '(?i),|;|\band\b|\bbut\b|\bwhile\b')) + 1 AS clause_count,
    regexp_matches(lower(text), '\b\w+ing\b') AS has_participial,
    regexp_matches(lower(text), '\bthat\b|\bwhich\b|\bwho\b') AS has_relative_clause FROM sents)""")
cte("hot", f"""SELECT f.*, least(10.0, {jr('(coalesce(h.h, 0.0) + CASE WHEN clause_balance_ratio > 0.85 AND clause_count >= 2 THEN (clause_balance_ratio - 0.85) / 0.15 ELSE 0.0 END + CASE WHEN has_participial AND clause_count >= 3 THEN 0.8::DOUBLE ELSE 0.0 END) * CASE WHEN coalesce(h.n, 0) >= 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END', 1)}) AS heat
  FROM feats f LEFT JOIN (SELECT doc_id, sent_id, sum((coalesce(weight, 0.5) * confidence)::DECIMAL(18,6))::DOUBLE AS h, count(*) AS n FROM hits LEFT JOIN registry USING (type) GROUP BY ALL) h USING (doc_id, sent_id)""")
cte("cum", "SELECT doc_id, sent_id, word_count, coalesce(sum(word_count) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sents")
_sets = ", ".join(f"('{n}', {l}, {t}, {s})" for n, l, t, s in fixed.WINDOW_SETS)
cte("rolling", f"""SELECT a.doc_id, z.size, a.sent_id AS start_sentence, max(b.sent_id) AS end_sentence, sum(b.word_count)::BIGINT AS word_count
  FROM cum a CROSS JOIN (VALUES {_sets}) z(size, least_words, target, step) JOIN cum b ON a.doc_id = b.doc_id AND b.sent_id >= a.sent_id AND b.before < a.before + z.target
  WHERE a.sent_id % z.step = 0 GROUP BY a.doc_id, z.size, a.sent_id, z.least_words HAVING sum(b.word_count) >= z.least_words OR a.sent_id = 0""")
cte("tok", r"SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS ws FROM mdocs)")
cte("members", "SELECT w.doc_id, w.size, w.start_sentence, w.end_sentence, w.word_count AS window_words, s.sent_id, s.text, s.word_count FROM rolling w JOIN sents s ON s.doc_id = w.doc_id AND s.sent_id BETWEEN w.start_sentence AND w.end_sentence")
