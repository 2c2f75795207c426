"""Divergence of the sources of each language: an Arrow pipeline counts terms, columnar shards compare their shares.

Terms are runs of letters and of anything beyond ASCII, with A-Z lower-cased. Inside ``mapInArrow`` a block of texts goes through
``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and two hash ``group_by``: occurrences per document and term, then
occurrences and documents per (language, source, term). A task merges its blocks and hands on at most ``HELD`` rows at a time, and Spark
adds them up: first by (language, source, term), so that a term that all texts hold is one row per source, then by (language, term).
The kept terms lie in a table in the shared folder.

A share is 1 + floor(10**9 * (count + 1) / (all counts + number of kept terms)). With p the group's share and q the other's, a
term diverges by floor((p - q)**2 / q). All arithmetic is in integers. For two sources the sum over all kept terms is

* for terms of one of them: a histogram of its counts against the other's share of nothing,
* for terms of neither: their number times one value,
* for terms of both: a correction, found in the shards, where the rows of one (language, term) stand together.

So no row is made for a term that a source does not have, and terms of few sources cost little. The rows of one term meet in pairs of
sources, block by block: every pair of sources is a row of the result anyway.

Defined cases: null text, language or source is empty text; a group without terms still takes part, with count 0 everywhere; a language that
keeps no term has pairs of value 0; repeated rows are documents each; an empty table gives no rows; only text, lang and source are read,
so other columns cannot clash; ties go to the smaller item in UTF-8 order; long texts are split whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrain.llm import common

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
HELD = 1 << 18  # rows that a task merges before it hands them on
PAIRS = 1 << 20  # pairs that are compared at a time
COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def _summed(tables: list[pa.Table], keys: list[str], values: list[str]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(keys).aggregate([(v, "sum") for v in values])
    return out.select(keys + [f"{v}_sum" for v in values]).rename_columns(keys + values)


def _terms(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents of each term in each group of a block of documents; the empty term marks that a group is there."""
    words = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    doc, term = pc.list_parent_indices(words), pc.list_flatten(words)
    held = pc.not_equal(term, "")
    coded = term.filter(held).dictionary_encode()
    each = pa.table({"doc": doc.filter(held), "code": coded.indices}).group_by(["doc", "code"]).aggregate([("code", "count")])
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    group = pair[each["doc"].to_numpy()]
    both = pa.table({"group": group, "code": each["code"], "n": each["code_count"], "docs": np.ones(len(group), np.int64)}).group_by(["group", "code"]).aggregate([("n", "sum"), ("docs", "sum")])
    there = np.unique(pair)
    group = np.append(both["group"].to_numpy(), there)
    none = np.zeros(len(there), np.int64)
    names = pa.concat_arrays([coded.dictionary.take(both["code"].combine_chunks()), pa.array([""] * len(there), text.type)])
    columns = [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), names]
    return pa.table([*columns, pa.array(np.append(both["n_sum"].to_numpy(), none)), pa.array(np.append(both["docs_sum"].to_numpy(), none))], names=["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for batch in batches:
        lang, source, text = (pc.fill_null(c, "") for c in batch.columns)
        _, off = common.utf8(text)
        for i, j in common.chunks(off, 1 << 22):
            kept.append(_terms(*(c.slice(i, j - i) for c in (lang, source, text))))
            size += len(kept[-1])
            if size > HELD:
                kept = [_summed(kept, ["lang", "source", "term"], ["n", "docs"])]
                size = len(kept[0])
                if size > HELD // 2:
                    yield from kept.pop().to_batches()
                    size = 0
    if kept:
        yield from _summed(kept, ["lang", "source", "term"], ["n", "docs"]).to_batches()


def counts(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, source, term, n, total, first): the kept terms with their count in the source and in the language, on one row of each term
    ``first`` is 1; the empty term, with count 0, stands for every group."""
    text = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*text).mapInArrow(_counted, COUNTS)
    summed = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    seen = summed.select("lang", "source", "term", "n", F.sum("docs").over(w).alias("docs"), F.sum("n").over(w).alias("total"), F.row_number().over(w.orderBy("source")).alias("at"))
    kept = seen.where((F.col("docs") >= least) | (F.col("term") == ""))
    return common.stored(kept.select("lang", "source", "term", "n", "total", F.when((F.col("at") == 1) & (F.col("term") != ""), 1).otherwise(0).alias("first")))


def _share(count, size: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / size), exactly; null for an empty size."""
    large = (F.lit(count) if isinstance(count, int) else count).cast("decimal(20,0)") + 1
    size = F.when(size > 0, size).cast("decimal(20,0)")
    return (1 + F.call_function("div", large * UNIT, size)).cast("long")


def _apart(p, q) -> Column:
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def sizes(held: DataFrame) -> DataFrame:
    """(lang, source, held, size, kept, whole, p0): terms and occurrences of each group, terms and occurrences of its language, and its
    share of a term that it does not have."""
    w = Window.partitionBy("lang")
    terms = F.sum(F.when(F.col("term") != "", 1).otherwise(0))
    groups = held.groupBy("lang", "source").agg(terms.alias("held"), F.sum("n").alias("size"), F.sum("first").alias("firsts"))
    groups = groups.select("lang", "source", "held", "size", F.sum("firsts").over(w).alias("kept"), F.sum("size").over(w).alias("whole"))
    return common.stored(groups.withColumn("p0", _share(0, F.col("size") + F.col("kept"))))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _corrections(t: pa.Table) -> Iterator[pa.Table]:
    """(lang, source, item, value) of the pairs of sources that share a term, where ``t`` holds whole terms in order."""
    langs, terms, sources = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
    lang, term, source = (x.indices.to_numpy() for x in (langs, terms, sources))
    p, p0 = t["p"].to_numpy(), t["p0"].to_numpy()
    edge = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])))
    length = np.diff(np.append(edge, len(t)))
    start, mates = np.repeat(edge, length), np.repeat(length, length)
    ends = np.cumsum(mates)
    i = 0
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        many = mates[i:j]
        a = np.repeat(np.arange(i, j), many)
        b = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[i:j], many)
        a, b = a[a != b], b[a != b]
        value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
        sums = pa.table({"lang": lang[a], "source": source[a], "item": source[b], "value": value}).group_by(["lang", "source", "item"]).aggregate([("value", "sum")])
        named = [d.dictionary.take(sums[c].combine_chunks()) for d, c in ((langs, "lang"), (sources, "source"), (sources, "item"))]
        yield pa.table([*named, sums["value_sum"]], names=["lang", "source", "item", "value"])
        i = j


def _highest(t: pa.Table, most: int) -> pa.Table:
    """The rows of the ``most`` highest values of each (lang, source), ties to the smaller item."""
    t = t.sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"), ("item", "ascending")]).combine_chunks()
    lang, source = (t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "source"))
    edge = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (source[1:] != source[:-1])))[: len(t)]
    rank = np.arange(len(t)) - np.repeat(edge, np.diff(np.append(edge, len(t))))
    return t.filter(pa.array(rank < most))


def _diverging(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, p, p0, q), whole terms together in order, to the parts of the result that this shard holds."""
    keys = ["lang", "source", "item"]
    pairs, tops, rest = [], [], None

    def named(t: pa.Table, part: str):
        t = t.add_column(2, "part", pa.array([part] * len(t), pa.string()))
        return t.select(["lang", "source", "part", "item", "value"]).to_batches()

    def take(t: pa.Table):
        p, q = t["p"].to_numpy(), t["q"].to_numpy()
        own = t.select(["lang", "source"]).append_column("item", t["term"]).append_column("value", pa.array(_f(p, q)))
        tops.append(own.filter(pa.array(p > q)))
        pairs.extend(_corrections(t))

    def cut(held: list, merge, part: str):
        if sum(map(len, held)) > HELD:
            held[:] = [merge(held)]
            if len(held[0]) > HELD // 2:
                yield from named(held.pop(), part)

    def summed(x):
        return _summed(x, keys, ["value"])

    def highest(x):
        return _highest(pa.concat_tables(x), most)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        same = pc.and_(pc.equal(t["lang"], t["lang"][-1]), pc.equal(t["term"], t["term"][-1]))
        n = len(t) - int(pc.sum(same).as_py())
        rest = t.slice(n)  # the last term may go on in the next batch
        if n:
            take(t.slice(0, n))
            yield from cut(pairs, summed, "pair")
            yield from cut(tops, highest, "term")
    if rest is not None:
        take(rest)
    if pairs:
        yield from named(summed(pairs), "pair")
    if tops:
        yield from named(highest(tops), "term")


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every other one of its language, and its ``most`` terms that
    stand out against the language."""
    held = counts(docs, least)
    groups = sizes(held)
    terms = held.where("term <> ''").join(groups, ["lang", "source"])
    shares = terms.select("lang", "source", "term", _share(F.col("n"), F.col("size") + F.col("kept")).alias("p"), "p0", _share(F.col("total"), F.col("whole") + F.col("kept")).alias("q"))
    shards = common.stored(shares.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lambda b: _diverging(b, most), PARTS))

    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held2"), F.col("p0").alias("q0"))
    bars = held.where("term <> ''").groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    bars = bars.select("lang", "source", "m", "p0", _share(F.col("n"), F.col("size") + F.col("kept")).alias("p"))
    exact = "decimal(38,0)"
    met = bars.join(other, "lang").where("source <> item")
    own = F.struct("source", "item", (F.col("m").cast("decimal(18,0)") * _apart("p", "q0")).cast(exact).alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m").cast("decimal(18,0)") * _apart("q0", "p")).cast(exact).alias("value"))
    single = met.select("lang", F.inline(F.array(own, back)))
    neither = (F.col("kept") - F.col("held") - F.col("held2")).cast("decimal(18,0)") * F.coalesce(_apart("p0", "q0"), F.lit(0))
    none = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", neither.cast(exact).alias("value"))
    shared = shards.where("part = 'pair'").select("lang", "source", "item", F.col("value").cast(exact).alias("value"))
    pair = none.union(single).union(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    term = ranked(shards.where("part = 'term'").select("lang", "source", "item", "value"), "term").where(F.col("rank") <= most)
    return ranked(pair, "pair").union(term)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents", "text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS size FROM a GROUP BY lang, source),
p AS (
  SELECT a.lang, a.source, a.term, a.n, 1 + (1000000000::HUGEINT * (a.n + 1)) // (s.size + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (a.total + 1)) // (v.whole + v.v)::HUGEINT AS q
  FROM a JOIN s USING (lang, source) JOIN v USING (lang)
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
