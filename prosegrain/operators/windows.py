"""Rolling windows of sentences, entropies and diversity measures, density checks and hot regions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stack

SENT = ["doc_id", "sent_id"]
WIN = ["doc_id", "size", "start_sentence"]


def rolling_windows(s: DataFrame, sets=fixed.WINDOW_SETS) -> DataFrame:
    """(doc_id, size, start_sentence, end_sentence, word_count) of the three window sets.

    A window is the sentences whose words-before count lies within the target after the start. That
    is a range frame over the running word count, so one shuffle by document is all it takes.
    """
    rows = Window.partitionBy("doc_id").orderBy("sent_id")
    cum = s.select(*SENT, F.col("word_count").cast("bigint").alias("wc")).withColumn(
        "before", F.coalesce(F.sum("wc").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    )
    by_words = Window.partitionBy("doc_id").orderBy("before")
    cells = []
    for name, least, target, step in sets:
        frame = by_words.rangeBetween(0, target - 1)
        cum = cum.withColumn(f"{name}_end", F.max("sent_id").over(frame)).withColumn(f"{name}_wc", F.sum("wc").over(frame))
        ok = (F.col("sent_id") % step == 0) & ((F.col(f"{name}_wc") >= least) | (F.col("sent_id") == 0))
        cells.append(
            F.when(ok, F.struct(F.lit(name).alias("size"), F.col(f"{name}_end").alias("end"), F.col(f"{name}_wc").alias("wc")))
        )
    return cum.select(
        "doc_id", F.col("sent_id").alias("start_sentence"),
        F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("w"),
    ).select(
        "doc_id", F.col("w.size").alias("size"), "start_sentence", F.col("w.end").alias("end_sentence"),
        F.col("w.wc").alias("word_count"),
    )


def sentence_type_sums(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*SENT, "type").agg(X.exact_sum(F.col("confidence")).alias("conf"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sums over windows
#
# The windows of a size, numbered by their start, have ascending starts and ends, so those that hold a sentence are a run of
# numbers. What a sentence adds to its windows is one change at the run's first number and the reverse after its last one;
# a running sum over the numbers gives every window's total. Windows are never multiplied by what is in them. Sentences and the
# ends of windows share one order within the document, so one shuffle by document is enough.

SIZE = ["doc_id", "size"]
NAMES = [x[0] for x in fixed.WINDOW_SETS]


def reached(w: DataFrame, rows: DataFrame) -> DataFrame:
    """The starts of the windows, and rows(doc_id, sent_id, …), in one table partitioned by document.

    A row has itself as ``row``, and ``first`` and ``after``: by window size, in the order of NAMES, the number of the first window that
    holds its sentence and the number after the last. A window has (size, i, start_sentence, end_sentence, word_count), i its number.
    """
    packed = rows.select("doc_id", F.col("sent_id").alias("pos"), F.lit(1).alias("k"), F.struct(*rows.columns).alias("row"))
    fact = ["size", "start_sentence", "end_sentence", "word_count"]
    ends = F.array(*(F.struct(F.col(c).alias("pos"), F.lit(k).alias("k")) for c, k in (("start_sentence", 0), ("end_sentence", 2))))
    both = stack(packed, w.select("doc_id", *fact, F.inline(ends)), missing=True)
    so_far = Window.partitionBy("doc_id").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda k, n: F.sum(F.when((F.col("k") == k) & (F.col("size") == n), 1).otherwise(0)).over(so_far)
    both = both.withColumns({"first": F.array(*(count(2, n) for n in NAMES)), "after": F.array(*(count(0, n) for n in NAMES))})
    i = F.get("after", F.array_position(F.array(*map(F.lit, NAMES)), F.col("size")).cast("int") - 1) - 1
    return both.filter("k < 2").select("doc_id", *fact, F.when(F.col("k") == 0, i).alias("i"), "row", "first", "after")


def swept(r: DataFrame, names: list[str], made, keys: list[str] | None = None) -> DataFrame:
    """Windows of ``reached`` with the totals of ``names``. ``made`` gives, for a size and its place in ``first`` and ``after``, the runs
    of a row: (a, b, {name: value}), of windows a up to, not including, b. With ``keys``, columns of the row, the changes stay apart."""
    cells = []  # (size, window, sign, whether the run is there, values)
    for j, size in enumerate(NAMES):
        for x, y, values in made(size, j):
            cells += [(F.lit(size), x, 1, x < y, values), (F.lit(size), y, -1, x < y, values)]
    c = F.col("_cell")
    pick = lambda xs: reduce(lambda w, ix: w.when(c == ix[0], ix[1]), list(enumerate(xs))[1:], F.when(c == 0, xs[0]))
    sign = F.when(c < 0, 0).when(c % 2 == 0, 1).otherwise(-1)

    def value(n):
        found = [v.get(n) for *_, v in cells]
        if all(x is found[0] for x in found):
            return F.coalesce(sign * found[0], F.lit(0))
        return F.coalesce(pick([F.lit(0) if x is None else k * x for (_, _, k, _, _), x in zip(cells, found)]), F.lit(0))

    own = F.col("row").isNull()
    e = r.withColumn("_cell", F.explode(F.when(own, F.array(F.lit(-1))).otherwise(F.array(*map(F.lit, range(len(cells)))))))
    e = e.filter((c < 0) | pick([x[3] for x in cells]))
    size, at = (pick([x[k] for x in cells]) for k in (0, 1))
    return e.select(
        "doc_id", F.coalesce("size", size).alias("size"), F.coalesce(F.col("i"), at).cast("bigint").alias("i"), *FACTS,
        *[F.col(f"row.{k}").alias(k) for k in keys or []], *[F.when(own, F.lit(0)).otherwise(value(n)).cast("bigint").alias(n) for n in names],
    )


FACTS = ("start_sentence", "end_sentence", "word_count")


def totals(e: DataFrame, names: list[str]) -> DataFrame:
    """Windows with the running sums of the changes ``names``."""
    g = e.groupBy(*SIZE, "i").agg(*[F.max(x).alias(x) for x in FACTS], *[F.sum(n).alias(n) for n in names])
    o = Window.partitionBy(*SIZE).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select(*SIZE, *FACTS, *[F.sum(n).over(o).alias(n) for n in names]).filter("start_sentence is not null")


def entropy_changes(e: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Changes of a count per key to changes of ``m``, the sum of the counts, and ``l``, the sum of n log2 n; windows pass."""
    d = e.groupBy(*SIZE, key, "i").agg(*[F.max(x).alias(x) for x in FACTS], F.sum(value).alias("d"))
    now = F.sum("d").over(Window.partitionBy(*SIZE, key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    f = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0).cast("decimal(38,12)")
    d = d.withColumn("now", now)
    return d.select(*SIZE, "i", *FACTS, F.col("d").alias("m"), (f(F.col("now")) - f(F.col("now") - F.col("d"))).cast("decimal(38,12)").alias("l"))


def _held(**values):
    """Runs of all windows that hold the sentence."""
    return lambda size, j: [(F.get("first", F.lit(j)), F.get("after", F.lit(j)), values)]


BLOCK = 16


def covering(w: DataFrame, per: DataFrame) -> DataFrame:
    """Windows joined with the rows (doc_id, sent_id, …) that lie in them.

    Both meet by blocks of sentences, so a window is a row for each block it touches, not for each sentence.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    wide = w.withColumn("block", F.explode(F.sequence(block("start_sentence"), block("end_sentence"))))
    return wide.join(per.withColumn("block", block("sent_id")), ["doc_id", "block"]).filter(F.col("sent_id").between(F.col("start_sentence"), F.col("end_sentence"))).drop("block")


def window_type_sums(w: DataFrame, hits: DataFrame) -> DataFrame:
    """Sum of confidence and count of hits per window and type."""
    return (
        covering(w.select(*WIN, "end_sentence"), sentence_type_sums(hits))
        .groupBy(*WIN, "type")
        .agg(X.exact_sum(F.col("conf")).alias("conf"), F.sum("n").alias("n"))
    )


def pattern_density(w: DataFrame, hits: DataFrame, types=fixed.DENSITY_PATTERNS) -> DataFrame:
    """Windows with ``density MAP<type, DOUBLE>``: confidence per 100 words, zeros kept."""
    sums = window_type_sums(w, hits.filter(F.col("type").isin(types)))
    maps = sums.groupBy(*WIN).agg(F.map_from_entries(F.collect_list(F.struct("type", "conf"))).alias("m"))
    j = w.join(maps, WIN, "left")
    entries = [
        F.struct(
            F.lit(t).alias("key"),
            F.when(F.col("word_count") > 0, X.js_round(F.coalesce(F.col("m")[t], F.lit(0.0)) * (F.lit(100.0) / F.col("word_count")), 2))
            .otherwise(0.0).alias("value"),
        )
        for t in types
    ]
    return j.withColumn("density", F.map_from_entries(F.array(*entries))).drop("m")


# ---------------------------------------------------------------- entropies by any key


def entropy(counts: DataFrame, by: list[str], total: str | None = None) -> DataFrame:
    """Entropy per group of rows with a ``n`` column. ``total`` names a column to divide by.

    Uses H = log2(T) - sum(n log2 n) / T form on partial sums, so a hot group is pre-aggregated.
    """
    t = F.max(total) if total else F.sum("n")
    g = counts.groupBy(*by).agg(
        t.cast("double").alias("t"), F.sum("n").cast("double").alias("m"),
        F.sum((F.col("n") * F.log2(F.col("n").cast("double"))).cast("decimal(38,12)")).cast("double").alias("l"),
    )
    h = (F.col("m") * F.log2("t") - F.col("l")) / F.col("t")
    return g.select(*by, F.when(F.col("t") > 0, X.js_round(X.js_round(h, 9), 3)).otherwise(0.0).alias("entropy"))


def dominant_register() -> Column:
    """The first register with the highest score above zero, else the first."""
    top = F.greatest(*[F.col(d) for d in fixed.REGISTERS])
    out = F.when(top <= 0, fixed.REGISTERS[0])
    for d in fixed.REGISTERS:
        out = out.when(F.col(d) == top, d)
    return out


def register_entropy(s: DataFrame, by: list[str]) -> DataFrame:
    n = s.groupBy(*by, dominant_register().alias("register")).agg(F.count(F.lit(1)).alias("n"))
    return entropy(n, by)


def length_entropy(s: DataFrame, by: list[str]) -> DataFrame:
    n = s.groupBy(*by, (F.floor(F.col("word_count") / 5) * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return entropy(n, by)


def device_entropy(hits: DataFrame, by: list[str]) -> DataFrame:
    return entropy(hits.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n")), by)


def autocorrelation(s: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Lag-1 autocorrelation per group from five sums; the window only fetches the neighbour."""
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value).cast("double")
    d = s.select(*by, F.col(order).alias("o"), v.alias("v"), F.lead(v).over(w).alias("nx"))
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"),
        F.coalesce(F.sum(F.col("v") * F.col("nx")), F.lit(0.0)).alias("p"),
        F.min_by("v", "o").alias("a"), F.max_by("v", "o").alias("z"),
    )
    return g.select(*by, X.autocorrelation_of(*[F.col(c) for c in ("n", "s", "q", "p", "a", "z")]).alias("autocorrelation"))


def co_occurrence(hits: DataFrame, by: list[str]) -> DataFrame:
    """How often two distinct types share a sentence. ``by`` is the grouping, e.g. ["doc_id"].

    The types of a sentence are a small set, so pairs are made inside the row instead of by a self join.
    """
    keys = list(dict.fromkeys([*by, *SENT]))
    types = hits.groupBy(*keys).agg(F.array_sort(F.collect_set("type")).alias("t"))
    pairs = F.flatten(
        F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return types.select(*by, F.explode(pairs).alias("p")).groupBy(*by, F.col("p.a").alias("type_a"), F.col("p.b").alias("type_b")).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- lexical diversity


def token_stats(tokens: Column, k: int = 50) -> Column:
    """STRUCT<distinct, hapax, windows, n, …> of one array of lower-cased words.

    A single pass over the (word, position) pairs in sorted order. A token adds to the moving ratio
    the number of windows of ``k`` tokens in which it is the first of its kind. The length travels in the
    running state, because a lambda body evaluates whatever it names once per step.
    """
    pairs = F.array_sort(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    zero = F.lit(0).cast("bigint")
    init = F.struct(
        F.lit(None).cast("string").alias("last"), F.lit(-1).alias("at"), zero.alias("run"),
        zero.alias("distinct"), zero.alias("hapax"), zero.alias("windows"), F.size(tokens).alias("n"),
    )

    def step(a, x):
        same = a["last"].eqNullSafe(x["w"])
        prev = F.when(same, a["at"]).otherwise(F.lit(-1))
        add = F.greatest(F.lit(0), F.least(x["i"], a["n"] - k) - F.greatest(prev + 1, x["i"] - k + 1, F.lit(0)) + 1)
        return F.struct(
            x["w"].alias("last"), x["i"].alias("at"),
            F.when(same, a["run"] + 1).otherwise(F.lit(1).cast("bigint")).alias("run"),
            (a["distinct"] + F.when(same, 0).otherwise(1)).alias("distinct"),
            (a["hapax"] + F.when(same & (a["run"] == 1), -1).when(same, 0).otherwise(1)).alias("hapax"),
            (a["windows"] + add).alias("windows"), a["n"].alias("n"),
        )

    return F.aggregate(pairs, init, step)


def mattr_of(stats: Column, n: Column, k: int = 50) -> Column:
    whole = X.ratio(stats["distinct"], n)
    return F.when(n <= k, whole).otherwise(X.js_round(stats["windows"].cast("double") / (F.lit(k) * (n - k + 1)), 3))


def word_length_counts(ws: Column) -> Column:
    lens = F.filter(F.transform(ws, lambda w: F.length(F.regexp_replace(w, "[^a-zA-Z]", ""))), lambda n: n > 0)
    return X.array_counts(F.transform(lens, lambda n: F.lpad(n.cast("string"), 8, "0")))


def lexical_diversity(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Type-token ratio, hapax ratio, word-length entropy and function-word ratio per group.

    Words are counted first, then by their number of letters, so a hot group shrinks before it is shuffled whole; all measures
    come from one pass over the tokens.
    """
    c = F.col("c")
    counted = tokens.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("c"))
    bins = counted.groupBy(*by, F.length(F.regexp_replace("word", "[^a-zA-Z]", "")).alias("len")).agg(
        F.count(F.lit(1)).alias("d"), F.sum("c").alias("n"), F.sum(F.when(c == 1, 1).otherwise(0)).alias("h"),
        F.sum(F.when(F.col("word").isin(fixed.FUNCTION_WORDS), c).otherwise(0)).alias("f"),
    )
    n = F.when(F.col("len") > 0, F.col("n")).otherwise(0)
    bits = F.when(F.col("len") > 0, F.col("n") * F.log2(F.col("n").cast("double"))).otherwise(0.0).cast("decimal(38,12)")
    g = bins.groupBy(*by).agg(*[F.sum(x).alias(x) for x in "dnhf"], F.sum(n).alias("m"), F.sum(bits).alias("l"))
    named = reduce(Column.__and__, [F.col(x).isNotNull() for x in by])
    return g.select(
        *by, F.col("n").alias("n_tokens"), F.col("d").alias("n_types"),
        X.ratio(F.col("d"), F.col("n")).alias("ttr"), X.ratio(F.col("h"), F.col("n")).alias("hapax_ratio"),
        X.ratio(F.col("f"), F.col("n")).alias("function_word_ratio"),
        F.when(named, _entropy(F.col("m"), F.col("l"), F.col("n"))).otherwise(0.0).alias("word_length_entropy"),
    )


def mattr(tokens: DataFrame, k: int = 50) -> DataFrame:
    """Moving type-token ratio per document from tokens(doc_id, pos, word): closed form by the
    distance to the previous use of the word; linear, no window arrays."""
    w = Window.partitionBy("doc_id", "word").orderBy("pos")
    n = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    t = tokens.withColumn("prev", F.coalesce(F.lag("pos").over(w), F.lit(-1))).join(n, "doc_id")
    add = F.greatest(
        F.lit(0), F.least(F.col("pos"), F.col("n") - k) - F.greatest(F.col("prev") + 1, F.col("pos") - k + 1, F.lit(0)) + 1
    )
    g = t.groupBy("doc_id").agg(F.sum(add).alias("windows"), F.sum(F.when(F.col("prev") < 0, 1).otherwise(0)).alias("distinct"), F.max("n").alias("n"))
    return g.select("doc_id", mattr_of(F.struct("windows", "distinct"), F.col("n"), k).alias("mattr"))


def opening_variety(s: DataFrame, by: list[str]) -> DataFrame:
    g = s.groupBy(*by, X.opening_key(F.col("text")).alias("o")).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("d"), F.sum("c").alias("n")
    )
    return g.select(*by, F.when(F.col("n") <= 1, 1.0).otherwise(X.ratio(F.col("d"), F.col("n"))).alias("opening_variety"))


def _entropy(m: Column, l: Column, t: Column) -> Column:
    t = t.cast("double")
    return F.when(t > 0, X.js_round(X.js_round((m.cast("double") * F.log2(t) - l.cast("double")) / t, 9), 3)).otherwise(0.0)


def window_metrics(w: DataFrame, s: DataFrame, hits: DataFrame) -> DataFrame:
    """All per-window measures. A window holds at most its word budget, so each is one small row.

    The sentences of a document travel once, and windows are measured from them in its row: text is not multiplied at all.
    """
    types = hits.groupBy(*SENT).agg(F.sort_array(F.collect_list("type")).alias("types"))
    cols = s.select(
        *SENT, "text", "word_count", dominant_register().alias("register"), X.opening_key(F.col("text")).alias("opening")
    ).join(types, SENT, "left")
    row = F.struct("sent_id", "text", "word_count", "register", "opening", "types")
    own = w.groupBy("doc_id").agg(F.collect_list(F.struct("size", "start_sentence", "end_sentence", F.col("word_count").alias("n_words"))).alias("ws"))
    d = cols.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("all")).join(own, "doc_id")
    ss = F.transform("all", lambda x: F.struct(
        x["sent_id"].cast("bigint").alias("sent_id"), x["word_count"].cast("double").alias("word_count"), x["register"].alias("register"), x["opening"].alias("opening"),
        F.coalesce(x["types"], F.array().cast("array<string>")).alias("types"), x["text"].cast("binary").alias("text"), F.lower(x["text"]).cast("binary").alias("lower")))
    kept = [StructField(c, w.schema[c].dataType) for c in [*WIN, "end_sentence", "word_count"]]
    return d.select("doc_id", "ws", ss.alias("all")).mapInArrow(_measured, StructType([*kept, *(StructField(m, DoubleType()) for m in MEASURES)]))


MEASURES = (
    "register_entropy", "length_entropy", "device_entropy", "autocorrelation", "ttr", "hapax_ratio", "word_length_entropy", "opening_variety",
    "function_word_ratio",
)
_FUNCTION_WORDS = frozenset(w.encode() for w in fixed.FUNCTION_WORDS)
_NO_LETTERS = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ws, all -> the measures of each window that holds a sentence."""
    for batch in batches:
        ws, ss = (batch.column(i).flatten() for i in (1, 2))
        w_at, s_at = (np.append(0, np.cumsum(pc.list_value_length(batch.column(i)).to_numpy())) for i in (1, 2))
        col = {f.name: ss.field(i) for i, f in enumerate(ss.type)}
        start, end = (ws.field(i).to_numpy() for i in (1, 2))
        sent_id, counts = col["sent_id"].to_numpy(), col["word_count"].to_numpy(zero_copy_only=False)
        register, opening = (_codes(col[c]) for c in ("register", "opening"))
        hits, h_at = _codes(col["types"].flatten()), np.append(0, np.cumsum(pc.list_value_length(col["types"]).to_numpy()))
        keep, out = [], []
        for i in range(len(batch)):
            a, b = s_at[i], s_at[i + 1]
            own = slice(w_at[i], w_at[i + 1])
            lo, hi = np.searchsorted(sent_id[a:b], start[own]), np.searchsorted(sent_id[a:b], end[own], "right")
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            keep.append(some + w_at[i])
            texts = [[t.split() for t in col[c].slice(a, b - a).to_pylist()] for c in ("text", "lower")]
            out.append(_of_document(lo[some], hi[some], counts[a:b], register[a:b], opening[a:b], hits[h_at[a] : h_at[b]], h_at[a : b + 1] - h_at[a], *texts))
        rows = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        of = pa.array(np.searchsorted(w_at, rows, "right") - 1, pa.int64())
        chosen = ws.take(pa.array(rows, pa.int64()))
        values = np.concatenate(out, axis=1) if out else np.zeros((len(MEASURES), 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(of), *(chosen.field(i) for i in range(4)), *map(pa.array, values)], names=[*WIN, "end_sentence", "word_count", *MEASURES]
        )


def _codes(c: pa.Array) -> np.ndarray:
    """A number for each value; null is one of them."""
    return pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy()


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _rounded(a / np.maximum(b, 1), 3) * (b > 0)


def _entropies(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Entropy of the codes in each range; those below 0 count in the total only. Terms are added in ascending order of the counts."""
    found = np.unique(codes[codes >= 0])
    n = np.zeros((len(found), len(lo)), np.int64)
    for k, c in enumerate(found):
        sums = np.append(0, np.cumsum(codes == c))
        n[k] = sums[hi] - sums[lo]
    n.sort(axis=0)
    total, h = np.maximum(hi - lo, 1), np.zeros(len(lo))
    for c in n:
        p = np.where(c > 0, c, total) / total
        h += -p * (np.log(p) / np.log(2.0))
    return _rounded(_rounded(h, 9), 3) * (hi > lo)


def _kinds(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """How many codes stand in each range, and how many only once: by the places of the same code before and after, about ``most`` at a time."""
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    kinds, single = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    sizes = np.append(0, np.cumsum(hi - lo))
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + most, "right")) - 1)
        lens = hi[i:j] - lo[i:j]
        edges = sizes[i : j + 1] - sizes[i]
        at = np.arange(edges[-1]) + np.repeat(lo[i:j] - edges[:-1], lens)
        first = before[at] < np.repeat(lo[i:j], lens)
        for total, flags in ((kinds, first), (single, first & (after[at] >= np.repeat(hi[i:j], lens)))):
            sums = np.append(0, np.cumsum(flags))
            total[i:j] = sums[edges[1:]] - sums[edges[:-1]]
        i = j
    return kinds, single


def _of_document(lo, hi, counts, register, opening, hits, h_at, texts: list[list[bytes]], lowers: list[list[bytes]]) -> np.ndarray:
    """MEASURES of the ranges lo to hi of a document's sentences; ``hits`` of sentence i are those from h_at[i] to h_at[i + 1]."""
    at = np.append(0, np.cumsum([len(x) for x in lowers]))
    numbers: dict[bytes, int] = {}
    letters: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(x, len(numbers)) for y in lowers for x in y], np.int64)
    for x in {x for y in texts for x in y}:
        letters[x] = len(x.translate(None, _NO_LETTERS)) or -1
    lens = np.array([letters[x] for y in texts for x in y], np.int64)
    common = np.array([x in _FUNCTION_WORDS for x in numbers], bool)
    grammar = np.append(0, np.cumsum(common[words])) if len(words) else np.zeros(1, np.int64)
    a, b, k = at[lo], at[hi], hi - lo
    n = b - a
    kinds, single = _kinds(words, a, b)
    s, q, p = (np.append(0.0, np.cumsum(x)) for x in (counts, counts * counts, np.append(counts[:-1] * counts[1:], 0.0)))
    s, q, p = s[hi] - s[lo], q[hi] - q[lo], p[hi - 1] - p[lo]
    den = k * q - s * s
    num = k * p - s * (2.0 * s - counts[lo] - counts[hi - 1]) + (k - 1) * s * s / k
    flat = (k < 3) | (den <= 0)
    return np.stack([
        _entropies(register, lo, hi), _entropies(np.unique(np.floor(counts / 5), return_inverse=True)[1], lo, hi), _entropies(hits, h_at[lo], h_at[hi]),
        np.where(flat, 0.0, _rounded(num / np.where(flat, 1.0, den), 3)), _share(kinds, n), _share(single, n), _entropies(lens, a, b),
        np.where(k <= 1, 1.0, _share(_kinds(opening, lo, hi)[0], k)), _share(grammar[b] - grammar[a], n),
    ])


def window_device_entropy(w: DataFrame, hits: DataFrame) -> DataFrame:
    """Device entropy per window; 0 where a window has no hit."""
    e = swept(reached(w, hits.select(*SENT, "type")), ["n"], _held(n=F.lit(1)), ["type"])
    g = totals(entropy_changes(e, "type"), ["m", "l"])
    return g.select(*WIN, "end_sentence", "word_count", _entropy(F.col("m"), F.col("l"), F.col("m")).alias("device_entropy"))


def convergence(w: DataFrame) -> DataFrame:
    """Slope of device entropy over the medium windows of a document; 0 below two windows."""
    m = w.filter("size = 'medium'").withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_sentence")) - 1)
    i, y = F.col("i").cast("double"), F.col("device_entropy")
    g = m.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(i).alias("sx"), X.exact_sum(y).alias("sy"), X.exact_sum(i * y).alias("sxy"), F.sum(i * i).alias("sxx")
    )
    n = F.col("n").cast("double")
    slope = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (n * F.col("sxx") - F.col("sx") * F.col("sx"))
    return g.select("doc_id", F.when(F.col("n") < 2, 0.0).otherwise(X.js_round(X.js_round(slope, 9), 4)).alias("convergence_slope"))


# ---------------------------------------------------------------- density checks


def density_violations(w: DataFrame, hits: DataFrame, thresholds: DataFrame, registry: DataFrame, genre: str = "general") -> DataFrame:
    """Windows in which a pattern's confidence sum is over its limit.

    The level of a pattern picks the window set, so hits only meet windows of that set.
    """
    level_window = X.mapping(fixed.LEVEL_WINDOW, "medium")
    lim = thresholds.join(registry.select("type", "level", F.coalesce(F.col("tolerance")[genre], F.lit(1.0)).alias("tol")), "type", "left")
    lim = lim.select("type", "window_words", "max_count", "unit", F.coalesce("tol", F.lit(1.0)).alias("tol"),
                     level_window(F.coalesce("level", F.lit("sentence"))).alias("wanted"))
    per = sentence_type_sums(hits.join(lim.select("type"), "type", "left_semi"))
    sums = (
        covering(w.filter(F.col("size").isin(sorted(set(fixed.LEVEL_WINDOW.values()) | {"medium"}))), per.join(lim, "type"))
        .filter(F.col("size") == F.col("wanted"))
        .groupBy("type", *WIN, "end_sentence", "word_count", "window_words", "max_count", "unit", "tol")
        .agg(X.exact_sum(F.col("conf")).alias("total"))
    )
    span = F.when(F.col("unit") == "per_1000_words", F.lit(1000.0)).otherwise(F.greatest(F.lit(1), F.col("window_words")).cast("double"))
    allowed = F.when(F.col("tol") == 0, 0.0).otherwise(F.col("max_count") * F.col("tol") * (F.col("word_count") / span))
    return (
        sums.withColumn("allowed", allowed)
        .filter((F.col("word_count") > 0) & (F.col("total") > F.col("allowed") + 1e-6))
        .select("doc_id", "type", "size", "start_sentence", "end_sentence", "word_count", F.col("total").alias("total"),
                X.js_round(F.col("allowed"), 3).alias("max_allowed"))
    )


def violation_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("violations"))


def word_windows(tokens: DataFrame, size: int, stride: int) -> DataFrame:
    """(doc_id, window_id, n, types, first_pos, last_pos) of sliding windows of ``size`` words of tokens(doc_id, pos, word).

    A token is the first of its kind in the windows that start after its last use and hold it: a run of window numbers, so it is
    two changes, not a row for each window.
    """
    o = Window.partitionBy("doc_id", "word").orderBy("pos")
    at = lambda c: F.floor(c / stride).cast("bigint")
    first = F.greatest(F.lit(0), at(F.col("pos") - size) + 1, F.coalesce(at(F.lag("pos").over(o)) + 1, F.lit(0)))
    runs = tokens.select("doc_id", "pos", first.alias("a"), (at(F.col("pos")) + 1).alias("b")).filter("a < b")
    c = runs.select("doc_id", F.inline(F.array(F.struct(F.col("a").alias("window_id"), F.lit(1).alias("d")), F.struct(F.col("b").alias("window_id"), F.lit(-1).alias("d")))))
    c = c.groupBy("doc_id", "window_id").agg(F.sum("d").alias("d"))
    ids = tokens.groupBy("doc_id").agg((F.max("pos") + 1).alias("words")).select("doc_id", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), at(F.col("words") - 1))).alias("window_id"))
    so_far = Window.partitionBy("doc_id").orderBy("window_id")
    g = stack(ids, c, missing=True).groupBy("doc_id", "window_id").agg(F.max("words").alias("words"), F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    g = g.withColumn("types", F.sum("d").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("words is not null")
    start = F.col("window_id") * stride
    last = F.least(start + size, F.col("words")) - 1
    return g.select("doc_id", "window_id", (last - start + 1).alias("n"), "types", start.alias("first_pos"), last.alias("last_pos"))


# ---------------------------------------------------------------- hot regions


def hot_regions(s: DataFrame, hits: DataFrame, registry: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Runs of two or more hot sentences with mean heat, top three types and a description."""
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    hot = s.filter(F.col("heat") >= threshold).select(*SENT, "heat")
    hot = hot.withColumn("g", F.col("sent_id") - F.row_number().over(w))
    reg = hot.groupBy("doc_id", "g").agg(
        F.min("sent_id").alias("start_sentence"), F.max("sent_id").alias("end_sentence"),
        F.count(F.lit(1)).alias("n"), X.exact_sum(F.col("heat")).alias("h"),
    ).filter("n >= 2")
    avg = F.col("h") / F.col("n")
    reg = reg.withColumn("avg", X.js_round(avg, 9))
    names = registry.select("type", "name")
    c = hot.join(hits, SENT).groupBy("doc_id", "g", "type").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("sent_id", "hit_pos")).alias("o")
    ).join(names, "type", "left")
    top = c.groupBy("doc_id", "g").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "o", "type", F.coalesce("name", F.replace(F.col("type"), F.lit("_"), F.lit(" "))).alias("name")))), 1, 3).alias("top")
    )
    j = reg.join(top, ["doc_id", "g"], "left")
    sev = F.when(F.col("avg") >= 7, "High").when(F.col("avg") >= 5, "Moderate").otherwise("Mild")
    who = F.coalesce(F.array_join("top.name", ", "), F.lit(""))
    return j.select(
        "doc_id", "start_sentence", "end_sentence", X.js_round(F.col("avg"), 1).alias("heat"),
        F.coalesce(F.col("top.type"), F.array().cast("array<string>")).alias("primary_patterns"),
        F.concat(sev, F.lit(" structural clustering across "), F.col("n").cast("string"), F.lit(" sentences: "),
                 F.when(who == "", "general uniformity").otherwise(who)).alias("description"),
    )


def hot_singles(s: DataFrame, threshold: float = 2.2, k: int = 4) -> DataFrame:
    """The first ``k`` sentences of a document at or above the threshold."""
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    return s.filter(F.col("heat") >= threshold).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select(*SENT, "heat")
