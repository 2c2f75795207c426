"""Personal data by base patterns and bootstrapped contexts, in DataFrame functions only.

Base entities match four patterns; places come from the lengths of the matches and of the text between them. They seed the
method, and so do keys (kind ``key``: access key ids, hexadecimal runs of 32 to 64 digits), which are spans themselves.
The surroundings of a seed are lexical patterns: the two words before it; the words before and after it; the word before it with
the shape of the seed; what is attached to it on both sides, with its shape. So are those of every other token with digits
enough. Words are lower-cased and their digits are one ``0``; a shape keeps punctuation and tells digits, letters and mixed runs.

Patterns and instances form a bipartite graph. In each round a pattern's score is the mean confidence of its instances,
shrunk towards zero for few of them, and zero without ``support`` different sure ones: seeds, or instances that earlier rounds have
made sure. The confidence of an instance that is no seed is one minus the product of its patterns' doubts; a pattern without a
score doubts wholly. After the last round the places that a pattern of high score announces, with an instance of high
confidence, are spans of kind ``id``.

The base patterns are written so that a long run of letters or digits is read once: a match may start only where the
last one ended or where a run begins, and what follows never gives characters back. Neighbouring words come from the text
between places, whatever its length; words of more than 64 characters stand for themselves by a digest.

Defined cases: null and empty texts have no spans; repeated rows get the same spans, and their repeated contexts count as
one instance; rows are told apart by 128 bits; a null doc_id is kept; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.llm import common
from prosegrain.llm.matches import matched, once

KINDS = ("email", "ip", "card", "phone")
ADDED = "id"
_FRESH = r"(?:\G|(?<![{0}]))"
PATTERNS = {
    "email": _FRESH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _FRESH.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit; tokens are runs without white space.
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
CORE = r"[A-Za-z0-9](?:[A-Za-z0-9_.@+/-]*[A-Za-z0-9])?"
#: Entities beyond the base that seed the method.
KEY = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"


def _word(w: Column) -> Column:
    low = F.regexp_replace(F.lower(w), "[0-9]++", "0")
    return F.when(F.length(low) > 64, F.md5(low)).otherwise(low)


def _beside(before: Column, after: Column, has_last: Column, has_next: Column) -> list[Column]:
    """What is attached to a place on either side, the two words before it and the word after it; another place of its kind counts as
    the word ``0``."""
    back = F.reverse(before)
    left = lambda regex: F.reverse(F.regexp_extract(back, regex, 1))
    one, two, next_ = left(r"\A\S*+\s++(\S++)"), left(r"\A\S*+\s++\S++\s++(\S++)"), F.regexp_extract(after, r"\A\S*+\s++(\S++)", 1)
    zero = lambda w, other: F.when((w == "") & other, "0").otherwise(_word(w))
    return [
        _word(left(r"\A(\S++)")).alias("to"), zero(one, has_last).alias("one"), _word(two).alias("two"),
        _word(F.regexp_extract(after, r"\A(\S++)", 1)).alias("off"), zero(next_, has_next).alias("next"),
    ]


def _shape(value: Column) -> Column:
    mixed = F.regexp_replace(value, "(?<![A-Za-z0-9])(?:[0-9]++[A-Za-z]|[A-Za-z]++[0-9])[A-Za-z0-9]*+", "#")
    return _word(F.regexp_replace(F.regexp_replace(mixed, "[A-Za-z]++", "a"), "[0-9]++", "0"))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


_CONTEXT = ("to", "one", "two", "off", "next")


def based(docs: DataFrame) -> DataFrame:
    """docs with text non-null, and ``base``: an array of (kind, start, end, value, and what is beside), by kind as listed, then start;
    ``keys`` likewise."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    digit = F.col("text").rlike("[0-9]")
    needs = {"email": F.col("text").contains("@"), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": F.col("_digit") & F.col("text").contains("+")}
    df = once(df, _digit=digit)
    for kind in KINDS:
        df = matched(df, f"_{kind}", PATTERNS[kind], needs[kind], _beside)
    df = matched(df, "_key", KEY, F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{32}|[0-9A-F]{32}"), _beside)
    df = once(df, base=F.concat(*(_kept(k) for k in KINDS)))
    free = F.filter(_kept("key"), lambda k: ~F.exists("base", lambda b: (b["start"] < k["end"]) & (k["start"] < b["end"])))
    return once(df, keys=free).drop("_key", *(f"_{k}" for k in KINDS))


def _kept(kind: str) -> Column:
    valid = F.filter(f"_{kind}", lambda x: _valid(kind, x["value"]))
    return F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), *(x[c].alias(c) for c in ("start", "end", "value", *_CONTEXT))))


def occurrences(df: DataFrame) -> DataFrame:
    """``based`` rows with an array ``seen`` of (start, end, value, seed, and what is beside): base entities, keys, and other tokens with
    digits, which count if their core has six characters and four digits.
    """
    df = matched(df, "_token", TOKEN, F.col("_digit"), _beside)
    fields = lambda t: [t[c].alias(c) for c in _CONTEXT]
    seeds = F.transform(F.concat("base", "keys"), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), F.lit(True).alias("seed"), *fields(b)))
    cores = F.transform("_token", lambda t: F.struct(t["start"].alias("start"), t["value"].alias("token"), F.regexp_extract(t["value"], CORE, 0).alias("value"), *fields(t)))
    df = once(df, _core=cores)
    large = F.filter("_core", lambda t: (F.length(t["value"]) >= 6) & (F.length(F.regexp_replace(t["value"], "[^0-9]", "")) >= 4))
    df = once(df, _large=large)
    placed = F.transform("_large", _placed)
    df = once(df, _placed=placed)
    other = F.filter("_placed", lambda t: ~F.exists(F.concat("base", "keys"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return once(df, seen=F.concat(seeds, other)).drop("_token", "_core", "_large", "_placed")


def _placed(t: Column) -> Column:
    """A token's core as a place of its own, with the rest of the token beside it."""
    at = F.call_function("instr", t["token"], t["value"])
    start, end = t["start"] + at - 1, t["start"] + at - 1 + F.length(t["value"])
    before, after = F.call_function("left", t["token"], at - 1), F.substring(t["token"], at + F.length(t["value"]), F.length(t["token"]))
    return F.struct(
        start.alias("start"), end.alias("end"), t["value"].alias("value"), F.lit(False).alias("seed"), _word(before).alias("to"),
        t["one"].alias("one"), t["two"].alias("two"), _word(after).alias("off"), t["next"].alias("next"),
    )


def patterns(seen: DataFrame) -> DataFrame:
    """seen with a row for each pattern around each occurrence, in a column ``pattern``."""
    there = lambda *names: reduce(Column.__and__, (F.col(n) != "" for n in names))
    named = lambda kind, *parts: F.concat_ws("\n", F.lit(kind), *parts)
    shape = _shape(F.col("value"))
    around = F.array(
        F.when(there("one", "two"), named("words before", "two", "one", "to")), F.when(there("one", "next"), named("words around", "one", "to", "off", "next")),
        F.when(there("one"), named("word and shape", "one", "to", shape)), F.when(there("to"), named("attached", "to", "off", shape)),
    )
    return seen.withColumn("pattern", F.explode(F.array_compact(around)))


def bootstrapped(seen: DataFrame, rounds: int = 3, support: int = 3, sure: float = 0.8, shrink: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(pattern, score) and (value, confidence) of all that reach ``sure``, from occurrences (value, seed, and what is beside)."""
    edges = common.stored(patterns(seen).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    known = edges.groupBy("value").agg(F.max("seed").cast("double").alias("confidence"))
    used = [edges]
    for _ in range(rounds):
        rated = edges.join(known, "value").groupBy("pattern")
        certain = F.count(F.when(F.col("confidence") >= sure, 1))
        rated = rated.agg((F.sum(F.col("confidence").cast("decimal(30,18)")).cast("double") / (F.count("*") + shrink)).alias("score"), certain.alias("certain"))
        scores = common.stored(rated.where(F.col("certain") >= support).select("pattern", "score"))
        doubt = F.exp(F.sum(F.log(1 - F.least(F.coalesce("score", F.lit(0.0)), F.lit(1 - 1e-9)))))
        known = common.stored(edges.join(scores, "pattern", "left").groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(F.round(1 - doubt, 9)).alias("confidence")))
        used += [scores, known]
    for done in used[:-2]:
        common.release(done)
    return scores.where(F.col("score") >= sure), known.where(F.col("confidence") >= sure)


def _row_key(df: DataFrame) -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(df["doc_id"].cast("string"), F.lit("")), F.coalesce(df["text"], F.lit("")))))


def added(rows: DataFrame, **how) -> DataFrame:
    """(row, added): the arrays of (start, end) that bootstrapping finds in rows of (row, seen)."""
    seen = common.stored(rows.select("row", F.inline("seen")))
    scores, known = bootstrapped(seen.drop("row"), **how)
    there = patterns(seen.where("not seed")).join(scores.select("pattern"), "pattern", "left_semi").join(known.select("value"), "value", "left_semi")
    out = common.stored(there.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("added")))
    common.release(seen)
    return out


def found(docs: DataFrame, **how) -> DataFrame:
    """doc_id, base (kind, start, end) and all spans of every row."""
    rows = occurrences(based(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])))
    rows = common.stored(rows.select("doc_id", _row_key(rows).alias("row"), _bare("base").alias("base"), _bare("keys").alias("keys"), "seen"))
    out = rows.join(added(rows.where(F.size("seen") > 0), **how), "row", "left")
    return out.select("doc_id", "base", F.concat("base", "keys", _named_added()).alias("spans"))


def _bare(spans: str) -> Column:
    return F.transform(spans, lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))


def _named_added() -> Column:
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.transform(F.coalesce("added", none), lambda a: F.struct(F.lit(ADDED).alias("kind"), a["start"].alias("start"), a["end"].alias("end")))


def _is(kind: str):
    return lambda b: b["kind"] == kind


def _listed(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(docs: DataFrame, **how) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans."""
    out = found(docs, **how)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def masked(docs: DataFrame, **how) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; spans that overlap are replaced once."""
    names = docs.columns
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = occurrences(based(plain))
    rows = common.stored(rows.where(F.size("seen") > 0).select(_row_key(rows).alias("row"), F.concat(_bare("base"), _bare("keys")).alias("plain"), "seen"))
    ordered = F.transform(F.concat("plain", _named_added()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = rows.join(added(rows, **how), "row", "left").select("row", F.array_sort(ordered).alias("spans")).where(F.size("spans") > 0)
    spans = common.stored(spans.dropDuplicates(["row"]))
    common.release(rows)
    marked = docs.select(F.struct(*(docs[c].alias(c) for c in names)).alias("doc"), _row_key(docs).alias("row")).join(spans, "row", "left")
    text = F.coalesce(F.col("doc")["text"], F.lit(""))

    def step(acc, s):
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return (
            F.when(s["end"] <= acc["at"], acc)
            .when(s["start"] < acc["at"], F.struct(acc["parts"].alias("parts"), s["end"].alias("at")))
            .otherwise(F.struct(F.concat(acc["parts"], piece).alias("parts"), s["end"].alias("at")))
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    new = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return marked.select(*(F.when(F.size("spans") > 0, new).otherwise(F.col("doc")["text"]).alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in names))


def op5_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"))
