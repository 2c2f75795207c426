"""Column expressions shared by the operators. All of them run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegrain.dims import fixed

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def _edge(m: re.Match) -> str:
    """The cheapest assertion for one word boundary: which side is a word shows from its neighbours."""
    before, after = m.string[: m.start()][-1:], m.string[m.end():][:1]
    word_before = before.isalnum() or before == ")"
    if not word_before and (after.isalnum() or (after and after in "(\\")):
        return f"(?<!{_WORD})"
    if word_before and not (after.isalnum() or after == "\\"):
        return f"(?!{_WORD})"
    return _EDGE


_PHRASE = r"[A-Za-z0-9](?:[A-Za-z0-9 '—-]|\\[^A-Za-z0-9])*"


def _ahead(pattern: str) -> str:
    """A look at the first letter, which most places fail, for a list of phrases or one phrase between word boundaries."""
    m = re.fullmatch(rf"\\b(?:\((?:\?:)?)?({_PHRASE}(?:\|{_PHRASE})*)\)?\\b", pattern)
    if not m or ("(" in pattern) != (")" in pattern) or ("|" in pattern and "(" not in pattern):
        return ""
    return "(?=[" + "".join(sorted({w[0] for w in re.findall(_PHRASE, m[1])})) + "])"


def rx(pattern: str, ignore_case: bool = True) -> str:
    """Adapt a pattern for the JVM: word boundaries look at ASCII word characters only."""
    return ("(?i)" if ignore_case else "") + _ahead(pattern) + re.sub(r"\\b", _edge, pattern)


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(rx(pattern, ignore_case))


def first_match(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Text of the first match, empty when there is none."""
    return F.regexp_extract(c, rx(pattern, ignore_case), 0)


def match_count(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(c, F.lit(rx(pattern, ignore_case)))


def literals(pattern: str) -> list[str]:
    """The lower-case words of a plain list of words, one of which every match holds; nothing for any other expression."""
    m = re.fullmatch(r"\^?(?:\\b)?(\((?:\?:)?)?([A-Za-z' —|-]+)(\))?(?:\\b)?", pattern)
    if not m or bool(m[1]) != bool(m[3]) or (not m[1] and "|" in m[2]):
        return []
    words = m[2].lower().split("|")
    return words if all(words) else []


def holds(lower: Column, words) -> Column:
    """Whether a text, given in lower case, holds one of the words anywhere."""
    return reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in words])


def matches_held(c: Column, lower: Column, pattern: str, ignore_case: bool = True) -> Column:
    """``matches`` of a text, given in lower case as well: its words are looked for before the expression is run."""
    words = literals(pattern)
    return holds(lower, words) & matches(c, pattern, ignore_case) if words else matches(c, pattern, ignore_case)


def js_round(c: Column, digits: int) -> Column:
    """Round halves toward plus infinity, as the metrics are defined."""
    k = float(10**digits)
    return F.floor(c * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def exact_sum(c: Column) -> Column:
    """Sum of a fractional column that does not depend on the order of the rows."""
    return F.sum(c.cast("decimal(18,6)")).cast("double")


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def squeeze(c: Column) -> Column:
    """Trim and turn every run of white space into one space."""
    return F.regexp_replace(trim_ws(c), r"\s+", " ")


def canonical_text(c: Column) -> Column:
    """Text identity: no-break spaces, runs and ends of white space do not count."""
    return squeeze(F.translate(c, "\u00a0", " "))


def same_text(a: Column, b: Column) -> Column:
    return canonical_text(a) == canonical_text(b)


def count_words(c: Column) -> Column:
    """Runs without white space. Between single spaces and line ends there is one more of them than of those."""
    odd = lambda t: holds(t, ["  ", "\t", "\x0b", "\f", "\r"]) | F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" ")) | (t == "")
    n = lambda t: F.when(~odd(t), count_of(t, " ") + 1).otherwise(F.regexp_count(t, F.lit(r"\S+")))
    return let(F.replace(c, F.lit("\n"), F.lit(" ")), n)


def count_of(c: Column, sign: str) -> Column:
    """How often a sign of one byte occurs."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(sign), F.lit("")))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: what a lambda names is otherwise computed at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lens: Column, block: int = 64) -> Column:
    """The sums before each of an array of lengths, in blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda b: total(F.slice(v, b * block + 1, block)))
    before = lambda v: F.aggregate(sums(v), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    at = lambda i: F.floor(i / block).cast("int")
    return let(lens, lambda v: let(before(v), lambda b: F.transform(v, lambda _, i: F.get(b, at(i)) + total(F.slice(v, at(i) * block + 1, i % block)))))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; every character keeps its place."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ALPHA_WORD = r"([A-Za-z][A-Za-z'-]*)"


def alpha_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ALPHA_WORD), F.lit(1))


def content_words(c: Column) -> Column:
    """Distinct lower-case words of three or more letters, digits, apostrophes and hyphens."""
    clean = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s'-]", " ")
    return F.array_distinct(F.filter(words(clean), lambda w: F.length(w) > 2))


def overlap(a: Column, b: Column) -> Column:
    """Shared content words over the smaller set; 0 when either side has none."""
    def share(x, y):
        least = F.least(F.size(x), F.size(y))
        return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)

    return let(F.struct(content_words(a).alias("x"), content_words(b).alias("y")), lambda w: share(w["x"], w["y"]))


def sentence_hash(c: Column) -> Column:
    """Join key of a sentence: hash of its trimmed, lower-cased text."""
    return F.xxhash64(F.lower(trim_ws(c)))


def sentence_hash32(c: Column) -> Column:
    """The 32-bit rolling form of the hash, as eight hex digits."""
    codes = F.transform(F.split(F.lower(trim_ws(c)), ""), lambda ch: F.ascii(ch).cast("long"))
    rolled = F.aggregate(
        F.filter(codes, lambda v: v > 0),
        F.lit(5381).cast("long"),
        lambda acc, v: (acc * 33 + v).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return F.lower(F.lpad(F.hex(rolled), 8, "0"))


def heat_level(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c < 1), "none").when(c < 3, "low").when(c < 6, "medium").otherwise("high")
    )


def finish_sentence(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), r"([^.!?])$", "$1.")


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def drop_article(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), r"(?i)^(?:a|an|the)\s+", "")


def ratio(a: Column, b: Column, digits: int = 3, empty: float = 0.0) -> Column:
    return F.when(b > 0, js_round(a.cast("double") / b.cast("double"), digits)).otherwise(F.lit(empty))


def plogp(count: Column, total: Column) -> Column:
    p = count.cast("double") / total.cast("double")
    return F.when(count > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def entropy_of(counts: Column, total: Column) -> Column:
    """Shannon entropy of an array of counts against a total, three digits, 0 for nothing.

    Terms are added in ascending order of the counts, so the result does not depend on row order.
    """
    h = F.aggregate(
        F.array_sort(counts),
        F.lit(0.0),
        lambda acc, c: acc + plogp(c, total),
    )
    return F.when(total > 0, js_round(js_round(h, 9), 3)).otherwise(F.lit(0.0))


def array_counts(values: Column) -> Column:
    """Count of each distinct value of an array, by run lengths of the sorted array."""
    s = F.array_sort(values)
    return F.aggregate(
        s,
        F.struct(
            F.array().cast("array<bigint>").alias("out"),
            F.lit(None).cast("string").alias("last"),
            F.lit(0).cast("bigint").alias("n"),
        ),
        lambda acc, v: F.when(
            acc["last"].eqNullSafe(v),
            F.struct(acc["out"].alias("out"), v.alias("last"), (acc["n"] + 1).alias("n")),
        ).otherwise(
            F.struct(
                F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"]).alias("out"),
                v.alias("last"),
                F.lit(1).cast("bigint").alias("n"),
            )
        ),
        lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"]),
    )


def autocorrelation_of(n: Column, s: Column, q: Column, p: Column, first: Column, last: Column) -> Column:
    """Lag-1 autocorrelation from count, sum, sum of squares, sum of neighbour products and ends."""
    n, s, q, p, first, last = (x.cast("double") for x in (n, s, q, p, first, last))
    num = n * p - s * (F.lit(2.0) * s - first - last) + (n - 1) * s * s / n
    den = n * q - s * s
    return F.when((n < 3) | (den <= 0), F.lit(0.0)).otherwise(js_round(num / den, 3))


def opening_key(c: Column, k: int = 3) -> Column:
    """First words in lower case, letters only, joined by a space."""
    return F.array_join(
        F.transform(F.slice(words(c), 1, k), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")), " "
    )


def std_pop_of(n: Column, s: Column, q: Column) -> Column:
    """Population deviation from count, sum and sum of squares of whole numbers."""
    n, s, q = (x.cast("double") for x in (n, s, q))
    return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), n * q - s * s)) / n).otherwise(F.lit(0.0))


def three_item_lists(c: Column) -> Column:
    """Number of unbroken stretches that read "a, b, c and d".

    A stretch counts when two separators with text around them come before its last "and". Looking at
    stretches one by one keeps the work linear; one expression over the whole text would backtrack.
    """
    stretches = F.split(c, r"[.!?\n]+")
    heads = F.transform(stretches, lambda x: F.regexp_extract(x, rx(r"^(.*)\band\b"), 1))
    return F.size(F.filter(heads, lambda h: h.rlike(r"^.[^,;]*[,;].+[,;][^,;]*.$")))


def fold_replace(c: Column, rules, ignore_case: bool = True) -> Column:
    """All replacements in turn; one that begins with plain words is made only where they stand."""

    def turned(acc: Column, r) -> Column:
        new = lambda t: F.regexp_replace(t, rx(r[0], ignore_case), r[1])
        m = None if "|" in r[0] else re.match(r"(?:\\b|\^)?([A-Za-z][A-Za-z' -]*)(?=$|\\b|,)", r[0])
        return let(acc, lambda t: F.when(~F.contains(F.lower(t), F.lit(m[1].lower())), t).otherwise(new(t))) if m else new(acc)

    return reduce(turned, rules, c)


def mapping(pairs, default) -> "callable":
    """Constant lookup from a fixed dictionary, as a map literal."""
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    table = F.create_map(*flat)
    return lambda c: F.coalesce(table[c], F.lit(default))


def oppose(c: Column, template: str) -> Column:
    pattern = next(p for n, p, _ in fixed.OPPOSITION_TEMPLATES if n == template)
    return matches(c, pattern)
