"""Secrets in every version of a corpus, by an incremental ledger of blobs. DataFrame functions only.

A version's content is addressed by the SHA-256 of its text; equal texts are one blob, however many paths hold it. A rule's version is a
digest of all that decides its matches, so a changed rule is a new one. The ledger lies in the shared folder as two tables: ``scans``
(which rule versions a blob has been scanned by) and ``findings`` (blob, rule version, kind, start, end). A delivery of
versions is hashed, its blobs are held against the ledger, and only unseen pairs of a blob and a rule version are scanned.
The findings of a blob, old and new, are joined back to all paths that hold it.

A rule names what every match of it needs (``needs``, literal words or a short expression). A text without them is settled by that test in
the pass that hashes, and does not travel; the others meet by blob, one text each, before they are scanned.

Findings are written before the scans that vouch for them, and read without repeats: a delivery that was cut short may be sent again.

Kinds, in this order: ``assign`` (a value of six characters or more given to a password, secret, token or key), ``access`` (an access key
id), ``hex`` (24 hexadecimal digits or more), then those beyond the base: ``private`` (the armour of a private key),
``web`` (a signed web token), ``hub`` (tokens of code hosts and chats by their prefixes), ``login`` (a password in an address).

Defined cases: null text is empty; a null path is kept; repeated rows have the same findings; an empty table gives no rows; the input's
columns may have any names; a text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrain.llm import common, matches

BASE = ("assign", "access", "hex")
FOUND = "array<struct<start:int,place:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # Java's; A-Z and a-z are the only letters that (?i) equates
    least: int  # characters of ``group``
    group: int = 0
    words: tuple[str, ...] = ()  # one of them, in lower case, stands in every match
    needs: str = ""  # an expression that fits in every match

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr((self.regex, self.least, self.group)).encode()).hexdigest()[:16]}"

    def may(self, text: Column, lower: Column) -> Column:
        held = [reduce(Column.__or__, (lower.contains(w) for w in self.words))] if self.words else []
        return reduce(Column.__and__, [*held, *([text.rlike(self.needs)] if self.needs else [])])


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", 6, 2, ("password", "passwd", "secret", "token", "apikey", "api_key"), "[:=]"),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", 20, 0, ("akia",)),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 24, 0, (), r"[0-9a-f]{24}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, 0, ("private key-----",)),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 1, 0, (".eyj",)),
    Rule("hub", r"(?:gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}+)", 1, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("login", r"://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", 1, 0, ("://",), "@"),
)


class Ledger:
    """What has been scanned and found so far, in two tables under ``path``."""

    SCANS = "blob string, rules array<string>"
    FINDINGS = "blob string, rule string, kind string, start int, end int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("scans", self.SCANS), ("findings", self.FINDINGS)):  # so that both can be read
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")

    def scans(self) -> DataFrame:
        """(blob, rules), one row per blob."""
        rows = self.spark.read.schema(self.SCANS).parquet(f"{self.path}/scans")
        return rows.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("rules"))

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings").distinct()

    def add(self, scanned: DataFrame) -> None:
        """scanned has (blob, fresh, found), found holding (rule, kind, start, end)."""
        scanned.select("blob", F.inline("found")).write.mode("append").parquet(f"{self.path}/findings")
        scanned.select("blob", F.col("fresh").alias("rules")).write.mode("append").parquet(f"{self.path}/scans")


def addressed(versions: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """(version, blob, due, text): each row in a struct, the address of its text, and the rules whose needs the text meets; texts that meet
    none are null."""
    rows = versions.select(F.struct(*(versions[c].alias(f"c{i}") for i, c in enumerate(versions.columns))).alias("version"), F.coalesce(versions[text].cast("string"), F.lit("")).alias("text"))
    rows = matches.once(rows, lower=F.lower("text"))
    due = F.array_compact(F.array(*(F.when(r.may(F.col("text"), F.col("lower")), F.lit(r.version)) for r in rules)))
    rows = matches.once(rows, due=due)
    return rows.select("version", F.sha2("text", 256).alias("blob"), "due", F.when(F.size("due") > 0, F.col("text")).alias("text"))


def _kept(r: Rule) -> Column:
    size = lambda m: F.length(F.regexp_extract(m["value"], r.regex, r.group) if r.group else m["value"])
    held = F.filter(f"_{r.kind}", lambda m: size(m) >= r.least)
    return F.transform(held, lambda m: F.struct(F.lit(r.version).alias("rule"), F.lit(r.kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _found(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blobs of (blob, fresh, due, text) to (blob, fresh, found)."""
    for r in rules:
        blobs = matches.matched(blobs, f"_{r.kind}", r.regex, F.array_contains("fresh", r.version) & F.array_contains("due", r.version))
    return blobs.select("blob", "fresh", F.concat(*map(_kept, rules)).alias("found"))


def _unseen(rows: DataFrame, ledger: Ledger, rules: Sequence[Rule]) -> DataFrame:
    """(blob, fresh, due, text), one row per blob of which a rule version is unseen."""
    ids = F.array(*(F.lit(r.version) for r in rules))
    blobs = rows.groupBy("blob").agg(F.first("due").alias("due"), F.first("text").alias("text"))  # equal in all rows of a blob
    fresh = F.array_except(ids, F.coalesce("rules", F.array().cast("array<string>")))
    return blobs.join(ledger.scans(), "blob", "left").select("blob", fresh.alias("fresh"), "due", "text").where(F.size("fresh") > 0)


def scan(versions: DataFrame, ledger: Ledger, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """versions, with their findings in a last column ``found`` (start, place of the kind, end, kind), in order; the ledger grows by what
    it had not seen."""
    rows = common.stored(addressed(versions, text, rules))
    scanned = common.stored(_found(_unseen(rows, ledger, rules), rules))
    ledger.add(scanned)
    common.release(scanned)
    places = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))))
    current = ledger.findings().select("blob", "start", places[F.col("rule")].alias("place"), "end", "kind").where("place is not null")
    of_blob = common.stored(current.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).cast(FOUND).alias("found")))
    named = [F.col(f"version.c{i}").alias(c) for i, c in enumerate(versions.columns)]
    none = F.array().cast(FOUND)
    may = rows.where(F.size("due") > 0).join(of_blob, "blob", "left").select(*named, F.coalesce("found", none).alias("found"))
    return may.union(rows.where(F.size("due") == 0).select(*named, none.alias("found")))


def _listed(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans."""
    found = scan(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), ledger, rules=rules)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    kinds = F.col("found.kind")
    counts = [(F.size("found") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def op12_secret_ledger(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return digests(docs, Ledger(spark, common.scratch(spark)))


_SQL_RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("hub", "(?:gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
    ("login", r"://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", 0, 1),
]
_SQL_HITS = "\n  UNION ALL ".join(
    f"SELECT text, {i} AS place, '{k}' AS kind, {g} AS g, {n} AS least, '{rx}' AS rx, regexp_extract_all(text, '{rx}') AS hits, regexp_extract_all(text, '{rx}', {g}) AS given, "
    f"regexp_split_to_array(text, '{rx}') AS gaps FROM t"
    for i, (k, rx, g, n) in enumerate(_SQL_RULES)
)
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), t AS (SELECT DISTINCT text FROM d),
h AS ({_SQL_HITS}),
m AS (SELECT text, place, kind, least, hits, given, gaps, unnest(range(1, len(hits) + 1)) AS i FROM h),
s AS (
  SELECT text, place, kind, hits[i] AS hit, coalesce(list_sum([length(x) FOR x IN gaps[1:i]]), 0)::BIGINT + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0)::BIGINT AS a
  FROM m WHERE length(given[i]) >= least
), f AS (
  SELECT text, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || a || ':' || (a + length(hit)), ',' ORDER BY a, place) FILTER (place < 3), '') AS base,
    string_agg(kind || ':' || a || ':' || (a + length(hit)), ',' ORDER BY a, place) AS spans FROM s GROUP BY text
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (text)
"""
