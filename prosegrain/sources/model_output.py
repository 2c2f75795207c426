"""Raw text that a language model returned, to typed rows. Damaged output is repaired where that is safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.functions import exprs as X

# Keys under which results are looked for.
RESULT_KEYS = ["results", "result", "data", "classifications", "output", "items"]
MAX_TYPES = 5000


def strip_wrapping(c: Column) -> Column:
    """Text without reasoning tags, code fences and what comes before the first bracket."""
    t = X.trim_ws(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    closed = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    open_ = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*)", 1)
    t = X.trim_ws(F.when(t.rlike(r"(?s)```(?:json)?\s*(.*?)```"), closed).when(F.contains(t, F.lit("```")), open_).otherwise(t))
    t = F.regexp_extract(t, r"(?s)[\[{].*", 0)
    return F.regexp_replace(t, r",(\s*[}\]])", "$1")


def close_brackets(c: Column) -> Column:
    """The text with its open brackets closed, null when none is open."""
    init = F.struct(F.lit("").alias("st"), F.lit(False).alias("q"), F.lit(False).alias("e"))

    def step(a, ch):
        push = F.when(ch == "{", F.concat(F.lit("}"), a["st"])).when(ch == "[", F.concat(F.lit("]"), a["st"])).when(
            ch.isin("}", "]"), F.substring(a["st"], 2, 1 << 30)
        ).otherwise(a["st"])
        return F.struct(
            F.when(a["q"], a["st"]).otherwise(push).alias("st"),
            F.when(a["e"], a["q"]).when(ch == '"', ~a["q"]).otherwise(a["q"]).alias("q"),
            (a["q"] & ~a["e"] & (ch == "\\")).alias("e"),
        )

    # Only the marks matter, so the rest is dropped before the walk; escaped pairs stay together.
    marks = F.regexp_extract_all(c, F.lit(r'(\\.|["{}\[\]])'), F.lit(1))
    kept = F.filter(marks, lambda m: F.length(m) == 1)
    stack = F.aggregate(kept, init, step, lambda a: a["st"])
    return F.when(stack != "", F.concat(c, stack))


def parse_damaged(c: Column) -> Column:
    """Variant of the text as it is, cut after its last bracket, or with brackets closed."""
    cut = F.regexp_extract(c, r"(?s)^(.*[\]}])", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(cut), F.try_parse_json(close_brackets(c)))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(_get(v, path, "variant"))


def _number(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), _get(v, path, "double"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", _get(v, path, "string"))


def _clamp(c: Column, missing: float = 0.0) -> Column:
    """Into 0..1; ``greatest`` and ``least`` skip nulls, so a missing number is settled first."""
    return F.when(c.isNull(), F.lit(missing)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def _true(v: Column, path: str) -> Column:
    return F.coalesce((_kind(v, path) == "BOOLEAN") & _get(v, path, "boolean"), F.lit(False))


def _valid_types(registry: DataFrame) -> list[str]:
    rows = registry.select("type").limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} pattern types")
    return [r[0] for r in rows]


def _patterns(r: Column, valid: list[str]) -> Column:
    """Hits in any of the accepted shapes; unknown types are dropped."""
    ok = lambda c: c.isin(valid)
    hit = lambda t, c, e: F.struct(t.alias("type"), c.alias("confidence"), e.alias("evidence"))
    items = _get(r, "$.patterns", "array<variant>")
    named = F.transform(
        items,
        lambda p: hit(
            F.coalesce(*[F.when(ok(_text(p, f"$.{k}")), _text(p, f"$.{k}")) for k in ("type", "pattern", "name")],
                       F.when(ok(_text(p, "$")), _text(p, "$"))),
            _clamp(_number(p, "$.confidence"), 0.8),
            F.coalesce(_get(p, "$.evidence", "string"), F.lit("")),
        ),
    )
    keyed = F.transform(
        F.map_entries(_get(r, "$.patterns", "map<string,variant>")),
        lambda e: hit(F.when(ok(e["key"]), e["key"]), F.lit(0.8), F.coalesce(_get(e["value"], "$", "string"), F.lit(""))),
    )
    none = F.array().cast("array<struct<type:string,confidence:double,evidence:string>>")
    return F.filter(F.coalesce(named, keyed, none), lambda h: h["type"].isNotNull())


def parse_model_output(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per expected position of raw(batch_id, raw, expected_count), padded and cut to the count.

    ``parsed`` is false where the whole batch could not be read; such rows hold the defaults.
    """
    valid = _valid_types(registry)
    v = raw.withColumn("_v", parse_damaged(strip_wrapping(F.col("raw"))))
    single = F.when(
        _get(F.col("_v"), "$.biber", "variant").isNotNull() | _get(F.col("_v"), "$.patterns", "variant").isNotNull() | _get(F.col("_v"), "$.arc_role", "variant").isNotNull(),
        F.array("_v"),
    )
    found = F.coalesce(_get(F.col("_v"), "$", "array<variant>"), *[_get(F.col("_v"), f"$.{k}", "array<variant>") for k in RESULT_KEYS], single)
    d = v.withColumn("_r", found)
    d = d.select("batch_id", (F.coalesce(F.size("_r"), F.lit(0)) > 0).alias("parsed"), "_r", F.explode(F.sequence(F.lit(0), F.col("expected_count") - 1)).alias("position"))
    d = d.withColumn("_o", F.get("_r", F.col("position"))).withColumn("_o", F.when(_kind(F.col("_o"), "$").startswith("OBJECT"), F.col("_o")))
    r = F.col("_o")
    default = r.isNull()
    return d.select(
        "batch_id", "position", "parsed",
        *[_clamp(_number(r, f"$.biber.{k}")).alias(k) for k in ("informational", "involved", "narrative", "persuasive", "abstract", "elaborative")],
        _patterns(r, valid).alias("patterns"),
        F.coalesce(_number(r, "$.metrics.word_count"), F.lit(0.0)).cast("int").alias("word_count"),
        F.coalesce(_number(r, "$.metrics.clause_count"), F.lit(1.0)).cast("int").alias("clause_count"),
        _true(r, "$.metrics.has_participial").alias("has_participial"), _true(r, "$.metrics.has_relative_clause").alias("has_relative_clause"),
        F.when(default, 0.5).otherwise(_clamp(_number(r, "$.metrics.clause_balance_ratio"))).alias("clause_balance_ratio"),
        F.coalesce(_text(r, "$.metrics.construction_type"), F.lit("simple")).alias("construction_type"),
        F.coalesce(_text(r, "$.arc_role"), F.lit("claim")).alias("arc_role"),
    )


DEFAULTS = {
    "informational": 0.0, "involved": 0.0, "narrative": 0.0, "persuasive": 0.0, "abstract": 0.0, "elaborative": 0.0,
    "clause_count": 1, "has_participial": False, "has_relative_clause": False, "clause_balance_ratio": 0.5,
    "construction_type": "simple", "arc_role": "claim",
}


def with_default_classification(s: DataFrame, cls: DataFrame) -> DataFrame:
    """Sentences with the classification of their hash, or the default one."""
    cols = [c for c in DEFAULTS if c in cls.columns]
    j = s.drop(*[c for c in DEFAULTS if c in s.columns]).join(cls.select("hash", *cols), "hash", "left")
    return j.withColumns({c: F.coalesce(F.col(c) if c in cols else F.lit(None), F.lit(v)) for c, v in DEFAULTS.items()})


# ---------------------------------------------------------------- rewrites, verdicts, entailment


def _bare(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return X.trim_ws(F.regexp_replace(t, r"(?i)```(?:json)?\s*|```", ""))


def _jsonish(c: Column) -> Column:
    return F.try_parse_json(F.regexp_replace(F.regexp_extract(c, r"(?s)[\[{].*", 0), r",\s*([}\]])", "$1"))


def _salvage(c: Column, key: str) -> Column:
    pat = rf'(?i)"{key}"\s*:\s*"((?:\\.|[^"\\])*+)"'
    return F.when(c.rlike(pat), X.trim_ws(F.replace(F.regexp_extract(c, pat, 1), F.lit('\\"'), F.lit('"'))))


def _filled(c: Column) -> Column:
    return F.when(X.trim_ws(c) != "", X.trim_ws(c))


def parse_rewrite_output(raw: DataFrame, kind: str) -> DataFrame:
    """raw(id, raw) of one kind to typed rows: ``replacement``, ``alternatives``, ``suggestions``, ``verdict`` or ``entailment``."""
    d = raw.withColumn("_t", _bare(F.col("raw"))).withColumn("_v", _jsonish(F.col("_t")))
    v, t = F.col("_v"), F.col("_t")
    any_text = lambda *ks: F.coalesce(*[_text(v, f"$.{k}") for k in ks])
    line = F.regexp_extract(t, r"^\s*([^\n]+)", 1)
    plain = F.when(~t.rlike(r"^[\[{]") & (F.length(X.trim_ws(line)) >= 12) & X.trim_ws(line).rlike(r"[.!?]$"), X.trim_ws(line))
    one = F.coalesce(_filled(any_text("replacement", "rewritten", "text")), _salvage(t, "replacement"), plain)
    if kind == "replacement":
        return d.select("id", one.alias("replacement"))
    if kind == "alternatives":
        lists = F.coalesce(_get(v, "$", "array<string>"), *[_get(v, f"$.{k}", "array<string>") for k in ("alternatives", "options", "rewrites")], F.array(one))
        clean = F.filter(F.transform(lists, X.trim_ws), lambda x: x.isNotNull() & (x != ""))
        e = d.select("id", F.posexplode(clean).alias("pos", "text")).withColumn("norm", X.squeeze(F.col("text")))
        first = e.groupBy("id", "norm").agg(F.min(F.struct("pos", "text")).alias("m"))
        return first.select("id", F.col("m.pos").alias("pos"), F.col("m.text").alias("text"))
    if kind == "suggestions":
        items = F.coalesce(*[_get(v, f"$.{k}", "array<variant>") for k in ("suggestions", "alternatives", "rewrites")], _get(v, "$", "array<variant>"))
        names = ("text", "rewrite", "alternative", "suggestion")
        read = F.transform(items, lambda p: F.struct(
            X.trim_ws(F.coalesce(_text(p, "$"), *[_text(p, f"$.{k}") for k in names])).alias("text"),
            X.trim_ws(F.coalesce(*[_text(p, f"$.{k}") for k in ("rationale", "reason", "explanation")], F.lit(""))).alias("rationale"),
        ))
        pat = r'(?i)"(?:text|rewrite|alternative|suggestion)"\s*:\s*"((?:\\.|[^"\\])*+)"'
        found = F.transform(F.regexp_extract_all(t, F.lit(pat), F.lit(1)), lambda x: F.struct(X.trim_ws(F.replace(x, F.lit('\\"'), F.lit('"'))).alias("text"), F.lit("").alias("rationale")))
        good = lambda a: F.filter(a, lambda s: F.length(s["text"]) >= 12)
        both = F.when(F.coalesce(F.size(good(read)), F.lit(0)) > 0, good(read)).otherwise(good(found))
        return d.select("id", F.posexplode(both).alias("pos", "s")).select("id", "pos", "s.text", "s.rationale")
    if kind == "verdict":
        names = ["vacuous", "earned", "uncertain"]
        ok = _text(v, "$.verdict").isin(names) & _text(v, "$.rationale").isNotNull()
        saved = F.lower(F.regexp_extract(t, r'(?i)"verdict"\s*:\s*"(vacuous|earned|uncertain)"', 1))
        return d.select(
            "id", F.when(ok, _text(v, "$.verdict")).when(saved != "", saved).otherwise("uncertain").alias("verdict"),
            F.when(ok, X.trim_ws(_text(v, "$.rationale"))).when(saved != "", F.coalesce(_salvage(t, "rationale"), F.lit(""))).otherwise("Could not parse model response.").alias("rationale"),
        )
    if kind == "entailment":
        read = v.isNotNull()
        saved = F.lower(F.regexp_extract(t, r'(?i)"entails"\s*:\s*(true|false)', 1))
        conf = F.regexp_extract(t, r'(?i)"confidence"\s*:\s*([0-9.]+)', 1)
        return d.select(
            "id", F.when(read, F.lower(F.coalesce(_get(v, "$.entails", "string"), F.lit(""))) == "true").otherwise(saved == "true").alias("entails"),
            F.when(read, _clamp(_number(v, "$.confidence"), 0.8)).otherwise(_clamp(conf.try_cast("double"), 0.5)).alias("confidence"),
            F.when(read, X.trim_ws(F.coalesce(_text(v, "$.explanation"), F.lit("")))).otherwise(F.coalesce(_salvage(t, "explanation"), F.lit(""))).alias("explanation"),
        )
    raise ValueError(f"unknown kind {kind}")
