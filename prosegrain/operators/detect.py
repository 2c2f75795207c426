"""Sentence-level detection. Everything that looks at one sentence is a projection; only the
opener rule and the lexicon join look beyond it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stack

SENT = ["doc_id", "sent_id"]


# ---------------------------------------------------------------- rule screens


def _rule_hits(text: Column, rules) -> Column:
    def cell(low, t, p, c):
        hit = lambda e: F.struct(F.lit(t).alias("type"), F.lit(float(c)).alias("confidence"), e.alias("evidence"))
        words = X.literals(p)
        if not words:
            return F.when(X.matches(text, p), hit(X.first_match(text, p)))
        # Few texts hold the words; there the first match, never empty, is looked for once.
        return F.when(X.holds(low, words), X.let(X.first_match(text, p), lambda e: F.when(e != "", hit(e))))

    cells = lambda low: F.array(*(cell(low, *r) for r in rules))
    return X.let(F.lower(text), lambda low: F.filter(cells(low), lambda h: h.isNotNull()))


def screen_lexical(s: DataFrame, rules=fixed.SCREEN_RULES) -> DataFrame:
    """hits(doc_id, sent_id, hit_pos, type, confidence, evidence) for (type, pattern, confidence) rules."""
    return s.select(*SENT, F.posexplode(_rule_hits(F.col("text"), rules)).alias("hit_pos", "h")).select(
        *SENT, "hit_pos", "h.type", "h.confidence", "h.evidence"
    )


def route(s: DataFrame, rules=fixed.SCREEN_RULES) -> DataFrame:
    """certain_negative without a hit, certain_positive with exactly one, else ambiguous."""
    n = F.size(_rule_hits(F.col("text"), rules))
    kind = F.when(n == 0, "certain_negative").when(n == 1, "certain_positive").otherwise("ambiguous")
    return s.select(*SENT, n.alias("n_hits"), kind.alias("route"))


def validators(s: DataFrame, rules=fixed.VALIDATOR_RULES) -> DataFrame:
    """One boolean column per rule."""
    return s.select(*SENT, *[X.matches(F.col("text"), p).alias(t) for t, p in rules])


# ---------------------------------------------------------------- lexicon


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


FLEX = r"[\s '’-]*"
GAP = r"[\s '’-]+"
GRAM = 3


def wording_regex(ws: Column) -> Column:
    """Expression that finds the lower-case words of a phrase without slots."""
    return F.concat(F.lit("(?i)(?<![a-z0-9])"), F.array_join(F.transform(ws, escape), FLEX), F.lit("(?![a-z0-9])"))


def matchers(lexicon: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Add ``regex``, ``keys``, ``needs`` and labels to lexicon(subcategory, sub_pos, phrase_pos, phrase[, pattern]).

    One word is matched between bounds, several words with a flexible gap. A phrase with ``[slots]``
    becomes its literal parts with windows of up to 40 characters; slots at the ends are dropped. A given
    ``pattern`` is used as it is. Phrases without a literal part match nothing and are left out.

    ``keys`` (kind, key) file a phrase where a sentence that holds it must look: a single word under itself
    (``word``); several words under one of them, and under the runs of words around it, as gaps may be empty (``part``); other literal text
    under the first letters of its longest run (``gram``). The word is the rarest by ``frequency`` (word, n), without
    that the longest that is no function word. ``needs`` is literal text that the sentence holds, without what gaps
    may hold. Given patterns have neither.
    """
    given = F.col("pattern") if "pattern" in lexicon.columns else F.lit(None).cast("string")
    slot = F.col("phrase").rlike(r"\[[^\]]+\]")
    ws = X.words(F.lower("phrase"))
    plain = wording_regex(ws)
    parts = F.filter(F.split("phrase", r"\[[^\]]+\]"), lambda p: F.trim(p) != "")
    slotted = F.concat(
        F.lit("(?i)"), F.array_join(F.transform(parts, lambda p: escape(F.trim(p))), r"[^\n\r]{0,40}?")
    )
    triggers = F.filter(
        F.transform(F.regexp_extract_all("phrase", F.lit("([A-Za-z][A-Za-z-]{4,})"), F.lit(1)),
                    lambda t: F.regexp_replace(F.lower(t), "^-+|-+$", "")),
        lambda t: F.length(t).between(5, 28) & ~t.isin(fixed.COMMON_TRIGGERS),
    )
    literal = F.when(slot, F.size(parts) > 0).otherwise(F.size(ws) > 0)
    bundle = F.contains("regex", F.lit(fixed.BUNDLE_MARK))
    lex = (
        lexicon.filter(given.isNotNull() | literal)
        .withColumn("regex", F.coalesce(given, F.when(slot, slotted).otherwise(plain)))
        .withColumn("_ws", F.when(given.isNull() & ~slot, ws))
        .withColumn("_literal", F.when(given.isNull(), F.when(slot, F.array_join(F.transform(parts, lambda p: X.ascii_lower(F.trim(p))), "\n")).otherwise(X.ascii_lower(F.array_join(ws, " ")))))
        .withColumn("phrase_triggers", triggers)
        .withColumn("source", F.when(bundle, fixed.SOURCE_LABELS[0]).otherwise(fixed.SOURCE_LABELS[1]))
        .withColumn(
            "matcher_role",
            F.when(~bundle, "manual_phrase")
            .when(F.length("regex") > 900, "family_router")
            .when(F.length("regex") > 350, "mechanism_router")
            .otherwise("surface_exact_or_near_exact"),
        )
    )
    return _filed(lex, frequency).drop("_ws", "_literal")


def _filed(lex: DataFrame, frequency: DataFrame | None) -> DataFrame:
    """lex with ``keys`` and ``needs``."""
    simple = lambda w: w.rlike("^[a-z0-9]+$")
    if frequency is None:
        costs = F.transform("_ws", lambda w: F.when(w.isin(fixed.FUNCTION_WORDS), 1000 - F.length(w)).otherwise(100 - F.length(w)).cast("bigint"))
        lex = lex.withColumn("_cost", costs)
    else:
        words = lex.select(F.explode("_ws").alias("word")).distinct().join(frequency, "word", "left")
        seen = lex.select("phrase", F.posexplode("_ws").alias("i", "word")).distinct().join(words, "word")
        costs = seen.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
        lex = lex.join(costs.select("phrase", F.col("c.n").alias("_cost")), "phrase", "left")
    places = F.filter(F.transform("_ws", lambda w, i: F.when(simple(w), F.struct(F.get("_cost", i).alias("n"), i.alias("i")))), lambda x: x.isNotNull())
    lex = lex.withColumn("_at", F.array_min(places)["i"])
    # the words around that one which are runs of letters and digits as well
    near = lambda i, step: F.aggregate(
        F.sequence(F.lit(1), F.size("_ws")), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")),
        lambda a, j: F.struct((a["k"] + F.when(a["go"] & simple(F.coalesce(F.get("_ws", i + step * j), F.lit(""))), 1).otherwise(0)).alias("k"),
                              (a["go"] & simple(F.coalesce(F.get("_ws", i + step * j), F.lit("")))).alias("go")), lambda a: a["k"])
    lex = lex.withColumn("_back", near(F.col("_at"), -1)).withColumn("_on", near(F.col("_at"), 1))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_back")), lambda b: F.transform(
        F.sequence(F.lit(0), F.col("_on")), lambda e: F.array_join(F.slice("_ws", F.col("_at") - b + 1, b + e + 1), ""))))
    longest = F.array_max(F.transform(F.regexp_extract_all("_literal", F.lit("([a-z0-9]+)"), F.lit(1)), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    keys = (
        F.when((F.size("_ws") == 1) & F.col("_at").isNotNull(), F.array(key("word", F.get("_ws", F.lit(0)))))
        .when(F.col("_at").isNotNull(), F.transform(F.array_distinct(runs), lambda r: key("part", r)))
        .when(longest.isNotNull(), F.array(key("gram", F.substring(longest, 1, GRAM))))
    )
    needs = F.when(F.col("_ws").isNotNull(), F.array(F.regexp_replace("_literal", GAP, ""))).otherwise(F.transform(F.split("_literal", "\n"), lambda p: F.regexp_replace(p, GAP, "")))
    return lex.withColumn("keys", keys).withColumn("needs", needs).drop("_cost", "_at", "_back", "_on")


def _triggers(lex: DataFrame) -> DataFrame:
    """The trigger words of all phrases of each subcategory."""
    return lex.groupBy("subcategory").agg(F.array_distinct(F.flatten(F.collect_set("phrase_triggers"))).alias("triggers"))


#: Lexicon keys up to which they travel to the sentences; beyond, words travel to the keys and texts are fetched by sentence.
MOST_KEYS = 200_000
#: Phrases without a key word up to which their expressions are part of the plan; beyond, they are looked up by a few letters.
MOST_LOOSE = 64


def _grams(found: Column) -> Column:
    """All runs of up to GRAM letters of the words."""
    cuts = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, n))))
    return F.transform(F.array_distinct(F.flatten(F.transform(found, cuts))), lambda g: F.concat(F.lit("*"), g))


def _phrase_hits(s: DataFrame, lex: DataFrame, keep: list[str], allowed=None) -> DataFrame:
    """(doc_id, sent_id, *keep, start, evidence) of the first place of every phrase that occurs in a sentence.

    Phrases meet sentences on keys (see ``matchers``). Single words are settled by that: the first of them is found in the text with all
    signs blanked. Of the others only those whose literal text the sentence holds, and that ``allowed`` (from candidates with
    ``low``) lets pass, run their expression; a task takes them in the order of the expressions, so that each is compiled once
    there. Given patterns, which the caller wrote, are part of the plan, and so are phrases without a key word while they are few.
    """
    kind = F.coalesce(F.element_at("keys", 1)["kind"], F.lit("given"))
    counts = dict(map(tuple, lex.groupBy(kind.alias("k")).agg(F.sum(F.greatest(F.lit(1), F.size("keys")))).collect()))
    grams = counts.get("gram", 0) > MOST_LOOSE
    planned = lex.filter(kind == "given") if grams else lex.filter(kind.isin("given", "gram"))
    given = [(r.regex, r.needs) for r in planned.select("regex", "needs").distinct().collect()]
    named = F.when(kind == "given", F.array(F.struct(F.lit("given").alias("kind"), F.col("regex").alias("key"))))
    if not grams:
        named = named.when(kind == "gram", F.array(F.struct(F.lit("given").alias("kind"), F.col("regex").alias("key"))))
    keyed = lex.withColumn("keys", named.otherwise(F.col("keys"))).select(F.struct(*keep).alias("m"), "regex", "needs", F.explode("keys").alias("k"))
    mark = F.when(F.col("k.kind") == "gram", F.concat(F.lit("*"), "k.key")).when(F.col("k.kind") == "given", F.concat(F.lit("="), "k.key")).otherwise(F.col("k.key"))
    keyed = keyed.select("m", "regex", "needs", "k.kind", mark.alias("key"))
    rows = s.select(*SENT, "text", X.ascii_lower(F.col("text")).alias("low")).withColumn("bare", F.regexp_replace("low", GAP, ""))
    found = F.array_distinct(F.regexp_extract_all("low", F.lit("([a-z0-9]+)"), F.lit(1)))
    entries = F.concat(found, _grams(found)) if grams else found
    if given:
        fits = [F.when(reduce(Column.__and__, [F.contains("bare", F.lit(x)) for x in needs or []], F.lit(True)) & (F.regexp_instr("text", F.lit(r)) > 0), F.lit("=" + r)) for r, needs in given]
        entries = F.concat(entries, F.filter(F.array(*fits), lambda x: x.isNotNull()))
    if sum(counts.values()) <= MOST_KEYS:
        met = rows.select(*SENT, "text", "low", "bare", F.explode(entries).alias("key")).join(F.broadcast(keyed), "key")
    else:
        met = rows.select(*SENT, F.explode(entries).alias("key")).join(keyed, "key").join(rows, SENT)
    single = F.col("kind") == "word"
    met = met.filter(single | (F.col("kind") == "given") | F.forall("needs", lambda x: F.contains("bare", x)))
    met = met.select(*SENT, *[F.col(f"m.{c}").alias(c) for c in keep], "text", "low", "kind", "key", "regex")
    met = allowed(met) if allowed else met
    blanked = F.concat(F.lit(" "), F.regexp_replace("low", "[^a-z0-9]", " "), F.lit(" "))
    start = F.when(single, F.call_function("locate", F.concat(F.lit(" "), "key", F.lit(" ")), blanked) - 1)
    evidence = F.when(single, F.substring(F.col("text"), start + 1, F.length("key")))
    met = met.select(*SENT, *keep, start.alias("start"), evidence.alias("evidence"), F.when(~single, F.col("text")).alias("text"), F.when(~single, F.col("regex")).alias("regex")).sortWithinPartitions("regex")
    at = F.regexp_instr("text", F.col("regex"))
    place = lambda start, evidence: F.array(F.struct(start.alias("_start"), evidence.alias("_evidence")))
    places = F.when(F.col("regex").isNull(), place(F.col("start"), F.col("evidence"))).when(at > 0, place(at - 1, F.regexp_substr("text", F.col("regex"))))
    return met.select(*SENT, *keep, F.inline(places)).withColumnsRenamed({"_start": "start", "_evidence": "evidence"})


def match_lexicon(s: DataFrame, lexicon: DataFrame, mode: str = "tiered", triggers: bool = True, cap: int | None = None, frequency: DataFrame | None = None) -> DataFrame:
    """candidates(doc_id, sent_id, subcategory, phrase, evidence, start, end, …).

    The first matching phrase of each subcategory; with ``cap``, the first that many subcategories in order. Outside the
    exhaustive mode a subcategory is looked for only where one of its trigger words stands.
    """
    if mode == "off":
        return match_lexicon(s, lexicon, "exhaustive").filter(F.lit(False))
    lex = matchers(lexicon, frequency)
    if mode == "fast":
        lex = lex.filter(F.col("subcategory").isin(fixed.FAST_MARKERS))
    allowed = None
    if triggers and mode != "exhaustive":
        of = _triggers(lex)
        has = F.exists("triggers", lambda t: F.contains("low", t))
        none = F.lit(False) if mode == "fast" else F.col("subcategory").isin(fixed.FAST_MARKERS)

        def allowed(d):
            return d.join(of, "subcategory").filter(F.when(F.size("triggers") == 0, none).otherwise(has)).drop("triggers")

    found = _phrase_hits(s, lex, ["subcategory", "sub_pos", "phrase_pos", "phrase", "source", "matcher_role"], allowed)
    first = found.groupBy(*SENT, "subcategory").agg(
        F.min_by(F.struct("sub_pos", "phrase", "source", "matcher_role", "start", "evidence"), F.struct("phrase_pos", "start")).alias("m")
    )
    if cap is not None:
        w = Window.partitionBy(*SENT).orderBy("m.sub_pos")
        first = first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)
    return first.select(
        *SENT, "subcategory", F.col("m.sub_pos").alias("sub_pos"), F.col("m.phrase").alias("phrase"),
        F.col("m.evidence").alias("evidence"), F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.evidence")).alias("end"),
        F.col("m.source").alias("source"), F.col("m.matcher_role").alias("matcher_role"),
    )


def dedupe_candidates(cands: DataFrame) -> DataFrame:
    """One row per (sentence, subcategory, lower-cased evidence, start)."""
    return (
        cands.withColumn("_e", F.lower("evidence")).dropDuplicates([*SENT, "subcategory", "_e", "start"]).drop("_e")
    )


def map_patterns(cands: DataFrame, mapping: DataFrame) -> DataFrame:
    """Candidates with the 1-3 pattern types of their subcategory, one row each."""
    return cands.join(mapping.withColumnRenamed("pos", "map_pos"), "subcategory")


def promote(hits: DataFrame, cands: DataFrame, playbook: DataFrame, mapping: DataFrame,
            min_conf: float = 0.5, max_conf: float = 0.7, conf: float = 0.65) -> DataFrame:
    """hits plus one hit per sentence and playbook type that only candidates show."""
    if conf < min_conf:
        return hits
    allowed = playbook.select("type").distinct()
    mapped = map_patterns(cands, mapping).join(allowed, "type", "left_semi")
    mapped = mapped.join(hits.select(*SENT, "type").distinct(), [*SENT, "type"], "left_anti")
    new = mapped.groupBy(*SENT, "type").agg(
        F.min_by("evidence", F.struct("sub_pos", "map_pos")).alias("evidence"),
        F.min(F.struct("sub_pos", "map_pos")).alias("o"),
    )
    return stack(
        hits.withColumn("promoted", F.lit(0)),
        new.select(*SENT, (F.col("o.sub_pos") * 10 + F.col("o.map_pos") + 1000).cast("int").alias("hit_pos"), "type",
                   F.lit(min(max_conf, conf)).alias("confidence"), "evidence", F.lit(1).alias("promoted"))
    )


def drop_disabled(hits: DataFrame, disabled: DataFrame) -> DataFrame:
    return hits.join(disabled.select("type"), "type", "left_anti")


def keep_patterns(hits: DataFrame, ids: DataFrame) -> DataFrame:
    return hits.join(ids.select("type"), "type", "left_semi")


def scan_hitlist(s: DataFrame, lexicon: DataFrame, reach: int = 2) -> DataFrame:
    """Tiered scan: strong entries flag alone, moderate ones when another hit is within ``reach``
    sentences, watch entries only next to a strong or moderate hit in the same sentence."""
    hits = _phrase_hits(s, matchers(lexicon), ["phrase", "tier"]).select(*SENT, "phrase", "tier").distinct()
    near = Window.partitionBy("doc_id").orderBy("sent_id").rangeBetween(-reach, reach)
    here = Window.partitionBy(*SENT)
    firm = F.sum(F.when(F.col("tier") != "watch", 1).otherwise(0))
    return (
        hits.withColumn("near", F.count(F.lit(1)).over(near))
        .withColumn("firm", firm.over(here))
        .withColumn(
            "flagged",
            F.when(F.col("tier") == "strong", True)
            .when(F.col("tier") == "moderate", F.col("near") >= 2)
            .otherwise(F.col("firm") >= 1),
        )
        .select(*SENT, "phrase", "tier", "near", "flagged")
    )


# ---------------------------------------------------------------- rule classifier


def _repeated(ws: Column) -> Column:
    """Words that occur more than once, in the order they are first seen."""
    dup = F.aggregate(
        F.array_sort(ws),
        F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("out")),
        lambda a, w: F.struct(
            w.alias("last"),
            F.when(a["last"].eqNullSafe(w), F.array_union(a["out"], F.array(w))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.array().cast("array<string>")).otherwise(F.array_intersect(F.array_distinct(ws), dup))


def with_rule_features(s: DataFrame) -> DataFrame:
    """Metrics, register scores and arc role of the rule classifier; no shuffle. ``alpha_words`` counts words that begin with a letter."""
    text, lower = F.col("text"), F.col("_lower")
    held = lambda words: F.array_compact(F.array(*(F.when(F.contains(lower, F.lit(w)), w) for w in words)))
    # A lambda over the words would lower-case the sentence again for each of them.
    df = s.withColumn("_lower", F.lower("text")).withColumn("_strong", held(fixed.STRONG_WORDS)).withColumn("_nominal", held(fixed.NOMINAL_WORDS))
    joints = F.when(X.holds(lower, ("and", "but", "while")), X.match_count(text, r"\b(?:and|but|while)\b")).otherwise(0)
    clauses = X.count_of(text, ",") + X.count_of(text, ";") + joints + 1
    df = df.withColumn("clause_count", clauses).withColumn("alpha_words", F.regexp_count(text, F.lit(X.ALPHA_WORD)))
    k = F.col("clause_count")
    return (
        df.withColumn("has_participial", F.contains(lower, F.lit("ing")) & X.matches(lower, r"[A-Za-z0-9_]ing\b", False))
        .withColumn("has_relative_clause", X.matches_held(lower, lower, r"\bthat\b", False) | X.matches_held(lower, lower, r"\bwhich\b", False) | X.matches_held(lower, lower, r"\bwho\b", False))
        .withColumn("clause_balance_ratio", F.when(k >= 2, 0.78).otherwise(0.5))
        .withColumn("construction_type", F.when(k >= 3, "compound-complex").when(k == 2, "compound").otherwise("simple"))
        .withColumn("informational", F.lit(0.62))
        .withColumn("involved", F.lit(0.1))
        .withColumn("narrative", F.lit(0.05))
        .withColumn("persuasive", F.when(F.size("_strong") > 0, 0.58).otherwise(0.32))
        .withColumn("abstract", F.when(F.size("_nominal") > 0, 0.55).otherwise(0.24))
        .withColumn("elaborative", F.when(k > 2, 0.55).otherwise(0.28))
        .withColumn(
            "arc_role",
            F.when(F.col("sent_id") == 0, "claim")
            .when(X.matches_held(text, lower, r"\b(data|method|evidence)\b"), "evidence")
            .otherwise("development"),
        )
        .drop("_lower")
    )


def features(s: DataFrame) -> DataFrame:
    """Sentence columns with the rule classifier's metrics, without its working columns."""
    return with_rule_features(s).drop("_strong", "_nominal")


def classify_rules(s: DataFrame) -> DataFrame:
    """The rule classifier: metrics plus ``patterns ARRAY<STRUCT<type, confidence, evidence>>``."""
    df = with_rule_features(s).withColumn("_ws", X.alpha_words(F.col("text")))
    ws, text = F.col("_ws"), F.col("text")
    opening = F.lower(F.array_join(F.slice(ws, 1, 2), " "))
    content = F.filter(F.transform(ws, F.lower), lambda w: (F.length(w) > 5) & ~w.isin(fixed.COMMON_WORDS))
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    df = df.withColumns({"_open": opening, "_rep": X.let(content, _repeated)})
    ns, nn = F.size("_strong"), F.size("_nominal")
    stakes = F.filter("_strong", lambda x: x.isin(fixed.STAKES_WORDS))

    def hit(cond, kind, conf, evidence):
        return F.when(
            cond,
            F.struct(F.lit(kind).alias("type"), conf.cast("double").alias("confidence"), evidence.alias("evidence")),
        )

    # A contrast, never empty, is looked for once, where its words stand.
    contrast = X.let(X.first_match(text, fixed.CONTRAST_RE), lambda e: hit(e != "", "binary_contrast", F.lit(0.8), e))
    first = F.array(
        hit(ns >= 2, "intensifier_saturation",
            F.least(F.lit(1.0), X.js_round(F.lit(0.45) + ns * F.lit(0.12), 6)),
            F.array_join(F.slice("_strong", 1, 4), ", ")),
        hit(F.size(stakes) > 0, "importance_inflation", F.lit(0.72), F.get(stakes, F.lit(0))),
        X.let(F.lower(text), lambda low: F.when(X.holds(low, ("while", "not", "rather than", "instead of")), contrast)),
    )
    last = F.array(
        hit(nn >= 1, "nominalization", F.least(F.lit(1.0), X.js_round(F.lit(0.55) + nn * F.lit(0.1), 6)),
            F.array_join(F.slice("_nominal", 1, 3), ", ")),
        hit(F.size("_rep") > 0, "vocabulary_smoothing", F.lit(0.64), F.array_join(F.slice("_rep", 1, 3), ", ")),
    )
    # All that needs the text comes before the sort for the sentence before.
    df = df.withColumns({"_first": first, "_last": last}).withColumn("_prev", F.lag("_open").over(w))
    again = hit((F.col("_open") != "") & (F.col("_open") == F.col("_prev")), "sentence_opener_repetition", F.lit(0.84), F.col("_open"))
    df = df.withColumn("patterns", F.filter(F.concat("_first", F.array(again), "_last"), lambda h: h.isNotNull()))
    return df.drop("_strong", "_nominal", "_ws", "_open", "_prev", "_rep", "_first", "_last")


def explode_hits(classified: DataFrame) -> DataFrame:
    return classified.select(*SENT, F.posexplode("patterns").alias("hit_pos", "h")).select(
        *SENT, "hit_pos", "h.type", "h.confidence", "h.evidence"
    )


# ---------------------------------------------------------------- heat and routing


def heat(s: DataFrame, hits: DataFrame, registry: DataFrame) -> DataFrame:
    """Heat 0-10 of each sentence from weighted confidences, clause balance and stacking."""
    w = hits.join(registry.select("type", "weight"), "type", "left")
    per = w.groupBy(*SENT).agg(
        X.exact_sum(F.coalesce("weight", F.lit(0.5)) * F.col("confidence")).alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    j = s.join(per, SENT, "left")
    bal = F.col("clause_balance_ratio")
    h = F.coalesce("_h", F.lit(0.0))
    h = h + F.when((bal > 0.85) & (F.col("clause_count") >= 2), (bal - 0.85) / 0.15).otherwise(0.0)
    h = h + F.when(F.col("has_participial") & (F.col("clause_count") >= 3), 0.8).otherwise(0.0)
    h = h * F.when(F.coalesce("_n", F.lit(0)) >= 3, 1.2).otherwise(1.0)
    return j.withColumn("heat", F.least(F.lit(10.0), X.js_round(X.js_round(h, 6), 1))).drop("_h", "_n")


def rule_heat_of(patterns: Column, clause_count: Column) -> Column:
    weight = X.mapping(fixed.RULE_HEAT_WEIGHTS, 0.8)
    h = F.aggregate(patterns, F.lit(0.0), lambda a, p: a + weight(p["type"]) * p["confidence"])
    h = h + F.when(clause_count >= 3, 0.45).otherwise(0.0)
    h = h * F.when(F.size(patterns) >= 3, 1.15).otherwise(1.0)
    return F.least(F.lit(10.0), X.js_round(X.js_round(h, 6), 1))


def rule_heat(classified: DataFrame) -> DataFrame:
    """The rule classifier's own heat, on nested patterns."""
    return classified.withColumn("heat", rule_heat_of(F.col("patterns"), F.col("clause_count")))


def escalation(s: DataFrame, hits: DataFrame, medium: float = 0.4, full: float = 0.7) -> DataFrame:
    top = hits.groupBy(*SENT).agg(F.max("confidence").alias("max_confidence"))
    m = F.coalesce("max_confidence", F.lit(0.0))
    return s.join(top, SENT, "left").select(
        *SENT, m.alias("max_confidence"),
        F.when(m >= full, "full").when(m >= medium, "medium").otherwise("none").alias("tier"),
    )


# ---------------------------------------------------------------- swap lexicon


def _term(word: str) -> str:
    out = "".join(ch if ch.isalnum() else ("[- ]" if ch == "-" else "\\" + ch) for ch in word)
    return rf"\b{out}\b"


def _has_stem(lower: Column, word: str) -> Column:
    """Cheap test that must hold before a term's expression is worth running."""
    return F.contains(lower, F.lit(word.split("-")[0].lower()))


def lexicon_hits(docs: DataFrame, swaps=fixed.SWAPS) -> DataFrame:
    """(doc_id, word, suggestion, index, matched): every occurrence of every swap word.

    Offsets come from the running lengths of the text between matches; no join is needed because
    the swap table is a short constant.
    """
    cells = []
    docs = docs.select("doc_id", "text", F.lower("text").alias("_low"))
    for pos, (word, to) in enumerate(swaps):
        p = X.rx(_term(word))
        parts = F.split("text", p)
        found = F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))
        cells.append(
            F.when(
                _has_stem(F.col("_low"), word) & F.col("text").rlike(p),
                F.struct(F.lit(pos).alias("pos"), F.lit(word).alias("word"), F.lit(to).alias("suggestion"),
                         found.alias("found"), F.transform(parts, F.length).alias("gaps")),
            )
        )
    df = docs.select("doc_id", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    df = df.select("doc_id", "c.*").withColumn("lens", F.transform("found", F.length))
    offsets = F.aggregate(
        F.zip_with(F.slice("gaps", F.lit(1), F.size("found")), "lens", lambda g, n: F.struct(g.alias("g"), n.alias("n"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["g"])).alias("out")
        ),
        lambda a: a["out"],
    )
    return df.select(
        "doc_id", "pos", "word", "suggestion", F.explode(F.arrays_zip(offsets.alias("index"), F.col("found").alias("matched"))).alias("z")
    ).select("doc_id", "pos", "word", "suggestion", F.col("z.index").alias("index"), F.col("z.matched").alias("matched"))


def swap_lines(hits: DataFrame) -> DataFrame:
    """First hit of each word as a line of advice."""
    first = hits.groupBy("doc_id", "word", "suggestion").agg(
        F.min("index").alias("index"), F.min_by("matched", "index").alias("matched")
    )
    return first.withColumn("line", F.concat(F.lit('"'), "matched", F.lit('" → '), "suggestion"))


def banned_without_swap(docs: DataFrame, banned=fixed.BANNED_WORDS, swaps=fixed.SWAPS) -> DataFrame:
    have = {w for w, _ in swaps}
    docs = docs.select("doc_id", "text", F.lower("text").alias("_low"))
    cells = [
        F.when(_has_stem(F.col("_low"), w) & X.matches(F.col("text"), _term(w)), F.lit(w)) for w in banned if w not in have
    ]
    return docs.select("doc_id", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("word"))


def banned_found(text: Column, lower: Column, banned=fixed.BANNED_WORDS) -> Column:
    """Banned words in a text, given the text in lower case as well."""
    cells = [F.when(_has_stem(lower, w) & X.matches(text, _term(w)), F.lit(w)) for w in banned]
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


# ---------------------------------------------------------------- opposition


def opposition_template(s: DataFrame) -> DataFrame:
    cols = [X.matches(F.col("text"), p).alias(n) for n, p, _ in fixed.OPPOSITION_TEMPLATES]
    any_of = reduce(lambda a, b: a | b, [F.col(n) for n, _, _ in fixed.OPPOSITION_TEMPLATES])
    return s.select(*SENT, "text", *cols).withColumn("any_template", any_of)


def opposition_reason(c: Column) -> Column:
    """Reason of the first matching template, null when none matches."""
    out = None
    for _, p, why in fixed.OPPOSITION_TEMPLATES:
        cond = X.matches(c, p)
        out = F.when(cond, why) if out is None else out.when(cond, why)
    return out


def opposition_verdict(c: Column) -> Column:
    return F.when(opposition_reason(c).isNotNull(), "vacuous")


def opposition_filter(hits: DataFrame, s: DataFrame) -> DataFrame:
    """Opposition hits: clause symmetry needs a signal word; a plain template settles two types."""
    h = hits.filter(F.col("type").isin(fixed.OPPOSITION_TYPES)).join(s.select(*SENT, "text"), SENT)
    h = h.filter((F.col("type") != "clause_symmetry") | X.matches(F.col("text"), fixed.OPPOSITION_SIGNAL_RE))
    plain = F.col("type").isin("binary_contrast", "negation_reframe") & opposition_reason(F.col("text")).isNotNull()
    return h.select(*SENT, "type", "confidence", "evidence", F.when(plain, "vacuous").otherwise("uncertain").alias("verdict"))


def _gerund(c: Column) -> Column:
    """A leading gerund as its base form."""
    t = X.trim_ws(c)
    stem = F.regexp_extract(t, r"(?i)^([a-z]+)ing(?![A-Za-z0-9_])", 1)
    rest = F.substring(t, F.length(stem) + 4, F.lit(1 << 30))
    base = (
        F.when(stem.rlike("(at|it)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike("t$"), F.regexp_replace(stem, "t$", ""))
        .otherwise(stem)
    )
    return F.when(stem == "", t).otherwise(F.concat(base, rest))


def rewrite_of(text: Column) -> Column:
    """Direct replacement of an opposition sentence, null when no shape fits."""
    t = X.squeeze(text)

    def part(shape, i):
        return F.regexp_extract(t, "(?i)" + fixed.OPPOSITION_SHAPES[shape], i)

    def fits(shape):
        return t.rlike("(?i)" + fixed.OPPOSITION_SHAPES[shape])

    made = (
        F.when(fits("not_about"), F.concat(X.trim_ws(part("not_about", 1)), F.lit(" depends on "), X.drop_article(part("not_about", 3))))
        .when(fits("not_merely_about"), F.concat(F.lit("The work is to "), _gerund(part("not_merely_about", 2))))
        .when(
            fits("not_only_can"),
            F.concat(part("not_only_can", 1), F.lit(" can "), part("not_only_can", 2), F.lit(" and "),
                     F.regexp_replace(part("not_only_can", 3), r"(?i)^also\s+", "")),
        )
        .when(fits("nuanced"), F.concat(F.lit("The practical opportunity is "), X.lower_first(part("nuanced", 1))))
        .when(fits("one_and_other"), F.concat(X.trim_ws(part("one_and_other", 1)), F.lit(", but "), X.lower_first(X.trim_ws(part("one_and_other", 2)))))
        .when(fits("one_hand"), X.upper_first(part("one_hand", 1)))
        .when(fits("other_hand"), X.upper_first(part("other_hand", 1)))
    )
    return X.finish_sentence(made)


def rewrite_opposition(s: DataFrame) -> DataFrame:
    return s.select(*SENT, "text", rewrite_of(F.col("text")).alias("replacement")).filter("replacement is not null")


def rewrite_pairs(s: DataFrame) -> DataFrame:
    """Replacement of two adjacent sentences of a paragraph; a sentence is used once, left to right.

    Matching pairs form runs; every other pair of a run is kept.
    """
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    df = s.select(
        "doc_id", "sent_id", "paragraph_id", "text", X.squeeze(F.col("text")).alias("a"),
        F.lead("paragraph_id").over(w).alias("np"), F.lead("text").over(w).alias("next_text"),
    ).filter("np = paragraph_id").withColumn("b", X.squeeze(F.col("next_text")))

    def fits(k):
        return F.col("a").rlike("(?i)" + fixed.OPPOSITION_PAIRS[k][0]) & F.col("b").rlike("(?i)" + fixed.OPPOSITION_PAIRS[k][1])

    def a(k, i):
        return F.regexp_extract("a", "(?i)" + fixed.OPPOSITION_PAIRS[k][0], i)

    def b(k, i):
        return F.regexp_extract("b", "(?i)" + fixed.OPPOSITION_PAIRS[k][1], i)

    df = df.withColumn(
        "kind", F.when(fits("glance"), "concessive_while").when(fits("hands"), "binary_contrast").when(fits("about"), "negation_reframe")
    ).filter("kind is not null")
    run = Window.partitionBy("doc_id").orderBy("sent_id")
    df = df.withColumn("g", F.col("sent_id") - F.row_number().over(run))
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "g").orderBy("sent_id"))).filter("k % 2 = 1")
    bare = F.regexp_replace(X.squeeze(a("about", 1)), r"[.!?]+$", "")
    text = (
        F.when(F.col("kind") == "concessive_while", X.finish_sentence(F.concat(F.lit("The practical opportunity is "), X.lower_first(b("glance", 1)))))
        .when(F.col("kind") == "binary_contrast", F.concat(X.finish_sentence(X.upper_first(a("hands", 1))), F.lit(" "), X.finish_sentence(X.upper_first(b("hands", 1)))))
        .otherwise(X.finish_sentence(F.concat(bare, F.lit(" depends on "), X.drop_article(b("about", 1)))))
    )
    return df.select(
        "doc_id", "sent_id", (F.col("sent_id") + 1).alias("end_id"), F.col("kind").alias("type"),
        F.concat_ws(" ", "text", "next_text").alias("original"), text.alias("replacement"),
    )


def opposition_candidates(s: DataFrame, hits: DataFrame, cands: DataFrame, mapping: DataFrame,
                          types=tuple(fixed.OPPOSITION_TYPES)) -> DataFrame:
    """Sentences with a target hit, a candidate mapped to a target, or an opposition template."""
    by_hit = hits.filter(F.col("type").isin(*types)).select(*SENT)
    by_cand = map_patterns(cands, mapping).filter(F.col("type").isin(*types)).select(*SENT)
    out = stack(by_hit, by_cand)
    if {"binary_contrast", "negation_reframe"} & set(types):
        out = stack(out, s.filter(opposition_reason(F.col("text")).isNotNull()).select(*SENT))
    return out.distinct()


def with_context(s: DataFrame) -> DataFrame:
    """Previous and next sentence of the paragraph, and the whole paragraph."""
    p = Window.partitionBy("doc_id", "paragraph_id")
    o = p.orderBy("sent_id")
    whole = F.array_sort(F.collect_list(F.struct("sent_id", "text")).over(p))
    return s.select(
        *SENT, "text", F.lag("text").over(o).alias("before"), F.lead("text").over(o).alias("after"),
        F.array_join(whole["text"], " ").alias("paragraph"),
    )


# ---------------------------------------------------------------- phrase rewrites


def tidy(c: Column) -> Column:
    """One space between words, none before marks, a capital after a sentence end.

    Spark's replacement strings cannot change case, so sentences are cut, capitalised and joined.
    """
    t = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s+([.,;:!?])", "$1")
    marked = F.regexp_replace(t, r"([.!?]\s+)([a-z])", "$1$2")
    # The text is named once: each use of it would rewrite it again.
    joined = lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), X.upper_first), ""))
    return X.trim_ws(X.let(F.split(marked, ""), joined))


def apply_phrase_rules(docs: DataFrame, rules=None) -> DataFrame:
    """Soften and compact rewrites of each text by a table of phrase rules."""
    plain = tidy(F.regexp_replace("text", "(?i)" + fixed.BINARY_RULE[0], fixed.BINARY_RULE[1]))
    softened = X.fold_replace(plain, rules or fixed.SOFTEN_RULES)
    level = tidy(softened)
    compact = tidy(X.fold_replace(softened, fixed.COMPACT_RULES))
    keys = [c for c in docs.columns if c != "text"]
    return docs.select(*keys, plain.alias("binary"), level.alias("level"), compact.alias("compact"))


# The forms below change a text that ``apply_phrase_rules`` has made plain.


def _softened(text: Column) -> Column:
    return X.fold_replace(tidy(F.regexp_replace(text, "(?i)" + fixed.BINARY_RULE[0], fixed.BINARY_RULE[1])), fixed.SOFTEN_RULES)


def level_rewrite(docs: DataFrame) -> DataFrame:
    """docs(text, statement_force, expression_budget, …) with ``level``: emphatic settings support the first claim of importance, a budget
    of none takes the strongest words out."""
    pattern, new = fixed.EMPHATIC_RULE
    emphatic = lambda t: F.when(F.col("statement_force") == "emphatic", F.regexp_replace(t, rf"(?is)^(.*?){pattern}", f"$1{new}")).otherwise(t)
    weaker = lambda t: F.when(F.col("expression_budget") == "none", F.regexp_replace(F.regexp_replace(t, "(?i)" + fixed.BUDGET_NONE, ""), r"\s{2,}", " ")).otherwise(t)
    return docs.withColumn("level", tidy(X.let(X.let(_softened(F.col("text")), emphatic), weaker)))


def evidence_first(docs: DataFrame) -> DataFrame:
    """docs with ``evidence_first``: openings that put the claim before its ground are turned round."""
    return docs.withColumn("evidence_first", tidy(X.fold_replace(_softened(F.col("text")), fixed.EVIDENCE_RULES)))


def rhythm_rewrite(docs: DataFrame) -> DataFrame:
    """docs with ``rhythm``: sentence by sentence, with other openings in certain places."""
    from prosegrain.operators.split import plain_sentence_array

    def turned(s: Column, i: Column) -> Column:
        t = _softened(s)
        out = t
        for place, pattern, new in fixed.RHYTHM_RULES:
            out = F.when(i == place, F.regexp_replace(t, pattern, new)).otherwise(out)
        return out

    return docs.withColumn("rhythm", tidy(F.array_join(F.transform(plain_sentence_array(F.col("text")), turned), " ")))
