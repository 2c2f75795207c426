"""Document-level aggregation: profiles, style checks, playbook scores, audits, picks and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stack
from prosegrain.operators import detect, windows

SENT = ["doc_id", "sent_id"]


def nice(c: Column, digits: int) -> Column:
    """Rounded without the noise of summing in another order."""
    return X.js_round(X.js_round(c, 9), digits)


def number(c: Column) -> Column:
    """A number as text, without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


# ---------------------------------------------------------------- profile


def profile(classified: DataFrame) -> DataFrame:
    """One row per document from sentences with ``patterns``, ``heat`` and register scores.

    Everything a document needs sits in its own sentences, so one shuffle by document feeds the
    neighbour windows, the medium-window entropies and the aggregation.
    """
    _, _, target, step = fixed.WINDOW_SETS[1]
    least = fixed.WINDOW_SETS[1][1]
    rows = Window.partitionBy("doc_id").orderBy("sent_id")
    hot = F.col("heat") >= 3
    s = classified.select(
        *SENT, "paragraph_id", F.col("word_count").cast("bigint").alias("wc"), "heat", "text",
        windows.dominant_register().alias("register"), X.opening_key(F.col("text")).alias("opening"),
        F.transform("patterns", lambda p: p["type"]).alias("types"),
    )
    s = s.withColumns({
        "before": F.coalesce(F.sum("wc").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")),
        "next_wc": F.lead("wc").over(rows),
        "region": (hot & ~F.coalesce(F.lag(hot).over(rows), F.lit(False)) & F.coalesce(F.lead(hot).over(rows), F.lit(False))).cast("int"),
    })
    frame = Window.partitionBy("doc_id").orderBy("before").rangeBetween(0, target - 1)
    start = F.col("sent_id") % step == 0
    # Only window starts need their frame; the others carry nothing on.
    s = s.withColumn("span", F.sum("wc").over(frame)).withColumn("frame", F.flatten(F.collect_list("types").over(frame)))
    kept = start & ((F.col("span") >= least) | (F.col("sent_id") == 0))
    s = s.withColumn("medium", F.when(kept, X.entropy_of(X.array_counts(F.col("frame")), F.size("frame")))).drop("frame")
    i = F.when(F.col("medium").isNotNull(), F.floor(F.col("sent_id") / step)).cast("double")
    wc = F.col("wc").cast("double")
    g = s.groupBy("doc_id").agg(
        F.sum("wc").alias("word_count"), F.count(F.lit(1)).alias("sentence_count"),
        F.count_distinct("paragraph_id").alias("paragraph_count"), X.exact_sum(F.col("heat")).alias("h"),
        F.sum("region").cast("bigint").alias("hot_region_count"),
        F.sum(wc * wc).alias("q"), F.coalesce(F.sum(wc * F.col("next_wc")), F.lit(0.0)).alias("p"),
        F.min_by(wc, "sent_id").alias("a"), F.max_by(wc, "sent_id").alias("z"),
        F.count("medium").alias("m"), F.sum(i).alias("sx"), F.sum(i * i).alias("sxx"),
        X.exact_sum(F.col("medium")).alias("sy"), X.exact_sum(i * F.col("medium")).alias("sxy"),
        F.collect_list("register").alias("registers"), F.flatten(F.collect_list("types")).alias("types"),
        F.count_distinct("opening").alias("openings"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "text"))), lambda x: X.words(x["text"]))).alias("words"),
    )
    g = g.withColumn("lower", F.transform("words", F.lower)).withColumn("stats", windows.token_stats(F.col("lower")))
    n, m = F.col("stats.n"), F.col("m").cast("double")
    k = F.col("sentence_count")
    slope = (m * F.col("sxy") - F.col("sx") * F.col("sy")) / (m * F.col("sxx") - F.col("sx") * F.col("sx"))
    return g.select(
        "doc_id", "word_count", "sentence_count", "paragraph_count",
        nice(F.col("h") / k, 1).alias("mean_heat"), "hot_region_count",
        F.when(F.col("m") < 2, 0.0).otherwise(nice(slope, 4)).alias("convergence_slope"),
        X.entropy_of(X.array_counts(F.col("registers")), F.size("registers")).alias("register_entropy"),
        X.entropy_of(X.array_counts(F.col("types")), F.size("types")).alias("device_entropy"),
        X.autocorrelation_of(k, F.col("word_count"), F.col("q"), F.col("p"), F.col("a"), F.col("z")).alias("autocorrelation"),
        X.ratio(F.col("stats.distinct"), n).alias("ttr"),
        windows.mattr_of(F.col("stats"), n).alias("mattr"),
        X.ratio(F.col("stats.hapax"), n).alias("hapax_ratio"),
        X.entropy_of(windows.word_length_counts(F.col("words")), n).alias("word_length_entropy"),
        F.when(k <= 1, 1.0).otherwise(X.ratio(F.col("openings"), k)).alias("opening_variety"),
        X.ratio(F.size(F.filter("lower", lambda x: x.isin(fixed.FUNCTION_WORDS))), n).alias("function_word_ratio"),
    )


def summary(classified: DataFrame) -> DataFrame:
    """Words, mean heat and device entropy of each document, as ``profile`` has them, in one group over three small columns."""
    s = classified.select("doc_id", F.col("word_count").cast("bigint").alias("wc"), "heat", F.transform("patterns", lambda p: p["type"]).alias("types"))
    g = s.groupBy("doc_id").agg(
        F.sum("wc").alias("word_count"), F.count(F.lit(1)).alias("k"), X.exact_sum(F.col("heat")).alias("h"),
        F.flatten(F.collect_list(F.when(F.size("types") > 0, F.col("types")))).alias("types"),
    )
    entropy = X.entropy_of(X.array_counts(F.col("types")), F.size("types"))
    return g.select("doc_id", "word_count", nice(F.col("h") / F.col("k"), 1).alias("mean_heat"), entropy.alias("device_entropy"))


# ---------------------------------------------------------------- paragraphs

PURPOSES = ["analytical", "narrative", "argumentative", "transitional", "summary", "example", "definition"]


def paragraph_purpose(s: DataFrame, hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Purpose of each paragraph from mean registers and arc roles, with its structural targets."""
    define = hits.filter("type = 'definitional_opening'").select(*SENT).distinct().withColumn("_d", F.lit(1))
    one = F.lit(1)

    def share(role):
        return F.sum(F.when(F.col("arc_role") == role, 1).otherwise(0)) / F.count(one)

    roles = ["elaboration", "claim", "evidence", "transition", "pivot", "resolution"]
    g = s.join(define, SENT, "left").groupBy("doc_id", "paragraph_id").agg(
        F.count(one).alias("n"), F.max("_d").alias("define"),
        *[(X.exact_sum(F.col(d)) / F.count(one)).alias(d) for d in fixed.REGISTERS],
        *[share(r).alias(f"r_{r}") for r in roles],
    )
    c = F.col
    g = g.withColumns({
        "s_analytical": c("informational") + c("abstract") + c("r_evidence") * 0.5,
        "s_narrative": c("narrative") * 2 + c("r_elaboration") + F.when(c("involved") > 0.3, 0.3).otherwise(0.0),
        "s_argumentative": c("persuasive") * 2 + c("r_claim") * 0.5 + c("r_evidence") * 0.5,
        "s_transitional": c("r_transition") * 2 + F.when(c("n") <= 2, 0.5).otherwise(0.0) + c("r_pivot"),
        "s_summary": c("r_resolution") * 2 + F.when(c("informational") > 0.5, 0.3).otherwise(0.0),
        "s_example": c("r_evidence") + c("r_elaboration") + c("narrative") * 0.5,
        "s_definition": c("abstract") * 1.5 + F.when(c("define") == 1, 1.0).otherwise(0.0) + c("informational") * 0.5,
    })
    scored = F.array_sort(F.array(*[F.struct((-X.js_round(c(f"s_{p}"), 9)).alias("v"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PURPOSES)]))
    g = g.withColumn("ranked", scored)
    margin = c("ranked")[1]["v"] - c("ranked")[0]["v"]
    out = g.select(
        "doc_id", "paragraph_id", c("ranked")[0]["p"].alias("purpose"),
        nice(F.least(F.lit(1.0), F.lit(0.5) + margin * 0.3), 2).alias("confidence"), c("n").alias("sentence_count"),
    )
    return out.join(targets, "purpose", "left")


# ---------------------------------------------------------------- style


def measures(s: DataFrame, hits: DataFrame) -> DataFrame:
    """The per-document measures behind the style checks."""
    kinds = ["nominalization", "importance_inflation", "transition_formulaic", "resolution_complete", "binary_contrast"]
    h = hits.groupBy("doc_id").agg(*[F.sum(F.when(F.col("type") == k, 1).otherwise(0)).alias(k) for k in kinds])
    multi = F.col("clause_count") >= 2
    one = F.lit(1)
    base = s.groupBy("doc_id").agg(
        F.count(one).alias("n"), F.sum("word_count").cast("bigint").alias("words"),
        F.sum(F.col("word_count").cast("double") * F.col("word_count")).alias("sq"),
        F.sum(F.col("has_participial").cast("int")).alias("participial"), F.sum(multi.cast("int")).alias("multi"),
        X.exact_sum(F.when(multi, F.col("clause_balance_ratio"))).alias("balance"),
    )
    roles = s.groupBy("doc_id", "paragraph_id", "arc_role").agg(F.count(one).alias("c"), F.min("sent_id").alias("f"))
    dom = roles.groupBy("doc_id", "paragraph_id").agg(F.min_by("arc_role", F.struct(-F.col("c"), "f")).alias("role"))
    w = Window.partitionBy("doc_id").orderBy("paragraph_id")
    wr = Window.partitionBy("doc_id", "role").orderBy("paragraph_id")
    runs = dom.withColumn("g", F.row_number().over(w) - F.row_number().over(wr)).groupBy("doc_id", "role", "g").agg(F.count(one).alias("run"))
    longest = runs.groupBy("doc_id").agg(F.max("run").alias("same_arc"))
    m = (
        base.join(h, "doc_id", "left").join(longest, "doc_id", "left")
        .join(windows.autocorrelation(s, ["doc_id"], "sent_id", "word_count"), "doc_id", "left")
        .join(windows.device_entropy(hits, ["doc_id"]).withColumnRenamed("entropy", "device_entropy"), "doc_id", "left")
    )
    z = lambda k: F.coalesce(F.col(k), F.lit(0)).cast("double")
    words, n = F.col("words").cast("double"), F.col("n").cast("double")
    return m.select(
        "doc_id", "n", "words", (words / n).alias("mean_length"), X.std_pop_of(F.col("n"), F.col("words"), F.col("sq")).alias("std_length"),
        (z("nominalization") / (words / 100)).alias("nominalization"), F.col("autocorrelation"),
        F.coalesce("device_entropy", F.lit(0.0)).alias("device_entropy"),
        (z("importance_inflation") / (words / 100)).alias("importance_inflation"),
        (z("transition_formulaic") / n).alias("transitions"), (F.col("participial") / n).alias("participial"),
        F.when(F.col("multi") > 0, X.js_round(F.col("balance") / F.col("multi"), 9)).alias("balance"),
        F.coalesce("same_arc", F.lit(1)).alias("same_arc"),
        (z("resolution_complete") / n).alias("resolution"), (z("binary_contrast") / words * 1000).alias("binary"),
    )


MAX_GUIDES = 1000


def _guide_rows(guides: DataFrame) -> Column:
    rows = guides.limit(MAX_GUIDES + 1).collect()
    if len(rows) > MAX_GUIDES:
        raise ValueError(f"more than {MAX_GUIDES} style guides")
    return F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in guides.columns]) for r in rows])


def style_delta(s: DataFrame, hits: DataFrame, guides: DataFrame) -> DataFrame:
    """Violations(doc_id, guide, dimension, current, target, severity) of eleven checks.

    Guides are a short list, so each document meets them inside its row.
    """
    m = measures(s, hits).withColumn("g", F.explode(_guide_rows(guides)))
    c, g = F.col, lambda k: F.col("g")[k]

    def v(cond, name, current, target, high, low="medium"):
        return F.when(
            cond,
            F.struct(F.lit(name).alias("dimension"), current.cast("double").alias("current"), target.cast("double").alias("target"),
                     F.when(high, "high").otherwise(low).alias("severity")),
        )

    off = F.abs(c("resolution") - g("resolution_target"))
    cells = F.array(
        v(c("std_length") < g("len_std") * 0.6, "sentence_length_variance", X.js_round(c("std_length"), 1), g("len_std"), c("std_length") < g("len_std") * 0.3),
        v(c("nominalization") > g("nominalization_max") * 100, "nominalization_ratio", X.js_round(c("nominalization"), 2), g("nominalization_max") * 100, c("nominalization") > g("nominalization_max") * 200),
        v(c("autocorrelation") > g("max_rho"), "sentence_length_autocorrelation", c("autocorrelation"), g("max_rho"), c("autocorrelation") > g("max_rho") * 1.5),
        v(c("device_entropy") < g("entropy_min"), "device_entropy", c("device_entropy"), g("entropy_min"), c("device_entropy") < g("entropy_min") * 0.6),
        v(c("importance_inflation") > g("inflation_max") * 100, "importance_inflation", X.js_round(c("importance_inflation"), 2), g("inflation_max") * 100, F.lit(True)),
        v(c("transitions") > g("transition_max"), "transition_formulaicness", X.js_round(c("transitions"), 2), g("transition_max"), c("transitions") > g("transition_max") * 2),
        v(c("participial") > g("participial_max"), "participial_density", X.js_round(c("participial"), 2), g("participial_max"), c("participial") > g("participial_max") * 2),
        v(c("balance") > g("max_balance"), "clause_symmetry", X.js_round(c("balance"), 2), g("max_balance"), c("balance") > g("max_balance") + 0.1),
        v(c("same_arc") > g("max_consecutive_same"), "paragraph_arc_diversity", c("same_arc"), g("max_consecutive_same"), c("same_arc") > g("max_consecutive_same") + 2),
        v(off > 0.2, "resolution_completeness", X.js_round(c("resolution"), 2), g("resolution_target"), off > 0.4),
        v((c("binary") < g("contrast_min")) | (c("binary") > g("contrast_max")), "binary_contrast_frequency", X.js_round(c("binary"), 2),
          F.when(c("binary") > g("contrast_max"), g("contrast_max")).otherwise(g("contrast_min")),
          (c("binary") > g("contrast_max") * 1.5) | (c("binary") < g("contrast_min") * 0.5), "low"),
    )
    return m.select("doc_id", F.col("g.name").alias("guide"), F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("v")).select("doc_id", "guide", "v.*")


def style_distance(v: DataFrame) -> DataFrame:
    """Weighted share of violated checks per document and guide, at most 1."""
    w = F.sum(F.when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 6).otherwise(3)) / F.lit(10.0)
    return v.groupBy("doc_id", "guide").agg(
        F.count(F.lit(1)).alias("n_violations"), X.js_round(F.least(F.lit(1.0), w / 11), 2).alias("distance")
    )


def guides(dims: dict[str, DataFrame], name: str | None = None) -> DataFrame:
    g = dims["guides"]
    return g.filter(F.col("name") == name) if name else g.select("name", "description")


def derive_guide(s: DataFrame, hits: DataFrame) -> DataFrame:
    """Style targets per document as exemplar."""
    m = measures(s, hits)
    c = F.col
    r0 = lambda x: X.js_round(x, 0)
    return m.select(
        "doc_id", r0(c("mean_length")).alias("len_mean"), r0(c("std_length")).alias("len_std"),
        F.greatest(F.lit(1.0), r0(c("mean_length") - c("std_length") * 2)).alias("len_min"),
        r0(c("mean_length") + c("std_length") * 2.5).alias("len_max"),
        X.js_round(c("nominalization") / 100, 2).alias("nominalization_max"),
        X.js_round(c("participial"), 2).alias("participial_max"),
        X.js_round(F.coalesce("balance", F.lit(0.75)), 2).alias("max_balance"),
        F.lit(2).alias("max_consecutive_same"), X.js_round(c("resolution"), 2).alias("resolution_target"),
        F.greatest(F.lit(0.0), X.js_round(c("binary") - 1, 1)).alias("contrast_min"),
        X.js_round(c("binary") + 2, 1).alias("contrast_max"),
        nice(F.greatest(c("autocorrelation") + 0.05, F.lit(0.15)), 2).alias("max_rho"),
        nice(F.greatest(c("device_entropy") - 0.3, F.lit(1.5)), 1).alias("entropy_min"),
        X.js_round(c("importance_inflation") / 100, 2).alias("inflation_max"),
        X.js_round(c("transitions"), 2).alias("transition_max"), F.lit(0.5).alias("continuity"),
    )


def voice_summary(guide: DataFrame) -> DataFrame:
    return guide.select(
        "doc_id",
        F.concat(F.lit("Sentence length ~"), number(F.col("len_mean")), F.lit(" words. Vary rhythm (autocorrelation ≤"), number(F.col("max_rho")),
                 F.lit("). Device entropy ≥"), number(F.col("entropy_min")), F.lit(". Nominalization max "), number(F.col("nominalization_max")), F.lit(".")).alias("voice"),
    )


# ---------------------------------------------------------------- clusters and playbook


def pattern_clusters(s: DataFrame, hits: DataFrame) -> DataFrame:
    n = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    g = hits.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("sent_id")).alias("sentences"))
    return g.join(n, "doc_id").select("doc_id", "type", "n", "sentences", (F.col("n") / F.col("total")).alias("density"))


def playbook_clusters(c: DataFrame, playbook: DataFrame) -> DataFrame:
    return c.join(playbook.select("type").distinct(), "type", "left_semi")


def playbook_scores(docs: DataFrame, hits: DataFrame, v: DataFrame, layers: DataFrame) -> DataFrame:
    """Score of every layer of every document, its worst layer and the total; layers without a hit count 0.

    ``layers`` is the playbook, a dimension of a few dozen rows.
    """
    n = hits.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("c"))
    vc = windows.violation_counts(v)
    one = n.join(vc, ["doc_id", "type"], "left").join(layers, "type")
    one = one.withColumn("v", F.coalesce("violations", F.lit(0)).cast("bigint"))
    g = one.groupBy("doc_id", "layer_pos").agg(
        F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(1)).alias("hit_count"), F.sum("v").alias("violation_count"),
        F.count(F.lit(1)).alias("n_patterns"),
    )
    w = Window.partitionBy("doc_id")
    cells = docs.select("doc_id").crossJoin(layers.select("layer_pos", "layer", "label").distinct())
    return (
        cells.join(g, ["doc_id", "layer_pos"], "left").fillna(0, ["hit_count", "violation_count", "n_patterns"])
        .withColumn("total_hits", F.sum("hit_count").over(w))
        .withColumn("rank", F.row_number().over(w.orderBy(F.desc("hit_count"), "layer_pos")))
        .select("doc_id", "layer", "label", "hit_count", "violation_count", "n_patterns", (F.col("rank") == 1).alias("worst"), "total_hits")
    )


def audit(docs: DataFrame, hits: DataFrame, sep: str = r"\n\s*\n") -> DataFrame:
    """(doc_id, check, automated, status, detail): ten automated checks and three manual ones."""
    from prosegrain.operators.split import paragraph_array

    rev = hits.filter(F.col("type").isin("binary_contrast", "negation_reframe")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rev"))
    swap = detect.lexicon_hits(docs)
    lines = detect.swap_lines(swap).groupBy("doc_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("index", "line"))), 1, 3).alias("_lines")
    )
    nsw = swap.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_swaps"))
    t = F.col("text")
    openers = F.filter(
        F.transform(paragraph_array(t, sep), lambda p: F.lower(F.regexp_extract(p, r"^[\s#>*-]*+([A-Za-z0-9_]+)", 1))), lambda w: w != ""
    )
    df = (
        docs.select("doc_id", "text", F.lower("text").alias("_low")).join(rev, "doc_id", "left").join(nsw, "doc_id", "left").join(lines, "doc_id", "left")
        .withColumns({
            "em": F.regexp_count(t, F.lit("—|--")), "bad": detect.banned_found(t, F.col("_low")),
            "re": X.match_count(t, fixed.BINARY_REFRAME_RE) + F.coalesce("_rev", F.lit(0)),
            "ft": X.match_count(t, fixed.FORMAL_TRANSITION_RE, False), "mc": X.match_count(t, fixed.META_COMMENTARY_RE),
            "ve": X.match_count(t, fixed.VAGUE_ENDING_RE), "li": X.three_item_lists(t),
            "op": F.coalesce(F.array_max(X.array_counts(openers)), F.lit(0)), "st": X.match_count(t, fixed.STIFF_FORM_RE),
            "sw": F.coalesce("_swaps", F.lit(0)),
        })
    )
    c = lambda k: F.col(k)
    s = lambda k: F.col(k).cast("string")
    bad = F.size("bad")
    checks = [
        ("em_dash", c("em") <= 1, "fail", F.when(c("em") == 0, "No em dashes").otherwise("1 em dash"), F.concat(s("em"), F.lit(" em dashes found"))),
        ("worst_words", bad == 0, "fail", F.lit("No banned words"), F.concat(F.lit("Found: "), F.array_join(F.slice("bad", 1, 5), ", "), F.when(bad > 5, "…").otherwise(""))),
        ("lexicon_scan", c("sw") == 0, "fail", F.lit("No lexicon hits"), F.concat(s("sw"), F.lit(" banned phrase(s) — swap: "), F.array_join("_lines.line", "; "))),
        ("binary_reframe", c("re") == 0, "fail", F.lit("No binary reframes"), F.concat(s("re"), F.lit(" binary reframe signal(s)"))),
        ("formal_transitions", c("ft") == 0, "fail", F.lit("No formal openers"), F.concat(s("ft"), F.lit(" formal transition(s)"))),
        ("meta_commentary", c("mc") == 0, "fail", F.lit("No meta-commentary"), F.concat(s("mc"), F.lit(" meta-commentary phrase(s)"))),
        ("vague_ending", c("ve") == 0, "fail", F.lit("No vague closers"), F.concat(s("ve"), F.lit(" vague ending(s)"))),
        ("three_item_list", c("li") == 0, "warn", F.lit("No three-item list chains"), F.concat(s("li"), F.lit(" possible three-item list(s) — verify each needs three"))),
        ("paragraph_opener", c("op") < 3, "fail", F.lit("Paragraph openers vary"), F.concat(s("op"), F.lit(" paragraphs start the same way"))),
        ("contraction", c("st") <= 2, "warn", F.when(c("st") == 0, "Contractions OK").otherwise(F.concat(s("st"), F.lit(" stiff form(s)"))), F.concat(s("st"), F.lit(" stiff forms (do not, cannot…) — consider contractions"))),
    ]
    cells = [
        F.struct(F.lit(n).alias("check"), F.lit(True).alias("automated"), F.when(ok, "pass").otherwise(no).alias("status"), F.when(ok, good).otherwise(text).alias("detail"))
        for n, ok, no, good, text in checks
    ] + [
        F.struct(F.lit(n).alias("check"), F.lit(False).alias("automated"), F.lit("manual").alias("status"), F.lit("").alias("detail"))
        for n, _, auto in fixed.AUDIT_CHECKS if not auto
    ]
    out = df.select("doc_id", F.array(*cells).alias("a"))
    passed = F.size(F.filter("a", lambda x: x["status"] == "pass"))
    return out.select("doc_id", passed.alias("passed"), F.explode("a").alias("x")).select("doc_id", "x.*", "passed")


# ---------------------------------------------------------------- hot sentences


def _with_confidence(s: DataFrame, hits: DataFrame) -> DataFrame:
    h = hits.groupBy(*SENT).agg(
        F.count(F.lit(1)).alias("n_hits"), X.exact_sum(F.col("confidence")).alias("csum"), F.max("confidence").alias("cmax"),
        F.min_by("type", F.struct(-F.col("confidence"), "hit_pos")).alias("primary"),
    )
    return s.join(h, SENT)


def _impact() -> Column:
    wc = F.greatest(F.lit(1), F.col("word_count"))
    brevity = F.when(wc <= 20, 1.2).when(wc <= 35, 1.08).otherwise(1.0)
    compound = F.when(F.col("n_hits") >= 2, 1.12).otherwise(1.0)
    return X.js_round(F.col("heat") * brevity * compound * (F.lit(0.65) + F.lit(0.35) * (F.col("csum") / F.col("n_hits"))), 6)


def sentence_impact(classified: DataFrame) -> DataFrame:
    """``impact`` of sentences that carry their own patterns and heat: a projection."""
    conf = F.transform("patterns", lambda p: p["confidence"].cast("decimal(18,6)"))
    total = F.aggregate(conf, F.lit(0).cast("decimal(28,6)"), lambda a, x: (a + x).cast("decimal(28,6)")).cast("double")
    rows = classified.select(*SENT, "word_count", "heat", F.size("patterns").alias("n_hits"), total.alias("csum"))
    # A filter would move below and match the texts again.
    return rows.select(*SENT, F.inline(F.when(F.col("n_hits") > 0, F.array(F.struct(_impact().alias("impact"))))))


def impact(s: DataFrame, hits: DataFrame) -> DataFrame:
    return _with_confidence(s, hits).select(*SENT, _impact().alias("impact"))


def eligible(s: DataFrame, hits: DataFrame, min_conf: float = 0.45) -> DataFrame:
    """Sentences worth a rewrite, with impact and primary type."""
    total = s.groupBy("doc_id").agg(F.sum("word_count").alias("words"))
    e = _with_confidence(s, hits).join(total, "doc_id")
    least = F.when(F.col("words") <= 800, 1.8).otherwise(2.5)
    ok = (F.col("cmax") >= min_conf) & (((F.col("cmax") >= 0.8) & (F.col("heat") >= 1.0)) | (F.col("heat") >= least))
    return e.filter(ok).select(*SENT, "paragraph_id", "heat", "primary", "words", _impact().alias("impact"))


def budget(profile: DataFrame, hits: DataFrame) -> DataFrame:
    n = hits.select(*SENT).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("patterned"))
    w = F.col("word_count")
    b = F.when(w <= 150, 2).when(w <= 500, 3).when(w <= 1000, 5).otherwise(3)
    cap = F.greatest(F.lit(1), F.ceil(F.col("sentence_count") * 0.2))
    p = F.coalesce("patterned", F.lit(0))
    return profile.join(n, "doc_id", "left").select("doc_id", F.least(b, p, cap).cast("bigint").alias("budget"))


def _chosen(ranked: str, state: Column, limit: Column, cap: Column, regional: bool) -> Column:
    """``state`` after one look at each candidate of ``ranked``: it joins while there is room in the document and in its paragraph,
    and, where regions choose, if its region has none yet. The state holds a few rows, so searching it is cheap."""

    def step(a, x):
        here = F.size(F.filter(a["picks"], lambda p: p["paragraph_id"] == x["paragraph_id"]))
        known = F.exists(a["picks"], lambda p: p["sent_id"] == x["sent_id"])
        free = ~F.exists(a["picks"], lambda p: p["region"].eqNullSafe(x["region"])) if regional else F.lit(True)
        take = (F.size(a["picks"]) < limit) & ~known & (here < cap) & free
        return F.when(take, F.struct(F.concat(a["picks"], F.array(x)).alias("picks"))).otherwise(a)

    return F.aggregate(ranked, state, step)


def pick_hot(s: DataFrame, hits: DataFrame, regions: DataFrame, budget: DataFrame) -> DataFrame:
    """Sentences to rewrite: one per hot region, then by impact with a bonus for a new type, within a
    budget and a cap per paragraph. A choice depends on the earlier ones, so it is a fold over a document's ranked
    eligible sentences."""
    r = regions.select("doc_id", F.col("start_sentence").alias("region"), F.col("heat").alias("region_heat"), F.explode(F.sequence("start_sentence", "end_sentence")).alias("sent_id"))
    e = eligible(s, hits).join(r, SENT, "left").join(budget, "doc_id").filter("budget > 0")
    row = F.struct("sent_id", "paragraph_id", "heat", "impact", "primary", "region", "region_heat")
    d = e.groupBy("doc_id").agg(F.collect_list(row).alias("rows"), F.first("budget").alias("budget"), F.first("words").alias("words"))
    cap = F.when(F.col("words") <= 300, 1).otherwise(2)
    by = lambda rows, *keys: F.transform(F.array_sort(F.transform(rows, lambda x: F.struct(*(k(x).alias(f"k{i}") for i, k in enumerate(keys)), x.alias("x")))), lambda y: y["x"])
    sent = lambda x: x["sent_id"]
    inside = by(F.filter("rows", lambda x: x["region"].isNotNull()), lambda x: -x["region_heat"], lambda x: x["region"], lambda x: -x["impact"], sent)
    none = F.slice("rows", 1, 0)
    d = d.withColumn("regional", inside).withColumn("first", _chosen("regional", F.struct(none.alias("picks")), F.col("budget"), cap, True))
    fresh = lambda x: F.when(F.exists("first.picks", lambda p: p["primary"] == x["primary"]), 1.0).otherwise(1.3)
    rest = by(F.filter("rows", lambda x: x["impact"] > 0), lambda x: -(x["impact"] * fresh(x)), sent)
    d = d.withColumn("rest", rest).withColumn("all", _chosen("rest", F.col("first"), F.col("budget"), cap, False))
    return d.select("doc_id", F.explode("all.picks").alias("p")).select("doc_id", "p.sent_id", "p.heat", "p.impact")


# ---------------------------------------------------------------- advice


def diagnose(hits: DataFrame, v: DataFrame | None, registry: DataFrame, genre: str = "general", k: int = 5,
             passage: DataFrame | None = None, playbook: DataFrame | None = None) -> DataFrame:
    """Top hot patterns per document by violations, self amplification and count.

    ``passage`` (doc_id, start_sentence, end_sentence) and ``playbook`` (type) say which hits count; violations count whole documents.
    """
    if passage is not None:
        hits = hits.join(passage.select("doc_id", "start_sentence", "end_sentence"), "doc_id").filter(F.col("sent_id").between(F.col("start_sentence"), F.col("end_sentence"))).drop("start_sentence", "end_sentence")
    if playbook is not None:
        hits = hits.join(playbook.select("type").distinct(), "type", "left_semi")
    n = hits.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sent_id", "hit_pos")).alias("first"))
    reg = registry.select("type", "name", "amplification", F.coalesce(F.col("tolerance")[genre], F.lit(1.0)).alias("tol"))
    j = n.join(windows.violation_counts(v), ["doc_id", "type"], "left") if v is not None else n.withColumn("violations", F.lit(0))
    j = j.join(reg, "type", "left")
    j = j.filter(F.coalesce("tol", F.lit(1.0)) < 1.5).withColumn("violations", F.coalesce("violations", F.lit(0)).cast("bigint"))
    amp = F.when(F.col("amplification") == "high", 0).when(F.col("amplification") == "med", 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy(F.desc("violations"), amp, F.desc("n"), "first")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("doc_id", "rank", "type", "name", "n", "violations")


def avoid_lines(hot: DataFrame, menus: DataFrame, history: DataFrame, seed: int = 0, directives: DataFrame | None = None) -> DataFrame:
    """One line per hot pattern: a menu option not used last time, chosen by a seeded hash; without a menu the pattern's own
    directive(type, directive), and without that its type."""
    m = menus.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("option", "instruction"))).alias("menu"))
    j = hot.join(m, "type", "left").join(history, ["doc_id", "type"], "left")
    fresh = F.filter("menu", lambda o: o["option"] != F.coalesce("last_option", F.lit(-1)))
    j = j.withColumn("pool", F.when(F.size(fresh) > 0, fresh).otherwise(F.col("menu")))
    at = F.pmod(F.col("doc_id") * 31 + F.length("type") * 7 + F.lit(seed), F.size("pool")).cast("int")
    o = F.get("pool", at)
    j = j.withColumn("option", F.when(F.size("pool") > 0, o["option"])).withColumn("instruction", F.when(F.size("pool") > 0, o["instruction"]))
    who = F.coalesce("name", "type")
    suffix = F.when(F.col("violations") > 0, F.concat(F.lit(", "), F.col("violations").cast("string"), F.lit(" window violation(s)"))).otherwise("")
    line = F.when(
        F.col("option").isNotNull(), F.concat(who, F.lit(" ("), F.col("n").cast("string"), F.lit("× detected"), suffix, F.lit("): "), "instruction")
    ).otherwise(F.concat(who, F.lit(" — avoid: "), "type"))
    if directives is not None:
        j = j.join(directives.select("type", "directive"), "type", "left")
        plain = F.concat(F.col("name"), F.lit(" — "), F.regexp_replace("directive", r"^((?s:.*?))Do NOT ", "$1avoid: "))
        line = F.when(F.col("option").isNull() & F.col("directive").isNotNull(), F.coalesce(plain, F.col("type"))).otherwise(line)
    return j.select("doc_id", "rank", "type", F.coalesce("option", F.lit(0)).alias("option"), line.alias("line"))


def target_lines(profile: DataFrame, v: DataFrame, personal: DataFrame | None = None) -> DataFrame:
    """Advice from style violations and three global limits, and the lines of personal(doc_id, line)."""
    name = F.replace(F.col("dimension"), F.lit("_"), F.lit(" "))
    from_style = v.select("doc_id", F.concat(name, F.lit(": currently "), number(F.col("current")), F.lit(", target "), number(F.col("target"))).alias("line"))
    cells = F.array(
        F.when(F.col("autocorrelation") > 0.3, fixed.LINE_RHYTHM), F.when(F.col("device_entropy") < 2.0, fixed.LINE_VARIETY),
        F.when(F.col("convergence_slope") < -0.1, fixed.LINE_DECAY),
    )
    own = [personal.select("doc_id", "line")] if personal is not None else []
    return stack(from_style, profile.select("doc_id", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("line")), *own)


def positive_targets(profile: DataFrame, guide: DataFrame | None = None) -> DataFrame:
    cells = [
        F.when(F.col("autocorrelation") > 0.25, fixed.POSITIVE_RHYTHM), F.when(F.col("device_entropy") < 2.0, fixed.POSITIVE_VARIETY),
        F.when(F.col("convergence_slope") < -0.05, fixed.POSITIVE_DECAY),
    ]
    if guide is not None:
        g = guide.select(F.col("len_std").alias("_std"), F.col("entropy_min").alias("_least"), F.col("max_rho").alias("_rho")).limit(1)
        profile = profile.join(g, F.lit(True), "left")
        cells.append(F.concat(F.lit("Target sentence length std dev: "), number(F.col("_std")), F.lit("+ words")))
        cells.append(F.concat(F.lit("Target device entropy: "), number(F.col("_least")), F.lit("+")))
        cells.append(F.when(F.col("_rho") < 0.3, F.concat(F.lit("Keep rhythm autocorrelation below "), number(F.col("_rho")))))
    return profile.select("doc_id", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("line"))


def avoid_directives(hits: DataFrame, registry: DataFrame, k: int = 8) -> DataFrame:
    """Directives of the most frequent patterns. ``registry.directive`` is used when the table has one."""
    n = hits.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sent_id", "hit_pos")).alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    top = n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    text = F.concat(F.lit("Avoid: "), F.col("type"))
    if "directive" in registry.columns:
        top = top.join(registry.select("type", "directive"), "type", "left")
        text = F.coalesce("directive", text)
    return top.select("doc_id", "rank", "type", "n", text.alias("line"))


def directives(settings: DataFrame) -> DataFrame:
    """Directive lines of settings(doc_id, <seven fields>, notes)."""
    fields = list(dict.fromkeys(f for f, _, _ in fixed.DIRECTIVES))
    cells = []
    for f in fields:
        out = None
        for name, value, line in fixed.DIRECTIVES:
            if name == f:
                out = F.when(F.col(f) == value, line) if out is None else out.when(F.col(f) == value, line)
        cells.append(out)
    if "notes" in settings.columns:
        note = X.trim_ws(F.col("notes"))
        cells.append(F.when(note != "", F.concat(F.lit("Additional notes: "), note)))
    return settings.select("doc_id", F.posexplode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("pos", "line"))


def tone(settings: DataFrame) -> DataFrame:
    """(doc_id, line): the tone that settings(doc_id, statement_force, expression_budget) ask for."""
    bits = F.concat_ws(", ", F.nullif(F.col("statement_force"), F.lit("")), F.when(F.col("expression_budget") != "", F.concat("expression_budget", F.lit(" strongest expressions"))))
    return settings.select("doc_id", F.when(bits != "", F.concat(F.lit("Tone: "), bits)).otherwise("Default tone").alias("line"))


# ---------------------------------------------------------------- opposition scan


def opposition_scan(s: DataFrame, hits: DataFrame, cands: DataFrame, mapping: DataFrame, w: DataFrame) -> dict[str, DataFrame]:
    """Opposition hits by sentence, paragraph and section."""
    h = hits.filter(F.col("type").isin(fixed.OPPOSITION_TYPES)).select(*SENT, "type", "evidence", F.lit(0).alias("src"), F.col("hit_pos").cast("int").alias("o"))
    m = detect.map_patterns(cands, mapping).filter(F.col("type").isin(fixed.OPPOSITION_TYPES))
    m = m.select(*SENT, "type", "evidence", F.lit(1).alias("src"), (F.col("sub_pos") * 10 + F.col("map_pos")).cast("int").alias("o"))
    both = stack(h, m).groupBy(*SENT, "type").agg(F.min_by("evidence", F.struct("src", "o")).alias("evidence"))
    both = both.join(s.select(*SENT, "paragraph_id", "text"), SENT)
    both = both.filter((F.col("type") != "clause_symmetry") | X.matches(F.col("text"), fixed.OPPOSITION_SIGNAL_RE))
    paras = both.groupBy("doc_id", "paragraph_id").agg(
        F.count(F.lit(1)).alias("hit_count"), F.sort_array(F.collect_set("sent_id")).alias("sentence_ids"),
        F.sort_array(F.collect_set("type")).alias("types"), F.min_by("text", "sent_id").alias("excerpt"),
    )
    per = both.groupBy(*SENT).agg(F.count(F.lit(1)).alias("c"), F.collect_set("type").alias("ts"))
    kinds = {f"t{i}": t for i, t in enumerate(sorted(fixed.OPPOSITION_TYPES))}
    w = w.filter("size <> 'narrow'")
    values = {"hits": F.col("row.c"), "n_sentences": F.lit(1), **{n: F.array_contains("row.ts", t).cast("int") for n, t in kinds.items()}}
    sec = windows.totals(windows.swept(windows.reached(w, per), list(values), windows._held(**values)), list(values)).filter("n_sentences > 0")
    sec = sec.withColumn("types", F.array_compact(F.array(*(F.when(F.col(n) > 0, t) for n, t in kinds.items())))).drop(*kinds)
    sec = sec.withColumn("density", F.when(F.col("word_count") > 0, X.js_round(F.col("hits") / F.col("word_count") * 1000, 2)).otherwise(0.0))
    return {"sentences": both.drop("text"), "paragraphs": paras, "sections": sec.drop("hits")}
