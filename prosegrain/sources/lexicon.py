"""Building a clean lexicon from a raw phrase table with width-limited columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stack, stored
from prosegrain.operators import detect

# Widths at which the raw export cuts a column.
PHRASE_CAP, REPLACEMENT_CAP, GENRES_CAP = 50, 60, 40
# Subcategories that are not single-word matters.
SENTENCE_SUBCATEGORIES = (
    "contrastive_negation triadic_list balanced_formula compare_contrast_frame title_template listicle_frame "
    "engagement_bait search_optimizer content_farm_formula uplift_formula"
).split()
# Words in a genre that point to a style.
GENRE_STYLES = [
    ("academic", "academic|pubmed|research"), ("marketing", "marketing|seo|affiliate|saas|b2b"),
    ("technical", "technical|engineering|software|it "), ("journalism", "journalism|news|reporting"),
    ("literary-essay", "fiction|creative|narrative|literary"), ("code", "code|documentation"),
]
NO_MENU = "Replace the generic phrase with a specific claim."


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“”‘’", "\"\"''")


def _plain(c: Column) -> Column:
    return X.squeeze(F.regexp_replace(straight_quotes(X.trim_ws(c)), r'^"+|"+$', ""))


def clean_phrase(raw: DataFrame) -> DataFrame:
    """Add alternatives, matchable, truncated and template to rows with a raw ``phrase``."""
    capped = F.length("phrase") >= PHRASE_CAP
    text = F.regexp_replace(straight_quotes(F.col("phrase")), r"\s*\([^)]*(\)|$)", "")
    d = raw.withColumn("_text", text)
    alts = F.filter(F.transform(F.split("_text", " / "), lambda a: X.squeeze(F.replace(a, F.lit('"'), F.lit("")))), lambda a: a != "")
    d = d.withColumn("_alts", alts)
    d = d.withColumn("_alts", F.when(capped & (F.size("_alts") > 1), F.slice("_alts", F.lit(1), F.size("_alts") - 1)).otherwise(F.col("_alts")))
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    cut = capped & (F.size("_alts") <= 1) & (count(F.col("_text"), '"') % 2 == 1)
    d = d.withColumn("alternatives", F.filter("_alts", lambda a: count(a, "[") == count(a, "]")))
    usable = F.filter("alternatives", lambda a: ~X.matches(a, r"\b[XYZ]\b", False))
    d = d.withColumn("matchable", F.when(F.col("phrase").rlike("^[A-Z][^:]{3,40}: "), F.array().cast("array<string>")).otherwise(usable))
    return d.withColumn("truncated", (F.size("alternatives") == 0) | cut).withColumn("template", F.size("matchable") == 0).drop("_text", "_alts")


def clean_replacement(c: Column) -> Column:
    """STRUCT<text, truncated> of a replacement cut at its width."""
    t = X.trim_ws(straight_quotes(c))
    items = F.filter(F.transform(F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1)), X.trim_ws), lambda i: i != "")
    p = _plain(c)
    short = F.length(c) < REPLACEMENT_CAP
    open_ = F.regexp_replace(p, r"\s*\([^)]*$", "")
    many = F.contains(open_, F.lit(" / "))
    quoted = t.startswith('"')
    text = (
        F.when(quoted & (F.size(items) > 0), F.array_join(items, " / ")).when(quoted | short, p)
        .when(many, X.trim_ws(F.regexp_extract(open_, "^(.*) / ", 1))).otherwise(X.trim_ws(open_))
    )
    cut = F.when(quoted, F.size(items) == 0).otherwise(~short & ~many)
    return F.struct(text.alias("text"), cut.alias("truncated"))


def clean_genres(c: Column) -> Column:
    cut = (F.length(c) >= GENRES_CAP) & F.contains(c, F.lit(", "))
    return X.trim_ws(F.when(cut, F.regexp_extract(c, "^(.*), ", 1)).otherwise(c))


def tier(signal: Column, risk: Column) -> Column:
    s, r = F.lower(signal), F.lower(risk)
    return F.when(F.contains(s, F.lit("weak")) | r.isin("high", "unknown"), "watch").when(
        F.contains(s, F.lit("strong")) & r.isin("low", "medium"), "strong"
    ).otherwise("moderate")


def build_lexicon(raw: DataFrame) -> DataFrame:
    """Clean lexicon of raw(id, category, subcategory, phrase, signal, fp_risk, replacement, genres)."""
    d = clean_phrase(raw)
    r = clean_replacement(F.coalesce("replacement", F.lit("")))
    return d.select(
        "id", "category", "subcategory", F.array_join("alternatives", " / ").alias("phrase"), "alternatives", "matchable", "truncated", "template",
        "signal", "fp_risk", tier(F.coalesce("signal", F.lit("")), F.coalesce("fp_risk", F.lit(""))).alias("tier"),
        r["text"].alias("replacement"), r["truncated"].alias("replacement_truncated"), clean_genres(F.coalesce("genres", F.lit(""))).alias("genres"),
    )


def lexicon_phrases(lex: DataFrame) -> DataFrame:
    """The matcher table: one row per matchable wording, ordered inside its subcategory."""
    d = lex.select("id", "subcategory", "tier", F.posexplode("matchable").alias("i", "phrase"))
    order = lex.select("subcategory").distinct().withColumn("sub_pos", F.row_number().over(Window.orderBy("subcategory")) - 1)
    w = Window.partitionBy("subcategory").orderBy("id", "i")
    return d.withColumn("phrase_pos", F.row_number().over(w) - 1).join(order, "subcategory").select("subcategory", "sub_pos", "phrase_pos", "phrase", "tier", "id")


def lexicon_rollup(lex: DataFrame) -> DataFrame:
    """Per subcategory: mean weight, majority risk, level and the first five different replacements."""
    s, r = F.lower("signal"), F.lower("fp_risk")
    weight = F.when(F.contains(s, F.lit("strong")), 1.0).when(F.contains(s, F.lit("moderate")), 0.7).otherwise(0.4)
    amp = F.when(F.contains(r, F.lit("high")), "high").when(F.contains(r, F.lit("medium")), "med").otherwise("low")
    d = lex.withColumn("_w", weight).withColumn("_a", amp)
    one = F.lit(1)
    g = d.groupBy("subcategory").agg(F.count(one).alias("entries"), X.js_round(X.exact_sum(F.col("_w")) / F.count(one), 4).alias("weight"))
    risk = d.groupBy("subcategory", "_a").agg(F.count(one).alias("c"), F.min("id").alias("f")).groupBy("subcategory").agg(
        F.min_by("_a", F.struct(-F.col("c"), "f")).alias("amplification")
    )
    m = d.filter("replacement <> '' and not replacement_truncated").groupBy("subcategory", "replacement").agg(F.min("id").alias("f"))
    m = m.withColumn("n", F.row_number().over(Window.partitionBy("subcategory").orderBy("f"))).filter("n <= 5")
    m = m.groupBy("subcategory").agg(F.array_sort(F.collect_list(F.struct("n", "replacement"))).alias("m"))
    level = F.when(F.col("subcategory") == "paragraph_template", "paragraph").when(F.col("subcategory").isin(SENTENCE_SUBCATEGORIES), "sentence").otherwise("lexical")
    return g.join(risk, "subcategory").join(m, "subcategory", "left").select(
        "subcategory", "entries", "weight", "amplification", level.alias("level"),
        F.coalesce(F.col("m.replacement"), F.array(F.lit(NO_MENU))).alias("rewrite_menu"),
    )


def genre_tolerance(lex: DataFrame) -> DataFrame:
    """(subcategory, style, share, tolerance) of the styles that make up enough of a subcategory."""
    g = F.lower("genres")
    styles = F.filter(F.array(*[F.when(g.rlike(p), F.lit(s)) for s, p in GENRE_STYLES]), lambda x: x.isNotNull())
    c = lex.select("subcategory", F.explode(styles).alias("style")).groupBy("subcategory", "style").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("subcategory"))
    c = c.withColumn("share", X.js_round(share, 6)).withColumn("tolerance", F.when(share >= 0.5, 1.5).when(share >= 0.3, 1.2))
    return c.filter("tolerance is not null").drop("n")


def lexicon_index(lex: DataFrame) -> DataFrame:
    """Entries and tier counts per category."""
    t = lex.groupBy("category").pivot("tier", ["strong", "moderate", "watch"]).count().na.fill(0)
    return t.withColumn("entries", F.col("strong") + F.col("moderate") + F.col("watch")).orderBy("category")


def ordered_entries(lex: DataFrame) -> DataFrame:
    rank = F.when(F.col("tier") == "strong", 0).when(F.col("tier") == "moderate", 1).otherwise(2)
    return lex.orderBy("category", rank, "id")


def lexicon_violations(lex: DataFrame, matchers: DataFrame | None = None) -> DataFrame:
    """(id, problem) of entries that break a rule; empty for a sound lexicon."""
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    checks = F.array(
        F.when(F.col("tier") != tier(F.col("signal"), F.col("fp_risk")), "tier"),
        F.when(F.exists("alternatives", lambda a: count(a, "[") != count(a, "]")), "brackets"),
        F.when(F.exists("alternatives", lambda a: a.rlike('["“”]')), "quotes"),
    )
    checks = F.filter(checks, lambda x: x.isNotNull())
    alts = F.filter("matchable", lambda a: ~F.contains(a, F.lit("[")))
    if matchers is None:
        # A wording's own matcher is an expression of the wording, so it is tried in the row; few rows have more to tell.
        ws = lambda a: X.words(F.lower(a))
        alts = F.filter(alts, lambda a: ~((F.size(ws(a)) > 0) & F.rlike(a, detect.wording_regex(ws(a)))))
    alts = F.when(~F.col("truncated") & ~F.col("template"), alts).otherwise(F.array().cast("array<string>"))
    rows = lex.select("id", "subcategory", checks.alias("problems"), alts.alias("alts"))
    if matchers is None:
        # Kept before any filter: pushed below the cleaning steps, a filter would repeat each of them for every use of its result.
        rows = stored(rows, "unsettled")
    bad = rows.select("id", F.explode("problems").alias("problem"))
    want = rows.select("id", "subcategory", F.posexplode("alts").alias("i", "alt"))
    m = matchers if matchers is not None else detect.matchers(lexicon_phrases(lex))
    # What its own matcher leaves meets the others of its subcategory, on their keys.
    if matchers is not None and {"id", "phrase"} <= set(m.columns):
        own = want.join(m.select("id", F.col("phrase").alias("alt"), "regex"), ["id", "alt"]).filter(F.rlike("alt", F.col("regex"))).select("id", "i")
        want = stored(want.join(own, ["id", "i"], "left_anti"), "unsettled")
    if not want.head(1):
        return bad
    if "keys" in m.columns:
        hit = detect._phrase_hits(want.select(F.col("id").alias("doc_id"), F.col("i").alias("sent_id"), F.col("alt").alias("text")), m, ["subcategory"])
        hit = hit.select(F.col("doc_id").alias("id"), F.col("sent_id").alias("i"), "subcategory").distinct()
    else:
        hit = want.join(m.select("subcategory", "regex"), "subcategory").filter(F.rlike("alt", F.col("regex"))).select("id", "i", "subcategory").distinct()
    miss = want.join(hit, ["id", "i", "subcategory"], "left_anti").select("id", F.lit("unmatched").alias("problem")).distinct()
    return stack(bad, miss)
