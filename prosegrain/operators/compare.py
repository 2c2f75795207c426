"""Comparison of two texts, of suggestions and of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.operators import windows

SENT = ["doc_id", "sent_id"]


def diff_sentences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sentences of ``new`` whose hash the old text of the same document lacks; a document without an
    old text gives none."""
    had = old.select("doc_id", "hash").distinct()
    known = had.select("doc_id").distinct()
    return new.join(known, "doc_id", "left_semi").join(had, ["doc_id", "hash"], "left_anti")


# metric, column, lower is better
VERIFY = [
    ("Mean heat", "mean_heat", True), ("Device entropy", "device_entropy", False), ("Convergence slope", "convergence_slope", True),
    ("Length autocorrelation", "autocorrelation", True), ("Hot regions", "hot_region_count", True),
]
DELTA = [
    ("Mean Density", "mean_heat", True), ("Word Count", "word_count", False), ("Sentence Count", "sentence_count", False),
    ("Device Entropy", "device_entropy", False), ("Autocorrelation", "autocorrelation", True),
]


def _pairs(a: DataFrame, b: DataFrame, metrics) -> DataFrame:
    cols = list(dict.fromkeys(m[1] for m in metrics))
    j = a.select("doc_id", *[F.col(c).cast("double").alias(f"a_{c}") for c in cols]).join(
        b.select("doc_id", *[F.col(c).cast("double").alias(f"b_{c}") for c in cols]), "doc_id"
    )
    cells = [
        F.struct(F.lit(n).alias("metric"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after"), F.lit(low).alias("lower_better"))
        for n, c, low in metrics
    ]
    return j.select("doc_id", F.explode(F.array(*cells)).alias("m")).select("doc_id", "m.*").withColumn(
        "delta", X.js_round(F.col("after") - F.col("before"), 9)
    )


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """Five metrics per document with a dead band of .01, and the overall verdict."""
    d = _pairs(before, after, VERIFY)
    gain = F.when(F.col("lower_better"), -F.col("delta")).otherwise(F.col("delta"))
    d = d.withColumn("change", F.when(gain > 0.01, "+").when(gain < -0.01, "-").otherwise("="))
    w = Window.partitionBy("doc_id")
    up = F.sum((F.col("change") == "+").cast("int")).over(w)
    down = F.sum((F.col("change") == "-").cast("int")).over(w)
    return d.select(
        "doc_id", "metric", "before", "after", "change", up.alias("better"), down.alias("worse"),
        F.when(up > down, "Improved").when(down > up, "Regressed").otherwise("Mixed").alias("overall"),
    )


def score_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    d = _pairs(a, b, DELTA)
    return d.select(
        "doc_id", "metric", "before", "after", "delta",
        F.when(F.col("lower_better"), F.col("delta") < 0).otherwise(F.col("delta") > 0).alias("improved"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("h", F.xxhash64("line"))
    return lines.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("pos")))


def line_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines as added, removed or same: the n-th use of a line meets the n-th use on the other side."""
    j = _lines(a).alias("a").join(_lines(b).alias("b"), ["doc_id", "h", "k"], "full_outer")
    status = F.when(F.col("a.pos").isNull(), "added").when(F.col("b.pos").isNull(), "removed").otherwise("same")
    return j.select(
        "doc_id", status.alias("status"), F.coalesce("a.line", "b.line").alias("line"),
        F.coalesce("a.pos", F.lit(-1)).alias("old_pos"), F.coalesce("b.pos", F.lit(-1)).alias("new_pos"),
    )


def passage_metrics(s: DataFrame, hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Mean heat, device entropy, autocorrelation, hit and word counts of ranges(doc_id, range_id, start, end)."""
    by = ["doc_id", "range_id"]
    r = ranges.withColumn("sent_id", F.explode(F.sequence("start", "end"))).select(*by, "sent_id")
    rs = r.join(s.select(*SENT, "heat", "word_count"), SENT)
    rh = r.join(hits.select(*SENT, "type"), SENT)
    base = rs.groupBy(*by).agg((X.exact_sum(F.col("heat")) / F.count(F.lit(1))).alias("h"), F.sum("word_count").alias("word_count"))
    n = rh.groupBy(*by).agg(F.count(F.lit(1)).alias("p"))
    e = windows.device_entropy(rh, by)
    out = base.join(windows.autocorrelation(rs, by, "sent_id", "word_count"), by, "left").join(e, by, "left").join(n, by, "left")
    return out.select(
        *by, X.js_round(X.js_round(F.col("h"), 9), 1).alias("mean_heat"), F.coalesce("entropy", F.lit(0.0)).alias("device_entropy"),
        "autocorrelation", F.coalesce("p", F.lit(0)).alias("pattern_count"), "word_count",
    )


# ---------------------------------------------------------------- suggestions


def fidelity(pairs: DataFrame, threshold: float = 0.45) -> DataFrame:
    o = F.col("score")
    d = pairs.withColumn("score", X.overlap(F.col("original"), F.col("rewritten")))
    two = F.format_string("%.2f", X.js_round(o, 2))
    return d.withColumn("passed", o >= threshold).withColumn(
        "reason",
        F.when(o >= threshold, F.concat(F.lit("Overlap "), two, F.lit(" passed; no entailment model configured")))
        .otherwise(F.concat(F.lit("Content-word overlap "), two, F.lit(f" below threshold {threshold}"))),
    )


def is_valid(original: Column, text: Column) -> Column:
    placeholder = (F.length(text) < 12) | X.matches(text, fixed.PLACEHOLDER_RE)
    foreign = X.matches(text, fixed.FOREIGN_SCENE_RE) & ~X.matches(original, fixed.FOREIGN_SCENE_RE)
    wild = F.length(text) / F.greatest(F.length(original), F.lit(1)) > 2.5
    close = X.overlap(original, text) >= F.when(wild, 0.35).otherwise(0.22)  # last, and once: it costs most
    return ~placeholder & (X.trim_ws(text) != X.trim_ws(original)) & ~foreign & close


def valid_suggestions(pairs: DataFrame) -> DataFrame:
    return pairs.filter(is_valid(F.col("original"), F.col("rewritten")))


def live_suggestions(sug: DataFrame, s: DataFrame) -> DataFrame:
    """Valid alternatives whose original still is the sentence, grouped by sentence.

    sug(doc_id, sent_id, pos, original, rewritten)."""
    live = sug.join(s.select(*SENT, F.col("text").alias("current")), SENT).filter(
        X.trim_ws(F.col("original")) == X.trim_ws(F.col("current"))
    )
    return valid_suggestions(live.withColumn("original", F.col("current"))).groupBy(*SENT).agg(
        F.first("current").alias("original"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "rewritten"))), lambda x: x["rewritten"]).alias("alternatives"),
    )


def meaning_risk(pairs: DataFrame, claim_certainty: str = "preserve", expression_budget: str = "one") -> DataFrame:
    """Risk that a rewrite changed the meaning, a note and whether applying it is blocked."""
    o, r = X.trim_ws(F.col("original")), X.trim_ws(F.col("rewritten"))
    n = lambda c, p: X.match_count(c, p)
    d = pairs.withColumns({
        "neg": (n(o, fixed.NEGATION_RE) >= 2) & (n(r, fixed.NEGATION_RE) < n(o, fixed.NEGATION_RE) - 1),
        "sure": n(r, fixed.CERTAINTY_RE) > n(o, fixed.CERTAINTY_RE) + 1,
        "loud": n(r, fixed.INTENSIFIER_RE) > n(o, fixed.INTENSIFIER_RE) + 2,
        "thin": (F.length(r) / F.length(o) < 0.55) & (X.count_words(o) > 12),
        "blank": o == "",
    })
    sure = F.col("sure") & F.lit(claim_certainty in ("preserve", "qualify"))
    loud = F.col("loud") & F.lit(expression_budget == "none")
    risk = F.when(F.col("blank"), "low").when(F.col("neg") | loud, "high").when(sure | F.col("thin"), "elevated").otherwise("low")
    notes = F.concat_ws(
        " ",
        F.when(F.col("neg"), fixed.RISK_NOTES["neg"]),
        F.when(sure, fixed.RISK_NOTES["sure"]),
        F.when(loud, fixed.RISK_NOTES["loud"]),
        F.when(F.col("thin"), fixed.RISK_NOTES["thin"]),
    )
    blocked = (risk == "high") | ((risk == "elevated") & F.lit(claim_certainty == "preserve") & (F.col("neg") | F.col("sure")))
    note = F.when(F.col("blank"), fixed.RISK_NOTES["blank"]).when(
        notes == "", fixed.RISK_NOTES["none"]
    ).otherwise(notes)
    return d.withColumn("meaning_risk", risk).withColumn("apply_blocked", blocked).withColumn("meaning_note", note).drop(
        "neg", "sure", "loud", "thin", "blank"
    )


def change_summary_of(before: str, after: str) -> Column:
    """Short text of a change from columns <prefix>_heat, <prefix>_patterns and <prefix>_entropy."""
    h = X.js_round(F.col(f"{after}_heat") - F.col(f"{before}_heat"), 9)
    p = F.col(f"{after}_patterns") - F.col(f"{before}_patterns")
    e = X.js_round(F.col(f"{after}_entropy") - F.col(f"{before}_entropy"), 9)
    one = F.format_string("%.1f", F.abs(h))
    w = fixed.CHANGE_WORDS
    return F.concat_ws(
        ", ",
        F.when(h <= -0.5, F.concat(F.lit(w["down"]), one)).when(h >= 0.5, F.concat(F.lit(w["up"]), one)).otherwise(w["level"]),
        F.when(p < 0, F.concat((-p).cast("string"), F.lit(w["fewer"]))).when(p > 0, F.concat(p.cast("string"), F.lit(w["more"]))).otherwise(w["same"]),
        F.when(e >= 0.2, w["variety"]).when(e <= -0.2, w["less"]),
    )


def change_summary(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("summary", change_summary_of("before", "after"))


def unique_alternatives(alts: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` different texts per sentence of alts(doc_id, sent_id, original, pos, text); the original
    itself is dropped and white space does not count."""
    d = alts.withColumn("text", X.trim_ws(F.col("text"))).withColumn("norm", X.squeeze(F.col("text")))
    d = d.filter((F.col("text") != "") & (F.col("norm") != X.squeeze(F.col("original"))))
    first = d.groupBy(*SENT, "norm").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))
    w = Window.partitionBy(*SENT).orderBy("pos")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*SENT, "rank", "text")


def group_edits(edits: DataFrame) -> DataFrame:
    """Edits of one range and original merged: an accepted edit represents them, options are pooled.

    edits(doc_id, start, end, pos, original, rewritten, alternatives ARRAY<STRING>, accepted)."""
    norm = X.squeeze(F.col("original"))
    keys = ["doc_id", "start", "end", "norm"]
    d = edits.withColumn("norm", norm).withColumn(
        "options",
        F.concat(F.when(F.col("rewritten") != F.col("original"), F.array("rewritten")).otherwise(F.array().cast("array<string>")),
                 F.coalesce("alternatives", F.array().cast("array<string>"))),
    )
    o = d.select(*keys, "pos", "accepted", F.posexplode("options").alias("i", "option")).withColumn("option", X.trim_ws(F.col("option")))
    o = o.withColumn("on", X.squeeze(F.col("option"))).filter((F.col("option") != "") & (F.col("on") != F.col("norm")))
    rep = o.groupBy(*keys).agg(F.min(F.struct((~F.col("accepted")).alias("n"), "pos")).alias("r"))
    opts = o.groupBy(*keys, "on").agg(F.min(F.struct("pos", "i", "option")).alias("f")).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list("f")), lambda x: x["option"]).alias("options")
    )
    return rep.join(opts, keys).select(
        "doc_id", "start", "end", F.col("norm").alias("original"), F.col("r.pos").alias("representative"), (~F.col("r.n")).alias("accepted"), "options"
    )


def relocate(refs: DataFrame, s: DataFrame) -> DataFrame:
    """refs(doc_id, ref_id, hint, text) to the sentence they mean: the hinted one if it still matches,
    else the only sentence with that text."""
    n = s.select("doc_id", "sent_id", X.squeeze(F.col("text")).alias("norm"))
    one = n.groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("sent_id").alias("only"))
    r = refs.withColumn("norm", X.squeeze(F.col("text")))
    hinted = n.select("doc_id", F.col("sent_id").alias("hint"), "norm", F.lit(True).alias("ok"))
    j = r.join(one, ["doc_id", "norm"], "left").join(hinted, ["doc_id", "hint", "norm"], "left")
    return j.select(
        "doc_id", "ref_id", F.when(F.col("ok"), F.col("hint")).when(F.col("n") == 1, F.col("only")).alias("sent_id")
    ).filter("sent_id is not null")


def edit_metrics(edits: DataFrame) -> DataFrame:
    """Counts per document of edits(doc_id, verdict, accepted, fidelity_passed)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    vac = F.col("verdict") == "vacuous"
    return edits.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("spans_detected"), n(vac).alias("vacuous"), n(F.col("verdict") == "earned").alias("earned"),
        n(F.col("verdict") == "uncertain").alias("uncertain"), n(F.col("accepted")).alias("accepted"), n(~F.col("accepted")).alias("rejected"),
        n(vac & ~F.col("fidelity_passed")).alias("fidelity_failures"),
    )


def merge_partial(prev: DataFrame, part: DataFrame) -> DataFrame:
    """Partial result over the previous one: an empty entry keeps the earlier patterns of the same text.

    Both hold (doc_id, sent_id, hash, text, patterns, heat)."""
    p = prev.select("doc_id", "hash", F.col("text").alias("pt"), F.col("patterns").alias("pp"), F.col("heat").alias("ph"), "sent_id")
    p = p.groupBy("doc_id", "hash").agg(F.max_by(F.struct("pt", "pp", "ph"), "sent_id").alias("p")).select("doc_id", "hash", "p.*")
    j = part.join(p, ["doc_id", "hash"], "left")
    keep = (F.size("patterns") == 0) & (F.size(F.coalesce("pp", F.array().cast(part.schema["patterns"].dataType))) > 0) & (F.col("text") == F.col("pt"))
    return j.select(
        "doc_id", "sent_id", "hash", "text", F.when(keep, F.col("pp")).otherwise(F.col("patterns")).alias("patterns"),
        F.when(keep, F.col("ph")).otherwise(F.col("heat")).alias("heat"), keep.alias("kept"),
    )


def alternatives(runs: DataFrame) -> DataFrame:
    """Table of valid rewrite alternatives with word change, risk and summary, renumbered per passage.

    runs(doc_id, range_id, idx, original, rewritten, before_words, before_heat, before_patterns,
    before_entropy, after_heat, after_patterns, after_entropy)."""
    d = meaning_risk(change_summary(valid_suggestions(runs)))
    w = Window.partitionBy("doc_id", "range_id").orderBy("idx")
    return d.withColumn("position", F.row_number().over(w) - 1).withColumn(
        "word_delta", X.count_words(F.col("rewritten")) - F.col("before_words")
    ).select("doc_id", "range_id", "position", F.col("rewritten").alias("text"), "summary", "meaning_risk", "apply_blocked", "word_delta")
