"""Evaluation of detectors against labelled rows.

labels(id, expected ARRAY<STRING>, absent ARRAY<STRING>, difficulty); hits(id, detector, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.functions import exprs as X

ONE = "*"


def _none():
    return F.array().cast("array<string>")


def score_rows(labels: DataFrame, hits: DataFrame, detectors: list[str]) -> DataFrame:
    """True positives, misses, false positives and decoys hit per row and detector."""
    # Labels are repeated for the detectors after they have met the hits.
    d = hits.filter(F.col("type").isNotNull() & F.col("detector").isNotNull()).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("detector", "type"))).alias("of"))
    rows = labels.join(d, "id", "left").withColumn("detector", F.explode(F.array(*map(F.lit, detectors))))
    rows = rows.withColumn("detected", F.transform(F.filter("of", lambda x: x["detector"] == F.col("detector")), lambda x: x["type"]))
    det, exp = F.coalesce("detected", _none()), F.col("expected")
    return rows.select(
        "id", "detector", "difficulty", exp, F.coalesce("absent", _none()).alias("absent"), det.alias("detected"),
        F.array_intersect(exp, det).alias("tp"), F.array_except(exp, det).alias("fn"), F.array_except(det, exp).alias("fp"),
        F.array_intersect(det, F.coalesce("absent", _none())).alias("decoys"),
    )


def per_pattern(rows: DataFrame) -> DataFrame:
    """Counts, recall and precision per expected pattern and detector; false positives are decoys only."""
    cells = F.concat(*[
        F.transform(c, (lambda k: lambda t: F.struct(t.alias("type"), F.lit(k).alias("k")))(k)) for k, c in (("tp", "tp"), ("fn", "fn"), ("fp", "decoys"))
    ])
    n = lambda k: F.sum(F.when(F.col("k") == F.lit(k), 1).otherwise(0)).alias(k)
    g = rows.select("detector", F.explode(cells).alias("c")).select("detector", "c.*").groupBy("detector", "type").agg(n("tp"), n("fn"), n("fp"))
    w = F.sum(F.col("tp") + F.col("fn")).over(_by_type())
    g = g.withColumn("seen", w).filter("seen > 0").drop("seen")
    return g.withColumn("recall", X.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 4)).withColumn(
        "precision", X.ratio(F.col("tp"), F.col("tp") + F.col("fp"), 4, 1.0)
    )


def _by_type():
    from pyspark.sql.window import Window

    return Window.partitionBy("type")


def overall(pp: DataFrame) -> DataFrame:
    g = pp.groupBy("detector").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    return g.withColumn("recall", X.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 4)).withColumn(
        "precision", X.ratio(F.col("tp"), F.col("tp") + F.col("fp"), 4, 1.0)
    )


def worst_misses(rows: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` rows that detectors missed most."""
    m = rows.filter(F.size("expected") > 0).groupBy("id").agg(
        F.sum(F.size("fn")).alias("missed"),
        F.array_sort(F.collect_list(F.when(F.size("fn") > 0, F.concat("detector", F.lit(": "), F.array_join("fn", ", "))))).alias("details"),
    )
    return m.filter("missed > 0").orderBy(F.desc("missed"), "id").limit(k)


def label_stats(labels: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    pats = labels.select(F.explode("expected").alias("t")).agg(F.count_distinct("t").alias("unique_patterns"))
    base = labels.agg(
        F.count(ONE).alias("total"), n(F.size("expected") == 0).alias("clean"),
        *[n(F.col("difficulty") == d).alias(d) for d in ("obvious", "subtle", "decoy")],
    )
    return base.withColumn("k", F.lit(1)).join(pats.withColumn("k", F.lit(1)), "k").drop("k")


def select_labels(labels: DataFrame, pattern: str | None = None, difficulty: str | None = None) -> DataFrame:
    out = labels
    if pattern:
        out = out.filter(F.array_contains("expected", pattern) | F.coalesce(F.array_contains("absent", pattern), F.lit(False)))
    return out.filter(F.col("difficulty") == difficulty) if difficulty else out


def f1_table(labels: DataFrame, hits: DataFrame, rules: DataFrame, types: list[str]) -> DataFrame:
    """Precision, recall and F1 per pattern, a micro average and agreement with the rules in percent.

    rules(id, type) are the rows a rule flags; every listed type is compared on every row.
    """
    d = hits.groupBy("id").agg(F.collect_set("type").alias("d"))
    r = rules.groupBy("id").agg(F.collect_set("type").alias("r"))
    j = labels.select("id", "expected").join(d, "id", "left").join(r, "id", "left")
    has = lambda c: F.coalesce(F.array_contains(c, F.col("type")), F.lit(False))
    x = j.withColumn("type", F.explode(F.array(*map(F.lit, types)))).select("type", has("expected").alias("e"), has("d").alias("p"), has("r").alias("q"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    e, p, q = F.col("e"), F.col("p"), F.col("q")
    g = x.rollup("type").agg(n(e & p).alias("tp"), n(~e & p).alias("fp"), n(e & ~p).alias("fn"), n(p == q).alias("agree"), F.count(ONE).alias("n"))
    g = g.withColumn("type", F.coalesce("type", F.lit("MICRO AVG")))
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")
    return g.select(
        "type", "tp", "fp", "fn", X.ratio(tp, tp + fp, 4).alias("precision"), X.ratio(tp, tp + fn, 4).alias("recall"),
        F.when(tp > 0, X.js_round(2 * tp / (2 * tp + fp + fn), 4)).otherwise(0.0).alias("f1"),
        X.js_round(F.col("agree") / F.col("n") * 100, 0).alias("rule_agreement"),
    )


def exact_match(labels: DataFrame, hits: DataFrame) -> DataFrame:
    d = hits.groupBy("id").agg(F.sort_array(F.collect_set("type")).alias("d"))
    return labels.join(d, "id", "left").select("id", (F.sort_array("expected") == F.coalesce("d", _none())).alias("exact"))


def gate_quality(labels: DataFrame, gate: DataFrame, full: float = 0.7) -> DataFrame:
    """Share of rows the gate escalates and its recall of expected patterns at any confidence."""
    g = gate.groupBy("id").agg(F.collect_set("type").alias("d"), F.max("confidence").alias("m"))
    j = labels.join(g, "id", "left").select(
        F.coalesce(F.col("m") >= full, F.lit(False)).cast("int").alias("esc"),
        F.size(F.array_intersect("expected", F.coalesce("d", _none()))).alias("hit"), F.size("expected").alias("exp"),
    )
    return j.agg(
        F.count(ONE).alias("rows"), F.sum("esc").alias("escalated"), F.sum("hit").alias("tp"), (F.sum("exp") - F.sum("hit")).alias("fn")
    ).withColumn("escalation_rate", X.ratio(F.col("escalated"), F.col("rows"), 4)).withColumn("recall", X.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 4))


def rank_rewriters(runs: DataFrame) -> DataFrame:
    """runs(name, doc_id, heat_before, heat_after, entropy_before, entropy_after, words_before, words_after)
    averaged per rewriter, most heat reduction first."""
    avg = lambda c: X.js_round(X.js_round(X.exact_sum(c) / F.count(ONE), 9), 4)
    g = runs.groupBy("name").agg(
        avg(F.col("heat_after") - F.col("heat_before")).alias("heat_delta"), avg(F.col("entropy_after") - F.col("entropy_before")).alias("entropy_delta"),
        avg(X.js_round(F.col("words_after") / F.col("words_before"), 6)).alias("word_stability"),
    )
    return g.orderBy("heat_delta", "name")
