"""The whole analysis as one plan: documents in, classified sentences and profiles out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stored
from prosegrain.operators import detect, profile, split, windows

WEIGHTS = {r[0]: r[4] for r in fixed.REGISTRY}


def heat_of(patterns: Column) -> Column:
    """Heat of a sentence from its nested patterns and its metrics, without a join."""
    weight = X.mapping(WEIGHTS, 0.5)
    h = F.aggregate(patterns, F.lit(0.0), lambda a, p: a + weight(p["type"]) * p["confidence"])
    bal = F.col("clause_balance_ratio")
    h = h + F.when((bal > 0.85) & (F.col("clause_count") >= 2), (bal - 0.85) / 0.15).otherwise(0.0)
    h = h + F.when(F.col("has_participial") & (F.col("clause_count") >= 3), 0.8).otherwise(0.0)
    h = h * F.when(F.size(patterns) >= 3, 1.2).otherwise(1.0)
    return F.least(F.lit(10.0), X.js_round(X.js_round(h, 6), 1))


def classify(docs: DataFrame, rules=fixed.SCREEN_RULES, sep: str = split.BLANK_LINE) -> DataFrame:
    """Classified sentences of all documents: a chain of projections without a shuffle."""
    s = detect.features(split.sentences(docs, sep))
    return s.withColumn("patterns", detect._rule_hits(F.col("text"), rules)).withColumn("heat", heat_of(F.col("patterns")))


def analyze_corpus(
    docs: DataFrame, rules=fixed.SCREEN_RULES, sep: str = split.BLANK_LINE, guides: DataFrame | None = None, lexicon: DataFrame | None = None,
    dimensions: dict[str, DataFrame] | None = None, genre: str = "general", mode: str = "tiered", heat: float = 3.0, once: bool = False,
) -> dict[str, DataFrame]:
    """All outputs of the analysis by name, each a plan of its own.

    Always: sentences, hits, rule_hits, windows, window_metrics, density, profiles. With ``dimensions`` (registry, thresholds): regions and
    window_violations. With a lexicon: candidates, and with ``dimensions`` (mapping, playbook) promoted hits. With guides: violations and distances.
    ``once`` writes the classified sentences to the shared folder, so that texts are not cut and matched again for each use.
    """
    c = classify(docs, rules, sep)
    c = stored(c, "classified") if once else c
    hits = detect.explode_hits(c)
    w = windows.rolling_windows(c)
    out = {
        "sentences": c, "hits": hits, "windows": w, "profiles": profile.profile(c), "density": windows.pattern_density(w, hits),
        "window_metrics": windows.window_metrics(w, c, hits), "rule_hits": detect.explode_hits(detect.classify_rules(split.sentences(docs, sep))),
    }
    dims = dimensions or {}
    if "registry" in dims:
        out["regions"] = windows.hot_regions(c, hits, dims["registry"], heat)
        if "thresholds" in dims:
            out["window_violations"] = windows.density_violations(w, hits, dims["thresholds"], dims["registry"], genre)
    if lexicon is not None:
        out["candidates"] = detect.match_lexicon(c, lexicon, mode)
        if "mapping" in dims and "playbook" in dims:
            out["promoted"] = detect.promote(hits, out["candidates"], dims["playbook"], dims["mapping"])
    if guides is not None:
        out["violations"] = profile.style_delta(c, hits, guides)
        out["distances"] = profile.style_distance(out["violations"])
    return out
