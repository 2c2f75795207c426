"""Dimension tables. Built-in rows come from ``fixed``; a folder of JSON files can replace or extend them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.dims import fixed
from prosegrain.functions.frames import stack

GENRES = ["general", "technical", "literary-essay", "journalism", "fiction", "academic", "marketing", "code"]


def registry(spark: SparkSession) -> DataFrame:
    rows = [(*r[:6], 1 if r[6] else 0, r[7]) for r in fixed.REGISTRY]
    return spark.createDataFrame(
        rows,
        "type string, taxonomy_id string, name string, level string, weight double, "
        "amplification string, playbook int, tolerance map<string,double>",
    )


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, int(w), float(m), u) for t, w, m, u in fixed.DENSITY_THRESHOLDS],
        "type string, window_words int, max_count double, unit string",
    )


def guides(spark: SparkSession) -> DataFrame:
    types = ["string", "string"] + ["double"] * 16
    types[fixed.GUIDE_COLUMNS.index("max_consecutive_same")] = "int"
    return spark.createDataFrame(
        fixed.GUIDES, ", ".join(f"{n} {t}" for n, t in zip(fixed.GUIDE_COLUMNS, types))
    )


def playbook(spark: SparkSession) -> DataFrame:
    rows, seen = [], 0
    for li, (layer, label, types) in enumerate(fixed.PLAYBOOK_LAYERS):
        for t in types.split():
            rows.append((li, layer, label, seen, t))
            seen += 1
    return spark.createDataFrame(rows, "layer_pos int, layer string, label string, pos int, type string")


def playbook_types() -> list[str]:
    out: list[str] = []
    for _, _, types in fixed.PLAYBOOK_LAYERS:
        out += [t for t in types.split() if t not in out]
    return out


def swaps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, f, t) for i, (f, t) in enumerate(fixed.SWAPS)], "pos int, word string, suggestion string"
    )


def banned(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, w) for i, w in enumerate(fixed.BANNED_WORDS)], "pos int, word string")


def marker_types(spark: SparkSession) -> DataFrame:
    rows = [(m, i, t) for m, ts in fixed.MARKER_TYPES.items() for i, t in enumerate(ts.split())]
    return spark.createDataFrame(rows, "subcategory string, pos int, type string")


def purpose_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.PURPOSE_TARGETS,
        "purpose string, entropy_min double, entropy_max double, length_std_min double, "
        "max_autocorrelation double, expects_resolution boolean",
    )


def audit_checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.AUDIT_CHECKS, "check string, label string, automated boolean")


def word_lists(spark: SparkSession) -> DataFrame:
    rows = [(k, w) for k, ws in fixed.LEXICONS.items() for w in ws]
    return spark.createDataFrame(rows, "list string, phrase string")


BUILT_IN = {
    "patterns": (registry, ["type"]),
    "density_thresholds": (thresholds, ["type"]),
    "guides": (guides, ["name"]),
    "playbook": (playbook, ["layer", "type"]),
    "swaps": (swaps, ["word"]),
    "banned": (banned, ["word"]),
    "marker_types": (marker_types, ["subcategory", "type"]),
    "purpose_targets": (purpose_targets, ["purpose"]),
    "audit_checks": (audit_checks, ["check"]),
    "word_lists": (word_lists, ["list", "phrase"]),
}


def override(built_in: DataFrame, user: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the user's table win over built-in rows with the same key."""
    both = stack(built_in.withColumn("_own", F.lit(0)), user.withColumn("_own", F.lit(1)), missing=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_own"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_own")


#: What a folder's patterns may say beyond the built-in columns.
PATTERN_TEXTS = "directive string, hint string, rewrite_menu array<struct<id:int,instruction:string>>"
#: An entry of a hit list, and a line of its index.
HIT_ENTRY = (
    "id string, phrase string, alternatives array<string>, subcategory string, tier string, signal string, fp_risk string, evidence string, "
    "replacement string, genres string, template boolean, truncated boolean"
)
HIT_INDEX = "slug string, category string, entries bigint, tiers struct<strong:bigint,moderate:bigint,watch:bigint>"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_dims(spark: SparkSession, dir: str | None = None) -> dict[str, DataFrame]:
    """All dimension tables; ``<dir>/<name>.json`` extends or overrides the built-in rows.

    A folder's ``patterns.json`` may also hold a directive, a detection hint and a rewrite menu for each pattern: then the patterns have
    the columns directive and hint, and there are the tables ``directives`` (type, directive), ``hints`` (type, hint) and ``menus``
    (type, option, instruction). ``<dir>/lexicon.json`` is the phrase table; it has no built-in rows. ``<dir>/hitlists`` holds
    ``index.json`` and a file of entries per category: ``hitlist_index`` and ``hitlists``, whose ``slug`` is the file's name.
    """
    out = {}
    for name, (build, keys) in BUILT_IN.items():
        df = build(spark)
        path = f"{dir}/{name}.json"
        if dir and _there(spark, path):
            wide = df.select("*", *(F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split()[0]) for x in PATTERN_TEXTS.split(", "))) if name == "patterns" else df
            df = override(df, spark.read.schema(wide.schema).json(path, multiLine=True), keys)
        out[name] = df
    p = out["patterns"]
    if "rewrite_menu" in p.columns:
        out["menus"] = p.select("type", F.inline("rewrite_menu")).withColumnRenamed("id", "option")
        out["directives"] = p.filter("directive is not null").select("type", "directive")
        out["hints"] = p.filter("hint is not null").select("type", "hint")
        out["patterns"] = p.drop("rewrite_menu")
    if dir and _there(spark, f"{dir}/lexicon.json"):
        out["lexicon"] = spark.read.json(f"{dir}/lexicon.json", multiLine=True)
    if dir and _there(spark, f"{dir}/hitlists/index.json"):
        out["hitlist_index"] = spark.read.schema(HIT_INDEX).json(f"{dir}/hitlists/index.json", multiLine=True)
        files = spark.read.schema(HIT_ENTRY).json(f"{dir}/hitlists", multiLine=True, pathGlobFilter="*.json")
        slug = F.regexp_extract(F.input_file_name(), r"([^/]+)[.]json$", 1)
        out["hitlists"] = files.withColumn("slug", F.url_decode(slug)).filter("slug <> 'index'").join(out["hitlist_index"].select("slug", "category"), "slug", "left")
    return out


def hitlist_differences(index: DataFrame, entries: DataFrame) -> DataFrame:
    """(slug, listed, found) of categories whose entries or tiers are not as many as the index says, or that only one side has."""
    tiers = ["strong", "moderate", "watch"]
    n = entries.groupBy("slug").agg(F.count(F.lit(1)).alias("entries"), *[F.sum((F.col("tier") == t).cast("bigint")).alias(t) for t in tiers])
    found = n.select("slug", F.struct("entries", *tiers).alias("found"))
    listed = index.select("slug", F.struct("entries", *[F.col(f"tiers.{t}").alias(t) for t in tiers]).alias("listed"))
    return listed.join(found, "slug", "full").filter(~F.col("listed").eqNullSafe(F.col("found")))
