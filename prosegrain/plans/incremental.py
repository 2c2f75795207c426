"""Queries on caches, scopes and streams (K) and on plug points (U)."""

from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.functions.frames import stored
from prosegrain.operators import detect, plug, split
from prosegrain.plans.catalog import cte, jr, q, query
from prosegrain.plans.comparing import osents
from prosegrain.plans.profiles import classified
from prosegrain.streaming import stream as K

@query("k01_with_cache", "SELECT doc_id, sent_id, lower(text) IN (SELECT lower(text) FROM osents) AS cached FROM sents")
def _(t):
    cache = osents(t).select("hash").distinct()
    return K.with_cache(t.sents, cache).select("doc_id", "sent_id", "cached")


@query("k02_upsert_cache", "SELECT count(*) AS n, sum(w)::BIGINT AS words FROM (SELECT lower(text) AS t, max(word_count) AS w FROM (SELECT text, word_count FROM osents UNION ALL SELECT text, word_count FROM sents) GROUP BY ALL)")
def _(t):
    cache, schema = K.Cache(t.spark, K.scratch(t.spark, "cache")), "hash bigint, word_count int"
    cache.upsert(osents(t).select("hash", "word_count"), "full", "first", 1)
    cache.upsert(t.sents.select("hash", "word_count"), "full", "second", 1)
    cache.compact(schema)
    return cache.read(schema).agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))


@query("k03_gate_cache", "SELECT count(DISTINCT lower(text)) AS full_rows, count(DISTINCT CASE WHEN sent_id % 2 = 0 THEN lower(text) END) AS gate_rows FROM osents")
def _(t):
    cache, schema = K.Cache(t.spark, K.scratch(t.spark, "cache")), "hash bigint, sent_id int"
    s = osents(t).select("hash", "sent_id")
    cache.upsert(s, "full")
    cache.upsert(s.filter("sent_id % 2 = 0"), "gate")
    one = F.lit(1)
    full = cache.read(schema, "full").agg(F.count(one).alias("full_rows")).withColumn("k", one)
    gate = cache.read(schema, "gate").agg(F.count(one).alias("gate_rows")).withColumn("k", one)
    return full.join(gate, "k").drop("k")


def arriving(t, rows, turn, files):
    """rows as a stream that reads one file a micro-batch, in the order of ``turn`` (0 to files - 1)."""
    path = K.scratch(t.spark, "arriving")
    numbered = rows.withColumn("_turn", turn)
    for i in range(files):
        numbered.filter(F.col("_turn") == i).drop("_turn").coalesce(1).write.mode("append").parquet(path)
    return K.document_stream(t.spark, path, rows.schema, maxFilesPerTrigger=1)


@query("k15_cached_stream", "SELECT doc_id, sent_id, word_count, EXISTS (SELECT 1 FROM firsts f WHERE f.h = lower(s.text) AND f.turn < s.doc_id % 4) AS cached FROM sents s")
def _(t):
    """Sentences in four micro-batches against a cache that each of them fills and that is compacted on the way."""
    cache, out = K.Cache(t.spark, K.scratch(t.spark, "cache")), K.scratch(t.spark, "cached")
    s = stored(t.sents.select("doc_id", "sent_id", "hash", F.col("word_count").alias("w")))
    schema = "hash bigint, word_count int"
    sink = K.cached_sink(cache, schema, lambda new: new.select("hash", F.col("w").alias("word_count")), out, every=2)
    path, check = K.scratch(t.spark, "arriving"), K.scratch(t.spark, "cached-check")
    for i in range(4):  # the stream goes on where it was; what has arrived since is its next micro-batch
        s.filter(F.col("doc_id") % 4 == i).write.mode("append").parquet(path)
        K.stream_cached(K.document_stream(t.spark, path, s.schema), sink, check, availableNow=True).awaitTermination()
    return t.spark.read.parquet(out).select("doc_id", "sent_id", "word_count", "cached")


cte("firsts", "SELECT lower(text) AS h, min(doc_id % 4) AS turn FROM sents GROUP BY ALL")


@query("k04_suggestion_key", "SELECT count(DISTINCT lower(text) || '|' || coalesce((SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM hits h WHERE h.doc_id = s.doc_id AND h.sent_id = s.sent_id), '')) AS n_keys, count(*) AS n FROM sents s")
def _(t):
    k = K.suggestion_key(classified(t), "m", 3)
    return k.agg(F.count_distinct("suggestion_key").alias("n_keys"), F.count(F.lit(1)).alias("n"))


cte("chg", "SELECT doc_id, sent_id FROM sents s WHERE NOT EXISTS (SELECT 1 FROM osents o WHERE o.doc_id = s.doc_id AND lower(o.text) = lower(s.text))")


@query("k05_scope", "SELECT s.doc_id, s.sent_id FROM sents s WHERE (s.doc_id, s.paragraph_id) IN (SELECT x.doc_id, x.paragraph_id FROM sents x JOIN chg USING (doc_id, sent_id))")
def _(t):
    from prosegrain.operators import compare

    s = stored(t.sents.select("doc_id", "sent_id", "paragraph_id", "hash"))
    old = stored(osents(t).select("doc_id", "hash"))
    return K.scope(s, compare.diff_sentences(old, s)).select("doc_id", "sent_id")


@query(
    "k06_waterfall",
    "SELECT doc_id, sent_id, CASE WHEN n <= 1 THEN 'screen' WHEN sent_id % 3 = 0 THEN 'full' WHEN sent_id % 2 = 0 THEN 'medium' ELSE 'gate' END AS tier, coalesce(CASE WHEN n <= 1 THEN n WHEN sent_id % 3 = 0 THEN 100 WHEN sent_id % 2 = 0 THEN 50 END, -1)::BIGINT AS result FROM (SELECT doc_id, sent_id, (SELECT count(*) FROM screen r WHERE regexp_matches(text, r.re)) AS n FROM sents)",
    once=True,
)
def _(t):
    r = detect.route(t.sents)
    screen = r.withColumn("result", F.col("n_hits"))
    amb = r.filter("route = 'ambiguous'").select("doc_id", "sent_id")
    gate = amb.withColumn("result", F.lit(1))
    medium = amb.filter("sent_id % 2 = 0").withColumn("result", F.lit(50))
    full = amb.filter("sent_id % 3 = 0").withColumn("result", F.lit(100))
    return K.waterfall(t.sents.select("doc_id", "sent_id"), screen, gate, medium, full).withColumn("result", F.coalesce("result", F.lit(-1)).cast("bigint"))


@query("k07_running_profiles", f"SELECT doc_id, count(*) AS sentence_count, sum(word_count)::BIGINT AS word_count, {jr('sum(heat::DECIMAL(18,6))::DOUBLE / count(*)', 1)} AS mean_heat FROM hot GROUP BY doc_id")
def _(t):
    """Runs as a stream over the documents; the last update of each document is its result."""
    from prosegrain.plans import analyze
    from prosegrain.plans.catalog import RULES, marked, split

    schema = t.documents.schema
    docs = K.document_stream(t.spark, f"{t.path}/documents*.parquet", schema).select("doc_id", marked(F.col("text")).alias("text"))
    s = analyze.classify(docs, RULES, split.ONE_LINE).select("doc_id", "word_count", "heat")
    out = K.scratch(t.spark, "profiles")
    sink = lambda batch, i: batch.withColumn("seq", F.lit(i)).write.mode("append").parquet(out)
    K.stream_profiles(s, sink, K.scratch(t.spark, "profiles-check"), availableNow=True).awaitTermination()
    d = t.spark.read.parquet(out)
    return d.groupBy("doc_id").agg(F.max_by(F.struct("sentence_count", "word_count", "mean_heat"), "seq").alias("v")).select("doc_id", "v.*")


@query("k08_progress", "SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE c) AS cached, count(*) FILTER (WHERE NOT c) AS to_do FROM (SELECT doc_id, lower(text) IN (SELECT lower(text) FROM osents) AS c FROM sents) GROUP BY doc_id")
def _(t):
    return K.progress(t.sents, osents(t).select("hash").distinct())


@query("k09_document_stream", "SELECT doc_id, n_chars FROM documents")
def _(t):
    return K.drain(K.document_stream(t.spark, f"{t.path}/documents*.parquet", t.documents.schema).select("doc_id", "n_chars"))


def events(t, streaming=False):
    ev = t.read("events")
    if streaming:
        ev = K.document_stream(t.spark, f"{t.path}/events*.parquet", ev.schema)
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("provider"), F.col("value").cast("decimal(18,2)").alias("value"))


LATE = 5  # micro-batches in which the events arrive


def arrivals(t):
    """The events as a stream in five micro-batches by time, every tenth row one batch late; then a row that only moves the watermark.

    Returns the stream and a watermark that no row is too late for.
    """
    ev = events(t)
    ends = ev.agg(F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("b"))
    a, b = ends.first()
    step = (b - a) // (LATE - 1) + 1
    turn = F.floor((F.unix_timestamp("ts") - a) / step).cast("int") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    last = ends.select(F.lit(None).cast("bigint").alias("event_id"), F.timestamp_seconds(F.col("b") + 10 * step + 864000).alias("ts"), F.lit(None).cast("bigint").alias("user_id"),
                       F.lit(None).cast("string").alias("provider"), F.lit(None).cast("decimal(18,2)").alias("value"))
    rows = ev.unionByName(last.select(*[F.col(c).cast(ev.schema[c].dataType) for c in ev.columns]))
    return arriving(t, rows, F.when(F.col("event_id").isNull(), LATE).otherwise(turn), LATE + 1), f"{step} seconds"


def as_saves(ev, time="ts"):
    return ev.select(F.col("user_id").alias("doc_id"), F.col("ts").alias(time), F.col("event_id").alias("save_id"), F.col("provider").alias("content"))


@query("k10_stream_snapshots", "SELECT doc_id, save_id, content FROM (SELECT user_id AS doc_id, event_id AS save_id, event_type AS content, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> content")
def _(t):
    ev, watermark = arrivals(t)
    return K.drain(K.stream_snapshots(as_saves(ev, "saved_at"), watermark), "snapshots")


def _act(size, slide):
    step = slide or size
    n = size // step
    return f"SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, provider, count(*) AS n, sum(value)::DOUBLE AS value FROM (SELECT provider, value, make_timestamp(1000000 * ((b - i) * {step})) AS start FROM (SELECT event_type AS provider, value::DECIMAL(18,2) AS value, epoch_ms(ts) // (1000 * {step}) AS b, unnest(range({n})) AS i FROM events)) GROUP BY ALL"


def act(t, size, slide=None):
    a = K.activity(events(t), size, slide)
    return a.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "provider", "n", F.col("value").cast("double").alias("value"))


@query("k11_activity_daily", _act(86400, None))
def _(t):
    return act(t, "1 day")


@query("k11_activity_stream", _act(86400, None))
def _(t):
    ev, watermark = arrivals(t)
    a = K.drain(K.activity(ev, "1 day", None, watermark), "activity")
    return a.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "provider", "n", F.col("value").cast("double").alias("value"))


@query("k12_activity_stream", _act(86400, 21600))
def _(t):
    ev, watermark = arrivals(t)
    a = K.drain(K.activity(ev, "1 day", "6 hours", watermark), "activity")
    return a.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "provider", "n", F.col("value").cast("double").alias("value"))


@query("k12_activity_sliding", _act(86400, 21600))
def _(t):
    return act(t, "1 day", "6 hours")


cte("sess", "SELECT doc_id, min(ts) AS start, max(ts) AS last, count(*) AS n, arg_max(content, (ts, save_id)) AS content, max(save_id) AS save_id FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ts, save_id) AS g FROM (SELECT user_id AS doc_id, event_id AS save_id, ts, event_type AS content, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY doc_id, g")


def saves(t):
    return events(t).select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("save_id"), F.col("provider").alias("content"))


@query("k13_sessions", "SELECT doc_id, save_id, n, content FROM sess")
def _(t):
    return K.sessions(saves(t), "6 hours").select("doc_id", "save_id", "n", "content")


@query("k13_auto_versions", "SELECT doc_id, save_id, content FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY last, save_id) AS p FROM sess) WHERE p IS NULL OR p <> content")
def _(t):
    return K.auto_versions(saves(t), 6 * 3600).select("doc_id", "save_id", "content")


@query("k13_sessions_stream", "SELECT doc_id, save_id, n, content FROM sess")
def _(t):
    ev, watermark = arrivals(t)
    return K.drain(K.sessions(as_saves(ev), "6 hours", watermark).select("doc_id", "save_id", "n", "content"), "sessions")


@query("k13_auto_versions_stream", "SELECT doc_id, save_id, content FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY last, save_id) AS p FROM sess) WHERE p IS NULL OR p <> content")
def _(t):
    ev, watermark = arrivals(t)
    return K.drain(K.auto_versions(as_saves(ev), 6 * 3600, watermark), "versions")


@query("k14_dedupe_stream", "SELECT DISTINCT user_id, event_type AS provider FROM events")
def _(t):
    return K.drain(K.dedupe_stream(events(t, True), keys=("user_id", "provider")).select("user_id", "provider"), "dedupe")


@query("k14_dedupe_within", "SELECT event_id, user_id FROM events")
def _(t):
    """Every event arrives twice, a micro-batch apart; within the watermark a key is kept once, and keys older than that leave."""
    ev = events(t)
    twice = ev.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1))))
    a, b = ev.agg(F.unix_timestamp(F.min("ts")), F.unix_timestamp(F.max("ts"))).first()
    step = (b - a) // 3 + 1
    s = arriving(t, twice, F.floor((F.unix_timestamp("ts") - a) / step).cast("int") + F.col("_again"), 4)
    return K.drain(K.dedupe_stream(s, f"{2 * step} seconds", keys=("event_id",)).select("event_id", "user_id"), "dedupe")


# ---------------------------------------------------------------- plug points


def by_length(s):
    """A user's classifier: any DataFrame -> DataFrame function."""
    kind = F.when(F.col("word_count") > 20, "long").when(F.col("word_count") > 5, "mid").otherwise("short")
    return s.withColumn("label", kind)


@query("u01_pluggable_classifier", "SELECT doc_id, sent_id, CASE WHEN word_count > 20 THEN 'long' WHEN word_count > 5 THEN 'mid' ELSE 'short' END AS label FROM sents")
def _(t):
    return t.sents.transform(by_length).select("doc_id", "sent_id", "label")


@query("u02_user_patterns", f"SELECT doc_id, sent_id, type, CASE type WHEN 'hedging' THEN 2.5 ELSE weight END::DOUBLE AS weight FROM hits JOIN registry USING (type) WHERE type IN ('hedging', {q('nominalization')})")
def _(t):
    own = t.values([("hedging", "L-03", "My hedges", "lexical", 2.5, "low", 1, {})], dims.registry(t.spark).schema)
    reg = dims.override(dims.registry(t.spark), own, ["type"])
    return t.hits.filter(F.col("type").isin("hedging", "nominalization")).join(reg, "type").select("doc_id", "sent_id", "type", "weight")



@query("u01_batch_classifier", "SELECT doc_id, sent_id, floor((0.25::DOUBLE * word_count + 0.5::DOUBLE * len(regexp_replace(text, '[^,]', '', 'g')) - 3.0::DOUBLE) * 1000.0 + 0.5) / 1000.0 AS score, 0.25::DOUBLE * word_count + 0.5::DOUBLE * len(regexp_replace(text, '[^,]', '', 'g')) >= 3.0 AS dense FROM sents")
def _(t):
    """A numeric model over batches: it is loaded once in a task."""

    def load():
        import numpy as np
        import pyarrow.compute as pc

        weights = np.array([0.25, 0.5])

        def model(batch):
            x = np.stack([batch["word_count"].to_numpy(), pc.count_substring(batch["text"], ",").to_numpy()], 1).astype(float)
            score = x @ weights - 3.0
            return {"score": np.floor(score * 1000 + 0.5) / 1000, "dense": score >= 0}

        return model

    return plug.classify_batches(t.sents.select("doc_id", "sent_id", "text", "word_count"), load, "score double, dense boolean", ["text", "word_count"]).select("doc_id", "sent_id", "score", "dense")


@query("u04_sentences_in_sql", "SELECT doc_id, sent_id, paragraph_id, text FROM sents")
def _(t):
    plug.register_functions(t.spark, split.ONE_LINE, "line_")
    t.docs.createOrReplaceTempView("u04_docs")
    return t.spark.sql("SELECT d.doc_id, s.sent_id, s.paragraph_id, s.text FROM u04_docs d, LATERAL line_sentences(d.text) s")
