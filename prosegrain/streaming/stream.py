"""Incremental work: result caches, re-scoping after edits, and Structured Streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrain.functions import exprs as X
from prosegrain.functions.frames import scratch
from prosegrain.operators import library

SENT = ["doc_id", "sent_id"]
ONE = "*"


# ---------------------------------------------------------------- caches


def with_cache(s: DataFrame, cache: DataFrame) -> DataFrame:
    """Sentences with the cached columns of their hash; ``cached`` tells known from unknown.

    A static cache may meet a stream of sentences here.
    """
    known = cache.withColumn("_known", F.lit(True))
    return s.join(known, "hash", "left").withColumn("cached", F.coalesce("_known", F.lit(False))).drop("_known")


def progress(s: DataFrame, cache: DataFrame) -> DataFrame:
    """Total, cached and open sentences per document."""
    c = with_cache(s, cache.select("hash"))
    n = F.sum(F.col("cached").cast("int"))
    return c.groupBy("doc_id").agg(F.count(ONE).alias("total"), n.alias("cached"), (F.count(ONE) - n).alias("to_do"))


class Cache:
    """Results by sentence hash, in generations of files.

    The newest complete folder ``g<number>`` under ``path`` counts. In it each write has a folder of its own, ``part=<order>.<name>.<id>``:
    a micro-batch that is repeated replaces what it wrote, whatever came after, and keeps its place in the order, also
    across restarts. ``compact`` writes the newest row of each hash as the next generation and renames it into place; the last
    generation stays until the one after, for readers that have begun. One stream writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if n.startswith(prefix))

    def _generation(self) -> str:
        return f"{self.path}/{(self._names(self.path, 'g') or ['g000000'])[-1]}"

    def upsert(self, batch: DataFrame, tier: str = "full", name: str = "batch", batch_id: int = 0) -> None:
        """Add results; a later write of a hash replaces the earlier one. ``name`` tells streams apart."""
        folder = self._generation()
        own = f".{name}-{tier}.{batch_id}"
        parts = self._names(folder, "part=")
        part = next((p for p in parts if p.endswith(own)), None)
        if part is None:
            part = f"part={int(parts[-1][5:].split('.')[0]) + 1 if parts else 1:09d}{own}"
        batch.dropDuplicates(["hash"]).withColumn("tier", F.lit(tier)).write.mode("overwrite").partitionBy("tier").parquet(f"{folder}/{part}")

    def read(self, schema, tier: str = "full", but: tuple[str, int] | None = None) -> DataFrame:
        """The newest row of each hash; ``but`` leaves out what the write of that name and id has added."""
        folder = self._generation()
        fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        if not self._names(folder, "part="):
            return self.spark.createDataFrame([], fields)
        d = self.spark.read.schema(f"{fields}, part string, tier string").option("basePath", folder).parquet(folder).filter(F.col("tier") == tier)
        if but is not None:
            d = d.filter(~F.col("part").endswith(f".{but[0]}-{tier}.{but[1]}"))
        rest = [c for c in d.columns if c not in ("hash", "part", "tier")]
        return d.groupBy("hash").agg(F.max_by(F.struct(*rest), "part").alias("v")).select("hash", "v.*")

    def compact(self, schema, tiers=("full", "gate")) -> None:
        """Replace this generation by one that holds the newest row of each hash once."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        number = int(self._generation().rsplit("/g", 1)[1])
        fresh = f"{self.path}/_{uuid.uuid4().hex}"
        for i, tier in enumerate(tiers):
            self.read(schema, tier).withColumn("tier", F.lit(tier)).write.mode("overwrite").partitionBy("tier").parquet(f"{fresh}/part={i:09d}.compact-{tier}.0")
        self._fs.rename(jvm.Path(fresh), jvm.Path(f"{self.path}/g{number + 1:06d}"))
        for old in self._names(self.path, "g")[:-2]:
            self._fs.delete(jvm.Path(f"{self.path}/{old}"), True)

    def has(self, tier: str, name: str, batch_id: int) -> bool:
        return any(p.endswith(f".{name}-{tier}.{batch_id}") for p in self._names(self._generation(), "part="))

    def size(self) -> int:
        """Writes of the newest generation."""
        return len(self._names(self._generation(), "part="))


def cached_sink(cache: Cache, schema, classify, out: str, tier: str = "full", name: str = "stream", every: int = 16):
    """What ``foreachBatch`` runs: sentences meet the cache, ``classify`` works on each unknown hash once, its results join the cache,
    and (sentences with results, cached) go to ``out``.

    A repeated batch replaces both writes and doesn't see its own results as known. The cache is compacted before
    a batch when it holds ``every`` writes.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        if cache.size() >= every and not cache.has(tier, name, batch_id):  # a repeated batch has not been committed
            cache.compact(schema, (tier,))
        known = cache.read(schema, tier, but=(name, batch_id))
        fresh = batch.join(known.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        cache.upsert(classify(fresh), tier, name, batch_id)
        rows = with_cache(batch, known.select("hash")).join(cache.read(schema, tier), "hash", "left")
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return sink


def stream_cached(s: DataFrame, sink, checkpoint: str, **trigger):
    w = s.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**trigger).start() if trigger else w.start()


def suggestion_key(s: DataFrame, model: str, n: int, version: str = "v1") -> DataFrame:
    """Cache key of a suggestion: version, sentence, sorted pattern set, model and count."""
    digest = F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.transform("patterns", lambda p: p["type"]))), ","))
    return s.withColumn("suggestion_key", F.concat_ws(":", F.lit(version), "hash", digest, F.lit(model), F.lit(n)))


# ---------------------------------------------------------------- scope and tiers


def scope(s: DataFrame, changed: DataFrame, neighbours: bool = True) -> DataFrame:
    """Changed sentences, with the rest of their paragraphs when asked."""
    ids = changed.select(*SENT).distinct()
    if not neighbours:
        return s.join(ids, SENT, "left_semi")
    paras = s.join(ids, SENT, "left_semi").select("doc_id", "paragraph_id").distinct()
    return s.join(paras, ["doc_id", "paragraph_id"], "left_semi")


def waterfall(s: DataFrame, screen: DataFrame, gate: DataFrame, medium: DataFrame, full: DataFrame) -> DataFrame:
    """Result of the deepest tier that has one. screen(…, route); the tiers hold (…, result).

    A sure screen result stands; a gate result counts only through the tier it escalates to.
    """
    d = s.join(screen.select(*SENT, "route", F.col("result").alias("r_screen")), SENT, "left")
    for name, t in (("gate", gate), ("medium", medium), ("full", full)):
        d = d.join(t.select(*SENT, F.col("result").alias(f"r_{name}")), SENT, "left")
    sure = F.col("route") != "ambiguous"
    tier = F.when(sure, "screen").when(F.col("r_full").isNotNull(), "full").when(F.col("r_medium").isNotNull(), "medium").when(
        F.col("r_gate").isNotNull(), "gate"
    ).otherwise("default")
    result = F.when(sure, F.col("r_screen")).otherwise(F.coalesce("r_full", "r_medium"))
    return d.select(*SENT, tier.alias("tier"), result.alias("result"))


# ---------------------------------------------------------------- streams


def document_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:
    """Documents as they arrive; the checkpoint of the query remembers what was seen."""
    return spark.readStream.schema(schema).options(**options).format(format).load(path)


def running_profiles(s: DataFrame) -> DataFrame:
    """Counts, words and mean heat per document so far; for batches and for update-mode streams."""
    return s.groupBy("doc_id").agg(
        F.count(ONE).alias("sentence_count"), F.sum("word_count").alias("word_count"),
        X.js_round(X.js_round(X.exact_sum(F.col("heat")) / F.count(ONE), 9), 1).alias("mean_heat"),
    )


def stream_profiles(s: DataFrame, sink, checkpoint: str, **trigger):
    """Start the running profiles; ``sink(batch, id)`` receives the documents that changed."""
    w = running_profiles(s).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**trigger).start() if trigger else w.start()


def activity(events: DataFrame, size: str = "1 day", slide: str | None = None, watermark: str = "2 days", key: str = "provider") -> DataFrame:
    """Events per key and tumbling or sliding window; late rows are dropped after the mark."""
    return (
        events.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), key)
        .agg(F.count(ONE).alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "value")
    )


def sessions(events: DataFrame, gap: str = "15 seconds", watermark: str = "1 minute") -> DataFrame:
    """Bursts of saves(doc_id, ts, save_id, content) as one version each: the last text of the burst. On a stream a burst is written when
    the watermark has passed its end."""
    d = (
        events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "doc_id")
        .agg(F.count(ONE).alias("n"), F.max_by("content", F.struct("ts", "save_id")).alias("content"), F.max("save_id").alias("save_id"))
    )
    return d.select("doc_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("saved_at"), "n", "save_id", "content")


def auto_versions(events: DataFrame, gap_seconds: int = 15, watermark: str = "1 minute") -> DataFrame:
    """Bursts whose text differs from the version before; on a stream (doc_id, save_id, content), bursts and their comparison in one state."""
    if not events.isStreaming:
        return library.snapshots(sessions(events, f"{gap_seconds} seconds", watermark))
    return _differing(events.withWatermark("ts", watermark).withColumnRenamed("ts", "saved_at"), None, gap_seconds * 1000)


def dedupe_stream(s: DataFrame, watermark: str | None = None, keys=("hash",)) -> DataFrame:
    """One row per key ever, whose state on a stream is every key seen; with a watermark, streams only, one
    row per key within it, and keys expire."""
    if watermark is None:
        return s.dropDuplicates(list(keys))
    if not s.isStreaming:
        raise ValueError("a watermark bounds the memory of a stream; a batch has none")
    return s.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_snapshots(saves: DataFrame, watermark: str = "1 hour", expire: int | None = None) -> DataFrame:
    """Saves(doc_id, saved_at, save_id, content) whose text differs from the one before in event time, on a stream.

    Saves wait in the state until the watermark has passed them, so a late one lands between its neighbours; one that comes
    when a later save of its document has been passed is dropped. Then the state of a document is the hash of its last text, and with ``expire``
    seconds without a save it goes too, and the next save counts as a first one. Rows without a document only move the watermark.
    """
    d = saves if watermark is None else saves.withWatermark("saved_at", watermark)
    return _differing(d, expire)


def _differing(d: DataFrame, expire: int | None, gap: int = 0) -> DataFrame:
    """Versions of saves: those less than ``gap`` milliseconds after the one before are one burst, which its last text stands for."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        doc = key[0]
        if doc is None or doc != doc:
            return
        mark = state.getCurrentWatermarkMs() * 1000
        last, seen, at, ids, hashes, texts = state.get if state.exists else (None, None, [], [], [], [])
        rows = list(zip(at, ids, hashes, texts, strict=True))
        passed = -(1 << 62) if seen is None else max(seen, seen + gap * 1000 - 1)  # what is older has had its turn
        for pdf in frames:
            new = pdf[["at", "save_id", "h", "content"]].itertuples(index=False, name=None)
            rows.extend((int(a), int(i), int(h), c) for a, i, h, c in new if a > passed)
        rows.sort(key=lambda r: r[:2])
        bursts: list[list] = []
        for r in rows:
            if bursts and r[0] < bursts[-1][-1][0] + gap * 1000:
                bursts[-1].append(r)
            else:
                bursts.append([r])
        wait, out = [], []
        for burst in bursts:
            a, _, h, c = burst[-1]
            if wait or a + gap * 1000 > mark:
                wait.extend(burst)
                continue
            if last is None or h != last or (expire is not None and burst[0][0] - seen > expire * 1_000_000):
                out.append((doc, max(r[1] for r in burst), c))
            last, seen = h, a
        over = None if seen is None or expire is None else seen // 1000 + expire * 1000
        if not wait and (over is not None and over * 1000 <= mark or last is None):
            if state.exists:
                state.remove()
        else:
            state.update((last, seen, *([r[k] for r in wait] for k in range(4))))
            if wait:
                state.setTimeoutTimestamp(max(wait[0][0] // 1000 + gap, mark // 1000) + 1)
            elif over is not None:
                state.setTimeoutTimestamp(over + 1)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "save_id", "content"])

    keyed = d.withColumns({"h": F.xxhash64("content"), "at": F.unix_micros(F.col("saved_at").cast("timestamp"))})
    held = "last bigint, seen bigint, at array<bigint>, ids array<bigint>, hashes array<bigint>, texts array<string>"
    return keyed.groupBy("doc_id").applyInPandasWithState(step, "doc_id bigint, save_id bigint, content string", held, "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str = "drain", mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the rows written."""
    spark = stream.sparkSession
    out, check = scratch(spark, name), scratch(spark, name + "-check")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


