import datetime as dt

from pyspark.sql import functions as F

from prosegrain.operators import library
from prosegrain.streaming import stream


def saves(spark):
    t0 = dt.datetime(2024, 1, 1)
    texts = "aabbaacca"
    rows = [(d, t0 + dt.timedelta(hours=7 * i), d * 100 + i, c) for d in range(3) for i, c in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, saved_at timestamp, save_id long, content string")


END = (None, dt.datetime(2030, 1, 1), None, None)  # a row that only moves the watermark


def deliveries(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, "doc_id long, saved_at timestamp, save_id long, content string").coalesce(1).write.mode("append").parquet(path)
    return stream.document_stream(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=1)


def test_snapshots_of_a_stream_with_late_rows_are_those_of_the_batch(spark, tmp_path):
    s = saves(spark)
    rows = [tuple(r) for r in s.collect()]
    day = lambda r: r[1].day
    late = [r for r in rows if r[2] % 3 == 0]
    batches = [[r for r in rows if r not in late and day(r) == d] + [r for r in late if day(r) == d - 1] for d in (1, 2, 3, 4)]
    got = stream.drain(stream.stream_snapshots(deliveries(spark, str(tmp_path / "in"), [b for b in batches if b] + [[END]]), "3 days"))
    assert sorted(r.save_id for r in got.collect()) == sorted(r.save_id for r in library.snapshots(s).collect())


def test_late_saves_land_between_their_neighbours(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, at(0), 1, "a"), (1, at(4), 3, "a")], [(1, at(2), 2, "b"), (2, at(5), 9, "x")], [(1, at(20), 4, "a")], [(1, at(21), 6, "a")], [(1, at(1), 5, "too late")], [END]]
    got = stream.drain(stream.stream_snapshots(deliveries(spark, str(tmp_path / "in"), batches), "6 hours"))
    assert sorted((r.doc_id, r.save_id) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 9)]
    # with an expiry the last text is forgotten: the same text counts again
    batches = [[(1, at(0), 1, "a")], [(2, at(100), 2, "z")], [(2, at(200), 3, "z")], [(1, at(300), 4, "a")], [END]]
    got = stream.drain(stream.stream_snapshots(deliveries(spark, str(tmp_path / "in2"), batches), "1 hour", expire=50 * 3600))
    assert sorted(r.save_id for r in got.collect()) == [1, 2, 3, 4]
    got = stream.drain(stream.stream_snapshots(deliveries(spark, str(tmp_path / "in3"), batches), "1 hour"))
    assert sorted(r.save_id for r in got.collect()) == [1, 2]


def test_versions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [(*r[:1], r[1], r[2], r[3]) for r in map(tuple, saves(spark).collect())]
    s = deliveries(spark, str(tmp_path / "in"), [[r for r in rows if r[1].day <= d and r[1].day > d - 1] for d in (1, 2, 3)] + [[END]]).withColumnRenamed("saved_at", "ts")
    want = stream.auto_versions(saves(spark).withColumnRenamed("saved_at", "ts"), 8 * 3600)
    got = stream.drain(stream.auto_versions(s, 8 * 3600, "1 day"))
    assert sorted((r.doc_id, r.save_id, r.content) for r in got.collect()) == sorted((r.doc_id, r.save_id, r.content) for r in want.collect())
    assert got.count() > 0


def test_activity_stream_equals_batch(spark, tmp_path):
    ev = saves(spark).select(F.col("saved_at").alias("ts"), F.col("content").alias("provider"), F.lit(1).alias("value"))
    src = str(tmp_path / "ev")
    ev.write.parquet(src)
    batch = {(r.start, r.provider): r.n for r in stream.activity(ev).collect()}
    got = {}
    q = (
        stream.activity(stream.document_stream(spark, src, ev.schema)).writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda b, i: got.update({(r.start, r.provider): r.n for r in b.collect()}))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert got == batch


def test_cache_keeps_the_newest_row(spark, tmp_path):
    cache, schema = stream.Cache(spark, str(tmp_path / "cache")), "hash long, v string"
    now = lambda: {r.hash: r.v for r in cache.read(schema).collect()}
    assert now() == {}
    a = spark.createDataFrame([(1, "x"), (2, "y")], schema)
    cache.upsert(a, "full", "s", 1)
    cache.upsert(spark.createDataFrame([(2, "z")], schema), "full", "s", 2)
    cache.upsert(a.limit(0), "full", "s", 3)
    cache.upsert(spark.createDataFrame([(9, "gate")], schema), "gate", "s", 1)
    assert now() == {1: "x", 2: "z"}
    cache.upsert(a, "full", "s", 1)  # the batch once more: it stays older than the second
    assert now() == {1: "x", 2: "z"}
    before = cache.read(schema)
    cache.compact(schema)
    assert now() == {1: "x", 2: "z"} and cache.size() == 2 and before.count() == 2  # a reader that had begun goes on
    cache.upsert(spark.createDataFrame([(1, "new")], schema), "full", "other", 1)  # another stream, whose batches count anew
    assert now() == {1: "new", 2: "z"}
    cache.compact(schema)
    assert now() == {1: "new", 2: "z"} and {r.hash for r in cache.read(schema, "gate").collect()} == {9}


def test_a_cached_stream_goes_on_after_a_restart(spark, tmp_path):
    cache, schema, calls = stream.Cache(spark, str(tmp_path / "cache")), "hash long, n long", []

    def classify(new):
        calls.append(sorted(r.hash for r in new.collect()))
        return new.select("hash", F.col("hash").alias("n"))

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *rows: spark.createDataFrame(rows, "doc_id long, sent_id int, hash long").coalesce(1).write.mode("append").parquet(src)
    sink = stream.cached_sink(cache, schema, classify, out, every=2)

    def run():
        s = stream.document_stream(spark, src, "doc_id long, sent_id int, hash long", maxFilesPerTrigger=1)
        stream.stream_cached(s, sink, str(tmp_path / "check"), availableNow=True).awaitTermination()

    put((1, 0, 10), (1, 1, 11), (1, 2, 10))
    put((2, 0, 11), (2, 1, 12))
    run()
    put((3, 0, 12), (3, 1, 13))
    put((4, 0, 10), (4, 1, 14))
    run()  # the same checkpoint
    assert calls == [[10, 11], [12], [13], [14]]
    rows = lambda: sorted((r.doc_id, r.sent_id, r.cached, r.n) for r in spark.read.parquet(out).collect())
    want = [(1, 0, False, 10), (1, 1, False, 11), (1, 2, False, 10), (2, 0, True, 11), (2, 1, False, 12), (3, 0, True, 12), (3, 1, False, 13), (4, 0, True, 10), (4, 1, False, 14)]
    assert rows() == want
    sink(spark.createDataFrame([(4, 0, 10), (4, 1, 14)], "doc_id long, sent_id int, hash long"), 3)  # the last batch once more
    assert rows() == want and cache.read(schema).count() == 5


def test_snapshots_across_days(spark):
    kept = [r.save_id for r in library.snapshots(saves(spark)).filter("doc_id = 0").orderBy("save_id").collect()]
    assert kept == [0, 2, 4, 6, 8]
