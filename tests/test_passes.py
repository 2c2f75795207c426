"""Work that is done once: plans and results of the queries on large texts."""

from pyspark.sql import functions as F

from prosegrain.operators import detect, evaluate, windows
from prosegrain.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_marks_are_those_of_replace(spark):
    texts = ["Of a is to it of of x", "", None, "é to  to ü is is not Of", " of of of ", "The  der von\nDie 😀 an "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    for a, b in catalog.MARKS:
        c = F.replace(c, F.lit(a), F.lit(b))
    out = docs.select(catalog.marked(F.col("text")).alias("m"), c.alias("r"))
    assert out.filter(~F.col("m").eqNullSafe(F.col("r"))).count() == 0 and out.schema["m"].dataType == out.schema["r"].dataType
    assert "replace(" not in plan(docs.select(catalog.marked(F.col("text"))))


def test_window_measures_of_repeated_sentences(spark):
    sents = [(1, 0, "a b c", 3), (1, 0, "one two one two one two", 6), (1, 2, "Of it", 2)]
    scores = [f"0.5D as {r}" for r in windows.fixed.REGISTERS]
    s = spark.createDataFrame(sents, "doc_id long, sent_id int, text string, word_count int").selectExpr("*", *scores)
    w = spark.createDataFrame([(1, "narrow", 0, 0, 9), (1, "wide", 0, 2, 11), (1, "wide", 1, 1, 0)], "doc_id long, size string, start_sentence int, end_sentence int, word_count long")
    hits = spark.createDataFrame([(1, 2, "x"), (1, 2, "y")], "doc_id long, sent_id int, type string")
    got = {r.size: r for r in windows.window_metrics(w, s, hits).collect()}
    assert set(got) == {"narrow", "wide"}  # a window without sentences is none
    a, b = got["narrow"], got["wide"]
    assert (a.length_entropy, a.ttr, a.hapax_ratio, a.opening_variety, a.device_entropy) == (1.0, 0.556, 0.333, 1.0, 0.0)
    assert (b.ttr, b.function_word_ratio, b.device_entropy, b.register_entropy, b.word_count) == (0.636, 0.273, 1.0, 0.0, 11)


def test_diversity_reads_words_once(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "bcd"), (1, "12"), (2, "--"), (None, "ab")], "doc_id long, word string")
    out = windows.lexical_diversity(tokens, ["doc_id"])
    assert "Join" not in plan(out)
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (4, 3, 0.75, 0.5, 0.5, 1.0), 2: (1, 1, 1.0, 1.0, 0.0, 0.0), None: (1, 1, 1.0, 1.0, 0.0, 0.0)}


def test_texts_stay_behind_the_sort_and_labels_meet_hits_once(spark):
    s = spark.createDataFrame([(1, 0, 0, "While we are not there but here, we go", 9), (1, 1, 0, "While we wait", 3)], "doc_id long, sent_id int, paragraph_id int, text string, word_count int")
    rules = detect.classify_rules(s).select("doc_id", "sent_id", "patterns")
    node = rules._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().apply(0)
    assert "text#" not in node.output().mkString(" ")
    assert [[(p.type, p.evidence) for p in r.patterns] for r in rules.orderBy("sent_id").collect()] == [
        [("binary_contrast", "While")], [("binary_contrast", "While"), ("sentence_opener_repetition", "while we")],
    ]
    labels = spark.createDataFrame([("a", ["x", "y"], ["z"], "obvious"), ("b", ["x"], None, "subtle")], "id string, expected array<string>, absent array<string>, difficulty string")
    hits = spark.createDataFrame([("a", "p", "z"), ("a", "p", "x"), ("a", "q", "y"), ("a", "p", None), ("b", "q", "w"), ("b", None, "x")], "id string, detector string, type string")
    rows = evaluate.score_rows(labels, hits, ["p", "q"])
    text = plan(rows)
    assert text.index("Generate") < text.index("Join")
    got = {(r.id, r.detector): (r.detected, r.tp, r.fn, r.fp, r.decoys) for r in rows.collect()}
    assert got == {
        ("a", "p"): (["x", "z"], ["x"], ["y"], ["z"], ["z"]), ("a", "q"): (["y"], ["y"], ["x"], [], []),
        ("b", "p"): ([], [], ["x"], [], []), ("b", "q"): (["w"], [], ["x"], ["w"], []),
    }
