"""Texts are cut once for all uses, and filters don't repeat the steps below them."""

from pyspark.sql import functions as F

from prosegrain.functions import exprs as X
from prosegrain.operators import compare, detect, profile, split, windows
from prosegrain.plans import analyze, load_catalog
from prosegrain.sources import lexicon

PATH = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_is_cut_again(spark):
    q = load_catalog().QUERIES
    for name in ("e08_voice_summary", "e13_impact", "e15_pick_hot", "e19_personal_targets", "f16_merge_partial", "d17_violation_counts", "h10_rank_rewriters", "f13_group_edits"):
        assert plan(q[name](spark, PATH)).count(split.CUT) <= 2, name  # one mark and one split, or none


def test_overlap_is_computed_once(spark):
    d = spark.createDataFrame([("a plain old sentence", "a plain old sentence here"), ("", "x" * 12)], "o string, r string")
    p = plan(d.filter(compare.is_valid(F.col("o"), F.col("r"))))
    assert p.count("array_intersect") == 1 and p.count("[^\\p{L}") <= 2
    assert d.select(X.overlap(F.col("o"), F.col("r")).alias("x")).collect()[0].x == 1.0


def test_windows_are_cut_in_the_document(spark):
    d = spark.createDataFrame([(1, " ".join(f"Word{i} and more of it." for i in range(60))), (2, "One. Two.")], "doc_id long, text string")
    s = detect.features(split.sentences(d))
    h = detect.screen_lexical(s)
    w = windows.rolling_windows(s)
    m = windows.window_metrics(w, s, h)
    assert "sequence(" not in plan(m)  # no row for each window and sentence
    assert m.select("doc_id", "size", "start_sentence", "end_sentence", "word_count").exceptAll(w).count() == 0 and m.count() == w.count()
    gap = s.filter("sent_id <> 3")  # sentences that are not there are not counted
    words = {(r.doc_id, r.sent_id): r.text.lower().split() for r in gap.collect()}
    for r in windows.window_metrics(w, gap, h).collect():
        ws = [x for i in range(r.start_sentence, r.end_sentence + 1) for x in words.get((r.doc_id, i), [])]
        assert r.ttr == int(len(set(ws)) / len(ws) * 1000 + 0.5) / 1000


def test_own_wording_needs_no_join(spark, tmp_path):
    raw = spark.createDataFrame([(1, "c", "s", '"one two" / "three"', "weak", "low", "", ""), (2, "c", "s", "four", "weak", "low", "", "")],
                                "id long, category string, subcategory string, phrase string, signal string, fp_risk string, replacement string, genres string")
    lex = lexicon.build_lexicon(raw)
    assert lexicon.lexicon_violations(lex).count() == 0
    bad = lex.withColumn("tier", F.when(F.col("id") == 1, "strong").otherwise(F.col("tier")))
    out = lexicon.lexicon_violations(bad)
    assert [tuple(r) for r in out.collect()] == [(1, "tier")] and "lookbehind" not in plan(out) and "LogicalRDD" not in plan(out)
    assert [tuple(r) for r in lexicon.lexicon_violations(lex.limit(1), detect.matchers(lexicon.lexicon_phrases(lex)).filter("phrase <> 'three'")).collect()] == [(1, "unmatched")]


def test_counts_of_a_document_are_not_repeated(spark):
    q = load_catalog().QUERIES
    p = plan(q["j45_sensory"](spark, PATH))
    assert p.count("shadow") <= 3 and p.count("whisper") <= 3  # the marks, and one expression for each sense
    p = plan(q["e13_impact"](spark, PATH))
    assert p.count("robust") <= 4 and "Join" not in p and "Aggregate" not in p


def test_expressions_look_ahead_and_replacements_for_their_words(spark):
    assert X.rx(r"\b(?:glow|dark)\b").startswith("(?i)(?=[dg])") and X.rx(r"\b(a|b)c\b").startswith("(?i)(?<!") and X.rx(r"\ba|b\b").startswith("(?i)(?<!")
    d = spark.createDataFrame([("Glow glowing DARK, dark_ darkness, the dark",)], "t string")
    assert d.select(X.match_count(F.col("t"), r"\b(?:glow|dark)\b").alias("n")).collect()[0].n == 3
    p = d.select(X.fold_replace(F.col("t"), [(r"\bdark\b", "dim"), (r"^glow,?\s*", "x"), (r"\bthe\b", "a")]).alias("x"))
    assert p.collect()[0].x == "xglowing dim, dark_ darkness, a dim" and plan(p).count("Contains") + plan(p).lower().count("contains(") >= 2


def test_a_text_is_rewritten_once(spark):
    d = spark.createDataFrame([("one . two.  three",)], "t string").select(detect.tidy(F.regexp_replace("t", "one", "four")).alias("x"))
    assert d.collect()[0].x == "four. Two. Three" and plan(d).count("one, four") == 1


def test_rewriters_need_one_pass_and_no_profile(spark):
    p = plan(load_catalog().QUERIES["h10_rank_rewriters"](spark, PATH))
    assert p.count("posexplode") == 1 and p.count("Join") == 1 and "Window" not in p  # joined with the sources only
    d = spark.createDataFrame([(1, "It is crucial. Perhaps it is crucial, and robust."), (1, "Once more."), (2, ""), (3, None), (4, "Plain."), (None, "No id, perhaps.")], "doc_id long, text string")
    c = analyze.classify(d)
    s = profile.summary(c)
    assert sorted(map(str, s.collect())) == sorted(map(str, profile.profile(c).select(*s.columns).collect())) and s.count() == 3
