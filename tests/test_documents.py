import random

from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.operators import compare, detect, library, profile, split
from prosegrain.plans import analyze
from prosegrain.sources import lexicon, model_output

TEXT = (
    "Moreover, this crucial and essential implementation is truly significant. Perhaps the landscape is nuanced. "
    "It is not about speed, but about care. It is about craft.\n\n"
    "On the one hand, we won. On the other hand, we lost. On the one hand, it rained.\n\nThe data held while others fell."
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_default_rules_fire(spark):
    s = split.sentences(docs(spark, TEXT))
    got = {(r.sent_id, r.type) for r in detect.screen_lexical(s).collect()}
    assert (0, "transition_formulaic") in got and (0, "importance_inflation") in got and (1, "hedging") in got and (1, "llm_fingerprint_word") in got
    kinds = {r.sent_id: r.route for r in detect.route(s).collect()}
    assert kinds[0] == "ambiguous" and kinds[3] == "certain_negative"


def test_pairs_use_a_sentence_once(spark):
    s = split.sentences(docs(spark, TEXT))
    r = {x.sent_id: x for x in detect.rewrite_pairs(s).collect()}
    assert set(r) == {2, 4} and r[4].replacement == "We won. We lost."


def test_opposition_rewrites(spark):
    s = split.sentences(docs(spark, "Work is not about speed, but about the care.\n\nOn the one hand, we won."))
    got = [x.replacement for x in detect.rewrite_opposition(s).orderBy("sent_id").collect()]
    assert got == ["Work depends on care.", "We won."]


def test_lexicon_join_equals_brute_force(spark):
    import re

    phrases = [("a", 0, 0, "in essence"), ("a", 0, 1, "cutting-edge"), ("b", 1, 0, "very"), ("b", 1, 1, "not [X] but"), ("c", 2, 0, "it's")]
    texts = ["InEssence we ran.", "every cutting edge tool", "A very cuttingedge one, not now but later.", "knot a but", "it’s fine in  essence"]
    s = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sent_id int, text string")
    lex = spark.createDataFrame(phrases, "subcategory string, sub_pos int, phrase_pos int, phrase string")
    got = {(r.doc_id, r.subcategory, r.evidence, r.start) for r in detect.match_lexicon(s, lex, "exhaustive").collect()}
    want = set()
    for i, t in enumerate(texts):
        for sub in "abc":
            for _, _, _, p in [x for x in phrases if x[0] == sub]:
                if "[" in p:
                    pat = r"not[^\n\r]{0,40}?but"
                else:
                    pat = r"(?<![a-z0-9])" + r"[\s '’-]*".join(map(re.escape, p.split())) + r"(?![a-z0-9])"
                m = re.search(pat, t, re.I)
                if m:
                    want.add((i, sub, m.group(0), m.start()))
                    break
    assert got == want


def test_profile_invariants(spark):
    c = analyze.classify(docs(spark, TEXT, "One short text."))
    p = {r.doc_id: r for r in profile.profile(c).collect()}
    assert p[0].sentence_count == c.filter("doc_id = 0").count() and p[0].paragraph_count == 3
    assert p[0].word_count == len(TEXT.split())
    for r in p.values():
        assert 0 <= r.ttr <= 1 and 0 <= r.opening_variety <= 1 and 0 <= r.mean_heat <= 10 and -1 <= r.autocorrelation <= 1


def test_nested_and_joined_heat_agree(spark):
    d = docs(spark, TEXT)
    c = analyze.classify(d)
    j = detect.heat(detect.features(split.sentences(d)), detect.explode_hits(c), dims.registry(spark))
    assert sorted((r.sent_id, r.heat) for r in c.collect()) == sorted((r.sent_id, r.heat) for r in j.collect())


def greedy(rows, regions, budget, cap):
    """Plain form of the pick, for small inputs. rows: (id, para, impact, primary)."""
    chosen, used, types = [], {}, set()

    def can(r):
        return r[0] not in chosen and used.get(r[1], 0) < cap

    def add(r):
        chosen.append(r[0])
        used[r[1]] = used.get(r[1], 0) + 1
        types.add(r[3])

    for a, b, _ in sorted(regions, key=lambda x: -x[2]):
        if len(chosen) >= budget:
            break
        for r in sorted([r for r in rows if a <= r[0] <= b], key=lambda r: -r[2]):
            if can(r):
                add(r)
                break
    scored = []
    for r in rows:
        if r[0] not in chosen:
            score = r[2] * (1.0 if r[3] in types else 1.3)
            scored.append((0 if used.get(r[1], 0) >= cap else score, r))
    for score, r in sorted([x for x in scored if x[0] > 0], key=lambda x: -x[0]):
        if len(chosen) >= budget:
            break
        if can(r):
            add(r)
    return sorted(chosen)


def test_pick_hot_equals_brute_force(spark):
    rng = random.Random(11)
    s_rows, h_rows, regs = [], [], []
    for d in range(12):
        for i in range(30):
            s_rows.append((d, i, i // 4, 15, round(rng.uniform(0, 6), 1)))
            if rng.random() < 0.7:
                h_rows.append((d, i, 0, rng.choice(["a", "b", "c"]), rng.choice([0.3, 0.5, 0.9])))
        regs += [(d, 3, 6, 5.0), (d, 10, 12, 4.0)]
    s = spark.createDataFrame(s_rows, "doc_id long, sent_id int, paragraph_id int, word_count int, heat double")
    h = spark.createDataFrame(h_rows, "doc_id long, sent_id int, hit_pos int, type string, confidence double")
    r = spark.createDataFrame(regs, "doc_id long, start_sentence int, end_sentence int, heat double")
    b = spark.createDataFrame([(d, 3 + d % 3) for d in range(12)], "doc_id long, budget long")
    got = {}
    for x in profile.pick_hot(s, h, r, b).collect():
        got.setdefault(x.doc_id, []).append(x.sent_id)
    e = {}
    for x in profile.eligible(s, h).orderBy("sent_id").collect():
        e.setdefault(x.doc_id, []).append((x.sent_id, x.paragraph_id, x.impact, x.primary))
    for d in range(12):
        assert sorted(got.get(d, [])) == greedy(e.get(d, []), [(a, z, q) for k, a, z, q in regs if k == d], 3 + d % 3, 2)


def test_diff_needs_a_baseline(spark):
    old, new = split.sentences(docs(spark, "A one. B two.")), split.sentences(docs(spark, "A one. B three.", "C new."))
    assert [(r.doc_id, r.sent_id) for r in compare.diff_sentences(old, new).collect()] == [(0, 1)]


def test_folder_cycles_and_orphans(spark):
    f = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "d"), (5, 6, "e"), (6, 5, "f")], "folder_id long, parent_id long, name string")
    assert {r.folder_id: r.depth for r in library.folder_tree(f).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    paths = {r.folder_id: r.path for r in library.folder_paths(f).collect()}
    assert paths[3] == "a / b / c" and paths[4] == "d" and paths[5] == "f / e"


def test_model_output_shapes(spark):
    raw = ['{"results": [{"patterns": ["hedging"]}', "garbage", '[{"patterns": {"hedging": "may"}, "arc_role": "pivot"}]']
    d = spark.createDataFrame(list(enumerate(raw)), "batch_id long, raw string").withColumn("expected_count", F.lit(2))
    got = {(r.batch_id, r.position): r for r in model_output.parse_model_output(d, dims.registry(spark)).collect()}
    assert len(got) == 6 and got[(0, 0)].patterns[0].type == "hedging" and not got[(1, 0)].parsed
    assert got[(2, 0)].arc_role == "pivot" and got[(2, 0)].patterns[0].evidence == "may" and got[(2, 1)].patterns == []


def test_damaged_phrases(spark):
    raw = [(1, "c", "s", '"game-changing" / "game-changer"', "strong contextual", "low", "x", "code"), (2, "c", "s", '"one thing and another thing entirely" / "a cut off pie', "weak", "low", "x", "code")]
    d = spark.createDataFrame(raw, "id long, category string, subcategory string, phrase string, signal string, fp_risk string, replacement string, genres string")
    r = {x.id: x for x in lexicon.build_lexicon(d).collect()}
    assert r[1].matchable == ["game-changing", "game-changer"] and r[1].tier == "strong"
    assert r[2].tier == "watch" and r[2].matchable == ["one thing and another thing entirely"]
    assert lexicon.lexicon_violations(lexicon.build_lexicon(d)).count() == 0
