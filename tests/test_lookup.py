"""Phrase keys, folders, trees, dimensions from a folder, and plug points."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.operators import detect, library, plug, split
from prosegrain.sources import rich_text

PHRASES = [
    ("one", "leverage"), ("one", "cutting edge"), ("two", "cutting-edge"), ("two", "it's important to note"), ("three", "in this [noun] perhaps"),
    ("three", "[only] of"), ("four", "e.g."), ("four", "a b c"), ("five", "—"), ("five", "ze"), ("six", "not only"), ("six", "state of the art"),
]


def plain_regex(phrase):
    if "[" in phrase:
        parts = [re.escape(p.strip()) for p in re.split(r"\[[^\]]+\]", phrase) if p.strip()]
        return re.compile(r"[^\n\r]{0,40}?".join(parts), re.I | re.A)
    return re.compile("(?<![a-z0-9])" + r"[\s '’-]*".join(map(re.escape, phrase.lower().split())) + "(?![a-z0-9])", re.I | re.A)


def sentences(spark, n=400):
    rng = random.Random(7)
    words = ["Leverage", "leveraged", "cutting", "edge", "cutting-edge", "cuttingedge", "It's", "important", "to", "note", "in", "this", "Case", "perhaps", "of", "e.g.", "a", "b", "c", "abc", "—", "ze", "zebra",
             "not", "only", "notonly", "state", "stateofthe", "art", "the", "é"]
    rows = [(i // 20, i % 20, rng.choice(["", "\n"]).join(" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(2))) for i in range(n)]
    rows += [(900, 0, "It’s important -to note"), (900, 1, "the stateof the ART."), (900, 2, "its important to note; state of the artist"), (900, 3, "In this odd case perhaps"), (900, 4, "it's important to note")]
    return rows, spark.createDataFrame(rows, "doc_id long, sent_id int, text string")


@pytest.mark.parametrize("most,counted", [(200_000, False), (0, False), (200_000, True)])
def test_phrases_are_found_where_their_expressions_fit(spark, monkeypatch, most, counted):
    monkeypatch.setattr(detect, "MOST_KEYS", most)  # 0: words travel to the keys and texts are fetched
    rows, s = sentences(spark)
    lexicon = spark.createDataFrame([(c, i, j, p, None) for i, (c, p) in enumerate(PHRASES) for j in (i,)] + [("given", 90, 90, "given", "(?i)z[a-z]+a")], "subcategory string, sub_pos int, phrase_pos int, phrase string, pattern string")
    counts = s.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")) if counted else None
    hits = detect._phrase_hits(s, detect.matchers(lexicon, counts), ["phrase"]).groupBy("doc_id", "sent_id", "phrase").agg(F.min(F.struct("start", "evidence")).alias("m")).select("doc_id", "sent_id", "phrase", "m.*")
    want = set()
    for d, i, text in rows:
        for regex, phrase in [*((plain_regex(p), p) for _, p in PHRASES), (re.compile("z[a-z]+a", re.I | re.A), "given")]:
            m = regex.search(text)
            if m:
                want.add((d, i, phrase, m.start(), m[0]))
    assert {tuple(r) for r in hits.collect()} == want and {x[2] for x in want} == {p for _, p in PHRASES} | {"given"}


def test_triggers_come_before_expressions(spark):
    rows, s = sentences(spark)
    lexicon = spark.createDataFrame([(c, i, i, p) for i, (c, p) in enumerate(PHRASES)], "subcategory string, sub_pos int, phrase_pos int, phrase string")
    every = {(r.doc_id, r.sent_id, r.subcategory) for r in detect.match_lexicon(s, lexicon, "exhaustive").collect()}
    tiered = {(r.doc_id, r.sent_id, r.subcategory) for r in detect.match_lexicon(s, lexicon, "tiered").collect()}
    text = {(d, i): t.lower() for d, i, t in rows}
    words = {"one": ["leverage", "cutting"], "two": ["cutting-edge", "important"], "three": ["perhaps"], "six": ["state"]}
    assert tiered == {x for x in every if any(w in text[x[:2]] for w in words.get(x[2], []))}


def test_a_deep_folder_tree(spark):
    n = 100_000
    chain = spark.range(1, n + 1).select(F.col("id").alias("folder_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.concat(F.lit("f"), "id").alias("name"))
    odd = spark.createDataFrame([(-1, -2, "a"), (-2, -1, "b"), (-3, -1, "under a cycle"), (-4, -4, "itself"), (-5, 999_999_999, "no parent")], "folder_id long, parent_id long, name string")
    folders = chain.union(odd)
    t = library.folder_tree(folders)
    assert t.count() == n + 1 and t.filter("folder_id = 100000").select("depth", "root_id").first() == (n - 1, 1)
    up = library.ancestors(folders, spark.createDataFrame([(70_000,), (-3,), (-4,)], "folder_id long"))
    got = {(r.folder_id, r.ancestor_id): r.distance for r in up.filter("folder_id < 0 or distance in (0, 1, 69999)").collect()}
    assert got == {(70_000, 70_000): 0, (70_000, 69_999): 1, (70_000, 1): 69_999, (-3, -3): 0, (-3, -1): 1, (-3, -2): 2, (-4, -4): 0}


def test_trees_of_any_depth_and_order(spark):
    leaf = lambda t: {"type": "text", "text": t}
    para = lambda *ts: {"content": [leaf(t) for t in ts], "type": "paragraph"}
    tree = {"type": "doc", "content": [para("a", "b"), {"type": "bulletList", "content": [{"type": "listItem", "content": [para("c"), para(" d")]}, {"type": "x", "content": [para("e")]}]}, para("f "), para(" "), leaf("lost")]}
    deep = '{"type":"doc","content":[' + '{"type":"x","content":[' * 5000 + json.dumps(para("down \"here\"", "é")) + "]}" * 5000 + "]}"
    rows = [(1, json.dumps(tree)), (2, deep), (3, None), (4, "not json"), (5, "[1, 2]"), (6, "{}")]
    out = {r.doc_id: r.text for r in rich_text.flatten_rich_text(spark.createDataFrame(rows, "doc_id long, tree string")).collect()}
    kinds = rich_text.fixed.BLOCK_TYPES
    first = "ab\n\nc d\n\ne\n\nf" if "listItem" in kinds else "ab\n\nc\n\nd\n\ne\n\nf"
    assert out == {1: first, 2: 'down "here"é', 3: "", 4: "", 5: "", 6: ""}


def test_dimensions_of_a_folder(spark, tmp_path):
    known = dims.registry(spark).first().type
    (tmp_path / "patterns.json").write_text(json.dumps([
        {"type": known, "name": "Mine", "level": "lexical", "weight": 9.0, "amplification": "low", "playbook": 1, "tolerance": {"general": 1.0}, "directive": "Do NOT do it", "hint": "look", "rewrite_menu": [{"id": 1, "instruction": "Cut."}, {"id": 2, "instruction": "Say."}]},
        {"type": "new_one", "name": "New", "level": "sentence", "weight": 1.0, "amplification": "high", "playbook": 0},
    ]))
    lists = tmp_path / "hitlists"
    lists.mkdir()
    (lists / "index.json").write_text(json.dumps([{"slug": "a-b", "category": "A, b", "entries": 2, "tiers": {"strong": 1, "moderate": 1, "watch": 0}}, {"slug": "c", "category": "C", "entries": 1, "tiers": {"strong": 1, "moderate": 0, "watch": 0}}]))
    entry = lambda i, tier: {"id": f"D{i}", "phrase": f"p{i}", "alternatives": [f"p{i}"], "subcategory": "s", "tier": tier}
    (lists / "a-b.json").write_text(json.dumps([entry(1, "strong"), entry(2, "moderate")]))
    (lists / "c.json").write_text(json.dumps([entry(3, "strong")]))
    d = dims.load_dims(spark, str(tmp_path))
    p = {r.type: r for r in d["patterns"].collect()}
    assert p[known].weight == 9.0 and p[known].directive == "Do NOT do it" and p["new_one"].name == "New" and len(p) == dims.registry(spark).count() + 1
    assert sorted(map(tuple, d["menus"].collect())) == [(known, 1, "Cut."), (known, 2, "Say.")]
    assert [tuple(r) for r in d["directives"].collect()] == [(known, "Do NOT do it")] and [tuple(r) for r in d["hints"].collect()] == [(known, "look")]
    assert sorted((r.slug, r.id, r.category) for r in d["hitlists"].collect()) == [("a-b", "D1", "A, b"), ("a-b", "D2", "A, b"), ("c", "D3", "C")]
    assert dims.hitlist_differences(d["hitlist_index"], d["hitlists"]).count() == 0
    assert [r.slug for r in dims.hitlist_differences(d["hitlist_index"], d["hitlists"].filter("id <> 'D2'")).collect()] == ["a-b"]
    assert "menus" not in dims.load_dims(spark)


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    rows = spark.range(1000).repartition(3).select("id", F.concat(F.lit("t"), "id").alias("text"))
    mark = str(tmp_path)

    def load():
        import uuid

        open(f"{mark}/{uuid.uuid4().hex}", "w").close()
        return lambda batch: {"n": [len(t) for t in batch["text"].to_pylist()]}

    out = plug.classify_batches(rows, load, "n int", ["text"])
    assert out.columns == ["id", "text", "n"] and all(r.n == len(r.text) for r in out.collect())
    import os

    assert len(os.listdir(mark)) == 3


def test_table_functions_split_as_the_operators_do(spark):
    plug.register_functions(spark)
    text = "One here. Two, e.g. this, there! \x0b\f\n\nThree \"four.\" Five… J. Doe said so?\r\n\r\n  \n\nlast"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT d.doc_id, s.* FROM some_docs d, LATERAL doc_sentences(d.text) s").collect()
    want = split.split_sentences(docs).select("doc_id", "sent_id", "paragraph_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = spark.sql("SELECT d.doc_id, p.* FROM some_docs d, LATERAL doc_paragraphs(d.text) p").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, split.split_paragraphs(docs).collect()))
