import random

from pyspark.sql import functions as F

from prosegrain.dims import fixed
from prosegrain.operators import windows


def loop_windows(counts, least, target, step):
    out, start = [], 0
    while start < len(counts):
        end, words = start, 0
        while end < len(counts) and words < target:
            words += counts[end]
            end += 1
        if words < least and out:
            break
        out.append((start, end - 1, words))
        start += step
    return out


def test_windows_equal_a_loop(spark):
    rng = random.Random(7)
    docs = {d: [rng.randint(1, 40) for _ in range(rng.randint(1, 120))] for d in range(30)}
    rows = [(d, i, c) for d, cs in docs.items() for i, c in enumerate(cs)]
    s = spark.createDataFrame(rows, "doc_id long, sent_id int, word_count int")
    got = {}
    for r in windows.rolling_windows(s).collect():
        got.setdefault((r.doc_id, r.size), []).append((r.start_sentence, r.end_sentence, r.word_count))
    for d, cs in docs.items():
        for name, least, target, step in fixed.WINDOW_SETS:
            assert sorted(got[(d, name)]) == loop_windows(cs, least, target, step)


def test_moving_ratio_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [[rng.choice("abcdefghijk") for _ in range(rng.randint(1, 160))] for _ in range(40)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, w array<string>")
    st = windows.token_stats(F.col("w"))
    rows = d.select("doc_id", st.alias("s"), F.size("w").alias("n")).select("doc_id", windows.mattr_of(F.col("s"), F.col("n")).alias("m"), "s.hapax", "s.distinct").collect()
    tok = d.select("doc_id", F.posexplode("w").alias("pos", "word"))
    other = {r.doc_id: r.mattr for r in windows.mattr(tok).collect()}
    for r in rows:
        t = texts[r.doc_id]
        if len(t) <= 50:
            want = len(set(t)) / len(t)
        else:
            k = len(t) - 49
            want = sum(len(set(t[i:i + 50])) / 50 for i in range(k)) / k
        assert abs(r.m - want) <= 0.0005001 and other[r.doc_id] == r.m
        assert r.distinct == len(set(t)) and r.hapax == sum(t.count(x) == 1 for x in set(t))


def test_autocorrelation_known_values(spark):
    rows = [(1, i, v) for i, v in enumerate([1, 2, 3, 4])] + [(2, i, 5) for i in range(4)] + [(3, 0, 1), (3, 1, 9)]
    s = spark.createDataFrame(rows, "doc_id long, i int, v int")
    got = {r.doc_id: r.autocorrelation for r in windows.autocorrelation(s, ["doc_id"], "i", "v").collect()}
    assert got == {1: 0.25, 2: 0.0, 3: 0.0}


def test_entropy_is_bounded(spark):
    c = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (1, 5), (2, 9)], "g int, n long")
    assert {r.g: r.entropy for r in windows.entropy(c, ["g"]).collect()} == {1: 2.0, 2: 0.0}


def test_hot_regions(spark):
    heat = [4.0, 5.0, 1.0, 6.0, 3.0, 3.5, 0.0, 9.0]
    s = spark.createDataFrame([(1, i, h) for i, h in enumerate(heat)], "doc_id long, sent_id int, heat double")
    h = spark.createDataFrame([(1, 3, 0, "hedging"), (1, 4, 0, "hedging"), (1, 5, 0, "nominalization")], "doc_id long, sent_id int, hit_pos int, type string")
    names = spark.createDataFrame([("hedging", "Hedges")], "type string, name string")
    r = windows.hot_regions(s, h, names).orderBy("start_sentence").collect()
    assert [(x.start_sentence, x.end_sentence, x.heat) for x in r] == [(0, 1, 4.5), (3, 5, 4.2)]
    assert r[0].description == "Mild structural clustering across 2 sentences: general uniformity"
    assert r[1].primary_patterns == ["hedging", "nominalization"]
    assert r[1].description.endswith("Hedges, nominalization")


def test_word_windows_and_blocks_agree(spark):
    from prosegrain.operators import split, taxonomy

    text = " ".join(f"w{i % 7}" for i in range(733))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    a = windows.word_windows(split.doc_tokens(d), 200, 100)
    b = taxonomy.block_windows(d, 200, 100, k=lambda w: w == "w3")
    assert sorted((r.window_id, r.n) for r in a.collect()) == sorted((r.window_id, r.words) for r in b.collect())
    words = text.split()
    assert sorted((r.window_id, r.first_pos, r.last_pos, r.types) for r in a.collect()) == [
        (i, 100 * i, min(100 * i + 200, 733) - 1, len(set(words[100 * i : 100 * i + 200]))) for i in range(8)
    ]


def test_sums_over_windows_are_those_of_their_sentences(spark):
    import random

    rng = random.Random(4)
    s = [(d, i, rng.randint(0, 60)) for d in (1, 2, 3) for i in range(rng.choice([1, 40, 150]))]
    sents = spark.createDataFrame(s, "doc_id long, sent_id int, word_count int")
    hits = [(d, i, rng.choice("abc"), round(rng.random(), 6)) for d, i, _ in s for _ in range(rng.choice([0, 0, 1, 2]))]
    h = spark.createDataFrame(hits, "doc_id long, sent_id int, type string, confidence double")
    w = windows.rolling_windows(sents)
    got = {(r.doc_id, r.size, r.start_sentence): r.density for r in windows.pattern_density(w, h, ["a", "b"]).collect()}
    entropies = {(r.doc_id, r.size, r.start_sentence): r.device_entropy for r in windows.window_device_entropy(w, h).collect()}
    assert len(got) == len(entropies) == w.count()
    from collections import Counter
    from math import log2

    for r in w.collect():
        inside = [x for x in hits if x[0] == r.doc_id and r.start_sentence <= x[1] <= r.end_sentence]
        for t in "ab":
            total = sum(round(x[3] * 10**6) for x in inside if x[2] == t) / 10**6
            assert abs(got[r.doc_id, r.size, r.start_sentence][t] - (total * 100 / r.word_count if r.word_count else 0)) <= 0.0051
        n = Counter(x[2] for x in inside)
        assert abs(entropies[r.doc_id, r.size, r.start_sentence] + sum(c / len(inside) * log2(c / len(inside)) for c in n.values())) < 0.001
