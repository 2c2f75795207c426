"""Near duplicates, repeated passages, personal data and the pipeline against plain versions."""

import hashlib
import random
import re
import time

import brute
import corpus_pipeline
from conftest import SF

from prosegrain.llm import common, jaccard, pii, quality, suffixes


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near(rng, words, n, changes):
    base = [rng.choice(words) for _ in range(n)]
    for _ in range(changes):
        base[rng.randrange(n)] = rng.choice(words)
    return base


def varied(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 160]))]
        for _ in range(rng.choice([1, 4, 25])):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((rng.randrange(10**6), " ".join(t) + rng.choice(["", " ", " Tail"])))
    return rows


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 4), (7, 8), (9, 9), (-5, 8), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(200, 240))]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys([1, 2, 3, 4, 10], 1), **dict.fromkeys([7, 8, -5], -5), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 241), 200)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard(spark, awkward):
    rows = varied() + [tuple(r) for r in common.table(spark, SF, "documents", "doc_id", "text").limit(120).collect()]
    for words, num, capacity in ((4, 85, 1 << 18), (5, 80, 300)):
        got = {r.doc_id: r for r in jaccard.similar(pages(spark, rows), words, num, 100, capacity).collect()}
        sets = brute.shingle_sets([t for _, t in rows], words)
        for (d, _), s, c in zip(rows, sets, brute.components([d for d, _ in rows], sets, num, 100), strict=True):
            assert (got[d].n_shingles, got[d].component_id) == (len(s), c)
    odd = sorted(map(str, map(tuple, jaccard.similar(awkward, 4, 85).collect())))
    assert len(odd) == awkward.count() and "(1, 0, 1)" in odd and "(3, 0, 3)" in odd and odd.count("(5, 397, 5)") == 2
    assert "(11, 1, 4)" in odd and any(x.startswith("(6, ") and x.endswith(", 5)") for x in odd)
    assert jaccard.similar(awkward.limit(0)).count() == 0


def test_rows_without_an_id_link(spark):
    body = [f"w{i}" for i in range(101)]
    rows = [(1, " ".join(body)), (None, " ".join([*body[:-1], "x"])), (2, " ".join([*body[:-2], "y", "x"])), (7, "else " * 9), (None, "alone here"), (None, None)]
    got = sorted(map(str, map(tuple, jaccard.similar(pages(spark, rows), 4, 85).collect())))
    assert got == sorted(map(str, [(1, 98, 1), (None, 98, 1), (2, 98, 1), (7, 1, 7), (None, 1, None), (None, 0, None)]))
    kept = sorted(map(str, map(tuple, jaccard.one_of_each(pages(spark, rows), 4, 85).collect())))
    assert kept == sorted(map(str, [rows[0], rows[3], rows[4], rows[5]]))


def test_one_row_of_each_component_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (2, "own text of two"), (3, b + " more"), (None, b), (4, ""), (4, "")]
    kept = sorted(map(str, map(tuple, jaccard.one_of_each(pages(spark, rows), 5, 80).collect())))
    assert kept == sorted(map(str, [(1, a), (1, b), (2, "own text of two"), (4, ""), (4, "")]))


def test_sets_that_share_a_signature_get_another(spark, monkeypatch):
    rows = [(i, " ".join(f"{c}{k}" for k in range(30))) for i, c in enumerate("abcdef")]
    rows += [(100 + i, t + " end") for i, t in rows]
    real = jaccard.signatures

    def few(h, at, shared=frozenset()):
        import numpy as np

        s = real(h, at) % 3
        return s if not shared else np.where(np.isin(s, list(shared)), real(h, at), s)

    monkeypatch.setattr(jaccard, "checks", real)
    docs = pages(spark, rows)
    got, shared = None, frozenset()
    for batch in [[t for _, t in rows]]:
        data, off = common.utf8(__import__("pyarrow").array(batch))
        h, at = jaccard.sets(data, off, 4)
        shared = frozenset((few(h, at)).tolist())
        got = few(h, at, shared)
    assert len(set(got.tolist())) == len(rows)  # what ``_sets`` relies on
    each, reps, none = jaccard._sets(docs.selectExpr("doc_id", "unhex(md5(text)) as tid", "text"), 4)
    assert reps.count() == len(rows) and none == frozenset()


def test_large_meetings_go_in_blocks(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(3):  # variants of a template: different sets that share nearly all parts
        base = [rng.choice(words) for _ in range(90)]
        for i in range(60):
            t = list(base)
            t[rng.randrange(90)] = f"v{g}x{i}"
            rows.append((1000 * g + i, " ".join(t + [f"t{k}" for k in range(rng.randrange(14))])))
    line = " ".join(rng.choice(words) for _ in range(30))  # a line that many share who are not near
    rows += [(9000 + i, line + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40)))) for i in range(150)]
    sets = brute.shingle_sets([t for _, t in rows], 4)
    got = {r.doc_id: r.component_id for r in jaccard.similar(pages(spark, rows), 4, 85, 100, 2000, 7).collect()}
    assert got == dict(zip([d for d, _ in rows], brute.components([d for d, _ in rows], sets, 85, 100), strict=True))
    met = spark.range(3000).selectExpr("id % 2 as meeting", "id as s")
    reps = spark.range(3000).selectExpr("id as s", "100 + id % 50 as n", "cast('12345678' as binary) as bits")
    placed, tiles = jaccard.blocks(met, reps, met.select("meeting").distinct(), 85, 100, 100)
    assert placed.count() == 3000 and tiles.count() > 4
    assert placed.groupBy("meeting", "band", "salt").count().agg({"count": "max"}).first()[0] < 150


def test_pieces_of_a_cluster_meet_as_bitmaps(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    a = [rng.choice(words) for _ in range(300)]
    b = a[:262] + [rng.choice(words) for _ in range(38)]  # not near, but nearly: the small bitmaps cannot tell
    rows = []
    for base in (a, b):
        for _ in range(60):
            t = list(base)
            t[rng.randrange(300)] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    tiled, counts = jaccard._tiled, []
    monkeypatch.setattr(jaccard, "_tiled", lambda m, *x: counts.append(m.count()) or tiled(m, *x))
    got = {r.doc_id: r.component_id for r in jaccard.similar(pages(spark, rows), 4, 85, 100, 1500).collect()}
    sets = brute.shingle_sets([t for _, t in rows], 4)
    assert got == dict(zip([d for d, _ in rows], brute.components([d for d, _ in rows], sets, 85, 100), strict=True))
    assert len(counts) == 2 and counts[1] <= len(rows)  # sets in pairs of tiles: each would be in about 25


def test_shuffles_of_a_write_go_with_it(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum("shuffle" in manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size()))
    before = files()
    out = common.stored(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").sum("id"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 7


def test_every_band_has_parts_to_fill():
    for num in (80, 85, 95):
        tops, parts, spare = jaccard.bands(num, 100)
        for last, top, k, e in zip(tops[:-1], tops[1:], parts[1:], spare[1:], strict=True):
            differ = (100 - num) * 2 * int(top) // (100 + num)
            assert k == 0 and differ == 0 or k >= differ + 1 + e and k - e <= num * (last + 1) // 100


def test_long_sets_file_soon():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (9, 300, 50_000):
        h = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        keys, owner = jaccard.part_keys(h, np.array([0, n]), 80, 100)
        assert 0 < len(keys) < 8 * n and not owner.any()


def test_suffixes(spark, awkward):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (380, 399, 400, 401, 450, 700, 900)]
    rows = []
    for i in range(80):
        pick = [rng.choice([*parts, "".join(rng.choice("xyz w") for _ in range(rng.randint(0, 300)))])[: rng.choice([350, 395, 420, 2000])] for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(pick)))
    rows += [(1001, "a" * 1500), (1002, "b" * 600 + "a" * 700), (1003, "ab" * 600), (1004, None), (1005, ""), (1006, parts[6]), (1006, parts[6]), (1007, "x" + parts[6])]
    want = sorted(
        (d, len((t or "").encode()), sum(e - a for a, e in ranges), len(ranges), hashlib.sha256(kept).hexdigest())
        for (d, t), (kept, ranges) in zip(rows, brute.repeated([t for _, t in rows], 400), strict=True)
    )
    docs = pages(spark, rows)
    assert sorted(tuple(r)[:5] for r in suffixes.digests(docs).collect()) == want
    assert sorted(tuple(r)[:5] for r in suffixes.digests(docs, words=0, block=3, group=8).collect()) == want
    odd = [(r.doc_id, r.text) for r in awkward.collect()]
    plain = [(str(d), hashlib.sha256(kept).hexdigest()) for (d, _), (kept, _) in zip(odd, brute.repeated([t for _, t in odd], 400), strict=True)]
    assert sorted((str(r.doc_id), r.kept_sha256) for r in suffixes.digests(awkward).collect()) == sorted(plain)
    clean = suffixes.cleaned(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert suffixes.digests(docs.limit(0)).count() == 0


def test_passages_of_very_long_texts(monkeypatch):
    import numpy as np

    text = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8)
    whole = suffixes.anchors(text, 400)
    covered = np.zeros(len(text) - 399, int)
    for a, b in zip(whole[3], whole[4], strict=True):
        covered[a : b + 1] += 1
    assert (covered == 1).all()
    assert ((whole[2] >= whole[4]) & (whole[2] <= whole[3] + 368)).all()


def test_passages_over_the_borders_of_pieces(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(60):
        passage = some(rng.choice([400, 405, 430, 700]))
        rows.append((i, some(rng.randrange(900)) + passage + some(rng.randrange(500))))
        rows.append((100 + i, some(rng.randrange(900)) + passage + some(rng.randrange(500))))
    rows += [(300, "a" * 1500), (301, "ab" * 900), (302, "b" + "ab" * 300)]
    want = sorted((d, sum(e - a for a, e in ranges), hashlib.sha256(kept).hexdigest()) for (d, _), (kept, ranges) in zip(rows, brute.repeated([t for _, t in rows], 400), strict=True))
    for piece in (100, 500):
        got = suffixes.digests(pages(spark, rows), piece=piece).collect()
        assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == want


def test_passages_of_51_words_go(spark):
    rng = random.Random(8)
    some = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(n)]
    rows, want = [], {}
    for i, n in enumerate([51, 50, 51, 62, 49, 51]):
        passage = some(n)
        if i == 2:
            passage = list("abcdefghij" * 6)[:51]  # 101 bytes
        for d in (i, 100 + i):
            head, tail = some(rng.randrange(1, 90)), some(rng.randrange(1, 90))
            rows.append((d, " ".join(head) + "\n" + " ".join(passage) + " " + " ".join(tail)))
            want[d] = rows[-1][1] if n < 51 else " ".join(head) + "\n" + " " + " ".join(tail)
    left, middle, right = some(40), some(20), some(40)  # two repeats of 40 words side by side are no passage of over 50
    for d, x in ((200, left + middle + right), (201, left), (202, right)):
        rows.append((d, " ".join(x)))
        want[d] = rows[-1][1]
    alone = " ".join(some(55))
    rows += [(300, alone), (301, alone), (302, None), (303, "")]
    want |= {302: None}
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got == {**want, 303: ""}


def test_stage_removes_by_bytes_and_by_words(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents", "doc_id", "text").collect()]
    rows += [(10**9 + i, x * 700) for i, x in enumerate("ab")] + [(10**9 + 5, "a b " * 80), (10**9 + 6, "x " + "b a " * 40)]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, pages(spark, rows), SF).collect()}
    shown = {r.doc_id: r.text for r in suffixes.digests(pages(spark, rows)).collect()}
    for (d, _), kept in zip(rows, without_passages([t for _, t in rows]), strict=True):
        assert got.get(d, "") == shown[d] == kept


def without_passages(texts):
    """Each text without repeated strings of 400 bytes and repeated passages of 51 words."""
    data = [(t or "").encode() for t in texts]
    places = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in data]
    seen = {}
    for w in places:
        for i in range(len(w) - 50):
            key = tuple(x[2] for x in w[i : i + 51])
            seen[key] = seen.get(key, 0) + 1
    whole = {t for t in data if data.count(t) > 1}
    out = []
    for b, w, (_, ranges) in zip(data, places, brute.repeated(texts, 400), strict=True):
        keep = bytearray(b"\1" * len(b))
        more = [(w[i][0], w[i + 50][1]) for i in range(len(w) - 50) if seen[tuple(x[2] for x in w[i : i + 51])] > 1]
        for a, e in [*ranges, *more, *([(0, len(b))] if b in whole and (len(w) > 50 or len(b) >= 400) else [])]:
            keep[a:e] = bytes(e - a)
        out.append(bytes(x for x, k in zip(b, keep, strict=True) if k).decode("utf-8", "ignore"))
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(x):
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(x))) % 10 == 0


def base_spans(text):
    out = []
    for kind, regex in BASE.items():
        for m in re.finditer(regex, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def noise(n):
    rng = random.Random(3)
    signs = [*"ab.@+-() 0123459", "1.2.3.4", "é", "😀", "4713332104704538", "+1 (499) 555-6503", "a@b.c", " "]
    return [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def context(text, kind, regex):
    found = list(re.finditer(regex, text, re.ASCII))
    for i, m in enumerate(found):
        before, after = text[found[i - 1].end() if i else 0 : m.start()], text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
        back = before[::-1]
        left = lambda r: (re.match(r, back, re.ASCII) or ["", ""])[1][::-1]  # noqa: B023, E731
        one, two = left(r"\S*\s+(\S+)"), left(r"\S*\s+\S+\s+(\S+)")
        next_ = (re.match(r"\S*\s+(\S+)", after, re.ASCII) or ["", ""])[1]
        off = (re.match(r"(\S+)", after, re.ASCII) or ["", ""])[1]
        yield m, (word(left(r"(\S+)")), "0" if i and not one else word(one), word(two), word(off), "0" if i < len(found) - 1 and not next_ else word(next_))


def word(w):
    low = re.sub("[0-9]+", "0", w.lower())
    return hashlib.md5(low.encode()).hexdigest() if len(low) > 64 else low


def occurrences(text):
    """(start, end, value, seed, what is beside) as ``pii.occurrences`` describes it."""
    text, out = text or "", []
    base = {tuple(map(int, s.split(":")[1:])): s.split(":")[0] for s in base_spans(text)}
    for kind, regex in BASE.items():
        out += [(m.start(), m.end(), m[0], True, c) for m, c in context(text, kind, regex) if base.get(m.span()) == kind]
    clear = lambda a, b: all(b <= s or e <= a for s, e, *_ in out)
    out += [(m.start(), m.end(), m[0], True, c) for m, c in context(text, "key", pii.KEY) if clear(m.start(), m.end())]
    others = []
    for m, (_, one, two, _, next_) in context(text, "token", r"(?<!\S)[^\s0-9]*[0-9]\S*"):
        core = re.search(r"[A-Za-z0-9](?:[A-Za-z0-9_.@+/-]*[A-Za-z0-9])?", m[0])
        if core and len(core[0]) >= 6 and len(re.sub("[^0-9]", "", core[0])) >= 4 and clear(m.start() + core.start(), m.start() + core.end()):
            others.append((m.start() + core.start(), m.start() + core.end(), core[0], False, (word(m[0][: core.start()]), one, two, word(m[0][core.end() :]), next_)))
    return out + others


def patterns(value, beside):
    to, one, two, off, next_ = beside
    shape = re.sub("[A-Za-z]+", "a", re.sub(r"(?<![A-Za-z0-9])(?:[0-9]+[A-Za-z]|[A-Za-z]+[0-9])[A-Za-z0-9]*", "#", value))
    shape = word(re.sub("[0-9]+", "0", shape))
    cases = [(one and two, ("wb", two, one, to)), (one and next_, ("wa", one, to, off, next_)), (one, ("ws", one, to, shape)), (to, ("at", to, off, shape))]
    return {p for ok, p in cases if ok}


def plain_bootstrap(texts, rounds=3, support=3, sure=0.8):
    """Spans of kind id of each text, by the docstring's rules."""
    seen = [occurrences(t) for t in texts]
    edges, seeds = {}, set()
    for rows in seen:
        for _, _, v, seed, beside in rows:
            for p in patterns(v, beside):
                edges.setdefault(p, set()).add(v)
            if seed and patterns(v, beside):
                seeds.add(v)
    of = {}
    for p, vs in edges.items():
        for v in vs:
            of.setdefault(v, set()).add(p)
    conf = {v: float(v in seeds) for v in of}
    for _ in range(rounds):
        score = {p: sum(conf[v] for v in vs) / (len(vs) + 1) for p, vs in edges.items() if sum(conf[v] >= sure for v in vs) >= support}
        conf = {}
        for v, ps in of.items():
            doubt = 1.0
            for p in ps:
                doubt *= 1 - min(score.get(p, 0.0), 1 - 1e-9)
            conf[v] = 1.0 if v in seeds else round(1 - doubt, 9)
    good = {p for p, x in score.items() if x >= sure}
    return [sorted({(a, b) for a, b, v, seed, beside in rows if not seed and conf.get(v, 0) >= sure and patterns(v, beside) & good}) for rows in seen]


def test_bootstrapping_finds_what_a_plain_version_finds(spark):
    rng = random.Random(11)
    fill = lambda n: " ".join(rng.choice(["der", "und", "éa", "thou", "wen.", "x,", "2019", "é"]) for _ in range(n))
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [tuple(r) for r in common.table(spark, SF, "documents", "doc_id", "text").collect()]
    rows += [(10_000 + i, f'{fill(9)} token = "{key(40)}" {fill(5)}') for i in range(8)]
    hidden = [(20_000 + i, f'{fill(4)} token = "{key(9)}7Q81{i}" {fill(6)}') for i in range(5)]  # too short for a key
    rows += hidden + [(30_000 + i, f"{fill(3)} my account holder{i}@site.org is {fill(3)}") for i in range(5)] + [(30_100, f"{fill(3)} my account user-4711{7}x is {fill(2)}")]
    rows += [(40_000 + i, f"{fill(3)} order 2019-11{i:02d} of {fill(3)}") for i in range(12)]  # no identifiers
    rows += [(50_000, "w" * 300 + " a1b2c3d4e5f6 " + "z" * 300)]
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("id:")] for r in pii.digests(pages(spark, rows)).collect()}
    want = dict(zip([d for d, _ in rows], plain_bootstrap([t for _, t in rows]), strict=True))
    assert got == want
    assert all(got[d] for d, _ in hidden) and got[30_100]
    assert not any(got[40_000 + i] for i in range(12)) and not got[50_000]


def test_patterns_without_support_prove_nothing(spark):
    rows = [(1, "call me at number 4711-0815 now"), (2, "call me at number 4711-0816 now")]
    assert {r.spans for r in pii.digests(pages(spark, rows)).collect()} == {""}
    few = [(i, f"mail to a{i}@b.org today") for i in range(3)] + [(10 + i, f"mail to 2019{i:04d} today") for i in range(30)]
    assert {r.doc_id: r.spans for r in pii.digests(pages(spark, few)).collect()}[12] == ""


def test_personal_data(spark, awkward):
    rows = noise(800) + [(2000 + i, f"please reach me person{i}@site.org today or ring number +1 (499) 555-650{i} now") for i in range(6)]
    rows += [(3000, "a@" + "b." * 20_000 + "c"), (3001, "é 4713 3321 0470 4538 x@y.z%q@r.s 000001.2.3.255 256.1.1.1.1"), (3002, "please reach me user-77431x today")]
    got = {r.doc_id: r for r in pii.digests(pages(spark, rows)).collect()}
    for d, t in rows:
        want = base_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[d].spans.split(",")[: len(want)] == (want or got[d].spans.split(",")[:0])
        assert got[d].n_email == sum(x.startswith("email") for x in want)
    assert got[3002].spans == "id:16:27"
    odd = pii.digests(awkward).collect()
    assert len(odd) == awkward.count() and {r.spans for r in odd if r.doc_id in (1, 2, 3)} == {""}
    assert pii.digests(awkward.limit(0)).count() == 0


def test_long_runs_are_read_once(spark):
    rows = [(1, "a" * 200_000 + "@"), (2, "1" * 200_000), (3, "1." * 100_000)]
    got = {r.doc_id: r.spans for r in pii.digests(pages(spark, rows)).collect()}
    assert got[1] == got[2] == "" and got[3].startswith("ip:0:7,ip:8:15")


def test_masking(spark, awkward):
    rows = [(1, "x a@b.org, +1 (499) 555-6503"), (2, None), (3, "none"), (4, "9 a@b.org"), (5, "+4713332104704538 z")]
    got = {r.doc_id: r.text for r in pii.masked(pages(spark, rows)).collect()}
    assert got == {1: "x <email>, <phone>", 2: None, 3: "none", 4: "9 <email>", 5: "+<card> z"}
    assert pii.masked(awkward).columns == awkward.columns and pii.masked(awkward).count() == awkward.count()


def test_pipeline_stages(spark, awkward, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SF))
        assert out.columns == columns, name
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if stage is corpus_pipeline.near_duplicates:
            ids = sorted(before)
            sets = brute.shingle_sets([before[i] for i in ids], 5)
            assert set(after) == {i for i, c, s in zip(ids, brute.components(ids, sets, 80, 100), sets, strict=True) if c == i or not s}
        if stage is corpus_pipeline.repeated_passages:
            ids = sorted(before)
            for i, kept in zip(ids, without_passages([before[i] for i in ids]), strict=True):
                assert after.get(i, "") == kept
        if stage is corpus_pipeline.personal_data:
            assert not [t for t in after.values() if [s for s in base_spans(t) if not s.startswith("phone")]]
        docs = out
    from collections import Counter

    pieces = corpus_pipeline.run(spark, SF).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in docs.collect())
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {p.doc_id: p.doc_tokens for p in pieces}


def test_stages_on_awkward_rows(spark, awkward):
    rows = awkward.collect()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), SF).count() == 0
    judged = corpus_pipeline.quality_classifier(spark, awkward, SF)
    model = quality.fit(awkward, common.table(spark, SF, "labels", "doc_id", "quality"), quality.learnable(), quality.Setting())
    want = [(r.doc_id, r.text) for r in quality.scored(awkward, model, "_s").where("_s >= 0.3").collect()]
    assert sorted(map(str, ((r.doc_id, r.text) for r in judged.collect()))) == sorted(map(str, want)) and judged.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, awkward, SF).collect()) == sorted(["1", "2", "3", "4", "5", "None", "7", "8", "9", "10", "12"])
    left = corpus_pipeline.repeated_passages(spark, awkward, SF).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(["1", "2", "3", "4", "6", "None", "10", "11", "12"]) and {r.text for r in left if r.doc_id == 6} == {" end"}
    masked = {(r.doc_id, r.text) for r in corpus_pipeline.personal_data(spark, awkward, SF).collect()}
    assert len(masked) == len({(r.doc_id, r.text) for r in rows}) and (10, "mail <email> or <phone>") in masked
    pieces = corpus_pipeline.pack_sequences(spark, awkward, SF).collect()
    assert len([p for p in pieces if p.start == 0]) == len(rows) and {p.doc_tokens for p in pieces if p.doc_id in (1, 2)} == {1}


def test_frequent_grams_need_no_bucket_of_their_own(spark):
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = some(60)  # one gram in many places, of which few repeat
    rows = [(i, some(rng.randrange(200, 380)) + line + some(rng.randrange(200, 380))) for i in range(60)]
    rows += [(100 + i, some(50) + rows[i][1] + some(50)) for i in range(0, 60, 7)] + [(200 + i, rows[3][1]) for i in range(3)] + [(300, rows[5][1] * 3)]
    want = sorted((d, sum(e - a for a, e in ranges), hashlib.sha256(kept).hexdigest()) for (d, _), (kept, ranges) in zip(rows, brute.repeated([t for _, t in rows], 400), strict=True))
    for bounds in ({"often": 1, "block": 3, "group": 8}, {"often": 2}, {"block": 5}):
        got = suffixes.digests(pages(spark, rows), **bounds).collect()
        assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == want, bounds


def test_anchors_travel_packed_and_alike(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([10, 390, 400, 700, 5000, 40_000]))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([hashlib.md5(x.encode()).digest() for x in texts])], names=["text", "tid"])
    packed = [x for b in suffixes._anchored(iter([batch]), [400], suffixes.PIECE, 4, 16) for x in b["packed"].to_pylist()]
    assert len(packed) <= 32  # a row for each bucket, none for an anchor
    assert max(map(len, packed)) < 4 * sum(map(len, packed)) / 16  # anchors are the least hashes of many, yet fill all buckets
    rows = np.frombuffer(b"".join(packed), suffixes.ANCHOR)
    want = [(k, s, o, a, b) for t in texts for k, s, o, a, b in zip(*(x.tolist() for x in suffixes.anchors(np.frombuffer(t.encode(), np.uint8), 400)), strict=True)]
    assert sorted(zip(*(rows[c].tolist() for c in ("key", "sig", "o", "lo", "hi")), strict=True)) == sorted(want)


def test_texts_are_brought_to_results_once(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 30 + "some words that all of them have " * 20) for i in range(6)], "doc_id long, text string")
    for out in (suffixes.cleaned(docs, words=51), jaccard.one_of_each(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "Union" not in plan and "BroadcastHashJoin" not in plan
    again = docs.union(docs.limit(1))  # rows equal in id and text are one
    assert jaccard.one_of_each(again).count() == jaccard.one_of_each(docs).count()
