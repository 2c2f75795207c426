"""Quality, language, encoding and packing against held-out labels and the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prosegrain.llm import bpe, common, langid, packing, quality

BYTE, RANKS, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
byte_library, word_library = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
texts = st.text(st.one_of(st.sampled_from("abcdehilnorst  \n\t'.,!|1é"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_are_the_librarys(text):
    packed, decoded = bpe.codec(WORD)(text)
    want = word_library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == want
    assert decoded == word_library.decode(want, skip_special_tokens=False)
    assert np.frombuffer(packing.encoder(BYTE, RANKS)(text), "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts():
    for text in ("a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "  <|endoftext|>"):
        assert np.frombuffer(bpe.codec(WORD)(text)[0], "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.encoder(BYTE, RANKS)(text), "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_whole_vocabulary_is_one_token_each():
    run = bpe.codec(WORD)
    for word in ("the", "running", "internationalization", "aaaaaaaa", "hsss"):
        assert np.frombuffer(run(word)[0], "<u4").tolist() == word_library.encode(word, add_special_tokens=False).ids


def test_digests(spark, awkward):
    rows = awkward.select("doc_id", "text").collect()
    got = bpe.digests(awkward, WORD).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.tokens(awkward.limit(0), WORD).count() == 0


def check_pieces(rows, pieces, capacity=2048):
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity and at & (at - 1) == 0  # nothing is padded
    for d, t in rows:
        ids = byte_library.encode(t or "", add_special_tokens=False).ids + [1]
        own = [p for p in docs[d] if p.doc_tokens == len(ids)]
        assert sum(p.length for p in own) % len(ids) == 0
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_packing(spark, awkward):
    for docs in (awkward, common.table(spark, SF, "documents", "doc_id", "text")):
        rows = docs.select("doc_id", "text").collect()
        check_pieces(rows, packing.pack(docs, BYTE, RANKS, block=20_000).collect())
    assert packing.pack(awkward.limit(0), BYTE, RANKS).count() == 0


def test_cost_balance():
    rng = np.random.default_rng(0)
    pieces = packing.balanced(rng.integers(1, 600, 4000).tolist(), 2048, 4096)
    cost = defaultdict(int)
    for _, _, n, s, _ in pieces:
        cost[s] += n * n
    full = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 2048] if len(cost) < 50 else list(cost.values())
    assert np.percentile(full, 95) < 2.5 * np.percentile(full, 5)


def test_gradient_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    x, u = (a.astype(np.float64) for a in langid.start(3, 2)[:2])
    b, w = rng.integers(0, 5, (6, 4)), rng.normal(size=(6, 4, 3))
    keep = []
    langid.states(b, x.astype(np.float32), u.astype(np.float32), keep)
    dx, du = langid.gradients(b, x, u, keep, w)
    loss = lambda x, u: float((langid.states(b, x.astype(np.float32), u.astype(np.float32)) * w).sum())
    for a, g, i in ((x, dx, (2, 1)), (x, dx, (3, 7)), (u, du, (1, 4)), (u, du, (0, 8))):
        low, high = a.copy(), a.copy()
        low[i] -= 1e-2
        high[i] += 1e-2
        near = (loss(high, u) - loss(low, u) if a is x else loss(x, high) - loss(x, low)) / 2e-2
        assert near == pytest.approx(g[i], abs=5e-3)


def test_language(spark, awkward):
    got = langid.op9_byte_gru(spark, SF).join(common.table(spark, SF, "documents", "doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    model = langid.fit(common.table(spark, SF, "documents", "doc_id", "text", "lang"), langid.learnable())
    odd = {r.doc_id: r for r in langid.label(awkward, model).collect()}
    assert {odd[i].lang_pred for i in (1, 2, 3, 12)} == {"und"} and odd[1].score == 0
    assert langid.label(awkward, langid.fit(awkward.where("false"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_quality(spark, awkward):
    path = "/root/testdata/sf0.01"
    got = quality.op1_quality_network(spark, path).join(common.table(spark, path, "labels", "doc_id", "quality"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    docs = common.table(spark, SF, "documents", "doc_id", "text")
    model = quality.fit(docs, common.table(spark, SF, "labels", "doc_id", "quality"))
    out = quality.scored(awkward, model, "own").collect()
    assert len(out) == awkward.count() and all(0 <= r.own <= 1 for r in out)
    assert len({r.own for r in out if not (r.text or "").strip(" ")}) == 1
    none = quality.fit(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.own for r in quality.scored(awkward, none, "own").collect()} == {0.5}


def test_short_texts_are_learnt_from(spark):
    rows = [(i, f"le chat numero {i:02d}", "fr") for i in range(20)] + [(100 + i, f"the quick brown fox number {i} jumps over the lazy dog and then over the other one, too", "en") for i in range(20)]
    rows += [(200, "", "de"), (201, None, "de"), (202, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, s=langid.Setting(steps=150))
    assert model.labels == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.label(docs, model).collect()}
    assert sum(got[i] == lang for i, t, lang in rows[:40]) >= 38 and got[200] == got[201] == "und"
    assert langid.fit(docs, s=langid.Setting(steps=2, labels=1)).labels == ["en"]  # the most frequent, by name where they tie


def test_several_texts_of_an_id_are_learnt_from_alike(spark):
    docs = common.table(spark, SF, "documents", "doc_id", "text")
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' and more') as text"))
    labels = common.table(spark, SF, "labels", "doc_id", "quality")
    s = quality.Setting(epochs=3)
    a, b = (quality.fit(x, labels, None, s) for x in (twice.coalesce(1), twice.orderBy("text").repartition(5)))
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(a.layers, b.layers, strict=True))
