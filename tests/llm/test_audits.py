"""Source divergence, secret ledger and fill-in-middle against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegrain.llm import common, divergence, infill, secrets

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_audit(rows, least=3, most=200):
    groups, terms, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        terms[lang or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang in terms:
        kept = [w for w, n in seen[lang].items() if n >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        own = {s: share(c) for (x, s), c in groups.items() if x == lang}
        q = share(terms[lang])
        for s, p in own.items():
            pairs = [(o, sum((p[w] - r[w]) ** 2 // r[w] for w in kept)) for o, r in own.items() if o != s]
            there = [(w, (p[w] - q[w]) ** 2 // q[w]) for w in kept if groups[lang, s][w] and p[w] > q[w]]
            for part, items in (("pair", pairs), ("term", there)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < most]
    return sorted(out)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "ßa", "😀", "don't", "x9y", "ZEBRA", "zebra", *(f"{a}{b}" for a in "abcd" for b in "efgh")]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(30)))])
    return [(text(), rng.choice([None, "", "en", "en", "fr"]), rng.choice([None, "a", "a", "a", "b", "ç", "d"])) for _ in range(n)] + [("one 1", "de", "a"), (None, "de", "b"), ("", "de", None)]


def test_divergence_is_that_of_a_plain_count(spark, monkeypatch):
    for seed, n, bounds in ((1, 90, {}), (2, 200, {"HELD": 8, "PAIRS": 5})):
        for name, value in bounds.items():
            monkeypatch.setattr(divergence, name, value)
        rows = prose(seed, n)
        docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
        assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(rows)
    assert sorted(map(tuple, divergence.audit(docs, least=1, most=3).collect())) == plain_audit(rows, 1, 3)


def test_divergence_of_awkward_rows(spark, awkward):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    assert sorted(map(tuple, divergence.audit(awkward).collect())) == plain_audit(rows)
    assert divergence.audit(awkward.limit(0)).count() == 0
    many = spark.range(400).selectExpr("concat('common ', if(id % 7 = 0, 'seven', 'other')) as text", "'en' as lang", "concat('s', id % 40) as source")
    assert sorted(map(tuple, divergence.audit(many).collect())) == plain_audit([tuple(r) for r in many.collect()])


def test_shards_batch_by_batch():
    import pyarrow as pa

    rows = [("en", s, t, 10**8 + 7 * i + 31 * j, 5, 10**8 + 3) for i, t in enumerate(["a", "b", "c"]) for j, s in enumerate(["x", "y", "z"])]
    batch = pa.RecordBatch.from_pylist([dict(zip(["lang", "source", "term", "p", "p0", "q"], r, strict=True)) for r in rows])
    whole = pa.Table.from_batches(list(divergence._diverging(iter([batch]), 200))).sort_by([(c, "ascending") for c in ("part", "source", "item")])
    for size in (1, 2, 4):
        cut = [batch.slice(i, size) for i in range(0, len(rows), size)]
        assert pa.Table.from_batches(list(divergence._diverging(iter(cut), 200))).sort_by([(c, "ascending") for c in ("part", "source", "item")]).to_pylist() == whole.to_pylist()


RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    "private": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, bool), "web": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, bool),
    "hub": (r"gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}", 0, bool), "login": (r"://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", re.A, bool),
}


def plain_secrets(text):
    found = []
    for place, (kind, (regex, flags, good)) in enumerate(RULES.items()):
        # only A-Z and a-z are letters of either case
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(regex, text or "", flags) if good(m)]
    return [x[2] for x in sorted(found)]


def leaks(n):
    rng = random.Random(6)
    parts = [
        "token", "PassWord", "api_key", "APIKEY", "secret", ":", "=", " ", "  ", '"', "'", "abc123", "x/y+z==", "é😀", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef",
        "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIiOi1.abcdefgh12", "ghp_" + "a1B2" * 9, "https://me:pw1@host", "\n", "K", "ſecret=abcdef",
    ]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(n)]


def listed(rows):
    return {r.doc_id: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.found) for r in rows}


def test_secrets(spark, awkward, tmp_path):
    rows = leaks(600) + [(1000, None), (1001, ""), (1002, "a" * 100_000), (1003, "token = " + "x" * 100_000), (1004, 'token = "' + "ab12" * 10 + '" é')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digests(docs, secrets.Ledger(spark, str(tmp_path / "a"))).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        want = plain_secrets(t)
        base = [x for x in want if x.split(":")[0] in secrets.BASE]
        assert (got[d].spans, got[d].base_sha256) == (",".join(want), hashlib.sha256(",".join(base).encode()).hexdigest()), t
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in secrets.BASE)
    odd = secrets.scan(awkward, secrets.Ledger(spark, str(tmp_path / "b")))
    assert odd.columns == [*awkward.columns, "found"] and odd.count() == awkward.count()
    assert secrets.scan(awkward.limit(0), secrets.Ledger(spark, str(tmp_path / "b"))).count() == 0
    clash = docs.select(docs.doc_id.alias("blob"), docs.text.alias("due"), docs.text.alias("found_in"), docs.text.alias("version"))
    assert secrets.scan(clash, secrets.Ledger(spark, str(tmp_path / "b")), text="due").count() == len(rows)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    versions = [("a", 1, "token = abcdef1"), ("a", 2, "token = abcdef2"), ("b", 1, "token = abcdef1"), ("c", 1, "nothing"), ("c", 2, "AKIA" + "B" * 16)]
    first = spark.createDataFrame(versions[:3], "path string, commit int, text string")
    every = spark.createDataFrame(versions, "path string, commit int, text string")
    ledger = secrets.Ledger(spark, str(tmp_path / "l"))
    rules = secrets.RULES[:2]

    def blobs(name):
        return spark.read.parquet(f"{ledger.path}/{name}").count()

    scanned = lambda: sum(len(r.rules) for r in spark.read.schema(ledger.SCANS).parquet(f"{ledger.path}/scans").collect())
    secrets.scan(first, ledger, rules=rules).collect()
    assert (blobs("scans"), scanned(), blobs("findings")) == (2, 4, 2)  # equal texts are one blob
    found = {(r.path, r.commit): [s.kind for s in r.found] for r in secrets.scan(every, ledger, rules=rules).collect()}
    assert found == {("a", 1): ["assign"], ("a", 2): ["assign"], ("b", 1): ["assign"], ("c", 1): [], ("c", 2): ["access"]}
    assert (blobs("scans"), scanned(), blobs("findings")) == (4, 8, 3)
    again = secrets.scan(every, ledger, rules=rules).collect()
    assert scanned() == 8 and len(again) == 5
    changed = (rules[0], secrets.Rule("access", r"AKIA[A-Z0-9]{4}", 1, 0, ("akia",)))  # another version of one rule
    later = {(r.path, r.commit): [(s.kind, s.end) for s in r.found] for r in secrets.scan(every, ledger, rules=changed).collect()}
    assert scanned() == 12 and later["c", 2] == [("access", 8)] and later["b", 1] == [("assign", 15)]
    ledger.add(spark.createDataFrame([], "blob string, fresh array<string>, found array<struct<rule:string,kind:string,start:int,end:int>>"))
    # a delivery that stopped between findings and scans leaves findings twice; they are read once
    twice = secrets.Ledger(spark, str(tmp_path / "m"))
    secrets.scan(first, twice, rules=rules).collect()
    spark.read.parquet(f"{twice.path}/findings").write.mode("append").parquet(f"{twice.path}/findings2")
    spark.read.parquet(f"{twice.path}/findings2").write.mode("append").parquet(f"{twice.path}/findings")
    assert {len(r.found) for r in secrets.scan(first, twice, rules=rules).collect()} == {1}


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill(spark, awkward):
    rng = random.Random(9)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "é", "😀", "<", "<P", "<S>", "P>", " ", "\x85", "word", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(700)] + [(None, "no id here"), (None, None), (-5, "x y z " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = infill.infilled(docs).withColumn("back", infill.restored())
    got = sorted(out.collect(), key=str)
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(str(plain_infill(*r)) for r in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    odd = infill.digests(awkward).collect()
    want = [plain_infill(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((str(r.doc_id), r.output_sha256) for r in odd) == sorted((str(w[0]), hashlib.sha256(w[5].encode()).hexdigest()) for w in want)
    assert infill.digests(awkward.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300), st.data())
def test_ranks(symbols, data):
    wave = infill.Wavelet(np.array(symbols, np.uint8))
    at = np.array(data.draw(st.lists(st.integers(0, len(symbols)), min_size=1, max_size=5)))
    for s in range(8):
        assert wave.rank(s, at).tolist() == [symbols[:i].count(s) for i in at]


@pytest.mark.parametrize("name,sql,run", [("op11", divergence.OP11_SQL, divergence.op11_source_divergence), ("op12", secrets.OP12_SQL, secrets.op12_secret_ledger), ("op13", infill.OP13_SQL, infill.op13_fill_in_middle)])
def test_sql_agrees(spark, name, sql, run):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(sql)
    out = run(spark, SF)
    assert out.columns == [d[0] for d in cur.description]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, cur.fetchall()))


def test_sql_finds_planted_secrets(spark, tmp_path):
    rows = leaks(300)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = secrets.digests(spark.createDataFrame(rows, "doc_id long, text string"), secrets.Ledger(spark, str(tmp_path / "l")))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(secrets.OP12_SQL).fetchall())
    assert common.scratch(spark)
