"""Vector searches and url rules against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrain.llm import curves, topk, urls

QUERY = "vec_id % 10 = 0"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=24))]) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # copies of a query
    rows += [(500, None), (510, [float("nan")] * 24), (520, [None] * 24), (530, [math.inf] + [0.0] * 23), (540, [0.0] * 24), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (None, rows[1][1]), (30, rows[30][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))


def rows_of(table, zero):
    out = {}
    for r in table.collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.setdefault(r.vec_id, np.array(v))
    return out


def brute(rows, score):
    want = set()
    for q, v in rows.items():
        if q % 10 == 0:
            near = sorted((score(v, w), i) for i, w in rows.items() if i != q and len(w) == len(v))[:10]
            want |= {(q, k, i) for k, (_, i) in enumerate(near, 1)}
    return want


def test_exact_products(table):
    rows = {i: np.floor(1024 * v.astype(float)).astype(int) for i, v in rows_of(table, True).items()}
    got = topk.top_products(table, QUERY, tile=64).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == brute(rows, lambda a, b: -int(a @ b))
    assert all(r.score == int(rows[r.query_id] @ rows[r.vec_id]) for r in got)
    assert topk.top_products(table.where("false"), QUERY).count() == 0


def test_large_values_stay_exact(spark):
    t = spark.createDataFrame([(0, [2e6, 1.0]), (1, [2e6, 2.0]), (2, [2e6, 3.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_products(t, QUERY).orderBy("rank").collect()]
    assert got == [(2, 2_048_000_000**2 + 1024 * 3072), (1, 2_048_000_000**2 + 1024 * 2048)]


def test_nearest_of_small_tables_is_exact(table):
    rows = rows_of(table, False)
    got = curves.nearest(table, QUERY).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == brute(rows, lambda a, b: float(np.sqrt(((a.astype(float) - b) ** 2).sum())))
    assert curves.nearest(table.where("false"), QUERY).count() == 0


def test_recall_with_windows(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = rows_of(e, False)
    got = {(r.query_id, r.vec_id) for r in curves.nearest(e, "vec_id % 100 = 0", least=60).collect()}  # as many ranges as in a large table
    ids = np.array(sorted(rows))
    m = np.stack([rows[i] for i in ids]).astype(float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((m - rows[q]) ** 2).sum(1)
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit, total = hit + sum((q, i) in got for i in best), total + 10
    assert hit / total >= 0.9


def test_hilbert_keys_are_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = curves.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)].astype(int), axis=0)).sum(1)
    assert (steps == 1).all()


def test_urls(spark):
    given = [
        ("http://Example.COM/en/x", "example.com/en/", "block"), ("http://www.example.com/en/x?q#f", "www.example.com/en/", "allow"), ("https://a.b.com/", "com/", "allow"),
        ("https://a.b.com", None, "allow"), ("ftp://x.net/es/", "net/es/", "block"), ("//x.net/es/", None, "allow"), (None, None, "allow"), ("", None, "allow"),
        ("http://x.net/EN/casino-win", None, "block"), ("http://casinos.org/", None, "allow"), ("http://free-bets.org/", None, "block"), ("http://notexample.com/en/", "com/", "allow"),
        ("x://net/fr/a", "net/fr/", "block"), ("a://b://com/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, (u, _, _) in enumerate(given)] * 2, "page_id long, url string, host string")
    got = urls.judge(pages, urls.rules()).collect()
    assert len(got) == 2 * len(given)
    for r in got:
        assert (r.rule, r.verdict) == given[r.page_id][1:], (given[r.page_id], r)
    assert urls.judge(pages.limit(0), urls.rules()).count() == 0


def test_rules_by_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://site{i}.example.com/common/") for i in range(20)] + [(20 + i, "http://other.example.com/") for i in range(3)], "page_id long, url string")
    rule = urls.Rule("block", "r", "||example.com/common^", True)
    index = urls.rarest(pages, [rule, urls.Rule("block", "any", "*x*")])
    assert sorted(index) == ["", "common"]
    assert rule.tokens() == ["example", "com", "common"]


def test_patterns_decide_as_all_expressions_would(spark):
    import random
    import re

    rng = random.Random(2)
    parts = ["ads", "Ad", "banner12", "banners", "x", "casino-win", "sex-shop", "click?a=1&url=b", "crack-free-download", "pixel.gif", "track", "setup.exe", "setup.exes", "calendar", "2024", "checkout", "jsessionid", "-", ".", "/", "?", "&", "sort=a", "_", "AFF_ID=7"]
    hosts = ["www.ads.org", "adserver.example.org", "m.casinos.org", "example.org:80", "porn4u.de", "cheap-good-meds.info", "EXAMPLE.org"]
    given = [f"http://{rng.choice(hosts)}/" + "".join(rng.choice(parts) + rng.choice(["", "/", "?", "&"]) for _ in range(rng.randrange(6))) for _ in range(600)]
    given += ["http://a.org/" + "long" * 50_000 + "/ads/", "http://a.org/" + "long" * 50_000, None]
    rules = urls.rules()
    pages = spark.createDataFrame([(i if i % 50 else None, u) for i, u in enumerate(given)], "page_id long, url string")

    def plain(url):
        host, path, query = urls.parts(url)
        low = host + (path + query).translate(urls._LOWER)
        named = [r for r in rules if r.named and re.search(r.regex(), host + path, re.S)]
        if named:
            return max(named, key=lambda r: len(r.text)).verdict
        return "block" if any(re.search(r.regex(), low, re.S) for r in rules if not r.named) else "allow"

    got = sorted((str(r.page_id), r.verdict) for r in urls.judge(pages, rules).collect())
    want = sorted((str(i if i % 50 else None), plain(u)) for i, u in enumerate(given))
    assert got == want and {v for _, v in want} == {"allow", "block"}
