"""Queries on windows, entropies, diversity and density (D)."""

from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.dims import fixed
from prosegrain.operators import detect, split, windows
from prosegrain.plans.catalog import cte, jr, jr0, q, query

W = "doc_id, size, start_sentence"


def ent(sub: str, by: str, name: str = "entropy") -> str:
    """SQL of the entropy of counts ``n`` per group."""
    return f"SELECT {by}, {jr('sum(CASE WHEN n > 0 THEN -(n / t) * log2(n / t) ELSE 0.0 END)', 3)} AS {name} FROM (SELECT *, sum(n) OVER (PARTITION BY {by})::DOUBLE AS t FROM ({sub})) GROUP BY {by}"


def ratio(a: str, b: str, k: int = 3) -> str:
    return f"(CASE WHEN {b} > 0 THEN floor({a}::DOUBLE / {b}::DOUBLE * {10**k}.0 + 0.5) / {10**k}.0 ELSE 0.0 END)"


def autocorr(n, s, sq, p, a, z):
    num = f"({n} * {p} - {s} * (2.0::DOUBLE * {s} - {a} - {z}) + ({n} - 1) * {s} * {s} / {n})"
    den = f"({n} * {sq} - {s} * {s})"
    return f"CASE WHEN {n} < 3 OR {den} <= 0 THEN 0.0 ELSE floor({num} / {den} * 1000.0 + 0.5) / 1000.0 END"


def autocorr_sql(table: str, by: str, order: str) -> str:
    return f"""SELECT {by}, {autocorr('n', 's', 'sq', 'p', 'a', 'z')} AS autocorrelation FROM (
  SELECT {by}, count(*)::DOUBLE AS n, sum(v)::DOUBLE AS s, sum(v * v)::DOUBLE AS sq, coalesce(sum(v * nx), 0.0)::DOUBLE AS p, arg_min(v, o) AS a, arg_max(v, o) AS z FROM (
    SELECT {by}, word_count::DOUBLE AS v, {order} AS o, lead(word_count::DOUBLE) OVER (PARTITION BY {by} ORDER BY {order}) AS nx FROM {table}) GROUP BY {by})"""


@query("d01_rolling_windows", f"SELECT {W}, end_sentence, word_count FROM rolling")
def _(t):
    return t.rolling


cte("wtypes", "SELECT w.doc_id, w.size, w.start_sentence, w.end_sentence, w.word_count, h.type, sum(h.confidence::DECIMAL(18,6))::DOUBLE AS conf, count(*) AS n FROM rolling w JOIN hits h ON h.doc_id = w.doc_id AND h.sent_id BETWEEN w.start_sentence AND w.end_sentence GROUP BY ALL")
_dens = "(" + ", ".join(q(x) for x in fixed.DENSITY_PATTERNS) + ")"


@query("d02_pattern_density", f"SELECT {W}, 25::BIGINT AS n_types, type, {jr0('conf * (100.0::DOUBLE / word_count)', 2)} AS density FROM wtypes WHERE type IN {_dens} AND {jr0('conf * (100.0::DOUBLE / word_count)', 2)} > 0", once=True)
def _(t):
    d = windows.pattern_density(t.rolling, t.hits)
    d = d.select("doc_id", "size", "start_sentence", F.size("density").cast("bigint").alias("n_types"), F.explode("density").alias("type", "density"))
    return d.filter("density > 0")


_dom = "CASE " + " ".join(f"WHEN {d} = greatest({', '.join(fixed.REGISTERS)}) THEN '{d}'" for d in fixed.REGISTERS) + " END"
cte("scored", "SELECT doc_id, sent_id, paragraph_id, word_count, arc_role, CASE WHEN word_count > 25 THEN 0.7 ELSE 0.62 END::DOUBLE AS informational, CASE WHEN word_count < 6 THEN 0.9 ELSE 0.1 END::DOUBLE AS involved, narrative, persuasive, CASE WHEN clause_count > 3 THEN 0.8 ELSE abstract END::DOUBLE AS abstract, elaborative FROM feats")


def scored(t):
    """Register scores that vary with the sentence, so that the dominant one does too."""
    return t.feats.withColumns({
        "informational": F.when(F.col("word_count") > 25, 0.7).otherwise(0.62),
        "involved": F.when(F.col("word_count") < 6, 0.9).otherwise(0.1),
        "abstract": F.when(F.col("clause_count") > 3, 0.8).otherwise(F.col("abstract")),
    })


@query("d03_register_entropy", ent(f"SELECT doc_id, {_dom} AS d, count(*) AS n FROM scored GROUP BY ALL", "doc_id"))
def _(t):
    return windows.register_entropy(scored(t), ["doc_id"])


@query("d04_length_entropy", ent("SELECT doc_id, word_count // 5 * 5 AS bin, count(*) AS n FROM sents GROUP BY ALL", "doc_id"))
def _(t):
    return windows.length_entropy(t.sents, ["doc_id"])


@query("d05_entropy", ent("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL", "source"))
def _(t):
    return windows.entropy(t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), ["source"])


@query("d06_device_entropy", ent("SELECT doc_id, type, count(*) AS n FROM hits GROUP BY ALL", "doc_id"))
def _(t):
    return windows.device_entropy(t.hits, ["doc_id"])


@query("d07_autocorrelation", autocorr_sql("sents", "doc_id", "sent_id"))
def _(t):
    return windows.autocorrelation(t.sents, ["doc_id"], "sent_id", "word_count")


@query("d08_co_occurrence", "SELECT doc_id, a.type AS type_a, b.type AS type_b, count(*) AS n FROM hits a JOIN hits b USING (doc_id, sent_id) WHERE a.type < b.type GROUP BY ALL")
def _(t):
    return windows.co_occurrence(t.hits, ["doc_id"])


_fw = "(" + ", ".join(q(w) for w in fixed.FUNCTION_WORDS) + ")"
_LETTERS = "len(regexp_replace(word, '[^a-zA-Z]', '', 'g'))"


def diversity(table: str, by: str) -> str:
    return f"""SELECT {by}, n::BIGINT AS n_tokens, d::BIGINT AS n_types, {ratio('d', 'n')} AS ttr, {ratio('h', 'n')} AS hapax_ratio, {ratio('f', 'n')} AS function_word_ratio, coalesce(e, 0.0) AS word_length_entropy FROM (
  SELECT {by}, sum(c) AS n, count(*) AS d, count(*) FILTER (WHERE c = 1) AS h, coalesce(sum(c) FILTER (WHERE word IN {_fw}), 0) AS f FROM (SELECT {by}, word, count(*) AS c FROM {table} GROUP BY ALL) GROUP BY {by})
  LEFT JOIN (SELECT {by}, {jr('sum(-(k / t) * log2(k / t))', 3)} AS e FROM (SELECT {by}, l, k, sum(k) OVER (PARTITION BY {by})::DOUBLE AS t FROM (SELECT {by}, {_LETTERS} AS l, count(*) AS k FROM {table} GROUP BY ALL)) WHERE l > 0 GROUP BY {by}) USING ({by})"""


@query("d09_lexical_diversity", diversity("tok", "doc_id"))
def _(t):
    return windows.lexical_diversity(t.tokens, ["doc_id"])


_MATTR = """SELECT doc_id, CASE WHEN n <= 50 THEN floor(d::DOUBLE / n * 1000.0 + 0.5) / 1000.0 ELSE floor(s::DOUBLE / (50 * (n - 49)) * 1000.0 + 0.5) / 1000.0 END AS mattr FROM (
  SELECT doc_id, any_value(n) AS n, count(*) FILTER (WHERE prev < 0) AS d, sum(greatest(0, least(pos, n - 50) - greatest(prev + 1, pos - 49, 0) + 1)) AS s FROM (
    SELECT doc_id, word, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos), -1) AS prev, count(*) OVER (PARTITION BY doc_id) AS n FROM tok) GROUP BY doc_id)"""
cte("mattrs", _MATTR)


@query("d10_mattr", "SELECT * FROM mattrs")
def _(t):
    return windows.mattr(t.tokens)


@query("d11_hapax_by_source", diversity("(SELECT source, unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM mdocs)", "source"))
def _(t):
    tok = t.docs_src.select("source", F.explode(split.X.words(F.lower("text"))).alias("word"))
    return windows.lexical_diversity(tok, ["source"])


@query("d12_word_length_entropy", f"SELECT doc_id, word_length_entropy FROM ({diversity('tok', 'doc_id')})")
def _(t):
    n = windows.X.words(F.col("text"))
    return t.docs.select("doc_id", windows.X.entropy_of(windows.word_length_counts(n), F.size(n)).alias("word_length_entropy"))


_OPEN = r"array_to_string([regexp_replace(lower(w), '[^a-z]', '', 'g') FOR w IN regexp_extract_all(text, '\S+')[1:3]], ' ')"


@query("d13_opening_variety", f"SELECT doc_id, CASE WHEN n <= 1 THEN 1.0 ELSE {ratio('d', 'n')} END AS opening_variety FROM (SELECT doc_id, count(*) AS n, count(DISTINCT {_OPEN}) AS d FROM sents GROUP BY doc_id)")
def _(t):
    return windows.opening_variety(t.sents, ["doc_id"])


@query("d14_function_word_ratio", f"SELECT doc_id, sent_id, {ratio('f', 'n')} AS function_word_ratio FROM (SELECT doc_id, sent_id, count(*) AS n, count(*) FILTER (WHERE word IN {_fw}) AS f FROM stok GROUP BY ALL)")
def _(t):
    ws = windows.X.words(F.lower("text"))
    f = F.size(F.filter(ws, lambda w: w.isin(fixed.FUNCTION_WORDS)))
    return t.sents.select("doc_id", "sent_id", windows.X.ratio(f, F.size(ws)).alias("function_word_ratio"))


cte("wdev", f"SELECT w.*, coalesce(e.device_entropy, 0.0) AS device_entropy FROM rolling w LEFT JOIN ({ent('SELECT doc_id, size, start_sentence, type, n FROM wtypes', W, 'device_entropy')}) e USING (doc_id, size, start_sentence)")
cte("conv", f"SELECT doc_id, CASE WHEN n < 2 THEN 0.0 ELSE {jr('(n * sxy - sx * sy) / (n * sxx - sx * sx)', 4)} END AS convergence_slope FROM (SELECT doc_id, count(*)::DOUBLE AS n, sum(i)::DOUBLE AS sx, sum(y::DECIMAL(18,6))::DOUBLE AS sy, sum((i * y)::DECIMAL(18,6))::DOUBLE AS sxy, sum(i * i)::DOUBLE AS sxx FROM (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_sentence) - 1)::DOUBLE AS i, device_entropy AS y FROM wdev WHERE size = 'medium') GROUP BY doc_id)")


@query("d15_convergence", "SELECT * FROM conv", once=True)
def _(t):
    return windows.convergence(windows.window_device_entropy(t.rolling, t.hits))


def tolerance_sql(genre: str) -> str:
    rows = [f"({q(r[0])}, {r[7][genre]}::DOUBLE)" for r in fixed.REGISTRY if genre in r[7]]
    return ", ".join(rows)


_lim = ", ".join(f"({q(a)}, {b}, {c}::DOUBLE, {q(d)})" for a, b, c, d in fixed.DENSITY_THRESHOLDS)
cte("limits", f"SELECT l.*, coalesce(g.tol, 1.0) AS tol, CASE r.level WHEN 'lexical' THEN 'narrow' WHEN 'document' THEN 'wide' ELSE 'medium' END AS size FROM (VALUES {_lim}) l(type, window_words, max_count, unit) LEFT JOIN registry r USING (type) LEFT JOIN (VALUES {tolerance_sql('marketing')}) g(type, tol) USING (type)")
cte("viol", f"""SELECT doc_id, type, size, start_sentence, end_sentence, word_count, conf AS total, {jr0('allowed', 3)} AS max_allowed FROM (
  SELECT w.*, CASE WHEN tol = 0 THEN 0.0 ELSE max_count * tol * (word_count / CASE WHEN unit = 'per_1000_words' THEN 1000.0::DOUBLE ELSE greatest(1, window_words)::DOUBLE END) END AS allowed FROM wtypes w JOIN limits l USING (type, size)) WHERE conf > allowed + 1e-6""")


def violations(t):
    return windows.density_violations(t.rolling, t.hits, dims.thresholds(t.spark), t.registry, "marketing")


@query("d16_density_violations", "SELECT * FROM viol", once=True)
def _(t):
    return violations(t)


@query("d17_violation_counts", "SELECT doc_id, type, count(*) AS violations FROM viol GROUP BY ALL", once=True)
def _(t):
    return windows.violation_counts(violations(t))


@query("d18_word_windows", "SELECT doc_id, window_id, count(*) AS n, count(DISTINCT word) AS types, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM (SELECT doc_id, word, pos, unnest(generate_series(CASE WHEN pos < 200 THEN 0 ELSE (pos - 200) // 100 + 1 END, pos // 100)) AS window_id FROM tok) GROUP BY ALL")
def _(t):
    w = windows.word_windows(t.tokens, *fixed.WORD_WINDOWS["lexical"])
    return w.select("doc_id", "window_id", F.col("n").cast("bigint").alias("n"), "types", "first_pos", "last_pos")


cte("islands", "SELECT doc_id, g, min(sent_id) AS start_sentence, max(sent_id) AS end_sentence, count(*) AS n, sum(heat::DECIMAL(18,6))::DOUBLE / count(*) AS avg FROM (SELECT doc_id, sent_id, heat, sent_id - row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS g FROM hot WHERE heat >= 2) GROUP BY doc_id, g HAVING count(*) >= 2")
cte("regions", f"""SELECT r.doc_id, start_sentence, end_sentence, {jr('avg', 1)} AS heat, coalesce(p.types, '') AS primary_patterns,
  CASE WHEN {jr('avg', 9)} >= 7 THEN 'High' WHEN {jr('avg', 9)} >= 5 THEN 'Moderate' ELSE 'Mild' END || ' structural clustering across ' || n || ' sentences: ' || CASE WHEN coalesce(p.names, '') = '' THEN 'general uniformity' ELSE p.names END AS description
  FROM islands r LEFT JOIN (SELECT doc_id, start_sentence, string_agg(type, ',' ORDER BY k) AS types, string_agg(name, ', ' ORDER BY k) AS names FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, start_sentence ORDER BY c DESC, o1, o2) AS k FROM (
      SELECT i.doc_id, i.start_sentence, h.type, coalesce(max(g.name), replace(h.type, '_', ' ')) AS name, count(*) AS c, min(h.sent_id) AS o1, arg_min(h.hit_pos, h.sent_id) AS o2
      FROM islands i JOIN hits h ON h.doc_id = i.doc_id AND h.sent_id BETWEEN i.start_sentence AND i.end_sentence LEFT JOIN registry g ON g.type = h.type GROUP BY i.doc_id, i.start_sentence, h.type)) WHERE k <= 3 GROUP BY doc_id, start_sentence) p USING (doc_id, start_sentence)""")


def regions(t):
    return windows.hot_regions(t.hot, t.hits, t.registry, threshold=2.0)


@query("d19_hot_regions", "SELECT * FROM regions", once=True)
def _(t):
    return regions(t).withColumn("primary_patterns", F.array_join("primary_patterns", ","))


@query("d20_hot_singles", "SELECT doc_id, sent_id, heat FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS n FROM rheat WHERE heat >= 2.2) WHERE n <= 4")
def _(t):
    return windows.hot_singles(detect.rule_heat(detect.classify_rules(t.sents)))


# Every measure of every window, from the window's own sentences.
cte("wtok", "SELECT doc_id, size, start_sentence, unnest(regexp_extract_all(text, '\\S+')) AS raw FROM members")
cte("wcnt", "SELECT doc_id, size, start_sentence, lower(raw) AS word, count(*) AS c FROM wtok GROUP BY ALL")
cte("wlex", f"SELECT {W}, sum(c) AS n, count(*) AS d, count(*) FILTER (WHERE c = 1) AS h, coalesce(sum(c) FILTER (WHERE word IN {_fw}), 0) AS f FROM wcnt GROUP BY ALL")
cte("wlen", f"SELECT {W}, {jr('sum(-(k / t) * log2(k / t))', 3)} AS e FROM (SELECT {W}, l, k, sum(k) OVER (PARTITION BY {W})::DOUBLE AS t FROM (SELECT {W}, {_LETTERS} AS l, sum(c) AS k FROM wcnt GROUP BY ALL)) WHERE l > 0 GROUP BY {W}")
cte("wlene", ent(f"SELECT {W}, word_count // 5 * 5 AS bin, count(*) AS n FROM members GROUP BY ALL", W))
cte("wauto", autocorr_sql("members", W, "sent_id"))
cte("wopen", f"SELECT {W}, CASE WHEN n <= 1 THEN 1.0 ELSE {ratio('d', 'n')} END AS v FROM (SELECT {W}, count(*) AS n, count(DISTINCT {_OPEN}) AS d FROM members GROUP BY ALL)")
cte("wreg", ent(f"SELECT m.doc_id, m.size, m.start_sentence, {_dom} AS d, count(*) AS n FROM members m JOIN scored s USING (doc_id, sent_id) GROUP BY ALL", W))


@query(
    "d21_window_metrics",
    f"""SELECT w.doc_id, w.size, w.start_sentence, w.end_sentence, w.word_count, wreg.entropy AS register_entropy, wlene.entropy AS length_entropy, w.device_entropy, wauto.autocorrelation,
  {ratio('wlex.d', 'wlex.n')} AS ttr, {ratio('wlex.h', 'wlex.n')} AS hapax_ratio, coalesce(wlen.e, 0.0) AS word_length_entropy, wopen.v AS opening_variety, {ratio('wlex.f', 'wlex.n')} AS function_word_ratio
  FROM wdev w JOIN wlex USING ({W}) JOIN wlene USING ({W}) JOIN wauto USING ({W}) JOIN wopen USING ({W}) JOIN wreg USING ({W}) LEFT JOIN wlen USING ({W})""",
    once=True,
)
def _(t):
    s = scored(t).select("doc_id", "sent_id", "text", "word_count", *fixed.REGISTERS)
    return windows.window_metrics(t.rolling, s, t.hits)
