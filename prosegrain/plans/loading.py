"""Queries on sources, lexicon building, model output, sinks and reports (A)."""

from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.operators import profile
from prosegrain.plans.catalog import cte, query
from prosegrain.plans.profiles import classified
from prosegrain.plans.rolling import regions
from prosegrain.sources import corpus, lexicon as L, model_output as M, report, rich_text
from prosegrain.streaming.stream import scratch


@query("a01_read_corpus", r"SELECT doc_id, text, source FROM documents WHERE regexp_matches(text, '\S')")
def _(t):
    return corpus.read_corpus(t.spark, f"{t.path}/documents.parquet").select("doc_id", "text", "source")


_flat = r"SELECT doc_id, [p FOR p IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(text, chr(10))] IF p <> ''] AS ps FROM documents"


@query("a03_flatten_rich_text", f"SELECT doc_id, array_to_string(ps, chr(10) || chr(10)) AS text FROM ({_flat})")
def _(t):
    """Lines as paragraphs, every second one as a nested list item cut into two text nodes."""
    line = lambda x: F.concat(F.lit('{"type":"text","text":'), _quote(x), F.lit("}"))
    leaf = lambda x: F.concat(F.lit('{"type":"paragraph","content":['), line(F.substring(x, 1, 5)), F.lit(","), line(F.substring(x, 6, 1 << 30)), F.lit("]}"))
    nested = lambda x: F.concat(F.lit('{"type":"bulletList","content":[{"type":"listItem","content":['), leaf(x), F.lit("]}]}"))
    nodes = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, leaf(x)).otherwise(nested(x)))
    tree = F.concat(F.lit('{"type":"doc","content":['), F.array_join(nodes, ","), F.lit("]}"))
    return rich_text.flatten_rich_text(t.documents.select("doc_id", tree.alias("tree")))


def _quote(x):
    """A string as JSON text."""
    j = F.to_json(F.array(x))
    return F.substring(j, F.lit(2), F.length(j) - 2)


@query("a04_load_dims", "SELECT d.source, r.level, count(*) AS n, sum((r.weight * 10)::BIGINT)::BIGINT AS weight10 FROM documents d JOIN registry r ON r.playbook = d.doc_id % 2 GROUP BY ALL")
def _(t):
    r = dims.load_dims(t.spark)["patterns"]
    d = t.documents.select("source", (F.col("doc_id") % 2).cast("int").alias("playbook"))
    return d.join(r, "playbook").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("weight") * 10).cast("bigint")).alias("weight10"))


# ---------------------------------------------------------------- lexicon

_RAW = """doc_id AS id, source AS category, lang || (doc_id % 4) AS subcategory,
  substr(CASE WHEN doc_id % 5 = 0 THEN 'Label: ' WHEN doc_id % 5 = 1 THEN '“' ELSE '"' END || w1 || ' ' || w2 || '" / "' || w3 || CASE WHEN doc_id % 7 = 0 THEN ' X' WHEN doc_id % 7 = 1 THEN ' [slot' ELSE '' END || '" / ' || w4 || CASE WHEN doc_id % 3 = 0 THEN ' (a note)' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' and much more of the same kind / more' ELSE '' END, 1, 50) AS phrase,
  CASE doc_id % 3 WHEN 0 THEN 'strong contextual' WHEN 1 THEN 'moderate' ELSE 'weak' END AS signal,
  CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS fp_risk,
  substr(CASE WHEN doc_id % 3 = 0 THEN '"Beyond ' || w1 || '," "Extending ' || w2 || '," "The same ' || w3 || ' as before"' WHEN doc_id % 3 = 1 THEN w1 || ' (plain / simple) / ' || w2 || ' / a longer way to say ' || w3 || ' (with' ELSE w4 END, 1, 60) AS replacement,
  substr('tech marketing, academic ' || w1 || ', code docs, news', 1, 40) AS genres"""
# Whole texts: each group of four words is an entry of its own.
ENTRIES = 1_000_000  # more than the groups of any text
cte("lexraw", rf"""SELECT {_RAW} FROM (SELECT doc_id * {ENTRIES} + g AS doc_id, source, lang, coalesce(ws[4 * g + 1], 'a') AS w1, coalesce(ws[4 * g + 2], 'b') AS w2, coalesce(ws[4 * g + 3], 'c') AS w3, coalesce(ws[4 * g + 4], 'd') AS w4
  FROM (SELECT *, unnest(range(greatest(1, (len(ws) + 3) // 4))) AS g FROM (SELECT doc_id, source, lang, [regexp_replace(w, '[^A-Za-z]', '', 'g') FOR w IN regexp_extract_all(text, '\S+')] AS ws FROM documents)))""")


def lexraw(t):
    # The words are a column of their own: a lambda would cut the whole text again for each of its entries.
    ws = F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    d = t.documents.select("doc_id", "source", "lang", ws.alias("ws"))
    last = F.greatest(F.lit(0), F.floor((F.size("ws") + 3) / 4).cast("int") - 1)
    word = lambda g, i: F.coalesce(F.get("ws", g * 4 + i), F.lit("abcd"[i])).alias(f"w{i + 1}")
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.struct(*(word(g, i) for i in range(4))))
    d = d.select("doc_id", "source", "lang", F.posexplode(groups).alias("g", "w")).select((F.col("doc_id") * ENTRIES + F.col("g")).alias("doc_id"), "source", "lang", "w.*")
    from prosegrain.plans.libraries import _split

    return d.selectExpr(*[x.strip() for x in _split(_RAW)])


_sq = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_st = lambda x: f"translate({x}, '“”‘’', '\"\"''''')"
_ct = lambda x, ch: f"(len({x}) - len(replace({x}, '{ch}', '')))"
cte("lexc1", rf"SELECT *, regexp_replace({_st('phrase')}, '\s*\([^)]*(\)|$)', '', 'g') AS tx FROM lexraw")
cte("lexc2", f"SELECT *, [a FOR a IN [{_sq('replace(x, chr(34), ' + chr(39) + chr(39) + ')')} FOR x IN string_split(tx, ' / ')] IF a <> ''] AS a0 FROM lexc1")
cte("lexc3", "SELECT *, CASE WHEN len(phrase) >= 50 AND len(a0) > 1 THEN a0[1:len(a0) - 1] ELSE a0 END AS a1 FROM lexc2")
cte("lexc4", f"SELECT *, len(phrase) >= 50 AND len(a1) <= 1 AND {_ct('tx', chr(34))} % 2 = 1 AS cut, [a FOR a IN a1 IF {_ct('a', '[')} = {_ct('a', ']')}] AS alternatives FROM lexc3")
_pl = lambda x: _sq(rf"regexp_replace({_st(x)}, '^\s*\"+|\"+\s*$', '', 'g')")
_op = rf"regexp_replace({_pl('replacement')}, '\s*\([^)]*$', '')"
cte("lexc", rf"""SELECT id, category, subcategory, array_to_string(alternatives, ' / ') AS phrase, alternatives, CASE WHEN regexp_matches(lexc4.phrase, '^[A-Z][^:]{{3,40}}: ') THEN [] ELSE [a FOR a IN alternatives IF NOT regexp_matches(a, '\b[XYZ]\b')] END AS matchable, signal, fp_risk,
  len(alternatives) = 0 OR cut AS truncated, CASE WHEN signal = 'weak' OR fp_risk IN ('high', 'unknown') THEN 'watch' WHEN signal = 'strong contextual' THEN 'strong' ELSE 'moderate' END AS tier,
  CASE WHEN starts_with(replacement, '"') THEN array_to_string([trim(x) FOR x IN regexp_extract_all(replacement, '"([^"]+)"', 1) IF trim(x) <> ''], ' / ') WHEN len(replacement) < 60 THEN {_pl('replacement')} WHEN contains({_op}, ' / ') THEN trim(regexp_extract({_op}, '^(.*) / ', 1)) ELSE trim({_op}) END AS replacement,
  CASE WHEN starts_with(replacement, '"') THEN false ELSE len(replacement) >= 60 AND NOT contains({_op}, ' / ') END AS replacement_truncated,
  trim(CASE WHEN len(genres) >= 40 AND contains(genres, ', ') THEN regexp_extract(genres, '^(.*), ', 1) ELSE genres END) AS genres FROM lexc4""")


@query("a05_build_lexicon", "SELECT id, category, subcategory, phrase, array_to_string(matchable, '|') AS matchable, truncated, len(matchable) = 0 AS template, tier, replacement, replacement_truncated, genres FROM lexc")
def _(t):
    return L.build_lexicon(lexraw(t)).withColumn("matchable", F.array_join("matchable", "|")).drop("alternatives", "signal", "fp_risk")


@query("a05d_phrase_matchers", "SELECT subcategory, row_number() OVER (PARTITION BY subcategory ORDER BY id, i) - 1 AS phrase_pos, m AS phrase FROM (SELECT id, subcategory, unnest(matchable) AS m, generate_subscripts(matchable, 1) AS i FROM lexc)")
def _(t):
    return L.lexicon_phrases(L.build_lexicon(lexraw(t))).select("subcategory", "phrase_pos", "phrase")


@query(
    "a05e_lexicon_rollup",
    """SELECT b.subcategory, entries, floor(w * 10000 + 0.5) / 10000 AS weight, a.amplification, 'lexical' AS level, coalesce(m.menu, 'Replace the generic phrase with a specific claim.') AS rewrite_menu FROM
  (SELECT subcategory, count(*) AS entries, sum((CASE signal WHEN 'strong contextual' THEN 1.0 WHEN 'moderate' THEN 0.7 ELSE 0.4 END)::DECIMAL(18,6))::DOUBLE / count(*) AS w FROM lexc GROUP BY ALL) b
  JOIN (SELECT subcategory, arg_min(a, (-c, f)) AS amplification FROM (SELECT subcategory, CASE fp_risk WHEN 'high' THEN 'high' WHEN 'medium' THEN 'med' ELSE 'low' END AS a, count(*) AS c, min(id) AS f FROM lexc GROUP BY ALL) GROUP BY ALL) a USING (subcategory)
  LEFT JOIN (SELECT subcategory, string_agg(replacement, '|' ORDER BY f) AS menu FROM (SELECT *, row_number() OVER (PARTITION BY subcategory ORDER BY f) AS n FROM (SELECT subcategory, replacement, min(id) AS f FROM lexc WHERE replacement <> '' AND NOT replacement_truncated GROUP BY ALL)) WHERE n <= 5 GROUP BY ALL) m USING (subcategory)""",
)
def _(t):
    return L.lexicon_rollup(L.build_lexicon(lexraw(t))).withColumn("rewrite_menu", F.array_join("rewrite_menu", "|"))


_styles = " UNION ALL ".join(f"SELECT subcategory, '{s}' AS style FROM lexc WHERE regexp_matches(lower(genres), '{p}')" for s, p in L.GENRE_STYLES)


@query("a05f_genre_tolerance", f"SELECT subcategory, style, floor(n / t * 1e6 + 0.5) / 1e6 AS share, CASE WHEN n / t >= 0.5 THEN 1.5 ELSE 1.2 END::DOUBLE AS tolerance FROM (SELECT *, sum(n) OVER (PARTITION BY subcategory) AS t FROM (SELECT subcategory, style, count(*)::DOUBLE AS n FROM ({_styles}) GROUP BY ALL)) WHERE n / t >= 0.3")
def _(t):
    return L.genre_tolerance(L.build_lexicon(lexraw(t)))


@query("a05g_lexicon_index", "SELECT category, count(*) FILTER (WHERE tier = 'strong') AS strong, count(*) FILTER (WHERE tier = 'moderate') AS moderate, count(*) FILTER (WHERE tier = 'watch') AS watch, count(*) AS entries FROM lexc GROUP BY category")
def _(t):
    return L.lexicon_index(L.build_lexicon(lexraw(t)))


@query("a05h_lexicon_violations", "SELECT id, 'tier' AS problem FROM lexc WHERE id % 10 = 3 AND tier <> 'watch'")
def _(t):
    """Every tenth tier is set to watch; those are the only violations of an otherwise sound lexicon."""
    lex = L.build_lexicon(lexraw(t))
    return L.lexicon_violations(lex.withColumn("tier", F.when(F.col("id") % 10 == 3, "watch").otherwise(F.col("tier"))))


# ---------------------------------------------------------------- model output

_A = '{"patterns": ["hedging", "zzz"], "arc_role": "pivot", "metrics": {"word_count": N, "clause_count": 3, "has_participial": true, "clause_balance_ratio": 1.5}}'
_B = '{"patterns": [{"type": "lexical", "name": "nominalization", "confidence": 1.7, "evidence": "e{x"}, {"pattern": "nothing"}, {"type": "hedging"}], "biber": {"abstract": 0.4, "narrative": "0.9"}}'
_C = '{"patterns": {"binary_contrast": "not a \\"but\\" b", "unknown": "x"}}'
_FORMS = [
    '{"results": [' + _A + ", " + _B + "]}",
    "<think>{ hm </think>```json\n" + '{"data": [' + _A + ", " + _C + ",]}\n```",
    'Sure: {"items": [' + _B + ", " + _A,
    "[" + _C + ", 7] and that is all",
    "no data here",
    _A,
]
_mo = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(_FORMS)) + " END"
# Result of a form at a position: hits, highest confidence, arc role, words, clause balance.
_a, _b, _c, _d = ("hedging", 0.8, "pivot", True, 1.0, 0.0), ("nominalization,hedging", 1.0, "claim", False, 0.0, 0.4), ("binary_contrast", 0.8, "claim", False, 0.0, 0.0), ("", 0.0, "claim", False, 0.5, 0.0)
_EXPECT = {0: [_a, _b, _d], 1: [_a, _c, _d], 2: [_b, _a, _d], 3: [_c, _d, _d], 4: [_d, _d, _d], 5: [_a, _d, _d]}
_exp = ", ".join(f"({f}, {p}, {str(f != 4).lower()}, '{h}', {m}::DOUBLE, '{r}', {str(w).lower()}, {bal}::DOUBLE, {ab}::DOUBLE)" for f, ps in _EXPECT.items() for p, (h, m, r, w, bal, ab) in enumerate(ps))


@query("a06_parse_model_output", f"SELECT d.doc_id AS batch_id, e.p AS position, e.parsed, e.types, e.top, e.arc_role, CASE WHEN e.w THEN d.n_chars ELSE 0 END AS word_count, e.bal AS clause_balance_ratio, e.ab AS abstract FROM documents d JOIN (VALUES {_exp}) e(f, p, parsed, types, top, arc_role, w, bal, ab) ON e.f = d.doc_id % 6")
def _(t):
    forms = F.array(*[F.lit(x) for x in _FORMS])
    raw = t.documents.select(F.col("doc_id").alias("batch_id"), F.replace(F.get(forms, (F.col("doc_id") % 6).cast("int")), F.lit("N"), F.col("n_chars").cast("string")).alias("raw"), F.lit(3).alias("expected_count"))
    p = M.parse_model_output(raw, t.registry)
    return p.select("batch_id", "position", "parsed", F.array_join("patterns.type", ",").alias("types"), F.coalesce(F.array_max("patterns.confidence"), F.lit(0.0)).alias("top"), "arc_role", F.col("word_count").cast("bigint").alias("word_count"), "clause_balance_ratio", "abstract")


@query("a07_default_classification", """SELECT f.doc_id, f.sent_id, CASE WHEN k.t IS NOT NULL THEN k.clause_count ELSE 1 END::BIGINT AS clause_count, coalesce(k.arc_role, 'claim') AS arc_role, coalesce(k.clause_balance_ratio, 0.5::DOUBLE) AS clause_balance_ratio FROM feats f
  LEFT JOIN (SELECT lower(text) AS t, arg_min(clause_count, (doc_id, sent_id)) AS clause_count, arg_min(arc_role, (doc_id, sent_id)) AS arc_role, arg_min(clause_balance_ratio, (doc_id, sent_id)) AS clause_balance_ratio FROM feats WHERE clause_count >= 2 GROUP BY ALL) k ON k.t = lower(f.text)""")
def _(t):
    f = t.feats
    rest = [c for c in f.columns if c != "hash"]
    cls = f.filter("clause_count >= 2").groupBy("hash").agg(F.min_by(F.struct(*rest), F.struct("doc_id", "sent_id")).alias("v")).select("hash", "v.*")
    d = M.with_default_classification(f.select("doc_id", "sent_id", "hash"), cls)
    return d.select("doc_id", "sent_id", F.col("clause_count").cast("bigint").alias("clause_count"), "arc_role", "clause_balance_ratio")


@query("a08_write_profiles", "SELECT doc_id, word_count, sentence_count FROM profs")
def _(t):
    out = scratch(t.spark, "profiles")
    corpus.write_profiles({"profiles": profile.profile(classified(t))}, out)
    return t.spark.read.parquet(f"{out}/profiles").select("doc_id", "word_count", "sentence_count")


@query("a09_report_lengths", "SELECT doc_id, word_count // 5 * 5 AS bin, count(*) AS n FROM sents GROUP BY ALL", once=True)
def _(t):
    return report.report_tables(profile.profile(classified(t)), t.hot)["lengths"]


@query("a09_report_heat", "SELECT doc_id, CASE WHEN heat <= 0 THEN 'none' WHEN heat <= 2 THEN 'cool' WHEN heat <= 4 THEN 'warm' WHEN heat <= 7 THEN 'hot' ELSE 'very hot' END AS bucket, count(*) AS n FROM hot GROUP BY ALL", once=True)
def _(t):
    return report.report_tables(profile.profile(classified(t)), t.hot)["heat"]


@query("a09_report_metrics", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS metric, {c}::DOUBLE AS value FROM profs" for n, c in report.METRICS), once=True)
def _(t):
    return report.report_tables(profile.profile(classified(t)), t.hot)["metrics"]


@query("a09_report_regions", "SELECT doc_id, start_sentence, heat, CASE WHEN heat >= 7 THEN 'high' WHEN heat >= 5 THEN 'moderate' ELSE 'mild' END AS severity FROM regions", once=True)
def _(t):
    return report.report_tables(profile.profile(classified(t)), t.hot, regions(t))["regions"].select("doc_id", "start_sentence", "heat", "severity")


def _raw(t, forms):
    a = F.array(*[F.lit(x) for x in forms])
    return t.documents.select(F.col("doc_id").alias("id"), F.replace(F.get(a, (F.col("doc_id") % len(forms)).cast("int")), F.lit("SRC"), F.col("source")).alias("raw"))


_VERDICTS = ['{"verdict": "earned", "rationale": " SRC holds "}', '```json\n{"verdict": "VACUOUS", "rationale": "cut SRC"', "nothing", '<think>x</think>{"verdict": "uncertain", "rationale": "r",}']


@query("a10_verdicts", "SELECT doc_id AS id, ['earned', 'vacuous', 'uncertain', 'uncertain'][doc_id % 4 + 1] AS verdict, [source || ' holds', 'cut ' || source, 'Could not parse model response.', 'r'][doc_id % 4 + 1] AS rationale FROM documents")
def _(t):
    return M.parse_rewrite_output(_raw(t, _VERDICTS), "verdict")


_REPL = ['{"replacement": "Use SRC now."}', 'text {"rewritten": " Try SRC. "}', '{"replacement": "Cut \\"SRC\\" off", "x', "A plain line with SRC.\nmore", "short"]


@query("a10_replacements", "SELECT doc_id AS id, ['Use ' || source || ' now.', 'Try ' || source || '.', 'Cut \"' || source || '\" off', 'A plain line with ' || source || '.', ''][doc_id % 5 + 1] AS replacement FROM documents")
def _(t):
    return M.parse_rewrite_output(_raw(t, _REPL), "replacement").withColumn("replacement", F.coalesce("replacement", F.lit("")))


_ALT = ['{"options": ["One SRC.", "Two  SRC.", "One  SRC."]}', '["Only SRC."]', '{"text": "Single SRC."}']


@query("a10_alternatives", "SELECT doc_id AS id, unnest([0, 1][1:len(a)]) AS pos, unnest(a) AS text FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['One ' || source || '.', 'Two  ' || source || '.'] WHEN 1 THEN ['Only ' || source || '.'] ELSE ['Single ' || source || '.'] END AS a FROM documents)")
def _(t):
    return M.parse_rewrite_output(_raw(t, _ALT), "alternatives")


_SUG = ['{"suggestions": [{"text": "A first rewrite of SRC.", "rationale": "clear"}, "A second rewrite of SRC.", {"text": "tiny"}]}', '{"rewrites": [{"rewrite": "A broken one for SRC.", "reason": "r"}, {"text": "An open one with SRC', 'none']


@query("a10_suggestions", "SELECT doc_id AS id, 0 AS pos, CASE doc_id % 3 WHEN 0 THEN 'A first rewrite of ' || source || '.' ELSE 'A broken one for ' || source || '.' END AS text, CASE doc_id % 3 WHEN 0 THEN 'clear' ELSE '' END AS rationale FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 1, 'A second rewrite of ' || source || '.', '' FROM documents WHERE doc_id % 3 = 0")
def _(t):
    return M.parse_rewrite_output(_raw(t, _SUG), "suggestions")


_ENT = ['{"entails": true, "confidence": 1.4, "explanation": "SRC stays"}', '{"entails": "false"}', 'so "entails": true, "confidence": 0.25', "none"]


@query("a10_entailments", "SELECT doc_id AS id, doc_id % 4 IN (0, 2) AS entails, [1.0, 0.8, 0.25, 0.5][doc_id % 4 + 1]::DOUBLE AS confidence, CASE doc_id % 4 WHEN 0 THEN source || ' stays' ELSE '' END AS explanation FROM documents")
def _(t):
    return M.parse_rewrite_output(_raw(t, _ENT), "entailment")
