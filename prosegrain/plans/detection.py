"""Queries on sentence detection (C)."""

from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stack
from prosegrain.operators import detect
from prosegrain.plans.catalog import cte, jr, q, query

S = "doc_id, sent_id"

cte("screen", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(t)}, {q('(?i)' + p)}, {c}::DOUBLE)" for i, (t, p, c) in enumerate(fixed.SCREEN_RULES)) + ") r(pos, type, re, confidence)")


@query("c01_screen_lexical", f"SELECT s.doc_id, s.sent_id, r.type, r.confidence, regexp_extract(s.text, r.re) AS evidence FROM sents s, screen r WHERE regexp_matches(s.text, r.re)")
def _(t):
    return detect.screen_lexical(t.sents).drop("hit_pos")


@query(
    "c02_route",
    f"SELECT {S}, n::BIGINT AS n_hits, CASE WHEN n = 0 THEN 'certain_negative' WHEN n = 1 THEN 'certain_positive' ELSE 'ambiguous' END AS route FROM (SELECT {S}, (SELECT count(*) FROM screen r WHERE regexp_matches(text, r.re)) AS n FROM sents)",
)
def _(t):
    return detect.route(t.sents).withColumn("n_hits", F.col("n_hits").cast("bigint"))


@query("c03_validators", f"SELECT {S}, " + ", ".join(f"regexp_matches(text, {q('(?i)' + p)}) AS {t}" for t, p in fixed.VALIDATOR_RULES) + " FROM sents")
def _(t):
    return detect.validators(t.sents)


# Test lexicon: subcategory, phrases. ``[slot]`` phrases match up to 40 characters.
LEX = [
    ("contrastive_negation", ["not about", "not only"]),
    ("hedge_phrase", ["perhaps", "slightly"]),
    ("hyperbolic_adjective", ["absolutely", "crucial", "significant"]),
    ("signposting_filler", ["it's important to note", "in other words", "moreover"]),
    ("empty_conclusion", ["in conclusion", "taken together"]),
    ("stereotyped_opener", ["throughout history", "at first glance"]),
    ("chatgpt_quirk", ["landscape", "cutting-edge"]),
    ("strategy_verb", ["leverage"]),
    ("faux_balance", ["rather than", "on the one hand"]),
    ("structural_padding", ["in this [noun] perhaps", "which means that"]),
    ("process_noun", ["implementation", "optimization"]),
    ("triadic_list", ["of crucial", "truly"]),
    # More phrases than a short list of triggers would hold; only the last two occur.
    ("long_list", [f"unseenword{i} here" for i in range(60)] + ["perhaps", "of the"]),
    # Nothing but a slot, or nothing at all: no sentence matches.
    ("empty_forms", ["[anything]", " "]),
    # Many subcategories that share a sentence.
    *((f"common_{w}", [w]) for w in "the of and a in is to at on it for as be an this that by with la de les und die der en es que nd ti re".split()),
]
LEX_ROWS = [(s, i, j, p) for i, (s, ps) in enumerate(LEX) for j, p in enumerate(ps)]
# Given expressions instead of phrases, with the mark of a bundle or without it.
LEX_PATTERNS = [("bundle", len(LEX), 0, "bundled words", "(?i)(?<![A-Za-z0-9_])(significant|crucial)(?![A-Za-z0-9_])"), ("plain_pattern", len(LEX) + 1, 0, "plain", "(?i)robust")]


def lexicon(t):
    return t.values([(*r, None) for r in LEX_ROWS] + LEX_PATTERNS, "subcategory string, sub_pos int, phrase_pos int, phrase string, pattern string")


def _sql_regex(p: str) -> str:
    import re

    if "[" in p:
        parts = [re.escape(x.strip()) for x in re.split(r"\[[^\]]+\]", p) if x.strip()]
        return "(?i)^(.*?)(" + r"[^\n\r]{0,40}?".join(parts) + ")"
    body = r"[\s '’-]*".join(re.sub(r"([^\w])", r"\\\1", w) for w in p.lower().split())
    return f"(?i)^((?:.*?[^a-z0-9])??)({body})(?:[^a-z0-9]|$)"


def _lex_triggers():
    import re

    out = {}
    for s, ps in [*LEX, ("bundle", ["bundled words"]), ("plain_pattern", ["plain"])]:
        ts = [w.lower().strip("-") for p in ps for w in re.findall("[A-Za-z][A-Za-z-]{4,}", p)]
        out[s] = [w for w in dict.fromkeys(ts) if 5 <= len(w) <= 28 and w not in fixed.COMMON_TRIGGERS]
    return out


# The SQL's own reading: phrases without literal text are not rules, a given expression is wrapped to give its place.
# A phrase's first literal word is looked for before its expression runs.
_SQL_LEX = [(s, i, j, p, _sql_regex(p), "phrase", p.lower().split()[0]) for s, i, j, p in LEX_ROWS if p.strip() and p.strip("[]") != "anything"] + [
    ("bundle", len(LEX), 0, "bundled words", "(?i)^((?:.*?[^a-z0-9_])??)(significant|crucial)(?:[^a-z0-9_]|$)", "A-Za-z0-9_", "i"),
    ("plain_pattern", len(LEX) + 1, 0, "plain", "(?i)^(.*?)(robust)", "phrase", "robust"),
]
cte("lex", "SELECT * FROM (VALUES " + ", ".join(f"({q(s)}, {i}, {j}, {q(p)}, {q(r)}, {q(k)}, {q(h)})" for s, i, j, p, r, k, h in _SQL_LEX) + ") l(subcategory, sub_pos, phrase_pos, phrase, re, kind, head)")
cte("trig", "SELECT * FROM (VALUES " + ", ".join(f"({q(s)}, {'[' + ', '.join(q(w) for w in ws) + ']::VARCHAR[]'}, {str(s in fixed.FAST_MARKERS).lower()})" for s, ws in _lex_triggers().items()) + ") t(subcategory, triggers, fast)")
cte("lexall", "SELECT * FROM (SELECT doc_id, sent_id, text, subcategory, sub_pos, phrase_pos, phrase, re, kind, regexp_extract(text, re, 2) AS evidence, len(regexp_extract(text, re, 1)) AS start, row_number() OVER (PARTITION BY doc_id, sent_id, subcategory ORDER BY phrase_pos) AS rn FROM (SELECT * FROM (SELECT *, lower(text) AS low FROM sents) s JOIN lex l ON contains(s.low, l.head)) p WHERE regexp_matches(text, re)) WHERE rn = 1")


def _mode_sql(mode: str, cols: str, cap: int = 1_000_000) -> str:
    scan = {
        "exhaustive": "true",
        "tiered": "CASE WHEN len(triggers) = 0 THEN fast ELSE len([x FOR x IN triggers IF contains(lower(text), x)]) > 0 END",
        "fast": "fast AND len([x FOR x IN triggers IF contains(lower(text), x)]) > 0",
    }[mode]
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY sub_pos) AS n FROM lexall JOIN trig USING (subcategory) WHERE {scan}) WHERE n <= {cap}"


CAND = "doc_id, sent_id, subcategory, phrase, evidence, start, start + len(evidence) AS \"end\""
cte("cands", _mode_sql("exhaustive", "doc_id, sent_id, subcategory, sub_pos, phrase, evidence, start, kind"))


@query("c04_match_lexicon", _mode_sql("exhaustive", CAND))
def _(t):
    return detect.match_lexicon(t.sents, lexicon(t), "exhaustive").drop("sub_pos", "matcher_role", "source")


@query("c05_mode_fast", _mode_sql("fast", CAND, 4))
def _(t):
    return detect.match_lexicon(t.sents, lexicon(t), "fast", cap=4).drop("sub_pos", "matcher_role", "source")


@query("c06_mode_tiered", _mode_sql("tiered", CAND, 8), once=True)
def _(t):
    return detect.match_lexicon(t.sents, lexicon(t), "tiered", cap=8).drop("sub_pos", "matcher_role", "source")


def cands(t):
    return detect.match_lexicon(t.sents, lexicon(t), "exhaustive")


@query("c07_dedupe_candidates", "SELECT DISTINCT doc_id, sent_id, subcategory, lower(evidence) AS evidence, start FROM cands")
def _(t):
    c = cands(t)
    return detect.dedupe_candidates(stack(c, c)).select("doc_id", "sent_id", "subcategory", F.lower("evidence").alias("evidence"), "start")


@query(
    "c08_matcher_roles",
    """SELECT subcategory, CASE kind WHEN 'phrase' THEN 'kimi_field_manual' ELSE 'oai_regex_bundle' END AS source,
  CASE kind WHEN 'phrase' THEN 'manual_phrase' ELSE 'surface_exact_or_near_exact' END AS matcher_role, count(*) AS n FROM cands GROUP BY ALL""",
)
def _(t):
    return cands(t).groupBy("subcategory", "source", "matcher_role").agg(F.count(F.lit(1)).alias("n"))


cte("mtypes", "SELECT * FROM (VALUES " + ", ".join(f"({q(m)}, {i}, {q(x)})" for m, xs in fixed.MARKER_TYPES.items() for i, x in enumerate(xs.split())) + ") m(subcategory, map_pos, type)")


@query("c09_map_patterns", "SELECT doc_id, sent_id, subcategory, type, evidence FROM cands JOIN mtypes USING (subcategory)")
def _(t):
    return detect.map_patterns(cands(t), dims.marker_types(t.spark)).select("doc_id", "sent_id", "subcategory", "type", "evidence")


@query(
    "c10_promote",
    """SELECT doc_id, sent_id, type, confidence, evidence, 0 AS promoted FROM hits UNION ALL
  SELECT doc_id, sent_id, type, 0.65::DOUBLE, arg_min(evidence, sub_pos * 10 + map_pos), 1 FROM cands JOIN mtypes USING (subcategory)
  WHERE type IN (SELECT type FROM play) AND (doc_id, sent_id, type) NOT IN (SELECT doc_id, sent_id, type FROM hits) GROUP BY doc_id, sent_id, type""",
    once=True,
)
def _(t):
    return detect.promote(t.hits, cands(t), dims.playbook(t.spark), dims.marker_types(t.spark)).drop("hit_pos")


@query("c11_drop_disabled", "SELECT doc_id, sent_id, type, confidence FROM hits WHERE type NOT IN ('hedging', 'nominalization')")
def _(t):
    off = t.values([("hedging",), ("nominalization",)], "type string")
    return detect.drop_disabled(t.hits, off).select("doc_id", "sent_id", "type", "confidence")


TIERS = [("perhaps", "watch"), ("crucial", "watch"), ("landscape", "moderate"), ("robust", "moderate"), ("in conclusion", "strong"), ("leverage", "strong"), ("in this [noun] perhaps", "strong")]
cte("tiered", "SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {q(x)}, {q(_sql_regex(p))})" for p, x in TIERS) + ") t(phrase, tier, re)")
cte("thits", "SELECT s.doc_id, s.sent_id, t.phrase, t.tier FROM sents s JOIN tiered t ON regexp_matches(s.text, t.re)")


@query(
    "c12_scan_hitlist",
    """SELECT doc_id, sent_id, phrase, tier, near, CASE tier WHEN 'strong' THEN true WHEN 'moderate' THEN near >= 2 ELSE firm >= 1 END AS flagged FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY sent_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near,
    count(*) FILTER (WHERE tier <> 'watch') OVER (PARTITION BY doc_id, sent_id) AS firm FROM thits)""",
)
def _(t):
    lex = t.values([(p, x) for p, x in TIERS], "phrase string, tier string")
    return detect.scan_hitlist(t.sents, lex)


_common = "(" + ", ".join(q(w) for w in fixed.COMMON_WORDS) + ")"
cte("reps", rf"""SELECT doc_id, sent_id, string_agg(w, ', ' ORDER BY p) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY p) AS k FROM (
  SELECT doc_id, sent_id, w, min(p) AS p FROM (SELECT doc_id, sent_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, sent_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*') AS ws FROM sents WHERE text IS NOT NULL))
  WHERE len(w) > 5 AND w NOT IN {_common} GROUP BY ALL HAVING count(*) > 1)) WHERE k <= 3 GROUP BY doc_id, sent_id""")
cte("opens", "SELECT doc_id, sent_id, o, lag(o) OVER (PARTITION BY doc_id ORDER BY sent_id) AS prev FROM (SELECT doc_id, sent_id, lower(array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')[1:2], ' ')) AS o FROM sents)")
_con = q("(?i)" + fixed.CONTRAST_RE)
cte("rhits", rf"""SELECT doc_id, sent_id, 0 AS hit_pos, 'intensifier_saturation' AS type, least(1.0, {jr('0.45 + len(strong) * 0.12::DOUBLE', 6)})::DOUBLE AS confidence, array_to_string(strong[1:4], ', ') AS evidence FROM feats WHERE len(strong) >= 2
  UNION ALL SELECT doc_id, sent_id, 1, 'importance_inflation', 0.72::DOUBLE, [w FOR w IN strong IF w IN ('crucial', 'essential', 'significant')][1] FROM feats WHERE len([w FOR w IN strong IF w IN ('crucial', 'essential', 'significant')]) > 0
  UNION ALL SELECT doc_id, sent_id, 2, 'binary_contrast', 0.8::DOUBLE, regexp_extract(text, {_con}) FROM feats WHERE regexp_matches(text, {_con})
  UNION ALL SELECT doc_id, sent_id, 3, 'sentence_opener_repetition', 0.84::DOUBLE, o FROM opens WHERE o <> '' AND o = prev
  UNION ALL SELECT doc_id, sent_id, 4, 'nominalization', least(1.0, {jr('0.55 + len(nominal) * 0.1::DOUBLE', 6)})::DOUBLE, array_to_string(nominal[1:3], ', ') FROM feats WHERE len(nominal) >= 1
  UNION ALL SELECT doc_id, sent_id, 5, 'vocabulary_smoothing', 0.64::DOUBLE, evidence FROM reps""")


@query("c13_classify_rules", "SELECT doc_id, sent_id, type, confidence, evidence FROM rhits")
def _(t):
    return detect.explode_hits(detect.classify_rules(t.sents)).drop("hit_pos")


FEATS = "clause_count::BIGINT AS clause_count, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS alpha_words, has_participial, has_relative_clause, clause_balance_ratio, construction_type, informational, involved, narrative, persuasive, abstract, elaborative, arc_role"


@query("c13_rule_features", f"SELECT doc_id, sent_id, {FEATS} FROM feats")
def _(t):
    return t.feats.drop("text", "hash", "word_count", "paragraph_id").withColumns({c: F.col(c).cast("bigint") for c in ("clause_count", "alpha_words")})


@query("c14_heat", "SELECT doc_id, sent_id, heat FROM hot")
def _(t):
    return t.hot.select("doc_id", "sent_id", "heat")


_w = "CASE type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in fixed.RULE_HEAT_WEIGHTS.items()) + " ELSE 0.8 END::DOUBLE"
cte("rheat", f"""SELECT f.doc_id, f.sent_id, f.paragraph_id, f.text, least(10.0, {jr('(coalesce(h, 0.0) + CASE WHEN clause_count >= 3 THEN 0.45::DOUBLE ELSE 0.0 END) * CASE WHEN coalesce(n, 0) >= 3 THEN 1.15::DOUBLE ELSE 1.0 END', 1)}) AS heat
  FROM feats f LEFT JOIN (SELECT doc_id, sent_id, sum(({_w} * confidence)::DECIMAL(18,6))::DOUBLE AS h, count(*) AS n FROM rhits GROUP BY ALL) USING (doc_id, sent_id)""")


@query("c15_rule_heat", "SELECT doc_id, sent_id, heat FROM rheat")
def _(t):
    return detect.rule_heat(detect.classify_rules(t.sents)).select("doc_id", "sent_id", "heat")


@query(
    "c16_escalation",
    "SELECT doc_id, sent_id, coalesce(m, 0.0) AS max_confidence, CASE WHEN m >= 0.7 THEN 'full' WHEN m >= 0.4 THEN 'medium' ELSE 'none' END AS tier FROM sents LEFT JOIN (SELECT doc_id, sent_id, max(confidence) AS m FROM hits GROUP BY ALL) USING (doc_id, sent_id)",
    once=True,
)
def _(t):
    return detect.escalation(t.sents, t.hits)


@query("c17_keep_patterns", "SELECT doc_id, sent_id, type, confidence FROM hits WHERE type IN (" + ", ".join(q(x) for x in fixed.GATE_IDS) + ")")
def _(t):
    ids = t.values([(x,) for x in fixed.GATE_IDS], "type string")
    return detect.keep_patterns(t.hits, ids).select("doc_id", "sent_id", "type", "confidence")


@query("c17_medium_patterns", "SELECT doc_id, sent_id, type, confidence FROM hits WHERE type IN ('binary_contrast', 'nominalization', 'hedging', 'sentence_opener_repetition', 'importance_inflation', 'transition_formulaic', 'llm_fingerprint_word', 'participial_cascade', 'agentless_passive', 'resumptive_phrase', 'tricolon_abstract')")
def _(t):
    ids = t.values([(x,) for x in fixed.MEDIUM_IDS], "type string")
    return detect.keep_patterns(t.hits, ids).select("doc_id", "sent_id", "type", "confidence")


def _term(w):
    return r"\b" + w.replace("-", "[- ]") + r"\b"


cte("swaps", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(a)}, {q(b)}, {q('(?i)' + _term(a))})" for i, (a, b) in enumerate(fixed.SWAPS)) + ") s(pos, word, suggestion, re)")
cte("swhits", """SELECT doc_id, pos, word, suggestion, matched, (coalesce(sum(len(gap)) OVER w, 0) + coalesce(sum(len(matched)) OVER (PARTITION BY doc_id, word ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS index FROM (
  SELECT doc_id, pos, word, suggestion, unnest(found) AS matched, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS k FROM (
    SELECT d.doc_id, s.pos, s.word, s.suggestion, regexp_extract_all(d.text, s.re) AS found, string_split_regex(d.text, s.re) AS gaps FROM mdocs d JOIN swaps s ON regexp_matches(d.text, s.re)))
  WINDOW w AS (PARTITION BY doc_id, word ORDER BY k ROWS UNBOUNDED PRECEDING)""")


@query("c18_lexicon_hits", "SELECT doc_id, word, suggestion, index, matched FROM swhits")
def _(t):
    return detect.lexicon_hits(t.docs).drop("pos").withColumn("index", F.col("index").cast("bigint"))


@query("c19_swap_lines", "SELECT doc_id, word, '\"' || arg_min(matched, index) || '\" → ' || any_value(suggestion) AS line FROM swhits GROUP BY doc_id, word")
def _(t):
    return detect.swap_lines(detect.lexicon_hits(t.docs)).select("doc_id", "word", "line")


cte("banned", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(w)}, {q('(?i)' + _term(w))})" for i, w in enumerate(fixed.BANNED_WORDS)) + ") b(pos, word, re)")


@query("c20_banned_without_swap", "SELECT d.doc_id, b.word FROM mdocs d JOIN banned b ON regexp_matches(d.text, b.re) WHERE b.word NOT IN (SELECT word FROM swaps)")
def _(t):
    return detect.banned_without_swap(t.docs)


_opp = [(n, q("(?i)" + p), q(why)) for n, p, why in fixed.OPPOSITION_TEMPLATES]
ANY_OPP = "(" + " OR ".join(f"regexp_matches(text, {p})" for _, p, _ in _opp) + ")"


@query("c21_opposition_template", "SELECT doc_id, sent_id, " + ", ".join(f"regexp_matches(text, {p}) AS {n}" for n, p, _ in _opp) + f", {ANY_OPP} AS any_template FROM sents")
def _(t):
    return detect.opposition_template(t.sents).drop("text")


REASON = "CASE " + " ".join(f"WHEN regexp_matches(text, {p}) THEN {w}" for _, p, w in _opp) + " END"


@query("c22_opposition_verdict", f"SELECT doc_id, sent_id, 'vacuous' AS verdict, {REASON} AS reason FROM sents WHERE {ANY_OPP}")
def _(t):
    s = t.sents.select("doc_id", "sent_id", detect.opposition_verdict(F.col("text")).alias("verdict"), detect.opposition_reason(F.col("text")).alias("reason"))
    return s.filter("verdict is not null")


_types = "(" + ", ".join(q(x) for x in fixed.OPPOSITION_TYPES) + ")"
_signal = q("(?i)" + fixed.OPPOSITION_SIGNAL_RE)
cte("opp", f"SELECT h.doc_id, h.sent_id, h.hit_pos, h.type, h.confidence, h.evidence, s.text FROM hits h JOIN sents s USING (doc_id, sent_id) WHERE h.type IN {_types} AND (h.type <> 'clause_symmetry' OR regexp_matches(s.text, {_signal}))")


@query("c23_opposition_filter", "SELECT doc_id, sent_id, type, confidence, evidence FROM opp", once=True)
def _(t):
    return detect.opposition_filter(t.hits, t.sents).drop("verdict")


@query("c24_promote_uncertain", f"SELECT doc_id, sent_id, type, CASE WHEN type IN ('binary_contrast', 'negation_reframe') AND {ANY_OPP} THEN 'vacuous' ELSE 'uncertain' END AS verdict FROM opp", once=True)
def _(t):
    return detect.opposition_filter(t.hits, t.sents).select("doc_id", "sent_id", "type", "verdict")


def _up(x):
    return f"(upper(left({x}, 1)) || substr({x}, 2))"


def _lo(x):
    return f"(lower(left({x}, 1)) || substr({x}, 2))"


def _trim(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _squeeze(x):
    return rf"regexp_replace({_trim(x)}, '\s+', ' ', 'g')"


def _finish(x):
    return f"(CASE WHEN {_squeeze(x)} = '' OR regexp_matches({_squeeze(x)}, '[.!?]$') THEN {_squeeze(x)} ELSE {_squeeze(x)} || '.' END)"


def _g(shape, i, col="a"):
    p = shape if shape.startswith("^") else fixed.OPPOSITION_SHAPES[shape]
    return f"regexp_extract({col}, {q('(?i)' + p)}, {i})"


def _fit(shape, col="a"):
    p = shape if shape.startswith("^") else fixed.OPPOSITION_SHAPES[shape]
    return f"regexp_matches({col}, {q('(?i)' + p)})"


def _article(x):
    return rf"regexp_replace({_trim(x)}, '(?i)^(?:a|an|the)\s+', '')"


_ger = _g("not_merely_about", 2)
_stem = rf"regexp_extract({_trim(_ger)}, '(?i)^([a-z]+)ing\b', 1)"
_made = f"""CASE WHEN {_fit('not_about')} THEN {_trim(_g('not_about', 1))} || ' depends on ' || {_article(_g('not_about', 3))}
  WHEN {_fit('not_merely_about')} THEN 'The work is to ' || CASE WHEN {_stem} = '' THEN {_trim(_ger)} ELSE CASE WHEN regexp_matches({_stem}, '(at|it)$') THEN {_stem} || 'e' WHEN regexp_matches({_stem}, 't$') THEN regexp_replace({_stem}, 't$', '') ELSE {_stem} END || substr({_trim(_ger)}, len({_stem}) + 4) END
  WHEN {_fit('not_only_can')} THEN {_g('not_only_can', 1)} || ' can ' || {_g('not_only_can', 2)} || ' and ' || regexp_replace({_g('not_only_can', 3)}, '(?i)^also\\s+', '')
  WHEN {_fit('nuanced')} THEN 'The practical opportunity is ' || {_lo(_g('nuanced', 1))}
  WHEN {_fit('one_and_other')} THEN {_trim(_g('one_and_other', 1))} || ', but ' || {_lo(_trim(_g('one_and_other', 2)))}
  WHEN {_fit('one_hand')} THEN {_up(_g('one_hand', 1))} WHEN {_fit('other_hand')} THEN {_up(_g('other_hand', 1))} END"""


@query("c25_rewrite_opposition", f"SELECT doc_id, sent_id, text, {_finish('made')} AS replacement FROM (SELECT *, {_made} AS made FROM (SELECT doc_id, sent_id, text, {_squeeze('text')} AS a FROM sents)) WHERE made IS NOT NULL")
def _(t):
    return detect.rewrite_opposition(t.sents)


_P = fixed.OPPOSITION_PAIRS


def _pair(k):
    return f"{_fit(_P[k][0], 'a')} AND {_fit(_P[k][1], 'b')}"


cte("pairs", f"""SELECT * FROM (SELECT *, CASE WHEN {_pair('glance')} THEN 'concessive_while' WHEN {_pair('hands')} THEN 'binary_contrast' WHEN {_pair('about')} THEN 'negation_reframe' END AS kind FROM (
  SELECT doc_id, sent_id, paragraph_id, text, {_squeeze('text')} AS a, lead(paragraph_id) OVER w AS np, lead(text) OVER w AS nt, {_squeeze('lead(text) OVER w')} AS b FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id))
  WHERE np = paragraph_id) WHERE kind IS NOT NULL""")
_bare = rf"regexp_replace({_squeeze(_g(_P['about'][0], 1, 'a'))}, '[.!?]+$', '')"
_ptext = f"""CASE kind WHEN 'concessive_while' THEN {_finish("'The practical opportunity is ' || " + _lo(_g(_P['glance'][1], 1, 'b')))}
  WHEN 'binary_contrast' THEN {_finish(_up(_g(_P['hands'][0], 1, 'a')))} || ' ' || {_finish(_up(_g(_P['hands'][1], 1, 'b')))}
  ELSE {_finish(_bare + " || ' depends on ' || " + _article(_g(_P['about'][1], 1, 'b')))} END"""
# A pair is used when an even number of directly linked pairs comes before it.
cte("used", "SELECT *, 1 AS k FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs o WHERE o.doc_id = p.doc_id AND o.sent_id = p.sent_id - 1) UNION ALL SELECT n.*, u.k + 1 FROM used u JOIN pairs n ON n.doc_id = u.doc_id AND n.sent_id = u.sent_id + 1")


@query("c26_rewrite_pairs", f"SELECT doc_id, sent_id, sent_id + 1 AS end_id, kind AS type, text || ' ' || nt AS original, {_ptext} AS replacement FROM used WHERE k % 2 = 1")
def _(t):
    return detect.rewrite_pairs(t.sents)


cte("ocands", f"SELECT doc_id, sent_id FROM hits WHERE type IN {_types} UNION SELECT doc_id, sent_id FROM cands JOIN mtypes USING (subcategory) WHERE type IN {_types} UNION SELECT doc_id, sent_id FROM sents WHERE {ANY_OPP}")


@query("c27_opposition_candidates", "SELECT * FROM ocands", once=True)
def _(t):
    return detect.opposition_candidates(t.sents, t.hits, cands(t), dims.marker_types(t.spark))


@query(
    "c28_with_context",
    "SELECT doc_id, sent_id, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after, string_agg(text, ' ') OVER (PARTITION BY doc_id, paragraph_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS paragraph FROM sents WINDOW w AS (PARTITION BY doc_id, paragraph_id ORDER BY sent_id)",
)
def _(t):
    c = detect.with_context(t.sents)
    return c.select("doc_id", "sent_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "paragraph")


def _tidy(x):
    t = rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g')"
    m = rf"string_split(regexp_replace({t}, '([.!?]\s+)([a-z])', '\1' || chr(57346) || '\2', 'g'), chr(57346))"
    return _trim(f"array_to_string(list_transform({m}, lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(left(x, 1)) || substr(x, 2) END), '')")


def _fold(x, rules):
    for p, r in rules:
        x = f"regexp_replace({x}, {q('(?i)' + p)}, {q(r)}, 'g')"
    return x


PHRASES = [(r"\bof crucial\b", "of"), (r"\btruly\b", "partly"), (r"\bleverage\b", "use"), (r"\bis not about\b", "shows")]
_binary_to = fixed.BINARY_RULE[1].replace("$", "\\")
cte("bin", f"SELECT doc_id, sent_id, {_tidy('regexp_replace(text, ' + q('(?i)' + fixed.BINARY_RULE[0]) + ', ' + q(_binary_to) + ')')} AS x FROM sents")


@query("c29_apply_phrase_rules", f"SELECT doc_id, sent_id, x AS \"binary\", {_tidy('y')} AS level, {_tidy(_fold('y', fixed.COMPACT_RULES))} AS compact FROM (SELECT *, {_fold('x', PHRASES)} AS y FROM bin)")
def _(t):
    return detect.apply_phrase_rules(t.sents.select("doc_id", "sent_id", "text"), PHRASES)


def _stock_sql(x):
    for a, b in _STOCK:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


# The forms that reorder and that settings choose, on sentences that hold the phrases of the built-in tables.
_STOCK = [(" truly ", " truly deserve the strongest "), (" perhaps ", " perhaps arguably "), (" robust ", " important cutting-edge technologies of remarkable potential "), (" landscape ", " virtually every very foundations "), (" slightly ", " sharpest ")]
cte("stock_rows", "SELECT doc_id, sent_id, CASE sent_id % 4 WHEN 0 THEN 'In strong writing, ' WHEN 1 THEN 'While traditional approaches relied heavily on manual processes, ' ELSE '' END || " + _stock_sql("text") + " AS text, CASE doc_id % 3 WHEN 0 THEN 'emphatic' ELSE 'measured' END AS statement_force, CASE doc_id % 2 WHEN 0 THEN 'none' ELSE 'one' END AS expression_budget FROM sents")


def stock(t):
    text = F.col("text")
    for a, b in _STOCK:
        text = F.replace(text, F.lit(a), F.lit(b))
    head = F.when(F.col("sent_id") % 4 == 0, "In strong writing, ").when(F.col("sent_id") % 4 == 1, "While traditional approaches relied heavily on manual processes, ").otherwise("")
    return t.sents.select(
        "doc_id", "sent_id", F.concat(head, text).alias("text"), F.when(F.col("doc_id") % 3 == 0, "emphatic").otherwise("measured").alias("statement_force"),
        F.when(F.col("doc_id") % 2 == 0, "none").otherwise("one").alias("expression_budget"),
    )


_SOFT = _fold(_tidy("regexp_replace(text, " + q("(?i)" + fixed.BINARY_RULE[0]) + ", " + q(_binary_to) + ")"), [
    ("\\bhas perhaps arguably created\\b", "may have created"), ("\\bPerhaps more importantly,\\s*the\\b", "The"), ("\\btruly fundamental paradigm shift\\b", "important change"),
    ("\\bvery foundations\\b", "basic assumptions"), ("\\bremarkable potential\\b", "practical potential"), ("\\bvirtually every\\b", "many"), ("\\bPerhaps more importantly,\\s*", ""),
    ("\\bperhaps arguably\\b", "arguably"), ("\\bunprecedented opportunities\\b", "new opportunities"), ("\\bpowerful tools\\b", "useful tools"), ("\\bcutting-edge technologies\\b", "new technologies"),
    ("\\bparticularly noteworthy\\b", "worth noting"), ("\\buniquely favorable\\b", "favorable"), ("\\bundoubtedly play a crucial role\\b", "will likely matter"),
    ("\\bstrongest expressions\\b", "strongest expressions"), ("\\btruly deserve\\b", "deserve"),
])
cte("soft_rows", f"SELECT *, {_SOFT} AS y FROM stock_rows")
_emph = "CASE statement_force WHEN 'emphatic' THEN regexp_replace(y, '(?i)\\bimportant\\b', 'important and well-supported') ELSE y END"


@query("c29_level_by_setting", f"""SELECT doc_id, sent_id, {_tidy("CASE expression_budget WHEN 'none' THEN regexp_replace(regexp_replace(z, '(?i)\\btruly\\b|\\bstrongest\\b|\\bsharpest\\b', '', 'g'), '\\s{2,}', ' ', 'g') ELSE z END")} AS level FROM (SELECT *, {_emph} AS z FROM soft_rows)""")
def _(t):
    return detect.level_rewrite(stock(t)).select("doc_id", "sent_id", "level")


@query("c29_evidence_first", "SELECT doc_id, sent_id, " + _tidy("regexp_replace(regexp_replace(y, '(?i)^In strong writing,\\s*', 'Strong writing works best when '), '(?i)^While traditional approaches relied heavily on manual processes,\\s*', 'Compared with manual processes, ')") + " AS evidence_first FROM soft_rows")
def _(t):
    return detect.evidence_first(stock(t)).select("doc_id", "sent_id", "evidence_first")


cte("rhythms", r"""SELECT doc_id, i, text FROM (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN regexp_extract_all('Opening. This ' || replace(text, chr(10), ' ') || ' Save it.', '([^.!?]+[.!?]+|[^.!?]+$)')] IF x <> ''] AS p FROM mdocs))""")
cte("rhythms2", f"SELECT doc_id, i, {_SOFT} AS y FROM rhythms")


@query("c29_rhythm", "SELECT doc_id, " + _tidy("string_agg(CASE WHEN i = 2 THEN regexp_replace(y, '^This\\b', 'That focus') WHEN i = 3 THEN regexp_replace(y, '^Save\\b', 'Reserve') ELSE y END, ' ' ORDER BY i)") + " AS rhythm FROM rhythms2 GROUP BY doc_id")
def _(t):
    text = F.concat(F.lit("Opening. This "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit(" Save it."))
    return detect.rhythm_rewrite(t.docs.select("doc_id", text.alias("text"))).select("doc_id", "rhythm")


@query("c30_heat_level", "SELECT CASE WHEN heat IS NULL OR heat < 1 THEN 'none' WHEN heat < 3 THEN 'low' WHEN heat < 6 THEN 'medium' ELSE 'high' END AS level, count(*) AS n FROM hot GROUP BY ALL", once=True)
def _(t):
    return t.hot.groupBy(X.heat_level(F.col("heat")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["cands", "lexicon"]
