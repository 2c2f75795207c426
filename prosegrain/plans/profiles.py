"""Queries on documents: profiles, style, playbook, audit and advice (E), and the whole analysis (A-02)."""

from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.dims import fixed
from prosegrain.operators import profile, split
from prosegrain.plans import analyze
from prosegrain.plans.catalog import ORACLES, RULES, cte, jr, jr0, q, query
from prosegrain.plans.detection import cands, lexicon
from prosegrain.plans.rolling import _OPEN, autocorr_sql, diversity, ent, ratio, regions, scored, violations


def classified(t):
    return t.classified


_reg = "CASE " + " ".join(f"WHEN {d} = greatest({', '.join(fixed.REGISTERS)}) THEN '{d}'" for d in fixed.REGISTERS) + " END"
cte("dauto", autocorr_sql("sents", "doc_id", "sent_id"))
cte("ddev", ent("SELECT doc_id, type, count(*) AS n FROM hits GROUP BY ALL", "doc_id"))
cte("dreg", ent(f"SELECT doc_id, {_reg} AS d, count(*) AS n FROM feats GROUP BY ALL", "doc_id"))
cte("dlex", diversity("tok", "doc_id"))
cte("hotreg", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, sent_id - row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS g FROM hot WHERE heat >= 3) GROUP BY doc_id, g HAVING count(*) >= 2")
cte("profs", f"""SELECT b.doc_id, b.word_count, b.sentence_count, b.paragraph_count, {jr('b.h / b.sentence_count', 1)} AS mean_heat, coalesce(r.n, 0) AS hot_region_count,
  conv.convergence_slope, dreg.entropy AS register_entropy, coalesce(ddev.entropy, 0.0) AS device_entropy, dauto.autocorrelation, dlex.ttr, mattrs.mattr, dlex.hapax_ratio, dlex.word_length_entropy,
  CASE WHEN b.sentence_count <= 1 THEN 1.0 ELSE {ratio('b.o', 'b.sentence_count')} END AS opening_variety, dlex.function_word_ratio
  FROM (SELECT doc_id, sum(word_count)::BIGINT AS word_count, count(*) AS sentence_count, count(DISTINCT paragraph_id) AS paragraph_count, sum(heat::DECIMAL(18,6))::DOUBLE AS h, count(DISTINCT {_OPEN}) AS o FROM hot GROUP BY doc_id) b
  JOIN conv USING (doc_id) JOIN dreg USING (doc_id) LEFT JOIN ddev USING (doc_id) JOIN dauto USING (doc_id) JOIN dlex USING (doc_id) JOIN mattrs USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM hotreg GROUP BY doc_id) r USING (doc_id)""")


@query("e01_profile", "SELECT * FROM profs")
def _(t):
    return profile.profile(classified(t))


@query("a02_analyze_corpus", "SELECT doc_id, sent_id, paragraph_id, heat, (SELECT count(*) FROM hits h WHERE h.doc_id = hot.doc_id AND h.sent_id = hot.sent_id) AS n_hits FROM hot")
def _(t):
    c = analyze.analyze_corpus(t.docs, RULES, split.ONE_LINE)["sentences"]
    return c.select("doc_id", "sent_id", "paragraph_id", "heat", F.size("patterns").cast("bigint").alias("n_hits"))


def _avg(c):
    return f"sum({c}::DECIMAL(18,6))::DOUBLE / count(*)"


def _share(r):
    return f"count(*) FILTER (WHERE arc_role = '{r}') / count(*)::DOUBLE"


_p = f"""SELECT doc_id, paragraph_id, count(*) AS n, max(d) AS define, {', '.join(f'{_avg(d)} AS {d}' for d in fixed.REGISTERS)}, {_share('evidence')} AS r_evidence, {_share('claim')} AS r_claim
  FROM scored s LEFT JOIN (SELECT DISTINCT doc_id, sent_id, 1 AS d FROM hits WHERE type = 'definitional_opening') USING (doc_id, sent_id) GROUP BY doc_id, paragraph_id"""
_scores = {
    "analytical": "informational + abstract + r_evidence * 0.5",
    "narrative": "narrative * 2 + CASE WHEN involved > 0.3 THEN 0.3 ELSE 0 END",
    "argumentative": "persuasive * 2 + r_claim * 0.5 + r_evidence * 0.5",
    "transitional": "CASE WHEN n <= 2 THEN 0.5 ELSE 0.0 END",
    "summary": "CASE WHEN informational > 0.5 THEN 0.3 ELSE 0.0 END",
    "example": "r_evidence + narrative * 0.5",
    "definition": "abstract * 1.5 + CASE WHEN define = 1 THEN 1.0 ELSE 0.0 END + informational * 0.5",
}
_vals = ", ".join(f"({i}, '{k}', {jr(v, 9)})" for i, (k, v) in enumerate(_scores.items()))
_targ = ", ".join(f"({q(a)}, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {str(f).lower()})" for a, b, c, d, e, f in fixed.PURPOSE_TARGETS)
cte("purposes", f"""SELECT p.doc_id, p.paragraph_id, p.n, z.purpose, z.v, lead(z.v) OVER (PARTITION BY p.doc_id, p.paragraph_id ORDER BY z.v DESC, z.i) AS v2, row_number() OVER (PARTITION BY p.doc_id, p.paragraph_id ORDER BY z.v DESC, z.i) AS k FROM ({_p}) p, LATERAL (SELECT * FROM (VALUES {_vals}) v(i, purpose, v)) z""")


@query(
    "e02_paragraph_purpose",
    f"SELECT doc_id, paragraph_id, purpose, {jr('least(1.0, 0.5 + (v - v2) * 0.3::DOUBLE)', 2)} AS confidence, n AS sentence_count FROM purposes WHERE k = 1",
    once=True,
)
def _(t):
    return profile.paragraph_purpose(scored(t), t.hits, dims.purpose_targets(t.spark)).select("doc_id", "paragraph_id", "purpose", "confidence", "sentence_count")


@query("e03_purpose_targets", f"SELECT doc_id, paragraph_id, purpose, emin AS entropy_min, emax AS entropy_max, smin AS length_std_min, rho AS max_autocorrelation, res AS expects_resolution FROM purposes JOIN (VALUES {_targ}) v(purpose, emin, emax, smin, rho, res) USING (purpose) WHERE k = 1", once=True)
def _(t):
    return profile.paragraph_purpose(scored(t), t.hits, dims.purpose_targets(t.spark)).drop("confidence", "sentence_count")


cte("hk", "SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{k}')::DOUBLE AS {a}" for a, k in [("nom", "nominalization"), ("imp", "importance_inflation"), ("tra", "transition_formulaic"), ("res", "resolution_complete"), ("bin", "binary_contrast")]) + " FROM hits GROUP BY doc_id")
cte("arcs", """SELECT doc_id, max(run) AS same_arc FROM (SELECT doc_id, role, g, count(*) AS run FROM (
  SELECT doc_id, paragraph_id, role, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id) - row_number() OVER (PARTITION BY doc_id, role ORDER BY paragraph_id) AS g FROM (
    SELECT doc_id, paragraph_id, arc_role AS role, row_number() OVER (PARTITION BY doc_id, paragraph_id ORDER BY c DESC, f) AS k FROM (SELECT doc_id, paragraph_id, arc_role, count(*) AS c, min(sent_id) AS f FROM feats GROUP BY ALL)) WHERE k = 1) GROUP BY ALL) GROUP BY doc_id""")
cte("meas", f"""SELECT b.doc_id, n, words, words::DOUBLE / n AS mean_length, sqrt(greatest(0.0, n::DOUBLE * sq - words::DOUBLE * words)) / n AS std_length,
  coalesce(nom, 0.0) / (words::DOUBLE / 100) AS nominalization, dauto.autocorrelation, coalesce(ddev.entropy, 0.0) AS device_entropy, coalesce(imp, 0.0) / (words::DOUBLE / 100) AS importance_inflation,
  coalesce(tra, 0.0) / n AS transitions, part::DOUBLE / n AS participial, CASE WHEN multi > 0 THEN {jr('bal / multi', 9)} END AS balance, same_arc, coalesce(res, 0.0) / n AS resolution, coalesce(bin, 0.0) / words * 1000 AS "binary"
  FROM (SELECT doc_id, count(*) AS n, sum(word_count)::BIGINT AS words, sum(word_count::DOUBLE * word_count) AS sq, count(*) FILTER (WHERE has_participial) AS part, count(*) FILTER (WHERE clause_count >= 2) AS multi, sum(clause_balance_ratio::DECIMAL(18,6)) FILTER (WHERE clause_count >= 2)::DOUBLE AS bal FROM feats GROUP BY doc_id) b
  LEFT JOIN hk USING (doc_id) JOIN dauto USING (doc_id) LEFT JOIN ddev USING (doc_id) JOIN arcs USING (doc_id)""")
cte("guides", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else f"{x}::DOUBLE" for x in g) + ")" for g in fixed.GUIDES) + f") g({', '.join(fixed.GUIDE_COLUMNS)})")


def _chk(name, cond, cur, target, high, low="medium"):
    return f"SELECT doc_id, name AS guide, '{name}' AS dimension, ({cur})::DOUBLE AS current, ({target})::DOUBLE AS target, CASE WHEN {high} THEN 'high' ELSE '{low}' END AS severity FROM mg WHERE {cond}"


cte("mg", "SELECT m.*, g.* FROM meas m CROSS JOIN guides g")
cte("sviol", " UNION ALL ".join([
    _chk("sentence_length_variance", "std_length < len_std * 0.6::DOUBLE", jr0("std_length", 1), "len_std", "std_length < len_std * 0.3::DOUBLE"),
    _chk("nominalization_ratio", "nominalization > nominalization_max * 100", jr0("nominalization", 2), "nominalization_max * 100", "nominalization > nominalization_max * 200"),
    _chk("sentence_length_autocorrelation", "autocorrelation > max_rho", "autocorrelation", "max_rho", "autocorrelation > max_rho * 1.5::DOUBLE"),
    _chk("device_entropy", "device_entropy < entropy_min", "device_entropy", "entropy_min", "device_entropy < entropy_min * 0.6::DOUBLE"),
    _chk("importance_inflation", "importance_inflation > inflation_max * 100", jr0("importance_inflation", 2), "inflation_max * 100", "true"),
    _chk("transition_formulaicness", "transitions > transition_max", jr0("transitions", 2), "transition_max", "transitions > transition_max * 2"),
    _chk("participial_density", "participial > participial_max", jr0("participial", 2), "participial_max", "participial > participial_max * 2"),
    _chk("clause_symmetry", "balance > max_balance", jr0("balance", 2), "max_balance", "balance > max_balance + 0.1::DOUBLE"),
    _chk("paragraph_arc_diversity", "same_arc > max_consecutive_same", "same_arc", "max_consecutive_same", "same_arc > max_consecutive_same + 2"),
    _chk("resolution_completeness", "abs(resolution - resolution_target) > 0.2::DOUBLE", jr0("resolution", 2), "resolution_target", "abs(resolution - resolution_target) > 0.4::DOUBLE"),
    _chk("binary_contrast_frequency", '("binary" < contrast_min OR "binary" > contrast_max)', jr0('"binary"', 2), 'CASE WHEN "binary" > contrast_max THEN contrast_max ELSE contrast_min END', '"binary" > contrast_max * 1.5::DOUBLE OR "binary" < contrast_min * 0.5::DOUBLE', "low"),
]))


def style(t):
    return profile.style_delta(t.feats, t.hits, dims.guides(t.spark))


@query("e04_style_delta", "SELECT * FROM sviol", once=True)
def _(t):
    return style(t)


@query("e05_style_distance", f"SELECT doc_id, guide, count(*) AS n_violations, {jr0('least(1.0, (sum(CASE severity WHEN ' + q('high') + ' THEN 10 WHEN ' + q('medium') + ' THEN 6 ELSE 3 END) / 10.0::DOUBLE) / 11)', 2)} AS distance FROM sviol GROUP BY ALL", once=True)
def _(t):
    return profile.style_distance(style(t))


@query("e06_guides", "SELECT d.doc_id, g.name FROM documents d JOIN guides g ON g.len_max > d.n_chars / 20")
def _(t):
    g = profile._guide_rows(dims.load_dims(t.spark)["guides"])
    d = t.documents.select("doc_id", "n_chars", F.explode(g).alias("g")).filter("g.len_max > n_chars / 20")
    return d.select("doc_id", F.col("g.name").alias("name"))


_r = lambda x, k: jr0(x, k)
cte("dguide", f"""SELECT doc_id, {_r('mean_length', 0)} AS len_mean, {_r('std_length', 0)} AS len_std, greatest(1.0, {_r('mean_length - std_length * 2', 0)}) AS len_min, {_r('mean_length + std_length * 2.5::DOUBLE', 0)} AS len_max,
  {_r('nominalization / 100', 2)} AS nominalization_max, {_r('participial', 2)} AS participial_max, {_r('coalesce(balance, 0.75)', 2)} AS max_balance, 2 AS max_consecutive_same, {_r('resolution', 2)} AS resolution_target,
  greatest(0.0, {_r('"binary" - 1', 1)}) AS contrast_min, {_r('"binary" + 2', 1)} AS contrast_max, {jr('greatest(autocorrelation + 0.05::DOUBLE, 0.15::DOUBLE)', 2)} AS max_rho, {jr('greatest(device_entropy - 0.3::DOUBLE, 1.5::DOUBLE)', 1)} AS entropy_min,
  {_r('importance_inflation / 100', 2)} AS inflation_max, {_r('transitions', 2)} AS transition_max, 0.5::DOUBLE AS continuity FROM meas""")


@query("e07_derive_guide", "SELECT * FROM dguide", once=True)
def _(t):
    return profile.derive_guide(t.feats, t.hits)


_num = lambda c: rf"regexp_replace(({c})::VARCHAR, '\.0$', '')"


@query("e08_voice_summary", f"SELECT doc_id, 'Sentence length ~' || {_num('len_mean')} || ' words. Vary rhythm (autocorrelation ≤' || {_num('max_rho')} || '). Device entropy ≥' || {_num('entropy_min')} || '. Nominalization max ' || {_num('nominalization_max')} || '.' AS voice FROM dguide", once=True)
def _(t):
    return profile.voice_summary(profile.derive_guide(t.feats, t.hits))


cte("clus", f"SELECT doc_id, type, n, sentences, n::DOUBLE / total AS density FROM (SELECT doc_id, type, count(*) AS n, string_agg(sent_id, ',' ORDER BY sent_id) AS sentences FROM hits GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS total FROM sents GROUP BY doc_id) USING (doc_id)")


def clusters(t):
    return profile.pattern_clusters(t.sents, t.hits).withColumn("sentences", F.array_join("sentences", ","))


@query("e09_pattern_clusters", "SELECT * FROM clus", once=True)
def _(t):
    return clusters(t)


@query("e10_playbook_clusters", "SELECT * FROM clus WHERE type IN (SELECT type FROM play)", once=True)
def _(t):
    return profile.playbook_clusters(clusters(t), dims.playbook(t.spark))


@query(
    "e11_playbook_scores",
    """SELECT doc_id, layer, label, hit_count, violation_count, n_patterns, row_number() OVER (PARTITION BY doc_id ORDER BY hit_count DESC, layer_pos) = 1 AS worst, sum(hit_count) OVER (PARTITION BY doc_id)::BIGINT AS total_hits FROM (
  SELECT d.doc_id, l.layer_pos, l.layer, l.label, coalesce(sum(CASE WHEN v > 0 THEN v ELSE 1 END) FILTER (WHERE v IS NOT NULL), 0)::BIGINT AS hit_count, coalesce(sum(v), 0)::BIGINT AS violation_count, count(v) AS n_patterns
  FROM documents d CROSS JOIN (SELECT DISTINCT layer_pos, layer, label FROM play) l LEFT JOIN (SELECT * FROM (
    SELECT n.doc_id, n.type, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT doc_id, type FROM hits) n LEFT JOIN (SELECT doc_id, type, count(*) AS v FROM viol GROUP BY ALL) v USING (doc_id, type)) JOIN play USING (type)) x ON x.doc_id = d.doc_id AND x.layer_pos = l.layer_pos GROUP BY ALL)""",
    once=True,
)
def _(t):
    return profile.playbook_scores(t.documents, t.hits, violations(t), dims.playbook(t.spark))


def _n(p, i=True):
    return f"len(regexp_extract_all(text, {q(('(?i)' if i else '') + p)}))"


cte("aud", f"""SELECT d.doc_id, d.text, {_n('—|--', False)} AS em, {_n(fixed.BINARY_REFRAME_RE)} + coalesce(r.n, 0) AS re, {_n(fixed.FORMAL_TRANSITION_RE, False)} AS ft, {_n(fixed.META_COMMENTARY_RE)} AS mc, {_n(fixed.VAGUE_ENDING_RE)} AS ve,
  {_n(fixed.THREE_ITEM_RE)} AS li, {_n(fixed.STIFF_FORM_RE)} AS st, coalesce(o.m, 0) AS op, coalesce(b.found, '') AS found, coalesce(b.n, 0) AS nb, coalesce(s.n, 0) AS sw, coalesce(s.lines, '') AS lines
  FROM mdocs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits WHERE type IN ('binary_contrast', 'negation_reframe') GROUP BY ALL) r USING (doc_id)
  LEFT JOIN (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, lower(regexp_extract(text, '^\\s*(?:[#>*-]+\\s*)*(\\w+)', 1)) AS w, count(*) AS c FROM paras GROUP BY ALL) WHERE w <> '' GROUP BY doc_id) o USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(word, ', ' ORDER BY pos) FILTER (WHERE k <= 5) AS found, count(*) AS n FROM (SELECT d.doc_id, b.word, b.pos, row_number() OVER (PARTITION BY d.doc_id ORDER BY b.pos) AS k FROM mdocs d JOIN banned b ON regexp_matches(d.text, b.re)) GROUP BY doc_id) b USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(line, '; ' ORDER BY k) FILTER (WHERE k <= 3) AS lines, sum(c)::BIGINT AS n FROM (SELECT doc_id, '"' || arg_min(matched, index) || '" → ' || any_value(suggestion) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY min(index)) AS k, count(*) AS c FROM swhits GROUP BY doc_id, word) GROUP BY doc_id) s USING (doc_id)""")
_checks = [
    ("em_dash", "em <= 1", "fail", "CASE WHEN em = 0 THEN 'No em dashes' ELSE '1 em dash' END", "em || ' em dashes found'"),
    ("worst_words", "nb = 0", "fail", "'No banned words'", "'Found: ' || found || CASE WHEN nb > 5 THEN '…' ELSE '' END"),
    ("lexicon_scan", "sw = 0", "fail", "'No lexicon hits'", "sw || ' banned phrase(s) — swap: ' || lines"),
    ("binary_reframe", "re = 0", "fail", "'No binary reframes'", "re || ' binary reframe signal(s)'"),
    ("formal_transitions", "ft = 0", "fail", "'No formal openers'", "ft || ' formal transition(s)'"),
    ("meta_commentary", "mc = 0", "fail", "'No meta-commentary'", "mc || ' meta-commentary phrase(s)'"),
    ("vague_ending", "ve = 0", "fail", "'No vague closers'", "ve || ' vague ending(s)'"),
    ("three_item_list", "li = 0", "warn", "'No three-item list chains'", "li || ' possible three-item list(s) — verify each needs three'"),
    ("paragraph_opener", "op < 3", "fail", "'Paragraph openers vary'", "op || ' paragraphs start the same way'"),
    ("contraction", "st <= 2", "warn", "CASE WHEN st = 0 THEN 'Contractions OK' ELSE st || ' stiff form(s)' END", "st || ' stiff forms (do not, cannot…) — consider contractions'"),
]
_aud = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS \"check\", true AS automated, CASE WHEN {ok} THEN 'pass' ELSE '{no}' END AS status, CASE WHEN {ok} THEN {good} ELSE {bad} END AS detail FROM aud" for n, ok, no, good, bad in _checks)
_aud += " UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, '{n}', false, 'manual', '' FROM aud" for n, _, a in fixed.AUDIT_CHECKS if not a)


@query("e12_audit", f"SELECT *, count(*) FILTER (WHERE status = 'pass') OVER (PARTITION BY doc_id) AS passed FROM ({_aud})")
def _(t):
    return profile.audit(t.docs, t.hits, split.ONE_LINE).withColumn("passed", F.col("passed").cast("bigint"))


cte("hc", "SELECT doc_id, sent_id, count(*) AS n_hits, sum(confidence::DECIMAL(18,6))::DOUBLE AS csum, max(confidence) AS cmax FROM hits GROUP BY ALL")
_imp = jr0("heat * CASE WHEN greatest(1, word_count) <= 20 THEN 1.2::DOUBLE WHEN word_count <= 35 THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n_hits >= 2 THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END * (0.65::DOUBLE + 0.35::DOUBLE * (csum / n_hits))", 6)


@query("e13_impact", f"SELECT doc_id, sent_id, {_imp} AS impact FROM hot JOIN hc USING (doc_id, sent_id)")
def _(t):
    return profile.sentence_impact(classified(t))


@query(
    "e14_eligible",
    f"SELECT doc_id, sent_id, {_imp} AS impact FROM hot JOIN hc USING (doc_id, sent_id) JOIN (SELECT doc_id, sum(word_count) AS words FROM sents GROUP BY doc_id) USING (doc_id) WHERE cmax >= 0.45 AND ((cmax >= 0.8 AND heat >= 1.0) OR heat >= CASE WHEN words <= 800 THEN 1.8 ELSE 2.5 END)",
    once=True,
)
def _(t):
    return profile.eligible(t.hot, t.hits).select("doc_id", "sent_id", "impact")


cte("budgets", "SELECT b.doc_id, w AS words, least(CASE WHEN w <= 150 THEN 2 WHEN w <= 500 THEN 3 WHEN w <= 1000 THEN 5 ELSE 3 END, coalesce(p.n, 0), greatest(1, ceil(b.n * 0.2::DOUBLE)))::BIGINT AS budget FROM (SELECT doc_id, sum(word_count) AS w, count(*) AS n FROM sents GROUP BY doc_id) b LEFT JOIN (SELECT doc_id, count(DISTINCT sent_id) AS n FROM hits GROUP BY doc_id) p USING (doc_id)")
cte("elig", f"SELECT h.doc_id, h.sent_id, h.paragraph_id, h.heat, {_imp.replace("heat *", "h.heat *")} AS impact, (SELECT arg_min(type, (-confidence, hit_pos)) FROM hits x WHERE x.doc_id = h.doc_id AND x.sent_id = h.sent_id) AS main, r.start_sentence AS region, r.heat AS region_heat, budgets.budget, CASE WHEN words <= 300 THEN 1 ELSE 2 END AS cap FROM hot h JOIN hc USING (doc_id, sent_id) JOIN budgets USING (doc_id) LEFT JOIN regions r ON r.doc_id = h.doc_id AND h.sent_id BETWEEN r.start_sentence AND r.end_sentence WHERE budget > 0 AND cmax >= 0.45 AND ((cmax >= 0.8 AND h.heat >= 1.0) OR h.heat >= CASE WHEN words <= 800 THEN 1.8 ELSE 2.5 END)")
cte("ranked1", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY region_heat DESC, region, impact DESC, sent_id) AS k FROM elig WHERE region IS NOT NULL")
cte("walk1", "SELECT DISTINCT doc_id, 0::BIGINT AS k, []::INT[] AS sents, []::INT[] AS paras, []::INT[] AS regs, []::VARCHAR[] AS mains FROM elig UNION ALL SELECT w.doc_id, c.k, CASE WHEN t THEN list_append(sents, c.sent_id) ELSE sents END, CASE WHEN t THEN list_append(paras, c.paragraph_id) ELSE paras END, CASE WHEN t THEN list_append(regs, c.region) ELSE regs END, CASE WHEN t THEN list_append(mains, c.main) ELSE mains END FROM walk1 w JOIN ranked1 c ON c.doc_id = w.doc_id AND c.k = w.k + 1, LATERAL (SELECT len(sents) < c.budget AND NOT list_contains(regs, c.region) AND len(list_filter(paras, lambda p: p = c.paragraph_id)) < c.cap AS t)")
cte("walked", "SELECT doc_id, arg_max(sents, k) AS sents, arg_max(paras, k) AS paras, arg_max(mains, k) AS mains FROM walk1 GROUP BY doc_id")
cte("ranked2", "SELECT e.*, row_number() OVER (PARTITION BY doc_id ORDER BY e.impact * CASE WHEN list_contains(walked.mains, e.main) THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END DESC, sent_id) AS k FROM elig e JOIN walked USING (doc_id) WHERE e.impact > 0 AND NOT list_contains(walked.sents, e.sent_id)")
cte("walk2", "SELECT doc_id, 0::BIGINT AS k, sents, paras FROM walked UNION ALL SELECT w.doc_id, c.k, CASE WHEN t THEN list_append(sents, c.sent_id) ELSE sents END, CASE WHEN t THEN list_append(paras, c.paragraph_id) ELSE paras END FROM walk2 w JOIN ranked2 c ON c.doc_id = w.doc_id AND c.k = w.k + 1, LATERAL (SELECT len(sents) < c.budget AND len(list_filter(paras, lambda p: p = c.paragraph_id)) < c.cap AS t)")


@query("e15_pick_hot", "SELECT e.doc_id, e.sent_id, e.heat, e.impact FROM elig e JOIN (SELECT doc_id, unnest(arg_max(sents, k)) AS sent_id FROM walk2 GROUP BY doc_id) p USING (doc_id, sent_id)", once=True)
def _(t):
    b = profile.budget(counts(t), t.hits)
    return profile.pick_hot(t.hot, t.hits, regions(t), b)


def counts(t):
    return t.sents.groupBy("doc_id").agg(F.sum("word_count").alias("word_count"), F.count(F.lit(1)).alias("sentence_count"))


@query(
    "e16_budget",
    "SELECT b.doc_id, least(CASE WHEN w <= 150 THEN 2 WHEN w <= 500 THEN 3 WHEN w <= 1000 THEN 5 ELSE 3 END, coalesce(p.n, 0), greatest(1, ceil(b.n * 0.2::DOUBLE)))::BIGINT AS budget FROM (SELECT doc_id, sum(word_count) AS w, count(*) AS n FROM sents GROUP BY doc_id) b LEFT JOIN (SELECT doc_id, count(DISTINCT sent_id) AS n FROM hits GROUP BY doc_id) p USING (doc_id)",
    once=True,
)
def _(t):
    return profile.budget(counts(t), t.hits)


_tol = ", ".join(f"({q(r[0])}, {r[7]['marketing']}::DOUBLE)" for r in fixed.REGISTRY if "marketing" in r[7])
cte("diag", f"""SELECT * FROM (SELECT n.doc_id, n.type, r.name, n.n, coalesce(v.v, 0) AS violations, row_number() OVER (PARTITION BY n.doc_id ORDER BY coalesce(v.v, 0) DESC, CASE r.amplification WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END, n.n DESC, n.f1, n.f2) AS rank
  FROM (SELECT doc_id, type, count(*) AS n, min(sent_id) AS f1, arg_min(hit_pos, sent_id) AS f2 FROM hits GROUP BY ALL) n LEFT JOIN (SELECT doc_id, type, count(*) AS v FROM viol GROUP BY ALL) v USING (doc_id, type) LEFT JOIN registry r USING (type)
  LEFT JOIN (VALUES {_tol}) g(type, tol) USING (type) WHERE coalesce(g.tol, 1.0) < 1.5) WHERE rank <= 5""")


def diagnosis(t):
    return profile.diagnose(t.hits, violations(t), t.registry, "marketing")


@query("e17_diagnose", "SELECT doc_id, rank, type, name, n, violations FROM diag", once=True)
def _(t):
    return diagnosis(t)


cte("pbtypes", "SELECT * FROM (VALUES " + ", ".join(f"({q(x)})" for x in dims.playbook_types()) + ") p(type)")


@query("e17_diagnose_passage", f"""SELECT doc_id, rank, type, name, n, violations FROM (SELECT n.doc_id, n.type, r.name, n.n, coalesce(v.v, 0) AS violations, row_number() OVER (PARTITION BY n.doc_id ORDER BY coalesce(v.v, 0) DESC, CASE r.amplification WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END, n.n DESC, n.f1, n.f2) AS rank
  FROM (SELECT doc_id, type, count(*) AS n, min(sent_id) AS f1, arg_min(hit_pos, sent_id) AS f2 FROM hits WHERE sent_id BETWEEN doc_id % 3 AND doc_id % 3 + 12 AND type IN (SELECT type FROM pbtypes) GROUP BY ALL) n LEFT JOIN (SELECT doc_id, type, count(*) AS v FROM viol GROUP BY ALL) v USING (doc_id, type) LEFT JOIN registry r USING (type)
  LEFT JOIN (VALUES {_tol}) g(type, tol) USING (type) WHERE coalesce(g.tol, 1.0) < 1.5) WHERE rank <= 5""", once=True)
def _(t):
    """Hits of thirteen sentences of every document, of the playbook's types."""
    passage = t.documents.select("doc_id", (F.col("doc_id") % 3).alias("start_sentence"), (F.col("doc_id") % 3 + 12).alias("end_sentence"))
    return profile.diagnose(t.hits, violations(t), t.registry, "marketing", passage=passage, playbook=dims.playbook(t.spark))


MENUS = [("hedging", 1, "State it."), ("hedging", 2, "Show the doubt."), ("llm_fingerprint_word", 1, "Use a plain word."), ("llm_fingerprint_word", 2, "Cut it."), ("llm_fingerprint_word", 3, "Name the thing."), ("em_dash_overuse", 1, "Use a comma.")]
cte("menu", "SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {b}, {q(c)})" for a, b, c in MENUS) + ") m(type, option, instruction)")


@query(
    "e18_avoid_lines",
    """SELECT doc_id, rank, type, coalesce(o.option, 0) AS option, CASE WHEN o.option IS NOT NULL THEN name || ' (' || n || '× detected' || CASE WHEN violations > 0 THEN ', ' || violations || ' window violation(s)' ELSE '' END || '): ' || o.instruction ELSE name || ' — avoid: ' || type END AS line FROM (
  SELECT d.*, CASE WHEN len(fresh) > 0 THEN fresh ELSE menu END AS pool FROM diag d LEFT JOIN (SELECT h.doc_id, m.type, list({'option': m.option, 'instruction': m.instruction} ORDER BY m.option) AS menu, list({'option': m.option, 'instruction': m.instruction} ORDER BY m.option) FILTER (WHERE m.option <> h.last_option) AS fresh FROM (SELECT doc_id, doc_id % 3 + 1 AS last_option FROM documents) h, menu m GROUP BY ALL) USING (doc_id, type)),
  LATERAL (SELECT pool[((doc_id * 31 + len(type) * 7 + 5) % len(pool)) + 1] AS o)""",
    once=True,
)
def _(t):
    menus = t.values(MENUS, "type string, option int, instruction string")
    d = diagnosis(t)
    history = d.select("doc_id", "type", (F.col("doc_id") % 3 + 1).alias("last_option"))
    return profile.avoid_lines(d, menus, history, seed=5)


@query(
    "e19_target_lines",
    f"""SELECT doc_id, replace(dimension, '_', ' ') || ': currently ' || {_num('current')} || ', target ' || {_num('target')} AS line FROM sviol WHERE guide = 'general'
  UNION ALL SELECT doc_id, {q(fixed.LINE_RHYTHM)} FROM profs WHERE autocorrelation > 0.3 UNION ALL SELECT doc_id, {q(fixed.LINE_VARIETY)} FROM profs WHERE device_entropy < 2.0 UNION ALL SELECT doc_id, {q(fixed.LINE_DECAY)} FROM profs WHERE convergence_slope < -0.1""",
    once=True,
)
def _(t):
    return profile.target_lines(profile.profile(classified(t)), style(t).filter("guide = 'general'"))


@query(
    "e19_personal_targets",
    f"""SELECT doc_id, replace(dimension, '_', ' ') || ': currently ' || {_num('current')} || ', target ' || {_num('target')} AS line FROM sviol WHERE guide = 'general'
  UNION ALL SELECT doc_id, {q(fixed.LINE_RHYTHM)} FROM profs WHERE autocorrelation > 0.3 UNION ALL SELECT doc_id, {q(fixed.LINE_VARIETY)} FROM profs WHERE device_entropy < 2.0 UNION ALL SELECT doc_id, {q(fixed.LINE_DECAY)} FROM profs WHERE convergence_slope < -0.1
  UNION ALL SELECT doc_id, 'Write as in ' || source FROM documents""",
    once=True,
)
def _(t):
    own = t.documents.select("doc_id", F.concat(F.lit("Write as in "), "source").alias("line"))
    return profile.target_lines(profile.profile(classified(t)), style(t).filter("guide = 'general'"), own)


@query("e18_directive_lines", "SELECT doc_id, rank, type, 0 AS option, name || ' — avoid: ' || 'use ' || name AS line FROM diag", once=True)
def _(t):
    """No menu holds the patterns: their own directives stand in."""
    d = diagnosis(t)
    none = t.values([], "type string, option int, instruction string")
    history = d.select("doc_id", "type", F.lit(1).alias("last_option"))
    own = t.registry.select("type", F.concat(F.lit("Do NOT use "), "name").alias("directive"))
    return profile.avoid_lines(d, none, history, directives=own)


@query("e20_registry_directives", "SELECT doc_id, rank, type, n, coalesce('Do NOT use ' || name, 'Avoid: ' || type) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f1, f2) AS rank FROM (SELECT doc_id, type, count(*) AS n, min(sent_id) AS f1, arg_min(hit_pos, sent_id) AS f2 FROM hits GROUP BY ALL)) LEFT JOIN registry USING (type) WHERE rank <= 8")
def _(t):
    return profile.avoid_directives(t.hits, t.registry.withColumn("directive", F.concat(F.lit("Do NOT use "), "name")))


@query("e20_avoid_directives", "SELECT doc_id, rank, type, n, 'Avoid: ' || type AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f1, f2) AS rank FROM (SELECT doc_id, type, count(*) AS n, min(sent_id) AS f1, arg_min(hit_pos, sent_id) AS f2 FROM hits GROUP BY ALL)) WHERE rank <= 8")
def _(t):
    return profile.avoid_directives(t.hits, t.registry)


@query(
    "e21_positive_targets",
    f"""SELECT doc_id, {q(fixed.POSITIVE_RHYTHM)} AS line FROM profs WHERE autocorrelation > 0.25 UNION ALL SELECT doc_id, {q(fixed.POSITIVE_VARIETY)} FROM profs WHERE device_entropy < 2.0 UNION ALL SELECT doc_id, {q(fixed.POSITIVE_DECAY)} FROM profs WHERE convergence_slope < -0.05
  UNION ALL SELECT doc_id, unnest(['Target sentence length std dev: 14+ words', 'Target device entropy: 3+', 'Keep rhythm autocorrelation below 0.15']) FROM profs""",
)
def _(t):
    return profile.positive_targets(profile.profile(classified(t)), profile.guides(dims.load_dims(t.spark), "fiction"))


_set = {
    "statement_force": ("doc_id % 5", ["tentative", "measured", "firm", "emphatic"]),
    "claim_certainty": ("doc_id % 6", ["qualify", "preserve", "strengthen", "reduce"]),
    "expression_budget": ("doc_id % 7", ["none", "one", "few", "preserve"]),
    "superlative_ceiling": ("doc_id % 4", ["none", "one_per_section", "preserve_if_evidence"]),
    "binary_contrast": ("doc_id % 3", ["avoid", "sparingly", "preserve_if_central"]),
    "abstraction_level": ("doc_id % 8", ["concrete", "balanced", "conceptual"]),
    "rhythm_policy": ("doc_id % 9", ["vary_openings", "break_mirrored", "preserve_cadence"]),
}
_setsql = {f: "CASE " + e + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vs)) + " END" for f, (e, vs) in _set.items()}
_lines = ", ".join(f"({q(f)}, {q(v)}, {q(x)}, {list(_set).index(f)})" for f, v, x in fixed.DIRECTIVES)


@query(
    "e22_directives",
    f"SELECT doc_id, line FROM ({' UNION ALL '.join(f'SELECT doc_id, {q(f)} AS field, {e} AS value FROM documents' for f, e in _setsql.items())}) JOIN (VALUES {_lines}) d(field, value, line, o) USING (field, value) UNION ALL SELECT doc_id, 'Additional notes: ' || source FROM documents",
)
def _(t):
    s = t.documents.select("doc_id", *[F.expr(e).alias(f) for f, e in _setsql.items()], F.concat(F.lit("  "), "source").alias("notes"))
    return profile.directives(s).select("doc_id", "line")


@query("e22_tone", f"SELECT doc_id, CASE WHEN f IS NULL AND b IS NULL THEN 'Default tone' ELSE 'Tone: ' || concat_ws(', ', f, b || ' strongest expressions') END AS line FROM (SELECT doc_id, {_setsql['statement_force']} AS f, {_setsql['expression_budget']} AS b FROM documents)")
def _(t):
    return profile.tone(t.documents.select("doc_id", *[F.expr(_setsql[f]).alias(f) for f in ("statement_force", "expression_budget")]))


_types = "(" + ", ".join(q(x) for x in fixed.OPPOSITION_TYPES) + ")"
_signal = q("(?i)" + fixed.OPPOSITION_SIGNAL_RE)
cte("oscan", f"""SELECT x.doc_id, x.sent_id, s.paragraph_id, s.text, x.type, arg_min(x.evidence, x.o) AS evidence FROM (
  SELECT doc_id, sent_id, type, evidence, hit_pos AS o FROM hits WHERE type IN {_types} UNION ALL SELECT doc_id, sent_id, type, evidence, 1000 + sub_pos * 10 + map_pos FROM cands JOIN mtypes USING (subcategory) WHERE type IN {_types}) x
  JOIN sents s USING (doc_id, sent_id) WHERE x.type <> 'clause_symmetry' OR regexp_matches(s.text, {_signal}) GROUP BY ALL""")


def scan(t):
    return profile.opposition_scan(t.sents, t.hits, cands(t), dims.marker_types(t.spark), t.rolling)


@query("e23_opposition_sentences", "SELECT doc_id, sent_id, paragraph_id, type, evidence FROM oscan", once=True)
def _(t):
    return scan(t)["sentences"]


@query("e23_opposition_paragraphs", "SELECT doc_id, paragraph_id, count(*) AS hit_count, string_agg(DISTINCT sent_id, ',' ORDER BY sent_id) AS sentence_ids, string_agg(DISTINCT type, ',' ORDER BY type) AS types, arg_min(text, sent_id) AS excerpt FROM oscan GROUP BY ALL", once=True)
def _(t):
    p = scan(t)["paragraphs"]
    return p.withColumn("sentence_ids", F.array_join("sentence_ids", ",")).withColumn("types", F.array_join("types", ","))


@query(
    "e23_opposition_sections",
    f"SELECT w.doc_id, w.size, w.start_sentence, w.end_sentence, w.word_count, count(DISTINCT o.sent_id) AS n_sentences, string_agg(DISTINCT o.type, ',' ORDER BY o.type) AS types, {jr0('count(*)::DOUBLE / w.word_count * 1000', 2)} AS density FROM rolling w JOIN oscan o ON o.doc_id = w.doc_id AND o.sent_id BETWEEN w.start_sentence AND w.end_sentence WHERE w.size <> 'narrow' GROUP BY w.doc_id, w.size, w.start_sentence, w.end_sentence, w.word_count",
    once=True,
)
def _(t):
    return scan(t)["sections"].withColumn("types", F.array_join("types", ","))


# ---------------------------------------------------------------- outputs of the whole analysis


def analysis(t):
    d = {"registry": t.registry, "thresholds": dims.thresholds(t.spark), "mapping": dims.marker_types(t.spark), "playbook": dims.playbook(t.spark)}
    return analyze.analyze_corpus(t.docs, RULES, split.ONE_LINE, lexicon=lexicon(t), dimensions=d, genre="marketing", mode="exhaustive", heat=2.0, once=True)


def _output(name, like, shape=lambda df: df):
    """Registers an output under the SQL of the operator that makes it alone."""

    @query(f"a02_{name}", ORACLES[like])
    def _(t):
        return shape(analysis(t)[name])


@query("c05_mode_off", "SELECT doc_id, sent_id, heat, NULL::VARCHAR AS subcategory FROM hot")
def _(t):
    """The whole analysis without the lexicon: sentences and their heat as ever, and no candidate."""
    d = {"registry": t.registry, "mapping": dims.marker_types(t.spark), "playbook": dims.playbook(t.spark)}
    out = analyze.analyze_corpus(t.docs, RULES, split.ONE_LINE, lexicon=lexicon(t), dimensions=d, mode="off")
    return out["sentences"].join(out["candidates"].select("doc_id", "sent_id", "subcategory"), ["doc_id", "sent_id"], "left").select("doc_id", "sent_id", "heat", "subcategory")


_output("windows", "d01_rolling_windows")
_output("rule_hits", "c13_classify_rules", lambda df: df.drop("hit_pos"))
_output("candidates", "c04_match_lexicon", lambda df: df.drop("sub_pos", "matcher_role", "source"))
_output("promoted", "c10_promote", lambda df: df.drop("hit_pos"))
_output("window_violations", "d16_density_violations")
_output("regions", "d19_hot_regions", lambda df: df.withColumn("primary_patterns", F.array_join("primary_patterns", ",")))
