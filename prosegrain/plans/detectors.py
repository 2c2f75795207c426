"""Queries on the statistical detectors (J)."""

from pyspark.sql import functions as F

from prosegrain.dims import fixed
from prosegrain.operators import split, taxonomy as T, windows
from prosegrain.plans.catalog import cte, jr0, q, query
from prosegrain.plans.rolling import _fw, ratio, scored

L = fixed.LEXICONS


def _ci(p):
    return q("(?i)" + p)


def _cnt(col, p, ci=True):
    return f"len(regexp_extract_all({col}, {_ci(p) if ci else q(p)}))"


def counted(table, unit, p, least=1, col="text"):
    return f"SELECT doc_id, {unit}::BIGINT AS unit_id, n::DOUBLE AS value, n >= {least} AS flagged FROM (SELECT *, {_cnt(col, p)} AS n FROM {table}) WHERE n > 0"


def whole(sql, value, flagged):
    return f"SELECT doc_id, 0::BIGINT AS unit_id, v::DOUBLE AS value, {flagged} AS flagged FROM (SELECT *, {value} AS v FROM ({sql}))"


def per_doc(where="true", **ps):
    return f"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, {', '.join(f'{_cnt("text", p)} AS {k}' for k, p in ps.items())} FROM mdocs) WHERE words > 0 AND {where}"


def rate(n):
    return jr0(f"{n} * 1000.0::DOUBLE / words", 3)


BARE = "regexp_replace(word, '[^a-z0-9'']', '', 'g')"


def _in(ws):
    return "(" + ", ".join(q(w) for w in ws) + ")"


def blocks(size, stride, flag):
    k = size // stride
    return f"SELECT doc_id, window_id, sum(words) OVER w AS words, sum(n) OVER w AS n FROM (SELECT doc_id, pos // {stride} AS window_id, count(*) AS words, count(*) FILTER (WHERE {flag}) AS n FROM tok GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id ORDER BY window_id RANGE BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"


def windowed(size, stride, flag, limit):
    return f"SELECT doc_id, window_id::BIGINT AS unit_id, n::DOUBLE AS value, n > {limit} AS flagged FROM ({blocks(size, stride, flag)}) WHERE n > 0"


cte("heads", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_id ORDER BY sent_id) AS k FROM sents) WHERE k = 1")
cte("psize", "SELECT doc_id, paragraph_id, count(*) AS sents_n, sum(word_count)::BIGINT AS words FROM sents GROUP BY ALL")


def paras(t):
    return split.split_paragraphs(t.docs, split.ONE_LINE)


_CON = _in(L["contraction"])
IMPORTANCE = L["importance"] + ["of crucial"]
RESUMPTIVE = L["resumptive"] + ["not only"]
PADDED = L["padded_verb"] + ["was considered"]
cte("o2", r"SELECT doc_id, sent_id, array_to_string([regexp_replace(lower(w), '[^a-z]', '', 'g') FOR w IN regexp_extract_all(text, '\S+')[1:2]], ' ') AS o FROM sents")
cte("hlines", "SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(replace(text, chr(10) || 'T', chr(10) || '- **T**: '), chr(10)) AS ls FROM mdocs)")
cte("readab", f"SELECT doc_id, chunk_id, {jr0('0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (y / w) - 15.59::DOUBLE', 2)} AS fk, {jr0('0.0588::DOUBLE * (c / w * 100) - 0.296::DOUBLE * (s / w * 100) - 15.8::DOUBLE', 2)} AS cl, {jr0('4.71::DOUBLE * (c / w) + 0.5::DOUBLE * (w / s) - 21.43::DOUBLE', 2)} AS ari FROM (SELECT doc_id, pos // 200 AS chunk_id, count(*)::DOUBLE AS w, greatest(1, count(*) FILTER (WHERE regexp_matches(word, '[.!?]')))::DOUBLE AS s, sum(greatest(1, len(regexp_extract_all({BARE}, '[aeiouy]+'))))::DOUBLE AS y, sum(len({BARE}))::DOUBLE AS c FROM tok GROUP BY ALL)")
cte("dwords", f"SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, {BARE} AS word FROM tok) WHERE word <> '' GROUP BY ALL")
cte("rarew", "SELECT word, f, n FROM (SELECT word, sum(c)::DOUBLE AS f, (SELECT sum(c) FROM dwords)::DOUBLE AS n FROM dwords GROUP BY word) WHERE f * 1e6 / n < 100")
cte("dregs", "SELECT doc_id, " + ", ".join(f"{jr0(f'sum({r}::DECIMAL(18,6))::DOUBLE / count(*)', 6)} AS {r}" for r in fixed.REGISTERS) + " FROM scored GROUP BY doc_id")
cte("qsents", "SELECT doc_id, sent_id, paragraph_id, word_count, CASE WHEN word_count % 5 = 0 THEN text || '?' ELSE text END AS text FROM sents")


SIMPLE = {
    "j01_importance": (counted("sents", "sent_id", T.phrase_re(IMPORTANCE)), lambda t: T.detect_importance(t.sents, IMPORTANCE)),
    "j02_resumptive": (counted("sents", "sent_id", T.phrase_re(RESUMPTIVE)), lambda t: T.detect_resumptive(t.sents, RESUMPTIVE)),
    "j03_hedge_stacks": (
        f"SELECT doc_id, pos::BIGINT AS unit_id, gap::DOUBLE AS value, gap <= 30 AS flagged FROM (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM tok WHERE {BARE} IN {_in(L['hedge'])}) WHERE gap IS NOT NULL",
        lambda t: T.detect_hedge_stacks(t.docs)),
    "j04_filler_openers": (
        f"SELECT doc_id, sent_id::BIGINT AS unit_id, gap::DOUBLE AS value, gap <= 200 AS flagged FROM (SELECT s.doc_id, s.sent_id, before - lag(before) OVER (PARTITION BY s.doc_id ORDER BY s.sent_id) AS gap FROM sents s JOIN cum USING (doc_id, sent_id) WHERE regexp_matches(s.text, {_ci(T.opener_re(L['filler_opener']))})) WHERE gap IS NOT NULL",
        lambda t: T.detect_filler_openers(t.sents)),
    "j05_em_dashes": (windowed(200, 100, "regexp_matches(word, '—|--')", 1), lambda t: T.detect_em_dashes(t.docs)),
    "j06_nominal_suffixes": (windowed(200, 100, f"regexp_matches({BARE}, '[a-z]{{2,}}(?:tion|ment|ness|ity|ence|ance)s?$')", 3), lambda t: T.detect_nominal_suffixes(t.docs)),
    "j07_pronouns": (
        f"SELECT doc_id, 0::BIGINT AS unit_id, {ratio('n_i', 'n_we')} AS value, n_it + n_this + n_that > n_i + n_we + n_you AS flagged, {', '.join(f'{rate("n_" + p)} AS rate_{p}' for p in ['i', 'we', 'you', 'it', 'this', 'that'])} FROM ({per_doc(**{f'n_{p}': rf'\b{p}\b' for p in ['i', 'we', 'you', 'it', 'this', 'that']})})",
        lambda t: T.detect_pronouns(t.docs)),
    "j08_downtoners": (whole(per_doc(n=T.phrase_re(L["downtoner"])), rate("n"), "v > 1.95 OR v < 1.125"), lambda t: T.detect_downtoners(t.docs)),
    "j09_content_ratio": (
        f"SELECT doc_id, window_id::BIGINT AS unit_id, v AS value, v < 0.8 OR v > 2.5 AS flagged FROM (SELECT *, {jr0('(words - n)::DOUBLE / n', 3)} AS v FROM ({blocks(500, 250, f'{BARE} IN {_fw}')}) WHERE n > 0)",
        lambda t: T.detect_content_ratio(t.docs)),
    "j10_sweeping_openers": (
        counted(r"(SELECT doc_id, paragraph_id, array_to_string(regexp_extract_all(text, '\S+')[1:15], ' ') AS text FROM paras)", "paragraph_id", T.phrase_re(L["sweeping_opener"])),
        lambda t: T.detect_sweeping_openers(paras(t))),
    "j11_stance": (whole(per_doc("n > 0", g=T.phrase_re(L["epistemic"]), n=T.phrase_re(L["institutional_hedge"])), ratio("g", "n"), "v < 1"), lambda t: T.detect_stance(t.docs)),
    "j12_contractions": (
        whole(f"SELECT doc_id, count(*) AS k, sum(n) AS n, sum(r::DECIMAL(18,6))::DOUBLE AS s, sum((r * r)::DECIMAL(28,6))::DOUBLE AS qq FROM (SELECT *, {rate('n')} AS r FROM ({blocks(200, 100, f'{BARE} IN {_CON}')})) GROUP BY doc_id HAVING sum(n) > 0", jr0("(qq - s * s / k) / k", 3), "v < 1 AND k >= 2"),
        lambda t: T.detect_contractions(t.docs)),
    "j13_intensifiers": (windowed(500, 250, f"{BARE} IN {_in(L['intensifier'])}", 3), lambda t: T.detect_intensifiers(t.docs)),
    "j14_evasion": (
        f"SELECT doc_id, sent_id::BIGINT AS unit_id, (paragraph_id = m)::INT::DOUBLE AS value, true AS flagged FROM (SELECT *, max(paragraph_id) OVER (PARTITION BY doc_id) AS m FROM sents) WHERE regexp_matches(text, {_ci(fixed.EVASIVE_RE)})",
        lambda t: T.detect_evasion(t.sents)),
    "j15_length_clusters": (
        f"SELECT doc_id, sent_id::BIGINT AS unit_id, v AS value, v < 4 AS flagged FROM (SELECT doc_id, sent_id, {jr0('sqrt(greatest(0.0, k * s2 - s1 * s1)) / k', 3)} AS v FROM (SELECT doc_id, sent_id, (count(*) OVER w)::DOUBLE AS k, (sum(word_count) OVER w)::DOUBLE AS s1, (sum(word_count * word_count) OVER w)::DOUBLE AS s2 FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE k = 10)",
        lambda t: T.detect_length_clusters(t.sents)),
    "j16_imperatives": (counted("sents", "sent_id", T.opener_re(L["imperative"])), lambda t: T.detect_imperatives(t.sents)),
    "j17_definitions": (counted("heads", "sent_id", fixed.DEFINITION_RE), lambda t: T.detect_definitions(t.sents)),
    "j18_previews": (counted("sents", "sent_id", fixed.PREVIEW_RE), lambda t: T.detect_previews(t.sents)),
    "j19_passives": (counted(f"(SELECT * FROM sents WHERE NOT regexp_matches(text, {_ci(r'\bby\b')}))", "sent_id", fixed.PASSIVE_RE), lambda t: T.detect_passives(t.sents)),
    "j20_participles": (counted("sents", "sent_id", fixed.PARTICIPLE_RE, 2), lambda t: T.detect_participles(t.sents)),
    "j20_participle_rate": (windowed(100, 50, f"regexp_matches({BARE}, '^[a-z]{{3,}}ing$')", 2), lambda t: T.detect_participle_rate(t.docs)),
    "j21_openers": (
        f"SELECT doc_id, sent_id::BIGINT AS unit_id, {jr0('u / k', 3)} AS value, {jr0('u / k', 3)} <= 0.6 AS flagged FROM (SELECT a.doc_id, a.sent_id, count(DISTINCT b.o)::DOUBLE AS u, count(*)::DOUBLE AS k FROM o2 a JOIN o2 b ON a.doc_id = b.doc_id AND b.sent_id BETWEEN a.sent_id - 9 AND a.sent_id GROUP BY ALL) WHERE k = 10",
        lambda t: T.detect_openers(t.sents)),
    "j22_punctuation": (
        f"SELECT doc_id, 0::BIGINT AS unit_id, {ratio('semicolon', 'colon')} AS value, colon > 0 AND {ratio('semicolon', 'colon')} < 0.5 AS flagged, {', '.join(f'{rate(k)} AS rate_{k}' for k in ['semicolon', 'colon', 'question', 'paren', 'exclaim', 'dash'])} FROM ({per_doc(semicolon=';', colon=':', question=r'\?', paren=r'\(', exclaim='!', dash='—|--')})",
        lambda t: T.detect_punctuation(t.docs)),
    "j23_while": (whole(r"SELECT doc_id, sum(word_count) AS words, count(*) FILTER (WHERE regexp_matches(text, '^While\b')) AS n FROM sents GROUP BY doc_id HAVING count(*) FILTER (WHERE regexp_matches(text, '^While\b')) > 0", rate("n"), "v > 4"), lambda t: T.detect_while(t.sents)),
    "j24_padded_verbs": (counted("sents", "sent_id", T.phrase_re(PADDED)), lambda t: T.detect_padded_verbs(t.sents, PADDED)),
    "j25_parallelism": (whole(f"SELECT * FROM (SELECT doc_id, sum(word_count) AS words, sum({_cnt('text', fixed.PARALLEL_RE)}) AS n FROM sents GROUP BY doc_id) WHERE n > 0", rate("n"), "v > 1.25"), lambda t: T.detect_parallelism(t.sents)),
    "j26_paragraph_lengths": (
        f"SELECT doc_id, paragraph_id::BIGINT AS unit_id, v AS value, v < 0.25 AS flagged FROM (SELECT doc_id, paragraph_id, {jr0('sqrt(greatest(0.0, k * s2 - s1 * s1)) / k * k / s1', 3)} AS v FROM (SELECT doc_id, paragraph_id, (count(*) OVER w)::DOUBLE AS k, (sum(words) OVER w)::DOUBLE AS s1, (sum(words * words) OVER w)::DOUBLE AS s2 FROM psize WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE k = 5)",
        lambda t: T.detect_paragraph_lengths(t.sents)),
    "j27_summaries": (counted("heads", "paragraph_id", T.opener_re(L["summary_marker"])), lambda t: T.detect_summaries(t.sents)),
    "j28_linking": (
        f"SELECT doc_id, paragraph_id::BIGINT AS unit_id, {jr0('n::DOUBLE / (k - 1)', 3)} AS value, {jr0('n::DOUBLE / (k - 1)', 3)} < 0.3 AS flagged FROM (SELECT doc_id, paragraph_id, count(*) AS k, count(*) FILTER (WHERE regexp_matches(text, {_ci(T.phrase_re(L['link_bundle']))})) AS n FROM sents GROUP BY ALL) WHERE k > 8",
        lambda t: T.detect_linking(t.sents)),
    "j29_markup": (counted("paras", "paragraph_id", fixed.MARKUP_RE, 2), lambda t: T.detect_markup(paras(t))),
    "j30_header_lists": (
        f"SELECT doc_id, min(pos)::BIGINT AS unit_id, count(*)::DOUBLE AS value, count(*) >= 3 AS flagged FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM hlines WHERE regexp_matches(line, {q(fixed.HEADER_ITEM_RE)})) GROUP BY doc_id, g",
        lambda t: T.detect_header_lists(headered(t))),
    "j31_entropy_decay": (
        "SELECT doc_id, min(start_sentence)::BIGINT AS unit_id, count(*)::DOUBLE AS value, count(*) >= 3 AS flagged FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY start_sentence) AS g FROM (SELECT doc_id, start_sentence, row_number() OVER w AS i, device_entropy < lag(device_entropy) OVER w AS fall FROM wdev WHERE size = 'medium' WINDOW w AS (PARTITION BY doc_id ORDER BY start_sentence)) WHERE fall) GROUP BY doc_id, g",
        lambda t: T.detect_entropy_decay(windows.window_device_entropy(t.rolling, t.hits))),
    "j32_even_sections": (whole("SELECT doc_id, max(abs((words * k)::DOUBLE / t - 1)) AS m FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k, sum(words) OVER (PARTITION BY doc_id) AS t FROM psize) WHERE k >= 2 GROUP BY doc_id", jr0("m", 3), "v <= 0.25"), lambda t: T.detect_even_sections(t.sents)),
    "j33_flat_register": (
        whole(f"SELECT doc_id, k, s, qq FROM (SELECT doc_id, count(*)::DOUBLE AS k, sum(r::DECIMAL(18,6))::DOUBLE AS s, sum((r * r)::DECIMAL(28,6))::DOUBLE AS qq FROM (SELECT doc_id, {jr0('(' + ' + '.join(_cnt('text', p) for p in [T.phrase_re(L['contraction']), chr(92) + 'b(?:i|we|my|our)' + chr(92) + 'b', chr(92) + '?', T.opener_re(L['imperative'])]) + ') * 1000.0::DOUBLE / len(regexp_extract_all(text, ' + q(chr(92) + 'S+') + '))', 3)} AS r FROM paras) GROUP BY doc_id) WHERE k >= 2", jr0("sqrt(greatest(0.0, k * qq - s * s)) / k", 2), "v < 5"),
        lambda t: T.detect_flat_register(paras(t))),
    "j34_positivity": (whole(per_doc("p > 0", p=T.phrase_re(L["positive"]), n=T.phrase_re(L["negative"])), ratio("n", "p"), "v < 0.7"), lambda t: T.detect_positivity(t.docs)),
    "j35_even_readability": (
        whole(f"SELECT doc_id, count(*)::DOUBLE AS k, sum(fk::DECIMAL(18,6))::DOUBLE AS s, sum((fk * fk)::DECIMAL(28,6))::DOUBLE AS qq FROM readab GROUP BY doc_id HAVING count(*) >= 2", jr0("sqrt(greatest(0.0, k * qq - s * s)) / k", 2), "v < 1"),
        lambda t: T.detect_even_readability(t.docs)),
    "j35_readability": ("SELECT * FROM readab", lambda t: T.readability(t.docs)),
    "j36_rare_tail": (
        whole("SELECT p.doc_id, sum(p.c) AS w, coalesce(sum(p.c) FILTER (WHERE r.word IS NOT NULL), 0) AS k, any_value(b.share) AS share FROM dwords p LEFT JOIN rarew r USING (word), (SELECT sum(f)::DOUBLE / any_value(n) AS share FROM rarew) b GROUP BY p.doc_id", jr0("k::DOUBLE / w", 4), "v < share * 0.5"),
        lambda t: T.detect_rare_tail(t.docs)),
    "j37_rigidity": (
        f"SELECT source, 0::BIGINT AS unit_id, v AS value, v < 0.15 AS flagged FROM (SELECT source, {jr0('(hi - lo) * k / s', 3)} AS v FROM (SELECT source, max(v) AS hi, min(v) AS lo, sum(v::DECIMAL(18,6))::DOUBLE AS s, count(*) AS k FROM (SELECT source, doc_id, {jr0('sum(abstract::DECIMAL(18,6))::DOUBLE / count(*)', 6)} AS v FROM feats JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY source) WHERE k >= 2 AND s > 0)",
        lambda t: T.detect_rigidity(source_scores(t))),
    "j38_vocabulary_collapse": (
        whole("SELECT * FROM (SELECT doc_id, count(*)::DOUBLE AS k, sum(i)::DOUBLE AS x, sum(u)::DOUBLE AS y, sum(i * u)::DOUBLE AS xy, sum(i * i)::DOUBLE AS xx FROM (SELECT doc_id, pos // 100 AS i, count(*) AS n, count(DISTINCT word) AS u FROM tok GROUP BY ALL) WHERE n = 100 GROUP BY doc_id) WHERE k >= 3", jr0("(k * xy - x * y) / (k * xx - x * x) / 100", 5), "v < 0"),
        lambda t: T.detect_vocabulary_collapse(t.docs)),
    "j39_fragments": (whole("SELECT doc_id, count(*) AS k, count(*) FILTER (WHERE sents_n = 1) AS n FROM psize GROUP BY doc_id", jr0("n::DOUBLE / k", 3), "v > 0.3"), lambda t: T.detect_fragments(t.sents)),
    "j40_self_answers": (
        r"SELECT doc_id, sent_id::BIGINT AS unit_id, word_count::DOUBLE AS value, true AS flagged FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id, paragraph_id ORDER BY sent_id) AS p FROM qsents) WHERE regexp_matches(p, '\?$') AND NOT regexp_matches(text, '\?$')",
        lambda t: T.detect_self_answers(asked(t))),
    "j41_whether_closer": (counted("(SELECT doc_id, max(sent_id) AS sent_id, replace(arg_max(text, sent_id), ' the', ' whether the or') AS text FROM sents GROUP BY doc_id)", "sent_id", fixed.WHETHER_RE), lambda t: T.detect_whether_closer(t.sents.withColumn("text", F.replace("text", F.lit(" the"), F.lit(" whether the or"))))),
    "j42_names": (whole(f"SELECT * FROM (SELECT doc_id, {' + '.join(f'regexp_matches(text, {_ci(T.phrase_re([n]))})::INT' for n in L['name'])} AS n FROM mdocs) WHERE n > 0", "n", "n >= 2"), lambda t: T.detect_names(t.docs)),
    "j43_burstiness": (whole("SELECT doc_id, count(*)::DOUBLE AS k, sum(word_count)::DOUBLE AS s, sum(word_count * word_count)::DOUBLE AS qq FROM sents GROUP BY doc_id HAVING count(*) >= 2", jr0("sqrt(greatest(0.0, k * qq - s * s)) / k * k / s", 3), "v < 0.5"), lambda t: T.detect_burstiness(t.sents)),
    "j44_register_distance": (
        whole("SELECT d.*, c.* FROM dregs d, (SELECT " + ", ".join(f"{jr0(f'sum({r}::DECIMAL(18,6))::DOUBLE / count(*)', 6)} AS c_{r}" for r in fixed.REGISTERS) + " FROM dregs) c", jr0("sqrt(" + " + ".join(f"({r} - c_{r}) * ({r} - c_{r})" for r in fixed.REGISTERS) + ")", 4), "v > 0.2"),
        lambda t: T.detect_register_distance(scored(t))),
    "j45_sensory": (
        whole(per_doc("n_visual + n_auditory + n_tactile + n_olfactory + n_gustatory > 0", **{f"n_{k}": T.phrase_re(L[k]) for k in ("visual", "auditory", "tactile", "olfactory", "gustatory")}), ratio("greatest(n_visual, n_auditory, n_tactile, n_olfactory, n_gustatory)", "(n_visual + n_auditory + n_tactile + n_olfactory + n_gustatory)"), "v > 0.6"),
        lambda t: T.detect_sensory(t.docs)),
}

def headered(t):
    """Lines turned into list items with bold headers, so that runs occur."""
    return t.docs.withColumn("text", F.replace("text", F.lit("\nT"), F.lit("\n- **T**: ")))


def asked(t):
    """Some sentences turned into questions."""
    return t.sents.withColumn("text", F.when(F.col("word_count") % 5 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")))


def source_scores(t):
    d = t.feats.groupBy("doc_id").agg(T.X.js_round(T.X.exact_sum(F.col("abstract")) / F.count(F.lit(1)), 6).alias("value"))
    return d.join(t.documents.select("doc_id", "source"), "doc_id")


for _name, (_sql, _fn) in SIMPLE.items():
    query(_name, _sql)(_fn)
