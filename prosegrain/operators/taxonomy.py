"""Statistical detectors. Each returns (doc_id, unit_id, value, flagged); the unit is a sentence, a
paragraph, a word window or the document, as the rule says. Word lists are arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.dims import fixed
from prosegrain.functions import exprs as X
from prosegrain.operators import windows

LEX = fixed.LEXICONS
ONE = "*"
MAX_PHRASES = 5000


def phrase_re(phrases) -> str:
    """One expression for a short list of phrases."""
    if len(phrases) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases; use match_lexicon")
    return r"\b(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in phrases) + r")\b"


def opener_re(phrases) -> str:
    return "^" + phrase_re(phrases)[2:]


def _n(c: Column, p: str, ignore_case: bool = True) -> Column:
    return X.match_count(c, p, ignore_case)


def _out(df: DataFrame, unit, value, flagged) -> DataFrame:
    return df.select("doc_id", (F.col(unit) if isinstance(unit, str) else unit).cast("bigint").alias("unit_id"), value.cast("double").alias("value"), flagged.alias("flagged"))


def _counted(df: DataFrame, unit: str, pattern: str, least: int = 1) -> DataFrame:
    """Units in which the pattern occurs, with the number of times."""
    d = df.withColumn("_n", _n(F.col("text"), pattern)).filter("_n > 0")
    return _out(d, unit, F.col("_n"), F.col("_n") >= least)


def _per_doc(docs: DataFrame, **patterns: str) -> DataFrame:
    """Words and matches per document; no shuffle, a document is one row. Filters stay above the generator, so nothing is counted again."""
    t = F.col("text")
    counts = F.struct(X.count_words(t).alias("words"), *[_n(t, p).alias(k) for k, p in patterns.items()])
    return docs.select("doc_id", F.inline(F.array(counts))).filter("words > 0")


def _rate(n: str) -> Column:
    return X.js_round(F.col(n) * 1000.0 / F.col("words"), 3)


def _whole(df: DataFrame, value: Column, flagged: Column) -> DataFrame:
    return _out(df, F.lit(0), value, flagged)


def bare(word: Column) -> Column:
    """A lower-cased word without its punctuation."""
    return F.regexp_replace(word, "[^a-z0-9']", "")


def block_windows(docs: DataFrame, size: int, stride: int, **flags) -> DataFrame:
    """(doc_id, window_id, words, <flag counts>) of sliding word windows.

    Words are counted once per stride block inside the document's row order and blocks are added up by
    a range frame, so no token is multiplied by the windows it lies in.
    """
    t = docs.select("doc_id", F.posexplode(X.words(F.lower("text"))).alias("pos", "word"))
    g = t.groupBy("doc_id", F.floor(F.col("pos") / stride).alias("window_id")).agg(
        F.count(ONE).alias("words"), *[F.sum(f(F.col("word")).cast("int")).alias(k) for k, f in flags.items()]
    )
    w = Window.partitionBy("doc_id").orderBy("window_id").rangeBetween(0, size // stride - 1)
    return g.select("doc_id", "window_id", *[F.sum(c).over(w).alias(c) for c in ["words", *flags]])


def _windowed(docs, size, stride, flag, limit) -> DataFrame:
    w = block_windows(docs, size, stride, n=flag).filter("n > 0")
    return _out(w, "window_id", F.col("n"), F.col("n") > limit)


# ---------------------------------------------------------------- lexical rules


def detect_importance(s, lexicon=LEX["importance"]):
    return _counted(s, "sent_id", phrase_re(lexicon))


def detect_resumptive(s, lexicon=LEX["resumptive"]):
    return _counted(s, "sent_id", phrase_re(lexicon))


def detect_hedge_stacks(docs, lexicon=LEX["hedge"], reach: int = 30):
    """A hedge within ``reach`` words of the one before; the unit is the word position."""
    t = docs.select("doc_id", F.posexplode(X.words(F.lower("text"))).alias("pos", "word")).filter(bare(F.col("word")).isin(list(lexicon)))
    t = t.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("gap is not null")
    return _out(t, "pos", F.col("gap"), F.col("gap") <= reach)


def detect_filler_openers(s, lexicon=LEX["filler_opener"], reach: int = 200):
    """A filler opener within ``reach`` words of the one before."""
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    at = F.coalesce(F.sum("word_count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = s.select("doc_id", "sent_id", at.alias("at"), X.matches(F.col("text"), opener_re(lexicon)).alias("hit")).filter("hit")
    d = d.withColumn("gap", F.col("at") - F.lag("at").over(w)).filter("gap is not null")
    return _out(d, "sent_id", F.col("gap"), F.col("gap") <= reach)


def detect_em_dashes(docs, size=200, stride=100, limit=1):
    return _windowed(docs, size, stride, lambda w: w.rlike("—|--"), limit)


def detect_nominal_suffixes(docs, size=200, stride=100, limit=3):
    return _windowed(docs, size, stride, lambda w: bare(w).rlike("[a-z]{2,}(?:tion|ment|ness|ity|ence|ance)s?$"), limit)


def detect_pronouns(docs):
    """I-to-we ratio, with the rate of each pronoun per 1000 words; flagged when impersonal ones lead."""
    names = ["i", "we", "you", "it", "this", "that"]
    d = _per_doc(docs, **{f"n_{p}": rf"\b{p}\b" for p in names})
    own, other = F.col("n_i") + F.col("n_we") + F.col("n_you"), F.col("n_it") + F.col("n_this") + F.col("n_that")
    return d.select(
        "doc_id", F.lit(0).cast("bigint").alias("unit_id"), X.ratio(F.col("n_i"), F.col("n_we")).alias("value"), (other > own).alias("flagged"),
        *[_rate(f"n_{p}").alias(f"rate_{p}") for p in names],
    )


def detect_downtoners(docs, lexicon=LEX["downtoner"], baseline: float = 1.5):
    d = _per_doc(docs, n=phrase_re(lexicon))
    return _whole(d, _rate("n"), (_rate("n") > baseline * 1.3) | (_rate("n") < baseline * 0.75))


def detect_content_ratio(docs, size=500, stride=250, low: float = 0.8, high: float = 2.5):
    w = block_windows(docs, size, stride, f=lambda x: bare(x).isin(fixed.FUNCTION_WORDS)).filter("f > 0")
    v = X.js_round((F.col("words") - F.col("f")) / F.col("f"), 3)
    return _out(w, "window_id", v, (v < low) | (v > high))


def detect_sweeping_openers(paras, lexicon=LEX["sweeping_opener"], head: int = 15):
    h = F.array_join(F.slice(X.words(F.col("text")), 1, head), " ")
    return _counted(paras.withColumn("text", h), "paragraph_id", phrase_re(lexicon))


def detect_stance(docs, genuine=LEX["epistemic"], institutional=LEX["institutional_hedge"]):
    d = _per_doc(docs, g=phrase_re(genuine), n=phrase_re(institutional)).filter("n > 0")
    v = X.ratio(F.col("g"), F.col("n"))
    return _whole(d, v, v < 1)


def detect_contractions(docs, lexicon=LEX["contraction"], size=200, stride=100, limit: float = 1.0):
    """Variance of the contraction rate (per 1000 words) over windows; low variance is the tell."""
    w = block_windows(docs, size, stride, n=lambda x: bare(x).isin(list(lexicon)))
    r = X.js_round(F.col("n") * 1000.0 / F.col("words"), 3)
    g = w.groupBy("doc_id").agg(
        F.count(ONE).alias("k"), F.sum("n").alias("n"), X.exact_sum(r).alias("s"), F.sum((r * r).cast("decimal(28,6)")).cast("double").alias("q")
    ).filter("n > 0")
    v = X.js_round((F.col("q") - F.col("s") * F.col("s") / F.col("k")) / F.col("k"), 3)
    return _whole(g, v, (v < limit) & (F.col("k") >= 2))


def detect_intensifiers(docs, lexicon=LEX["intensifier"], size=500, stride=250, limit=3):
    return _windowed(docs, size, stride, lambda w: bare(w).isin(list(lexicon)), limit)


def detect_evasion(s):
    """Sentences that call their topic complex; the value is 1 in the last paragraph."""
    last = F.max("paragraph_id").over(Window.partitionBy("doc_id"))
    d = s.withColumn("last", (F.col("paragraph_id") == last).cast("int")).filter(X.matches(F.col("text"), fixed.EVASIVE_RE))
    return _out(d, "sent_id", F.col("last"), F.lit(True))


# ---------------------------------------------------------------- sentence rules


def _frame(n: int):
    return Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(1 - n, 0)


def detect_length_clusters(s, n: int = 10, limit: float = 4.0):
    w, v = _frame(n), F.col("word_count").cast("double")
    d = s.withColumns({"k": F.count(ONE).over(w), "s1": F.sum(v).over(w), "s2": F.sum(v * v).over(w)}).filter(F.col("k") == n)
    sd = X.js_round(X.std_pop_of(F.col("k"), F.col("s1"), F.col("s2")), 3)
    return _out(d, "sent_id", sd, sd < limit)


def detect_imperatives(s, lexicon=LEX["imperative"]):
    return _counted(s, "sent_id", opener_re(lexicon))


def _heads(s):
    w = Window.partitionBy("doc_id", "paragraph_id").orderBy("sent_id")
    return s.withColumn("_k", F.row_number().over(w)).filter("_k = 1")


def detect_definitions(s):
    return _counted(_heads(s), "sent_id", fixed.DEFINITION_RE)


def detect_previews(s):
    return _counted(s, "sent_id", fixed.PREVIEW_RE)


def detect_passives(s):
    d = s.filter(~X.matches(F.col("text"), r"\bby\b"))
    return _counted(d, "sent_id", fixed.PASSIVE_RE)


def detect_participles(s, least: int = 2):
    return _counted(s, "sent_id", fixed.PARTICIPLE_RE, least)


def detect_participle_rate(docs, size=100, stride=50, limit=2):
    return _windowed(docs, size, stride, lambda w: bare(w).rlike("^[a-z]{3,}ing$"), limit)


def detect_openers(s, n: int = 10, limit: float = 0.6):
    """Share of different two-word openings in a window of ``n`` sentences."""
    o = s.withColumn("_o", X.opening_key(F.col("text"), 2))
    d = o.withColumn("k", F.count(ONE).over(_frame(n))).withColumn("u", F.size(F.collect_set("_o").over(_frame(n)))).filter(F.col("k") == n)
    v = X.js_round(F.col("u") / F.col("k"), 3)
    return _out(d, "sent_id", v, v <= limit)


def detect_punctuation(docs, limit: float = 0.5):
    """Semicolon-to-colon ratio with the rate of six marks per 1000 words."""
    marks = {"semicolon": ";", "colon": ":", "question": r"\?", "paren": r"\(", "exclaim": "!", "dash": "—|--"}
    d = _per_doc(docs, **marks)
    v = X.ratio(F.col("semicolon"), F.col("colon"))
    return d.select("doc_id", F.lit(0).cast("bigint").alias("unit_id"), v.alias("value"), ((F.col("colon") > 0) & (v < limit)).alias("flagged"),
                    *[_rate(k).alias(f"rate_{k}") for k in marks])


def detect_while(s, limit: float = 4.0):
    g = s.groupBy("doc_id").agg(F.sum("word_count").alias("words"), F.sum(X.matches(F.col("text"), r"^While\b", False).cast("int")).alias("n")).filter("n > 0")
    return _whole(g, _rate("n"), _rate("n") > limit)


def detect_padded_verbs(s, lexicon=LEX["padded_verb"]):
    return _counted(s, "sent_id", phrase_re(lexicon))


def detect_parallelism(s, limit: float = 1.25):
    g = s.groupBy("doc_id").agg(F.sum("word_count").alias("words"), F.sum(_n(F.col("text"), fixed.PARALLEL_RE)).alias("n")).filter("n > 0")
    return _whole(g, _rate("n"), _rate("n") > limit)


# ---------------------------------------------------------------- paragraph rules


def paragraph_sizes(s):
    return s.groupBy("doc_id", "paragraph_id").agg(F.count(ONE).alias("sents"), F.sum("word_count").alias("words"))


def detect_paragraph_lengths(s, n: int = 5, limit: float = 0.25):
    w, v = Window.partitionBy("doc_id").orderBy("paragraph_id").rowsBetween(1 - n, 0), F.col("words").cast("double")
    d = paragraph_sizes(s).withColumns({"k": F.count(ONE).over(w), "s1": F.sum(v).over(w), "s2": F.sum(v * v).over(w)}).filter(F.col("k") == n)
    cv = X.js_round(X.std_pop_of(F.col("k"), F.col("s1"), F.col("s2")) * F.col("k") / F.col("s1"), 3)
    return _out(d, "paragraph_id", cv, cv < limit)


def detect_summaries(s, lexicon=LEX["summary_marker"]):
    return _counted(_heads(s), "paragraph_id", opener_re(lexicon))


def detect_linking(s, lexicon=LEX["link_bundle"], least: int = 8, limit: float = 0.3):
    """Share of sentence transitions with an explicit link, in paragraphs of more than ``least`` sentences."""
    g = s.groupBy("doc_id", "paragraph_id").agg(F.count(ONE).alias("k"), F.sum(X.matches(F.col("text"), phrase_re(lexicon)).cast("int")).alias("n"))
    g = g.filter(F.col("k") > least)
    v = X.js_round(F.col("n") / (F.col("k") - 1), 3)
    return _out(g, "paragraph_id", v, v < limit)


def detect_markup(paras, least: int = 2):
    return _counted(paras, "paragraph_id", fixed.MARKUP_RE, least)


def detect_header_lists(docs, least: int = 3):
    """Runs of list lines that start with a bold header; the unit is the first line."""
    t = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(fixed.HEADER_ITEM_RE))
    t = t.withColumn("g", F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    g = t.groupBy("doc_id", "g").agg(F.min("pos").alias("pos"), F.count(ONE).alias("n"))
    return _out(g, "pos", F.col("n"), F.col("n") >= least)


def detect_fragments(s, limit: float = 0.3):
    """Share of paragraphs that hold one sentence."""
    g = paragraph_sizes(s).groupBy("doc_id").agg(F.count(ONE).alias("k"), F.sum((F.col("sents") == 1).cast("int")).alias("n"))
    v = X.js_round(F.col("n") / F.col("k"), 3)
    return _whole(g, v, v > limit)


# ---------------------------------------------------------------- document rules


def detect_entropy_decay(w, least: int = 3):
    """Runs of falling device entropy over medium windows(doc_id, start_sentence, device_entropy)."""
    o = Window.partitionBy("doc_id").orderBy("start_sentence")
    m = w.filter("size = 'medium'").select("doc_id", "start_sentence", F.row_number().over(o).alias("i"), (F.col("device_entropy") < F.lag("device_entropy").over(o)).alias("fall"))
    m = m.filter("fall").withColumn("g", F.col("i") - F.row_number().over(o))
    g = m.groupBy("doc_id", "g").agg(F.count(ONE).alias("n"), F.min("start_sentence").alias("at"))
    return _out(g, "at", F.col("n"), F.col("n") >= least)


def detect_even_sections(s, limit: float = 0.25):
    """Largest deviation of a section's length from the mean; sections are paragraphs."""
    p = paragraph_sizes(s)
    w = Window.partitionBy("doc_id")
    p = p.withColumns({"k": F.count(ONE).over(w), "t": F.sum("words").over(w)}).filter("k >= 2")
    g = p.groupBy("doc_id").agg(F.max(F.abs(F.col("words") * F.col("k") / F.col("t") - 1)).alias("v"))
    v = X.js_round(F.col("v"), 3)
    return _whole(g, v, v <= limit)


def detect_flat_register(paras, limit: float = 5.0):
    """Spread of informal markers per 1000 words over paragraphs."""
    t = F.col("text")
    marks = _n(t, phrase_re(LEX["contraction"])) + _n(t, r"\b(?:i|we|my|our)\b") + _n(t, r"\?") + _n(t, opener_re(LEX["imperative"]))
    r = X.js_round(marks * 1000.0 / X.count_words(t), 3)
    g = paras.select("doc_id", r.alias("r")).groupBy("doc_id").agg(F.count(ONE).alias("k"), X.exact_sum(F.col("r")).alias("s"), F.sum((F.col("r") * F.col("r")).cast("decimal(28,6)")).cast("double").alias("q"))
    v = X.js_round(X.std_pop_of(F.col("k"), F.col("s"), F.col("q")), 2)
    return _whole(g.filter("k >= 2"), v, v < limit)


def detect_positivity(docs, positive=LEX["positive"], negative=LEX["negative"], limit: float = 0.7):
    d = _per_doc(docs, p=phrase_re(positive), n=phrase_re(negative)).filter("p > 0")
    v = X.ratio(F.col("n"), F.col("p"))
    return _whole(d, v, v < limit)


def readability(docs, chunk: int = 200):
    """Three readability scores of each chunk of words: grade level, letter-based and character-based."""
    t = docs.select("doc_id", F.posexplode(X.words(F.lower("text"))).alias("pos", "word"))
    b = bare(F.col("word"))
    g = t.groupBy("doc_id", F.floor(F.col("pos") / chunk).alias("chunk_id")).agg(
        F.count(ONE).alias("w"), F.greatest(F.lit(1), F.sum(F.col("word").rlike("[.!?]").cast("int"))).alias("s"),
        F.sum(F.greatest(F.lit(1), F.regexp_count(b, F.lit("[aeiouy]+")))).alias("y"), F.sum(F.length(b)).alias("c"),
    )
    w, s, y, c = (F.col(k).cast("double") for k in "wsyc")
    return g.select(
        "doc_id", "chunk_id", X.js_round(0.39 * (w / s) + 11.8 * (y / w) - 15.59, 2).alias("fk"),
        X.js_round(0.0588 * (c / w * 100) - 0.296 * (s / w * 100) - 15.8, 2).alias("cl"),
        X.js_round(4.71 * (c / w) + 0.5 * (w / s) - 21.43, 2).alias("ari"),
    )


def detect_even_readability(docs, chunk: int = 200, limit: float = 1.0):
    r = readability(docs, chunk)
    v = F.col("fk")
    g = r.groupBy("doc_id").agg(F.count(ONE).alias("k"), X.exact_sum(v).alias("s"), F.sum((v * v).cast("decimal(28,6)")).cast("double").alias("q")).filter("k >= 2")
    sd = X.js_round(X.std_pop_of(F.col("k"), F.col("s"), F.col("q")), 2)
    return _whole(g, sd, sd < limit)


def detect_rare_tail(docs, per_million: float = 100.0, share: float = 0.5):
    """Share of a document's words that are rare in the corpus, against the corpus-wide share.

    Words are counted per document first; the corpus table is the sum of those counts, so a frequent
    word is never shuffled once per use. Words above the limit are few, at most a million divided by it, so they are
    broadcast and every other word is rare.
    """
    t = docs.select("doc_id", F.explode(X.words(F.lower("text"))).alias("word")).withColumn("word", bare(F.col("word"))).filter("word <> ''")
    per = t.groupBy("doc_id", "word").agg(F.count(ONE).alias("c"))
    freq = per.groupBy("word").agg(F.sum("c").alias("f"))
    total = freq.agg(F.sum("f").alias("n"))
    common = freq.join(F.broadcast(total)).filter(F.col("f") * 1e6 / F.col("n") >= per_million)
    used = common.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("used"))
    base = total.join(F.broadcast(used)).select(((F.col("n") - F.col("used")) / F.col("n")).alias("corpus_share"))
    g = per.join(F.broadcast(common.select("word", F.lit(1).alias("often"))), "word", "left").groupBy("doc_id").agg(F.sum("c").alias("w"), F.sum(F.when(F.col("often").isNull(), F.col("c")).otherwise(0)).alias("k"))
    v = X.js_round(F.col("k") / F.col("w"), 4)
    return _whole(g.join(F.broadcast(base)), v, v < F.col("corpus_share") * share)


def detect_rigidity(scores, limit: float = 0.15):
    """scores(source, doc_id, value): spread over mean across the documents of a source."""
    g = scores.groupBy("source").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), X.exact_sum(F.col("value")).alias("s"), F.count(ONE).alias("k")).filter("k >= 2 and s > 0")
    v = X.js_round((F.col("hi") - F.col("lo")) * F.col("k") / F.col("s"), 3)
    return g.select("source", F.lit(0).cast("bigint").alias("unit_id"), v.alias("value"), (v < limit).alias("flagged"))


def detect_vocabulary_collapse(docs, chunk: int = 100, least: int = 3):
    """Slope of the type-token ratio over full chunks of words."""
    ws = X.words(F.lower("text"))
    t = docs.select("doc_id", F.posexplode(ws).alias("pos", "word"))
    c = t.groupBy("doc_id", F.floor(F.col("pos") / chunk).alias("i")).agg(F.count(ONE).alias("n"), F.count_distinct("word").alias("u")).filter(F.col("n") == chunk)
    i, y = F.col("i").cast("double"), F.col("u").cast("double")
    g = c.groupBy("doc_id").agg(F.count(ONE).cast("double").alias("k"), F.sum(i).alias("x"), F.sum(y).alias("y"), F.sum(i * y).alias("xy"), F.sum(i * i).alias("xx")).filter(F.col("k") >= least)
    v = X.js_round((F.col("k") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("k") * F.col("xx") - F.col("x") * F.col("x")) / chunk, 5)
    return _whole(g, v, v < 0)


def detect_self_answers(s):
    """A sentence that follows a question of the same paragraph and is no question itself."""
    w = Window.partitionBy("doc_id", "paragraph_id").orderBy("sent_id")
    d = s.withColumn("_p", F.lag("text").over(w)).filter(F.col("_p").rlike(r"\?$") & ~F.col("text").rlike(r"\?$"))
    return _out(d, "sent_id", F.col("word_count"), F.lit(True))


def detect_whether_closer(s):
    last = s.groupBy("doc_id").agg(F.max_by(F.struct("sent_id", "text"), "sent_id").alias("l")).select("doc_id", "l.*")
    return _counted(last, "sent_id", fixed.WHETHER_RE)


def detect_names(docs, lexicon=LEX["name"], least: int = 2):
    found = F.filter(F.array(*[X.matches(F.col("text"), phrase_re([n])) for n in lexicon]), lambda b: b)
    d = docs.select("doc_id", F.size(found).alias("n")).filter("n > 0")
    return _whole(d, F.col("n"), F.col("n") >= least)


def detect_burstiness(s, limit: float = 0.5):
    """Length variation of a document's sentences."""
    v = F.col("word_count").cast("double")
    g = s.groupBy("doc_id").agg(F.count(ONE).alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).filter("k >= 2")
    cv = X.js_round(X.std_pop_of(F.col("k"), F.col("s"), F.col("q")) * F.col("k") / F.col("s"), 3)
    return _whole(g, cv, cv < limit)


def detect_register_distance(s, limit: float = 0.2):
    """Euclidean distance of a document's mean registers from the corpus centroid, which is one row."""
    dims = fixed.REGISTERS
    d = s.groupBy("doc_id").agg(*[X.js_round(X.exact_sum(F.col(r)) / F.count(ONE), 6).alias(r) for r in dims])
    c = d.agg(*[X.js_round(X.exact_sum(F.col(r)) / F.count(ONE), 6).alias(f"c_{r}") for r in dims])
    j = d.join(F.broadcast(c))
    v = X.js_round(F.sqrt(sum(((F.col(r) - F.col(f"c_{r}")) * (F.col(r) - F.col(f"c_{r}")) for r in dims), F.lit(0.0))), 4)
    return _whole(j, v, v > limit)


def detect_sensory(docs, limit: float = 0.6, **lists):
    """Largest share of one sense among sensory words."""
    senses = lists or {k: LEX[k] for k in ("visual", "auditory", "tactile", "olfactory", "gustatory")}
    d = _per_doc(docs, **{f"n_{k}": phrase_re(v) for k, v in senses.items()})
    cols = [F.col(f"n_{k}") for k in senses]
    total = sum(cols, F.lit(0))
    v = X.ratio(F.greatest(*cols), total)
    return _whole(d.filter(total > 0), v, v > limit)
