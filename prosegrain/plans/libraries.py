"""Queries on the document library (G). The library tables are derived from the shared ones."""

from pyspark.sql import functions as F

from prosegrain import dims
from prosegrain.operators import library as G
from prosegrain.plans.catalog import cte, jr, jr0, query

STATUS = "CASE doc_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'review' WHEN 2 THEN 'done' END"
COLS = f"""doc_id, 'Doc ' || doc_id || ' ' || lang AS title, doc_id % 7 AS user_id, source AS workspace_id, {STATUS} AS status,
  n_chars // 6 AS word_count, n_chars // 60 AS sentence_count, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 37 % 100) / 10.0::DOUBLE END AS mean_heat,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id // 5 END AS folder_id"""
cte("lib", f"SELECT {COLS}, CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 60)::INT, '%Y-%m-%d') || 'T00:00:00Z' END AS due_date, TIMESTAMP '2024-01-01' + to_days((doc_id * 13 % 400)::INT) AS created_at, TIMESTAMP '2024-06-01' + to_hours((doc_id * 7 % 900)::INT) AS updated_at FROM documents")
cte("tags", "SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, 'even' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 2000")
cte("folders", "SELECT folder_id, CASE WHEN folder_id = 0 THEN NULL WHEN folder_id % 17 = 5 THEN 100000000 + folder_id WHEN folder_id = 9 THEN 30 ELSE (folder_id - 1) // 3 END AS parent_id, 'F' || folder_id AS name FROM (SELECT DISTINCT doc_id // 5 AS folder_id FROM documents)")


def lib(t):
    c = COLS.replace("::DOUBLE", "D").replace("n_chars // 6 ", "n_chars div 6 ").replace("n_chars // 60", "n_chars div 60").replace("doc_id // 5", "doc_id div 5")
    return t.documents.selectExpr(
        *[x.strip() for x in _split(c)],
        "CASE WHEN doc_id % 3 = 0 THEN date_format(date_add(DATE'2024-01-01', cast(doc_id % 60 AS int)), 'yyyy-MM-dd') || 'T00:00:00Z' END AS due_date",
        "TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, cast(doc_id * 13 % 400 AS int)) AS created_at",
        "TIMESTAMP'2024-06-01' + make_interval(0, 0, 0, 0, cast(doc_id * 7 % 900 AS int)) AS updated_at",
    )


def _split(text):
    """Top-level comma-separated expressions; commas in brackets or strings do not count."""
    out, depth, cur, quoted = [], 0, "", False
    for ch in text:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def tags(t):
    extra = F.array_compact(F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("even")), F.when(F.col("n_chars") > 2000, F.lit("long"))))
    return t.documents.select("doc_id", F.explode(extra).alias("tag"))


def folders(t):
    f = t.documents.select(F.expr("doc_id div 5").alias("folder_id")).distinct()
    return f.selectExpr("folder_id", "CASE WHEN folder_id = 0 THEN NULL WHEN folder_id % 17 = 5 THEN 100000000 + folder_id WHEN folder_id = 9 THEN 30 ELSE (folder_id - 1) div 3 END AS parent_id", "'F' || folder_id AS name")


SHOW = "doc_id, title, word_count, coalesce(status, '') AS status"


@query("g01_list_documents", f"SELECT {SHOW}, mean_heat, (SELECT string_agg(tag, ',' ORDER BY tag) FROM tags x WHERE x.doc_id = lib.doc_id) AS tags FROM lib WHERE user_id = 3 AND status IN ('draft', 'review') AND mean_heat >= 1.5 AND mean_heat <= 9 AND due_date IS NOT NULL AND doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('even', 'fr'))")
def _(t):
    d = G.list_documents(lib(t), tags(t), 3, statuses=["draft", "review"], heat_min=1.5, heat_max=9, has_due_date=True, any_tags=["even", "fr"], sort="title")
    return d.select("doc_id", "title", "word_count", F.coalesce("status", F.lit("")).alias("status"), "mean_heat", F.array_join("tags", ",").alias("tags"))


@query("g02_with_tags", "SELECT doc_id, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM tags x WHERE x.doc_id = lib.doc_id AND tag <> 'en'), '') AS tags FROM lib")
def _(t):
    return G.with_tags(lib(t), tags(t).filter("tag <> 'en'")).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("g03_document", f"SELECT {SHOW} FROM lib WHERE doc_id = 17")
def _(t):
    return G.document(lib(t), 17).select("doc_id", "title", "word_count", F.coalesce("status", F.lit("")).alias("status"))


@query(
    "g04_workspace_rollup",
    f"SELECT workspace_id, count(*) AS document_count, sum(word_count)::BIGINT AS total_words, {jr('sum(mean_heat::DECIMAL(18,6))::DOUBLE / count(mean_heat)', 6)} AS avg_heat, count(*) FILTER (WHERE mean_heat < 3) AS cool, count(*) FILTER (WHERE mean_heat >= 3 AND mean_heat < 6) AS warm, count(*) FILTER (WHERE mean_heat >= 6) AS hot, count(*) FILTER (WHERE mean_heat IS NULL) AS unanalyzed, (SELECT string_agg(status || ':' || c, ',' ORDER BY status) FROM (SELECT status, count(*) AS c FROM lib y WHERE y.workspace_id = lib.workspace_id AND status IS NOT NULL GROUP BY status)) AS statuses FROM lib GROUP BY workspace_id",
)
def _(t):
    r = G.workspace_rollup(lib(t))
    return r.withColumn("statuses", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")).withColumn("avg_heat", jround(F.col("avg_heat")))


def jround(c):
    from prosegrain.functions import exprs as X

    return X.js_round(X.js_round(c, 9), 6)


@query("g05_workspace_tags", "SELECT DISTINCT workspace_id, tag FROM lib JOIN tags USING (doc_id)")
def _(t):
    return G.workspace_tags(lib(t), tags(t))


@query("g06_member_workspaces", "SELECT w.workspace_id, m.user_id FROM (SELECT DISTINCT workspace_id, workspace_id IN ('src3', 'src4') AS archived FROM lib) w JOIN (SELECT DISTINCT user_id, workspace_id FROM lib) m USING (workspace_id) WHERE NOT archived")
def _(t):
    ws = lib(t).select("workspace_id").distinct().withColumn("archived", F.col("workspace_id").isin("src3", "src4")).withColumn("name", F.col("workspace_id"))
    return G.member_workspaces(ws, lib(t).select("user_id", "workspace_id").distinct()).select("workspace_id", "user_id")


@query("g07_corpus_stats", f"SELECT count(*) AS documents, sum(word_count)::BIGINT AS words, {jr('sum(mean_heat::DECIMAL(18,6))::DOUBLE / count(mean_heat)', 6)} AS avg_heat, (SELECT doc_id FROM lib WHERE mean_heat IS NOT NULL ORDER BY mean_heat, doc_id LIMIT 1) AS best_doc, (SELECT doc_id FROM lib WHERE mean_heat IS NOT NULL ORDER BY mean_heat DESC, doc_id DESC LIMIT 1) AS worst_doc FROM lib")
def _(t):
    return G.corpus_stats(lib(t)).withColumn("avg_heat", jround(F.col("avg_heat")))


@query("g08_words_per_month", "SELECT strftime(m, '%Y-%m') AS month, coalesce((SELECT sum(word_count) FROM lib WHERE date_trunc('month', created_at) = m), 0)::BIGINT AS words FROM (SELECT unnest(generate_series(TIMESTAMP '2024-11-01', TIMESTAMP '2025-04-01', INTERVAL 1 MONTH)) AS m)")
def _(t):
    return G.words_per_month(lib(t), "2025-04-15").withColumn("month", F.date_format("month", "yyyy-MM"))


@query("g09_deadlines", "SELECT left(due_date, 10) AS day, doc_id, count(*) OVER (PARTITION BY left(due_date, 10)) AS n FROM lib WHERE due_date IS NOT NULL")
def _(t):
    return G.deadlines(lib(t)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "doc_id", "n")


@query("g10_month_grid", "SELECT strftime(d, '%Y-%m-%d') AS day, month(d) = 2 AS in_month, doc_id, (SELECT count(*) FROM lib WHERE left(due_date, 10) = strftime(d, '%Y-%m-%d')) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-28', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)) AS d) LEFT JOIN lib ON left(due_date, 10) = strftime(d, '%Y-%m-%d')")
def _(t):
    return G.month_grid(lib(t), "2024-02-10").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "in_month", "doc_id", "n")


cte("ftree", "SELECT f.folder_id, 0 AS depth, f.folder_id AS root_id FROM folders f WHERE f.parent_id IS NULL OR f.parent_id NOT IN (SELECT folder_id FROM folders) UNION ALL SELECT f.folder_id, t.depth + 1, t.root_id FROM ftree t JOIN folders f ON f.parent_id = t.folder_id")
cte("fanc", "SELECT folder_id, folder_id AS ancestor_id, parent_id, name, 0 AS distance, [folder_id] AS seen FROM folders UNION ALL SELECT a.folder_id, f.folder_id, f.parent_id, f.name, a.distance + 1, list_append(a.seen, f.folder_id) FROM fanc a JOIN folders f ON f.folder_id = a.parent_id WHERE NOT list_contains(a.seen, f.folder_id)")


@query("g11_folder_tree", "SELECT folder_id, depth, root_id FROM ftree")
def _(t):
    return G.folder_tree(folders(t)).select("folder_id", "depth", "root_id")


@query("g12_ancestors", "SELECT folder_id, ancestor_id, distance FROM fanc")
def _(t):
    return G.ancestors(folders(t)).drop("name")


@query("g13_search_documents", "SELECT doc_id, title FROM lib WHERE contains(lower(title), '7 en')")
def _(t):
    return G.search(lib(t), folders(t), "7 EN")[0].select("doc_id", "title")


@query("g13_search_folders", "SELECT DISTINCT ancestor_id AS folder_id FROM fanc WHERE folder_id IN (SELECT folder_id FROM lib WHERE contains(lower(title), '7 en'))")
def _(t):
    return G.search(lib(t), folders(t), "7 EN")[1].select("folder_id")


@query("g14_folder_paths", "SELECT folder_id, string_agg(name, ' / ' ORDER BY distance DESC) AS path, count(*) AS depth FROM fanc GROUP BY folder_id")
def _(t):
    return G.folder_paths(folders(t))


@query("g15_changed_since", "SELECT doc_id FROM lib WHERE updated_at > TIMESTAMP '2024-06-20'")
def _(t):
    return G.changed_since(lib(t), "2024-06-20").select("doc_id")


def iterations(t):
    return t.read("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("iteration_id"), F.col("ts").alias("created_at"), F.col("props").alias("profile"), "event_type", "value")


@query("g16_history", "SELECT doc_id, iteration_id, rank, k FROM (SELECT user_id AS doc_id, event_id AS iteration_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events) WHERE rank <= 20")
def _(t):
    return G.history(iterations(t), 20, ["k"]).select("doc_id", "iteration_id", "rank", F.coalesce("k", F.lit("")).alias("k"))


@query("g17_latest_version", "SELECT user_id AS doc_id, arg_max(event_id, (ts, event_id)) AS version_id, arg_max(event_type, (ts, event_id)) AS content FROM events GROUP BY user_id")
def _(t):
    v = iterations(t).select("doc_id", F.col("iteration_id").alias("version_id"), "created_at", F.col("event_type").alias("content"))
    return G.latest_version(v).select("doc_id", "version_id", "content")


@query("g18_snapshots", "SELECT doc_id, save_id, content FROM (SELECT user_id AS doc_id, event_id AS save_id, event_type AS content, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> content")
def _(t):
    s = iterations(t).select("doc_id", F.col("created_at").alias("saved_at"), F.col("iteration_id").alias("save_id"), F.col("event_type").alias("content"))
    return G.snapshots(s).drop("saved_at")


_ver = "SELECT doc_id // 4 AS doc_id, doc_id % 4 + 1 AS version, coalesce(mean_heat, 0.0) AS mean_heat, word_count, sentence_count, (word_count % 30) / 10.0 AS device_entropy, (sentence_count % 9) / 10.0 AS autocorrelation FROM lib"
cte("vers", _ver)


@query(
    "g19_compare_versions",
    " UNION ALL ".join(
        f"SELECT a.doc_id, '{n}' AS metric, a.{c}::DOUBLE AS before, b.{c}::DOUBLE AS after, {jr(f'b.{c}::DOUBLE - a.{c}::DOUBLE', 9)} AS delta, ({jr(f'b.{c}::DOUBLE - a.{c}::DOUBLE', 9)}) * {-1 if low else 1} > 0 AS improved FROM vers a JOIN vers b USING (doc_id) WHERE a.version = 1 AND b.version = 3"
        for n, c, low in G.compare.DELTA
    ),
)
def _(t):
    v = lib(t).selectExpr("doc_id div 4 AS doc_id", "doc_id % 4 + 1 AS version", "coalesce(mean_heat, 0D) AS mean_heat", "word_count", "sentence_count", "(word_count % 30) / 10D AS device_entropy", "(sentence_count % 9) / 10D AS autocorrelation")
    return G.compare_versions(v, 1, 3)


@query("g20_browse", "SELECT doc_id FROM lib WHERE workspace_id = 'src3' ORDER BY updated_at DESC, doc_id LIMIT 20")
def _(t):
    return G.browse(lib(t), workspace="src3", n=20).select("doc_id")


_lv = "CASE doc_id % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'sentence' WHEN 2 THEN 'paragraph' ELSE 'document' END"
cte("userp", f"SELECT 'p' || doc_id AS pattern_id, 'U-' || doc_id AS taxonomy_id, 'Pattern ' || doc_id || ' ' || lang AS name, {_lv} AS level, lang AS tag, doc_id % 7 AS user_id, doc_id FROM documents")
cte("builtp", "SELECT type AS pattern_id, taxonomy_id, name, level, CASE WHEN playbook = 1 THEN 'playbook-copy' ELSE '' END AS tag, weight FROM registry")
cte("allp", "SELECT pattern_id, taxonomy_id, name, level, tag, 'platform' AS scope FROM builtp UNION ALL SELECT pattern_id, taxonomy_id, name, level, tag, 'user' FROM userp")


def userp(t):
    return t.documents.selectExpr("'p' || doc_id AS pattern_id", "'U-' || doc_id AS taxonomy_id", "'Pattern ' || doc_id || ' ' || lang AS name", f"{_lv} AS level", "array(lang) AS tags", "doc_id % 7 AS user_id", "TIMESTAMP'2024-06-01' AS updated_at", "doc_id")


def builtp(t):
    r = dims.registry(t.spark)
    tags_ = F.when(F.col("playbook") == 1, F.array(F.lit("playbook-copy"))).otherwise(F.array().cast("array<string>"))
    return r.select(F.col("type").alias("pattern_id"), "taxonomy_id", "name", "level", tags_.alias("tags"), "weight").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))


@query("g21_catalogue", "SELECT pattern_id, scope, level, (SELECT count(*) FROM allp WHERE level IN ('lexical', 'sentence') AND tag IN ('playbook-copy', 'fr')) AS total FROM (SELECT * FROM allp WHERE level IN ('lexical', 'sentence') AND tag IN ('playbook-copy', 'fr') ORDER BY level, taxonomy_id, scope, pattern_id LIMIT 25 OFFSET 5)")
def _(t):
    return G.catalogue(builtp(t), userp(t), levels=["lexical", "sentence"], tags=["playbook-copy", "fr"], sort="level", limit=25, offset=5).select("pattern_id", "scope", "level", "total")


@query("g22_search_stored", "SELECT pattern_id FROM userp WHERE lower(name) LIKE '%n 1%' OR lower(pattern_id) LIKE '%n 1%' OR lower(taxonomy_id) LIKE '%n 1%'")
def _(t):
    return G.search_stored(userp(t), "n 1").select("pattern_id")


@query("g23_export_patterns", "SELECT CASE scope WHEN 'platform' THEN 'platform:' || pattern_id ELSE pattern_id END AS id, level FROM allp WHERE level = 'document'")
def _(t):
    return G.export_patterns(builtp(t).drop("updated_at", "weight"), userp(t).drop("updated_at", "user_id", "doc_id"), level="document").select("id", "level")


_new = "doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE 'q' END || (doc_id % 50 + 30) END AS pattern_id, 'N' AS name, CASE WHEN doc_id % 5 = 1 THEN 'word' ELSE 'lexical' END AS level, 'hint' AS detection_hint"


@query("g24_check_import", f"SELECT pos, CASE WHEN NOT ok THEN 'invalid' WHEN pattern_id IN (SELECT pattern_id FROM userp) THEN 'conflict' WHEN row_number() OVER (PARTITION BY pattern_id, ok ORDER BY pos) > 1 THEN 'duplicate' ELSE 'valid' END AS status FROM (SELECT *, pattern_id IS NOT NULL AND level = 'lexical' AS ok FROM (SELECT {_new} FROM documents))")
def _(t):
    new = t.documents.selectExpr(*[x.strip() for x in _split(_new)])
    return G.check_import(new, userp(t)).select("pos", "status")


@query("g25_fork", "SELECT d.doc_id AS user_id, b.pattern_id, CASE WHEN d.doc_id % 3 = 0 THEN 'Mine' ELSE b.name END AS name, b.level, CASE WHEN d.doc_id % 2 = 0 THEN 0.1 ELSE b.weight END AS weight, 1 AS version FROM documents d JOIN builtp b ON b.pattern_id IN ('hedging', 'nominalization') WHERE NOT (d.doc_id % 4 = 1 AND b.pattern_id = 'hedging')")
def _(t):
    ids = t.documents.select(F.col("doc_id").alias("user_id"), F.explode(F.array(F.lit("hedging"), F.lit("nominalization"))).alias("pattern_id"))
    ids = ids.selectExpr("user_id", "pattern_id", "CASE WHEN user_id % 3 = 0 THEN 'Mine' END AS name", "cast(NULL AS string) AS level", "CASE WHEN user_id % 2 = 0 THEN 0.1D END AS weight")
    have = t.documents.filter("doc_id % 4 = 1").select(F.col("doc_id").alias("user_id"), F.lit("hedging").alias("pattern_id"))
    return G.fork(ids, builtp(t), have).drop("forked_from")


@query("g26_pattern_as_of", "SELECT doc_id // 4 AS pattern_id, 2 AS version, lang AS snapshot FROM documents WHERE doc_id % 4 + 1 = 2")
def _(t):
    return G.pattern_as_of(pv(t), 2)


def pv(t):
    return t.documents.selectExpr("doc_id div 4 AS pattern_id", "cast(doc_id % 4 + 1 AS int) AS version", "lang AS snapshot")


@query("g26_revert", "SELECT d.doc_id // 4 AS pattern_id, m.v AS version, d.lang AS snapshot, 'Reverted to version 2' AS change_summary FROM documents d JOIN (SELECT doc_id // 4 AS p, max(doc_id % 4 + 1) + 1 AS v FROM documents GROUP BY ALL) m ON m.p = d.doc_id // 4 WHERE d.doc_id % 4 + 1 = 2")
def _(t):
    return G.revert(pv(t), 2)


@query("g27_completeness", "SELECT pattern_id, doc_id % 2 = 0 AS no_hint, doc_id % 3 > 0 AS no_examples, doc_id % 5 > 0 AS no_menu FROM userp")
def _(t):
    p = userp(t).selectExpr("pattern_id", "CASE WHEN doc_id % 2 = 1 THEN 'h' ELSE ' ' END AS detection_hint", "CASE WHEN doc_id % 3 = 0 THEN array('e') ELSE array() END AS examples", "CASE WHEN doc_id % 5 = 0 THEN array('m') END AS rewrite_menu")
    return G.completeness(p)


@query("g28_patterns", "SELECT pattern_id FROM userp WHERE level = 'sentence' AND tag = 'en'")
def _(t):
    return G.patterns(userp(t), level="sentence", tag="en").select("pattern_id")


@query(
    "g29_daily_usage",
    f"SELECT strftime(day, '%Y-%m-%d') AS day, provider, n, coalesce(l, 0) AS daily_limit, coalesce({jr0('n::DOUBLE / l * 100', 0)}, -1.0) AS pct, coalesce(n::DOUBLE / l >= 0.8, false) AS near_limit FROM (SELECT date_trunc('day', ts) AS day, event_type AS provider, count(*) AS n FROM events GROUP BY ALL) LEFT JOIN (VALUES ('click', 20), ('view', 500)) v(provider, l) USING (provider)",
)
def _(t):
    ev = t.read("events").select("ts", F.col("event_type").alias("provider"))
    limits = t.values([("click", 20), ("view", 500)], "provider string, daily_limit int")
    return G.daily_usage(ev, limits).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("g30_visible_to", "SELECT doc_id FROM lib WHERE (user_id = 2 OR doc_id % 9 = 0 OR doc_id % 10 = 0) AND (workspace_id = 'src1' OR doc_id % 8 = 0)")
def _(t):
    rows = lib(t).selectExpr("doc_id", "title AS name", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE user_id END AS user_id", "doc_id % 10 = 0 AS is_shared", "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE workspace_id END AS workspace_id")
    return G.visible_to(rows, 2, "src1").select("doc_id")
