"""Library queries over documents, tags, folders, versions and the pattern catalogue."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegrain.functions import exprs as X
from prosegrain.functions.frames import stack, stored
from prosegrain.operators import compare

ONE = "*"
SORTS = {"updated_at", "created_at", "title", "mean_heat", "word_count", "due_date"}


# ---------------------------------------------------------------- documents


def list_documents(docs: DataFrame, tags: DataFrame, user, workspace=None, statuses=None, heat_min=None, heat_max=None,
                   has_due_date=False, any_tags=None, sort="updated_at", ascending=False) -> DataFrame:
    d = docs.filter(F.col("user_id") == user)
    if workspace is not None:
        d = d.filter(F.col("workspace_id") == workspace)
    if statuses:
        d = d.filter(F.col("status").isin(*statuses))
    if heat_min is not None:
        d = d.filter(F.col("mean_heat") >= heat_min)
    if heat_max is not None:
        d = d.filter(F.col("mean_heat") <= heat_max)
    if has_due_date:
        d = d.filter("due_date is not null")
    if any_tags:
        d = d.join(tags.filter(F.col("tag").isin(*any_tags)).select("doc_id"), "doc_id", "left_semi")
    c = F.col(sort if sort in SORTS else "updated_at")
    return with_tags(d, tags).orderBy(c.asc() if ascending else c.desc(), "doc_id")


def with_tags(docs: DataFrame, tags: DataFrame) -> DataFrame:
    t = tags.groupBy("doc_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return docs.join(t, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


PUBLIC = ["doc_id", "title", "word_count", "sentence_count", "mean_heat", "status", "created_at", "updated_at"]


def document(docs: DataFrame, doc_id, user=None) -> DataFrame:
    """One document for its owner, or its public columns without a user."""
    d = docs.filter(F.col("doc_id") == doc_id)
    return d.select(*[c for c in PUBLIC if c in docs.columns]) if user is None else d.filter(F.col("user_id") == user)


def workspace_rollup(docs: DataFrame) -> DataFrame:
    """Counts, words, mean heat, heat bands and status counts per workspace."""
    h = F.col("mean_heat")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    by_status = docs.filter("status is not null").groupBy("workspace_id", "status").agg(F.count(ONE).alias("c")).groupBy("workspace_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "c")))).alias("statuses")
    )
    g = docs.groupBy("workspace_id").agg(
        F.count(ONE).alias("document_count"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        (X.exact_sum(h) / F.count(h)).alias("avg_heat"), n(h < 3).alias("cool"), n((h >= 3) & (h < 6)).alias("warm"), n(h >= 6).alias("hot"), n(h.isNull()).alias("unanalyzed"),
    )
    return g.join(by_status, "workspace_id", "left")


def workspace_tags(docs: DataFrame, tags: DataFrame) -> DataFrame:
    return docs.select("doc_id", "workspace_id").join(tags, "doc_id").select("workspace_id", "tag").distinct().orderBy("workspace_id", "tag")


def member_workspaces(ws: DataFrame, members: DataFrame) -> DataFrame:
    return ws.filter(~F.col("archived")).join(members, "workspace_id").orderBy("user_id", "name")


def corpus_stats(docs: DataFrame) -> DataFrame:
    h = F.col("mean_heat")
    key = F.when(h.isNotNull(), F.struct(h, "doc_id"))
    return docs.agg(
        F.count(ONE).alias("documents"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), (X.exact_sum(h) / F.count(h)).alias("avg_heat"),
        F.min(key)["doc_id"].alias("best_doc"), F.max(key)["doc_id"].alias("worst_doc"),
    )


def words_per_month(docs: DataFrame, now: str, months: int = 6) -> DataFrame:
    """Words of documents created in each of the last months; empty months are 0."""
    spark = docs.sparkSession
    first = F.add_months(F.trunc(F.lit(now).cast("date"), "month"), 1 - months)
    cal = spark.range(1).select(F.explode(F.sequence(first, F.trunc(F.lit(now).cast("date"), "month"), F.expr("interval 1 month"))).alias("month"))
    m = docs.filter((F.col("created_at") >= first) & (F.col("created_at") < F.add_months(F.trunc(F.lit(now).cast("date"), "month"), 1)))
    m = m.groupBy(F.trunc("created_at", "month").alias("month")).agg(F.sum("word_count").alias("words"))
    return cal.join(m, "month", "left").select("month", F.coalesce("words", F.lit(0)).alias("words"))


def deadlines(docs: DataFrame) -> DataFrame:
    """(day, doc_id, n) of every document with a due date; n documents are due that day."""
    d = docs.filter("due_date is not null").select(F.to_date(F.substring("due_date", 1, 10)).alias("day"), "doc_id")
    return d.join(d.groupBy("day").agg(F.count(ONE).alias("n")), "day")


def month_grid(docs: DataFrame, month: str) -> DataFrame:
    """Days of a month, padded to whole weeks from Sunday, with a row for each document due, or one for none."""
    first = F.trunc(F.lit(month).cast("date"), "month")
    last = F.last_day(first)
    start, end = F.date_sub(first, F.dayofweek(first) - 1), F.date_add(last, F.lit(7) - F.dayofweek(last))
    days = docs.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day")).withColumn("in_month", F.trunc("day", "month") == first)
    return days.join(deadlines(docs), "day", "left").select("day", "in_month", "doc_id", F.coalesce("n", F.lit(0)).alias("n"))


def changed_since(docs: DataFrame, ts: str) -> DataFrame:
    return docs.filter(F.col("updated_at") > F.lit(ts).cast("timestamp"))


def browse(docs: DataFrame, folder=None, workspace=None, n: int = 200) -> DataFrame:
    d = docs
    if folder is not None:
        d = d.filter(F.col("folder_id") == folder)
    if workspace is not None:
        d = d.filter(F.col("workspace_id") == workspace)
    return d.orderBy(F.desc("updated_at"), "doc_id").limit(n)


def visible_to(rows: DataFrame, user, workspace=None) -> DataFrame:
    """Rows that are the user's own, shared or built in, of the workspace or of none, by name."""
    d = rows.filter((F.col("user_id") == user) | F.col("user_id").isNull() | F.col("is_shared"))
    if workspace is not None:
        d = d.filter((F.col("workspace_id") == workspace) | F.col("workspace_id").isNull())
    return d.orderBy("name")


# ---------------------------------------------------------------- folders

# Links double in every round, so a tree of depth n takes log2(n) joins; each round is a table in the shared folder.


def _links(folders: DataFrame) -> DataFrame:
    """(folder_id, up) of the folders whose parent exists."""
    own = folders.select(F.col("folder_id").alias("up"))
    return folders.select("folder_id", F.col("parent_id").alias("up")).join(own, "up", "left_semi").select("folder_id", "up")


def _doubled(links: DataFrame) -> DataFrame:
    """Links over twice as many folders; those that would leave the tree are gone."""
    return links.join(links.select(F.col("folder_id").alias("up"), F.col("up").alias("to")), "up").select("folder_id", F.col("to").alias("up"))


def folder_tree(folders: DataFrame) -> DataFrame:
    """(folder_id, parent_id, name, depth, root_id); a folder whose parent is missing is a root. Folders in or under a cycle have no root
    and are left out."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    links = _links(folders).select("folder_id", "up", one.alias("depth"))
    at = stored(folders.select("folder_id").join(links, "folder_id", "left").select("folder_id", F.coalesce("up", "folder_id").alias("up"), F.coalesce("depth", zero).alias("depth")), "tree")
    roots = at.filter("depth = 0").select("folder_id")
    ends = roots.withColumnRenamed("folder_id", "up")
    before = None
    while True:
        open_ = at.join(ends, "up", "left_anti").count()
        if open_ in (0, before):  # what no round brings to a root goes round in circles
            break
        before = open_
        ahead = at.select(F.col("folder_id").alias("up"), F.col("up").alias("to"), F.col("depth").alias("more"))
        at = stored(at.join(ahead, "up").select("folder_id", F.col("to").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "tree")
    done = at.join(ends, "up").select("folder_id", F.col("depth").cast("int").alias("depth"), F.col("up").alias("root_id"))
    return folders.select("folder_id", "parent_id", "name").join(done, "folder_id")


def ancestors(folders: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(folder_id, ancestor_id, name, distance) with the folder itself at distance 0; cycles stop. With ``of`` (folder_id) for these only."""
    names = folders.select(F.col("folder_id").alias("ancestor_id"), "name")
    start = folders.select("folder_id") if of is None else of.select("folder_id").distinct().join(folders.select("folder_id"), "folder_id", "left_semi")
    found = stored(start.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("distance")), "above")
    links, step, n = stored(_links(folders), "links"), 1, found.count()
    while True:
        more = found.join(links.select(F.col("folder_id").alias("ancestor_id"), "up"), "ancestor_id").select("folder_id", F.col("up").alias("ancestor_id"), (F.col("distance") + step).alias("distance"))
        found = stored(stack(found, more).groupBy("folder_id", "ancestor_id").agg(F.min("distance").alias("distance")), "above")
        n, before = found.count(), n
        if n == before:
            return found.join(names, "ancestor_id").select("folder_id", "ancestor_id", "name", F.col("distance").cast("int").alias("distance"))
        links, step = stored(_doubled(links), "links"), 2 * step


def folder_paths(folders: DataFrame, of: DataFrame | None = None) -> DataFrame:
    a = ancestors(folders, of).groupBy("folder_id").agg(F.sort_array(F.collect_list(F.struct("distance", "name")), asc=False).alias("p"))
    return a.select("folder_id", F.array_join("p.name", " / ").alias("path"), F.size("p").alias("depth"))


def search(docs: DataFrame, folders: DataFrame, q: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose title holds the query; folders that match or lie above a matching document."""
    q = q.strip().lower()
    if not q:
        return docs, folders
    d = docs.filter(F.contains(F.lower(F.coalesce("title", F.lit("Untitled"))), F.lit(q)))
    up = ancestors(folders, d).select(F.col("ancestor_id").alias("folder_id"))
    own = folders.filter(F.contains(F.lower("name"), F.lit(q))).select("folder_id")
    return d, folders.join(stack(up, own).distinct(), "folder_id", "left_semi")


# ---------------------------------------------------------------- history and versions


def history(iterations: DataFrame, n: int = 50, fields=()) -> DataFrame:
    """Latest ``n`` entries per document with fields read from the profile text."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("created_at"), F.desc("iteration_id"))
    d = iterations.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return d.select("doc_id", "iteration_id", "created_at", "rank", *[F.get_json_object("profile", f"$.{f}").alias(f) for f in fields])


def latest_version(v: DataFrame) -> DataFrame:
    """Last version of each document by time; a partial maximum runs before the shuffle."""
    rest = [c for c in v.columns if c != "doc_id"]
    return v.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "version_id")).alias("v")).select("doc_id", "v.*")


def version(v: DataFrame, version_id) -> DataFrame:
    return v.filter(F.col("version_id") == version_id)


def snapshots(saves: DataFrame) -> DataFrame:
    """saves(doc_id, saved_at, save_id, content) that differ from the save before.

    Works day by day: neighbours inside a day, and the last save of the day before at its start. A
    document with a very long history is spread over its days.
    """
    d = saves.withColumn("_day", F.to_date("saved_at"))
    order = F.struct("saved_at", "save_id")
    inside = Window.partitionBy("doc_id", "_day").orderBy("saved_at", "save_id")
    ends = d.groupBy("doc_id", "_day").agg(F.max_by("content", order).alias("_last"))
    before = ends.select("doc_id", "_day", F.lag("_last").over(Window.partitionBy("doc_id").orderBy("_day")).alias("_before"))
    d = d.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_lag", F.lag("content").over(inside)).join(before, ["doc_id", "_day"])
    prev = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))
    return d.filter(prev.isNull() | (prev != F.col("content"))).select(*saves.columns)


def compare_versions(v: DataFrame, a: int, b: int) -> DataFrame:
    return compare.score_delta(v.filter(F.col("version") == a), v.filter(F.col("version") == b))


# ---------------------------------------------------------------- pattern catalogue


def catalogue(builtin: DataFrame, user: DataFrame, levels=None, scopes=None, search=None, tags=None, sort="taxonomy_id", limit=200, offset=0) -> DataFrame:
    """Built-in and user patterns, filtered and sorted, one page, with the total on each row.

    Both hold (pattern_id, taxonomy_id, name, level, tags ARRAY<STRING>, updated_at)."""
    cols = ["pattern_id", "taxonomy_id", "name", "level", "tags", "updated_at"]
    parts = []
    if not scopes or "platform" in scopes:
        parts.append(builtin.select(*cols).withColumn("scope", F.lit("platform")))
    if not scopes or "user" in scopes:
        parts.append(user.select(*cols).withColumn("scope", F.lit("user")))
    d = stack(*parts)
    if levels:
        d = d.filter(F.col("level").isin(*levels))
    if search:
        s = F.lit(search.lower())
        d = d.filter(F.contains(F.lower("pattern_id"), s) | F.contains(F.lower("name"), s) | F.contains(F.lower("taxonomy_id"), s))
    if tags:
        d = d.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    order = {"name": ["name"], "level": ["level", "taxonomy_id"], "updated_at": [F.desc("updated_at")]}.get(sort, ["taxonomy_id"])
    total = d.agg(F.count(ONE).alias("total"))
    page = d.orderBy(*order, "scope", "pattern_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))


def search_stored(user: DataFrame, q: str) -> DataFrame:
    like = "%" + q.lower() + "%"
    return user.filter(F.lower("pattern_id").like(like) | F.lower("name").like(like) | F.lower("taxonomy_id").like(like))


def export_patterns(builtin: DataFrame, user: DataFrame, path: str | None = None, scope=None, level=None, ids=None) -> DataFrame:
    """Patterns of a scope, level or id list; written as JSON lines when a path is given."""
    parts = []
    if scope in (None, "platform"):
        parts.append(builtin.withColumn("id", F.concat(F.lit("platform:"), "pattern_id")))
    if scope in (None, "user"):
        parts.append(user.withColumn("id", F.col("pattern_id")))
    d = stack(*parts, missing=True)
    if level:
        d = d.filter(F.col("level") == level)
    if ids:
        d = d.filter(F.col("id").isin(*ids))
    if path:
        d.write.mode("overwrite").json(path)
    return d


LEVELS = ["lexical", "sentence", "paragraph", "document"]


def check_import(new: DataFrame, user: DataFrame) -> DataFrame:
    """Each row of new(pos, pattern_id, name, level, detection_hint) as invalid, conflict, duplicate or valid."""
    need = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("pattern_id", "name", "level", "detection_hint")]
    ok = need[0] & need[1] & need[2] & need[3] & F.col("level").isin(*LEVELS)
    d = new.withColumn("_ok", F.coalesce(ok, F.lit(False))).join(user.select("pattern_id", F.lit(1).alias("_have")).distinct(), "pattern_id", "left")
    # The first row of an id is found by a partial minimum, so an id that fills a third of the batch is no hot group.
    first = d.filter("_ok").groupBy("pattern_id").agg(F.min("pos").alias("_first"))
    d = d.join(first, "pattern_id", "left")
    return d.select(
        "pos", "pattern_id",
        F.when(~F.col("_ok"), "invalid").when(F.col("_have") == 1, "conflict").when(F.col("pos") > F.col("_first"), "duplicate").otherwise("valid").alias("status"),
    )


def fork(ids: DataFrame, builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Copies of built-in patterns the user has not forked; ids(pattern_id, user_id, name, level, weight) override."""
    have = user.select("user_id", "pattern_id")
    d = ids.join(have, ["user_id", "pattern_id"], "left_anti").alias("o").join(builtin.alias("b"), "pattern_id")
    return d.select(
        "user_id", "pattern_id", F.coalesce("o.name", "b.name").alias("name"), F.coalesce("o.level", "b.level").alias("level"),
        F.coalesce("o.weight", "b.weight").alias("weight"), F.col("pattern_id").alias("forked_from"), F.lit(1).alias("version"),
    )


def pattern_as_of(v: DataFrame, n: int) -> DataFrame:
    return v.filter(F.col("version") == n)


def revert(v: DataFrame, n: int) -> DataFrame:
    """A new version with the content of version ``n`` for each pattern that has it."""
    top = v.groupBy("pattern_id").agg((F.max("version") + 1).cast("int").alias("next"))
    old = pattern_as_of(v, n).join(top, "pattern_id")
    return old.withColumn("version", F.col("next")).withColumn("change_summary", F.lit(f"Reverted to version {n}")).drop("next")


def completeness(p: DataFrame) -> DataFrame:
    """What a rule still lacks: hint, examples, rewrite menu."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return p.select(
        "pattern_id", (F.coalesce(F.trim("detection_hint"), F.lit("")) == "").alias("no_hint"), none("examples").alias("no_examples"), none("rewrite_menu").alias("no_menu"),
    )


def patterns(p: DataFrame, id=None, taxonomy_id=None, level=None, tag=None) -> DataFrame:
    for c, v in (("pattern_id", id), ("taxonomy_id", taxonomy_id), ("level", level)):
        if v is not None:
            p = p.filter(F.col(c) == v)
    return p.filter(F.array_contains("tags", tag)) if tag is not None else p


def daily_usage(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Calls per day and provider against the daily limit."""
    g = events.groupBy(F.window("ts", "1 day").alias("w"), "provider").agg(F.count(ONE).alias("n"))
    j = g.join(limits, "provider", "left")
    share = F.col("n") / F.col("daily_limit")
    return j.select(
        F.to_date("w.start").alias("day"), "provider", "n", F.coalesce("daily_limit", F.lit(0)).alias("daily_limit"),
        F.coalesce(X.js_round(share * 100, 0), F.lit(-1.0)).alias("pct"), F.coalesce(share >= 0.8, F.lit(False)).alias("near_limit"),
    )
