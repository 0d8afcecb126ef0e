"""Hybrid search: vectors, keywords, names, graph and recency, for many queries at once.

Frames: ``entities(id, kind, name, file, line)``, ``queries(qid, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k
from opsweave.functions.text import contains_join
from opsweave.session import cut_lineage


def _words(text: Column, pattern: str, least: int) -> Column:
    return F.filter(F.split(F.lower(text), pattern), lambda w: F.octet_length(w) >= least)


def _keyword_hits(entities: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(qid, pos, term)`` of the queries and the points ``(id, term, points, name_hit)`` of the entities."""
    terms = queries.select("qid", F.posexplode(_words(F.col("text"), r"(?U)[^\p{L}\p{N}]+", 2)).alias("pos", "term"))
    vocab = terms.select("term").distinct()
    parts = F.split(F.regexp_replace("name", r"(?U)(\p{Lu})", "_$1"), "[_-]+")
    e = entities.select(
        "id", F.lower("name").alias("_name"), F.lower("file").alias("_file"),
        F.transform(parts, F.lower).alias("_parts"),
    )
    by_name = contains_join(e.select("id", "_name", "_parts"), "_name", vocab, "term", min_length=2).select(
        "id", "term", F.when(F.array_contains("_parts", F.col("term")), 40).otherwise(20).alias("points"),
        F.lit(1).alias("name_hit"),
    )
    files = e.select("_file").distinct()
    in_file = contains_join(files, "_file", vocab, "term", min_length=2)
    by_file = e.select("id", "_file").join(in_file, "_file").select(
        "id", "term", F.lit(30).alias("points"), F.lit(0).alias("name_hit")
    )
    return terms, by_name.unionByName(by_file)


def _keyword_sums(hits: DataFrame, key: str) -> DataFrame:
    out = hits.groupBy("qid", key).agg(F.sum("points").alias("_p"), F.sum("name_hit").alias("_h"))
    bonus = F.when(F.col("_h") >= 2, 60).otherwise(0) + F.when(F.col("_h") >= 3, 120).otherwise(0)
    return out.select("qid", key, (F.col("_p") + bonus).alias("score"))


def keyword_scores(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """Name part 40, name substring 20, path segment 30 per term; +60 at two name
    hits, +120 more at three. Only pairs with a hit are ever built."""
    terms, hits = _keyword_hits(entities, queries)
    return _keyword_sums(hits.join(terms, "term"), "id")


def best_keywords(entities: DataFrame, queries: DataFrame, keep: int = 20) -> DataFrame:
    """The ``keep`` highest keyword scores per query (ties: smallest id), without a row per query and entity:
    entities with the same hits have the same scores, and only the first ``keep`` of them can be listed."""
    terms, hits = _keyword_hits(entities, queries)
    alike = F.sort_array(F.collect_list(F.struct("term", "points", "name_hit"))).alias("_like")
    rows = cut_lineage(hits.groupBy("id").agg(alike))
    likes = rows.select("_like").distinct().select("_like", F.inline("_like"))
    scores = _keyword_sums(likes.join(terms, "term"), "_like")
    listed = scores.join(top_k(rows, ["_like"], [F.col("id")], keep), "_like").select("qid", "id", "score")
    return top_k(listed, ["qid"], [F.desc("score"), F.col("id")], keep)


def related_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of words (a, b): equal, one inside the other, or equal first six characters."""
    a_in_b = contains_join(right, "b", left, "a", min_length=1).select("a", "b")
    b_in_a = contains_join(left, "a", right, "b", min_length=1).select("a", "b")
    six = (
        left.where(F.octet_length("a") >= 6).withColumn("_six", F.substring("a", 1, 6))
        .join(right.where(F.octet_length("b") >= 6).withColumn("_six", F.substring("b", 1, 6)), "_six")
        .select("a", "b")
    )
    return a_in_b.unionByName(b_in_a).unionByName(six).distinct()


def name_matches(entities: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Entities matching at least half of a query's words (three characters and more);
    best ratio first, then the shorter name."""
    words = queries.select("qid", F.posexplode(_words(F.col("text"), r"\s+", 3)).alias("pos", "a"))
    total = words.groupBy("qid").agg(F.count("*").alias("_n"))
    named = entities.where((F.col("kind") != "import") & (F.octet_length("name") > 2))
    tokens = named.select(
        "id", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), "[_-]+"), lambda w: w != ""))).alias("b")
    )
    pairs = related_words(words.select("a").distinct(), tokens.select("b").distinct())
    pairs = cut_lineage(pairs)
    alike = tokens.join(pairs.select("b").distinct(), "b").groupBy("id").agg(F.sort_array(F.collect_set("b")).alias("_like"))
    rows = cut_lineage(named.select("id", "name", "file").join(alike, "id"))
    # entities with the same matching tokens have the same ratios, so that only the first k of them can be listed
    first = top_k(rows, ["_like"], [F.length("name"), F.col("id")], k)
    likes = rows.select("_like").distinct().select("_like", F.explode("_like").alias("b"))
    hit = words.join(pairs, "a").join(likes, "b").select("qid", "_like", "pos").distinct()
    counted = hit.groupBy("qid", "_like").agg(F.count("*").alias("_c")).join(total, "qid")
    ratio = counted.select("qid", "_like", (F.col("_c") / F.col("_n")).alias("ratio")).where("ratio >= 0.5")
    listed = ratio.join(first, "_like").select("id", "qid", "ratio", "name", "file")
    return top_k(listed, ["qid"], [F.desc("ratio"), F.length("name"), F.col("id")], k)


def ranked(scored: DataFrame, score: str, tie: str = "id", keep: int = 20) -> DataFrame:
    """The best ``keep`` per query with ranks from 0."""
    best = top_k(scored, ["qid"], [F.desc(score), F.col(tie)], keep)
    w = Window.partitionBy("qid").orderBy(F.desc(score), tie)  # at most ``keep`` rows per query
    return best.select("qid", F.col(tie).alias("id"), (F.row_number().over(w) - 1).alias("rank"))


def fuse(lists: list[DataFrame], constant: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(qid, id, rank)``."""
    every = lists[0]
    for one in lists[1:]:
        every = every.unionByName(one)
    return every.groupBy("qid", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


# --- recency and centrality -------------------------------------------------------------


def recency_boost(days: Column) -> Column:
    return F.when(days <= 7, 1.0).when(days <= 30, 0.8).otherwise(0.6)


def file_recency(changes: DataFrame, now: str) -> DataFrame:
    """Days since the last commit per file, seen from ``now``."""
    last = changes.groupBy("file").agg(F.max("date").alias("last"))
    return last.select("file", F.datediff(F.lit(now).cast("date"), F.col("last")).alias("days"))


def since_days(text: str | None) -> int | None:
    """``7d``, ``2w``, ``1m``, ``1y`` -> days."""
    unit = {"d": 1, "w": 7, "m": 30, "y": 365}.get((text or "").strip()[-1:])
    number = (text or "").strip()[:-1]
    return int(number) * unit if unit and number.isdigit() else None


def caller_centrality(sites: DataFrame) -> DataFrame:
    """Call sites per called name over the highest such count."""
    per = sites.groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("callers"))
    top = per.agg(F.max("callers").alias("_max"))
    return per.crossJoin(F.broadcast(top)).select(  # one row
        "name", "callers", (F.col("callers") / F.col("_max")).alias("centrality")
    )


# Callee names that say nothing.
PLAIN_CALLS = (
    "trim", "is_empty", "contains", "ok", "err", "map", "unwrap", "clone", "to_string", "len",
    "push", "insert", "get", "iter", "collect", "filter", "find", "join", "split", "replace",
    "format", "println", "eprintln", "write", "read", "parse", "new", "default",
)


def graph_context(entities: DataFrame, sites: DataFrame) -> DataFrame:
    """``Called by: a, b, c, +n  |  Calls: …`` per entity (names in alphabetical order)."""

    def listed(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
        distinct = rows.distinct()
        n = distinct.groupBy(*keys).agg(F.count("*").alias("_n"))
        few = top_k(distinct, keys, [F.col("other")], 3).groupBy(*keys).agg(
            F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("_names")
        )
        more = F.when(F.col("_n") > 3, F.concat(F.lit(", +"), (F.col("_n") - 3).cast("string"))).otherwise("")
        return n.join(few, keys).select(*keys, F.concat(F.lit(label), "_names", more).alias("_text"))

    by = listed(
        sites.select(F.col("callee_name").alias("name"), F.col("caller_name").alias("other")), ["name"], "Called by: "
    ).withColumnRenamed("_text", "_by")
    calls = sites.where(~F.col("callee_name").isin(*PLAIN_CALLS)).select(
        F.col("caller_name").alias("name"), F.col("caller_file").alias("file"), F.col("callee_name").alias("other")
    )
    to = listed(calls, ["name", "file"], "Calls: ").withColumnRenamed("_text", "_to")
    out = entities.join(by, "name", "left").join(to, ["name", "file"], "left")
    return out.select(*entities.columns, F.concat_ws("  |  ", "_by", "_to").alias("graph_context"))


# --- fused search -----------------------------------------------------------------------


def fused_search(
    entities: DataFrame,
    semantic: DataFrame,
    names: DataFrame,
    recency: DataFrame,
    centrality: DataFrame,
    k: int = 10,
    since: str | None = None,
    docs: DataFrame | None = None,
) -> DataFrame:
    """0.6 similarity + 0.2 recency + 0.2 centrality.

    ``semantic(qid, id, similarity)`` from ``nearest`` with three times ``k``;
    ``names(qid, id, ratio)`` get at least 0.8 similarity and win over the same
    entity's vector hit, which must reach 0.30. ``docs(qid, doc, similarity)`` add
    up to three sections above 0.35 with neutral recency and centrality.
    """
    a = names.select("qid", "id", F.greatest("ratio", F.lit(0.8)).alias("similarity"), F.lit(0).alias("_via"))
    b = semantic.where("similarity >= 0.30").select("qid", "id", "similarity", F.lit(1).alias("_via"))
    e = entities.select("id", "name", "file")
    hits = a.unionByName(b).join(e, "id")
    once = hits.groupBy("qid", "name", "file").agg(
        F.min_by("similarity", F.struct("_via", (-F.col("similarity")).alias("neg"), "id")).alias("similarity")
    )
    full = once.join(recency, "file", "left").join(centrality.select("name", "centrality"), "name", "left")
    limit = since_days(since)
    if limit is not None:
        full = full.where(F.col("days") <= limit)
    boost = F.coalesce(recency_boost(F.col("days")), F.lit(0.6))
    boost = F.when(F.col("days").isNull(), 0.6).otherwise(boost)
    score = F.col("similarity") * 0.6 + boost * 0.2 + F.coalesce("centrality", F.lit(0.0)) * 0.2
    out = full.select("qid", "name", "file", score.alias("score"))
    if docs is not None:
        best = top_k(docs, ["qid"], [F.desc("similarity"), F.col("doc")], 3).where("similarity >= 0.35")
        out = out.unionByName(
            best.select(
                "qid", F.col("doc").alias("name"), F.lit("doc").alias("file"),
                (F.col("similarity") * 0.6 + 0.1).alias("score"),
            )
        )
    return top_k(out, ["qid"], [F.desc("score"), F.col("file"), F.col("name")], k)


def local_search(semantic: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """Up to five name hits first (score 1), then vector hits of at least 0.45."""
    first = top_k(names, ["qid"], [F.desc("ratio"), F.length("name"), F.col("id")], 5).select("qid", "id")
    first = first.withColumn("score", F.lit(1.0))
    rest = semantic.where("similarity >= 0.45").join(first.select("qid", "id"), ["qid", "id"], "left_anti")
    both = first.withColumn("_via", F.lit(0)).unionByName(
        rest.select("qid", "id", F.col("similarity").alias("score"), F.lit(1).alias("_via"))
    )
    return top_k(both, ["qid"], [F.col("_via"), F.desc("score"), F.col("id")], k).drop("_via")


def doc_search(semantic: DataFrame, k: int = 3) -> DataFrame:
    """Sections of at least 0.35 with their label."""
    best = top_k(semantic, ["qid"], [F.desc("similarity"), F.col("id")], k).where("similarity >= 0.35")
    s = F.col("similarity")
    label = F.when(s >= 0.7, "high").when(s >= 0.5, "medium").otherwise("low")
    return best.withColumns({"label": label, "score": s * 0.6 + 0.1})


def community_search(communities: DataFrame, members: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Whole-name 2.0 or contained 1.5; per word name 0.5, description 0.3, function 0.2,
    file 0.1; at least 1.0."""
    q = queries.select("qid", F.trim(F.lower("text")).alias("_q")).withColumn(
        "_words", F.filter(F.split("_q", r"\s+"), lambda w: w != "")
    )
    q = q.where(~((F.size("_words") == 1) & (F.octet_length("_q") < 4)))
    c = communities.select("component", F.lower("name").alias("_cn"), F.lower("description").alias("_cd"))
    words = q.select("qid", F.posexplode("_words").alias("pos", "w")).where(F.octet_length("w") >= 3)
    vocab = words.select("w").distinct()
    whole_q = q.select("qid", "_q")
    inside = contains_join(c, "_cn", whole_q, "_q", min_length=1).select("qid", "component", "_q", "_cn")
    around = contains_join(whole_q, "_q", c, "_cn", min_length=1).select("qid", "component", "_q", "_cn")
    whole = inside.unionByName(around).distinct().select(
        "qid", "component", F.when(F.col("_q") == F.col("_cn"), 2.0).otherwise(1.5).alias("points")
    )

    def each(texts: DataFrame, col: str, points: float) -> DataFrame:
        hit = contains_join(texts, col, vocab, "w", min_length=3).select("component", "w").distinct()
        return hit.join(words, "w").select("qid", "component", F.lit(points).alias("points"))

    m = members.select("component", F.lower("name").alias("_mn"), F.lower("file").alias("_mf"))
    points = whole
    for p in (
        each(c, "_cn", 0.5), each(c, "_cd", 0.3),
        each(m.select("component", "_mn").distinct(), "_mn", 0.2),
        each(m.select("component", "_mf").distinct(), "_mf", 0.1),
    ):
        points = points.unionByName(p)
    scored = points.groupBy("qid", "component").agg(F.sum("points").alias("score"))
    kept = scored.where(F.round("score", 6) >= 1.0)
    return top_k(kept, ["qid"], [F.desc("score"), F.col("component")], k)


# --- documents ----------------------------------------------------------------------------


def markdown_sections(docs: DataFrame) -> DataFrame:
    """Sections of ``docs(file, content)``: heading, level, first line, text.

    Front matter is skipped and a ``#`` inside a code fence is no heading. A file
    without headings is one section named after the file.
    """
    body = F.regexp_replace("content", "\r?\n$", "")
    lines = docs.select("file", F.posexplode(F.split(body, "\r?\n")).alias("pos", "text"))
    lines = lines.withColumns({"line": F.col("pos") + 1, "_t": F.trim(F.regexp_replace("text", r"[\t\x0B\f\r]", " "))})
    w = Window.partitionBy("file").orderBy("pos")  # the lines of one document
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    dash = (F.col("_t") == "---").cast("int")
    lines = lines.withColumns(
        {
            "_dash": dash,
            "_dashes": F.sum(dash).over(upto),
            "_first": F.min(F.when(dash == 1, F.col("line"))).over(Window.partitionBy("file")),
        }
    )
    matter = (F.col("_first") <= 2) & (
        (F.col("_dashes") == 1) | ((F.col("_dashes") == 2) & (F.col("_dash") == 1))
    )
    lines = lines.where(~F.coalesce(matter, F.lit(False)))
    fence = F.col("_t").startswith("```").cast("int")
    lines = lines.withColumn("_fence", fence).withColumn(
        "_open", F.coalesce(F.sum("_fence").over(before), F.lit(0)) % 2
    )
    hashes = F.length(F.regexp_extract("_t", "^(#*)", 1))
    heading = (
        (F.col("_fence") == 0) & (F.col("_open") == 0) & hashes.between(1, 6) & F.col("_t").rlike(r"^#+ +\S")
    )
    lines = lines.withColumn("_h", heading.cast("int")).withColumn("_sec", F.sum("_h").over(upto))
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_h") == 0, F.struct("pos", "text")))), lambda x: x["text"]),
        "\n",
    )
    sections = lines.groupBy("file", "_sec").agg(
        F.max(F.when(F.col("_h") == 1, F.trim(F.regexp_replace("_t", "^#+", "")))).alias("heading"),
        F.coalesce(F.max(F.when(F.col("_h") == 1, hashes)), F.lit(0)).alias("level"),
        F.coalesce(F.max(F.when(F.col("_h") == 1, F.col("line"))), F.lit(1)).alias("line"),
        F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("content"),
    )
    total = F.max("_sec").over(Window.partitionBy("file"))
    kept = sections.withColumn("_max", total).where("content <> '' and (_sec > 0 or _max = 0)")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(.)\.[^.]*$", "$1")
    return kept.select(
        "file", F.coalesce("heading", stem).alias("heading"), "level", "line", "content"
    )


def strip_tags(content: Column) -> Column:
    """Readable text of a page: front matter and tags removed, blank lines dropped.

    A tag ends in a blank; line breaks inside a tag stay line breaks.
    """
    parts = F.split(content, r"(?m)^[ \t]*---[ \t]*\r?$\n?")
    outside = F.array_join(F.filter(parts, lambda p, i: i % 2 == 0), "")
    pieces = F.split(outside, "(?=[<>])")
    cleaned = F.transform(
        pieces,
        lambda p: F.when(p.startswith("<"), F.regexp_replace(p, "[^\n]", ""))
        .when(p.startswith(">"), F.regexp_replace(p, "^>", " "))
        .otherwise(p),
    )
    lines = F.transform(
        F.split(F.array_join(cleaned, ""), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    )
    kept = F.filter(lines, lambda x: x != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise("")
