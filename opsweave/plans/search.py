"""Search queries over the parts' names, the embeddings, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions import vectors as V
from opsweave.operators import graph_algos as A
from opsweave.operators import search as S
from opsweave.plans.codegraph import SQL_CHANGES, SQL_FN, SQL_INDEX, small_index
from opsweave.plans.registry import query
from opsweave.session import cut_lineage
from opsweave.sources import tables as T


def entities(spark, sf):
    return T.functions(spark, sf).withColumn("kind", F.lit("function"))


def asked(spark, sf):
    """One search text per distinct part name and type: ``small ring economy``."""
    p = T.load(spark, sf, "part")
    text = F.concat_ws(" ", "p_name", F.lower("p_type"))
    return p.select(text.alias("qid"), text.alias("text")).distinct()


SQL_ASKED = f"{SQL_FN}, q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS qid FROM part)"


@query(
    "search_embed_text",
    "SEA1",
    f"""WITH {SQL_FN} SELECT id, concat_ws(' ', replace(name, '_', ' '), replace(name, '_', ' '), replace(name, '_', ' '), 'm' || line, 'm' || line,
    translate(file, '/.', '  '), p_type || ' ' || p_brand, left(p_name, 100)) AS text FROM fn JOIN part ON p_partkey = id""",
)
def embed_text(spark, sf):
    p = T.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_type", "p_brand").alias("params"), F.col("p_name").alias("body"))
    f = T.functions(spark, sf).join(p, "id")
    return f.select("id", V.embed_text(F.col("name"), F.col("file"), F.col("params"), F.col("body")).alias("text"))


def name_vectors(spark, sf):
    f = T.functions(spark, sf)
    return f.select("id", V.ngram_vector(V.spaced_name(F.col("name"))).alias("vector"))


def query_vectors(spark, sf):
    return asked(spark, sf).select("qid", V.ngram_vector(F.col("text")).alias("vector"))


@query(
    "search_ngram_vectors",
    "SEA2",
    f"""WITH {SQL_FN}, s AS (SELECT id, replace(name, '_', ' ') AS x FROM fn), n AS (SELECT id, x, unnest([3, 4, 5, 6]) AS n FROM s),
    g AS (SELECT id, substr(x, unnest(range(1, length(x) - n + 2))::INTEGER, n) AS g FROM n WHERE length(x) >= n),
    h AS (SELECT id, list_reduce(list_transform(string_split(g, ''), lambda c: ascii(c)::UBIGINT), lambda a, b: (xor(a, b) * 16777619::UBIGINT) % 4294967296::UBIGINT, 2166136261::UBIGINT) AS h FROM g),
    w AS (SELECT id, (h % 128)::INTEGER AS dim, sum(CASE WHEN h < 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL)
    SELECT id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS weight FROM w WHERE v <> 0""",
)
def ngram_vectors(spark, sf):
    v = name_vectors(spark, sf).select("id", F.posexplode("vector").alias("dim", "w"))
    return v.where("w <> 0").select("id", "dim", F.round("w", 6).alias("weight"))


@query("search_document_vectors", "SEA2")
def document_vectors(spark, sf):
    """n-gram vectors of the whole document texts, as norm and strongest dimension."""
    d = T.load(spark, sf, "documents").select("doc_id", V.ngram_vector(F.col("text")).alias("v"))
    size = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return d.select("doc_id", F.round(size, 6).alias("size"), F.array_position("v", F.array_max("v")).alias("top_dim"))


def label_means(spark, sf):
    """Query vectors: the mean embedding of every label."""
    e = T.load(spark, sf, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = flat.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return mean.groupBy(F.col("label").alias("qid")).agg(packed.alias("vector"))


SQL_SIM = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  m AS (SELECT label AS qid, pos, avg(v) AS v FROM x GROUP BY ALL), mn AS (SELECT qid, sqrt(sum(v * v)) AS n FROM m GROUP BY 1), xn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1),
  d AS (SELECT qid, vec_id, sum(m.v * x.v) AS d FROM x JOIN m USING (pos) GROUP BY ALL), sim AS (SELECT qid, vec_id AS id, d / mn.n / xn.n AS s FROM d JOIN mn USING (qid) JOIN xn USING (vec_id))"""


@query(
    "search_nearest",
    "SEA3 SEA4",
    f"""WITH {SQL_SIM} SELECT qid, id, round(s, 5) AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 10""",
)
def nearest(spark, sf):
    e = T.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    n = V.nearest(e, label_means(spark, sf), 10)
    return n.select("qid", "id", F.round("similarity", 5).alias("similarity"))


@query(
    "search_own_label_cosine",
    "SEA3",
    f"WITH {SQL_SIM} SELECT id, round(s, 5) AS similarity FROM sim JOIN embeddings ON vec_id = id AND label = qid",
)
def own_label_cosine(spark, sf):
    e = T.load(spark, sf, "embeddings")
    m = label_means(spark, sf).withColumnRenamed("qid", "label")
    j = e.join(F.broadcast(m), "label")  # one row per label
    return j.select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.col("vector")), 5).alias("similarity"))


SQL_KEYWORDS = f"""{SQL_ASKED}, t AS (SELECT qid, unnest(string_split(qid, ' ')) AS term FROM q),
  k AS (SELECT qid, id, CASE WHEN list_contains(string_split(name, '_'), term) THEN 40 WHEN contains(name, term) THEN 20 ELSE 0 END AS np, CASE WHEN contains(lower(file), term) THEN 30 ELSE 0 END AS fp FROM t, fn),
  kw AS (SELECT qid, id, (sum(np + fp) + CASE WHEN count(*) FILTER (np > 0) >= 2 THEN 60 ELSE 0 END + CASE WHEN count(*) FILTER (np > 0) >= 3 THEN 120 ELSE 0 END)::BIGINT AS score FROM k GROUP BY ALL HAVING sum(np + fp) > 0)"""


@query("search_keyword_scores", "SEA5", f"WITH {SQL_KEYWORDS} SELECT * FROM kw")
def keyword_scores(spark, sf):
    return S.keyword_scores(entities(spark, sf), asked(spark, sf))


SQL_NAMES = f"""{SQL_ASKED}, w AS (SELECT qid, unnest(string_split(qid, ' ')) AS a FROM q),
  nm AS (SELECT qid, id, name, count(*) FILTER (len(list_filter(string_split(name, '_'), lambda b: contains(a, b) OR contains(b, a) OR (length(a) >= 5 AND length(b) >= 5 AND left(a, least(length(a), length(b), 6)) = left(b, least(length(a), length(b), 6))))) > 0) / count(*) AS ratio
     FROM w, fn WHERE length(a) >= 3 GROUP BY ALL),
  nh AS (SELECT qid, id, ratio, name FROM nm WHERE ratio >= 0.5 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ratio DESC, length(name), id) <= 10)"""


@query("search_name_matches", "SEA6", f"WITH {SQL_NAMES} SELECT qid, id, round(ratio, 6) AS ratio FROM nh")
def name_matches(spark, sf):
    n = S.name_matches(entities(spark, sf), asked(spark, sf))
    return n.select("qid", "id", F.round("ratio", 6).alias("ratio"))


@query(
    "search_rank_fusion",
    "SEA7",
    f"""WITH {SQL_KEYWORDS}, w AS (SELECT qid, unnest(string_split(qid, ' ')) AS a FROM q),
    nm AS (SELECT qid, id, name, count(*) FILTER (len(list_filter(string_split(name, '_'), lambda b: contains(a, b) OR contains(b, a))) > 0) / count(*) AS ratio FROM w, fn WHERE length(a) >= 3 GROUP BY ALL),
    nh AS (SELECT qid, id, ratio FROM nm WHERE ratio >= 0.5 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ratio DESC, length(name), id) <= 10),
    l AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS r FROM kw QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20
      UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY ratio DESC, id) - 1 FROM nh)
    SELECT qid, id, round(sum(1 / (60 + r)), 8) AS score FROM l GROUP BY ALL""",
)
def rank_fusion(spark, sf):
    e, q = entities(spark, sf), asked(spark, sf)
    lists = [S.ranked(S.best_keywords(e, q), "score"), S.ranked(S.name_matches(e, q), "ratio")]
    return S.fuse(lists).withColumn("score", F.round("score", 8))


NOW = "2001-12-31"


@query(
    "search_file_recency",
    "SEA9",
    f"""WITH {SQL_CHANGES}, l AS (SELECT file, date_diff('day', max(date)::DATE, DATE '{NOW}') AS days FROM chg GROUP BY 1)
    SELECT file, days::INTEGER AS days, CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.8 ELSE 0.6 END::DOUBLE AS boost FROM l""",
)
def file_recency(spark, sf):
    r = S.file_recency(T.file_changes(spark, sf), NOW)
    return r.withColumn("boost", S.recency_boost(F.col("days")))


@query(
    "search_caller_centrality",
    "SEA10",
    f"""WITH {SQL_INDEX}, c AS (SELECT callee_name AS name, count(*) AS callers FROM sites GROUP BY 1)
    SELECT name, callers, round(callers / (SELECT max(callers) FROM c), 6) AS centrality FROM c""",
)
def caller_centrality(spark, sf):
    c = S.caller_centrality(small_index(spark, sf)[1].distinct())
    return c.withColumn("centrality", F.round("centrality", 6))


@query(
    "search_graph_context",
    "SEA11",
    f"""WITH {SQL_INDEX}, b AS (SELECT callee_name AS name, list_sort(list(DISTINCT caller_name)) AS l FROM sites GROUP BY 1), t AS (SELECT caller_name AS name, caller_file AS file, list_sort(list(DISTINCT callee_name)) AS l FROM sites GROUP BY 1, 2)
    SELECT id, concat_ws('  |  ', 'Called by: ' || array_to_string(b.l[1:3], ', ') || CASE WHEN len(b.l) > 3 THEN ', +' || (len(b.l) - 3) ELSE '' END,
      'Calls: ' || array_to_string(t.l[1:3], ', ') || CASE WHEN len(t.l) > 3 THEN ', +' || (len(t.l) - 3) ELSE '' END) AS graph_context
    FROM ent LEFT JOIN b ON b.name = ent.name LEFT JOIN t ON t.name = ent.name AND t.file = ent.file""",
)
def graph_context(spark, sf):
    ent, sites = small_index(spark, sf)
    return S.graph_context(ent, sites).select("id", "graph_context")


def semantic(spark, sf, k=30):
    return V.nearest(name_vectors(spark, sf), query_vectors(spark, sf), k)


@query("search_fused", "SEA8")
def fused(spark, sf):
    e, q = entities(spark, sf), asked(spark, sf)
    cent = S.caller_centrality(small_index(spark, sf)[1].distinct())
    out = S.fused_search(
        e, semantic(spark, sf), S.name_matches(e, q), S.file_recency(T.file_changes(spark, sf), NOW), cent
    )
    return out.withColumn("score", F.round("score", 6))


@query("search_local", "SEA16")
def local_search(spark, sf):
    out = S.local_search(semantic(spark, sf, 15), S.name_matches(entities(spark, sf), asked(spark, sf)))
    return out.withColumn("score", F.round("score", 6))


def markdown(spark, sf):
    d = T.load(spark, sf, "documents")
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\n## "))
    fenced = F.when(F.col("lang") == "de", F.concat(F.lit("```\n# no heading\n```\n"), body)).otherwise(body)
    matter = F.when(F.col("lang") == "fr", F.concat(F.lit("---\ntitle: x\n# no\n---\n"), fenced)).otherwise(fenced)
    name = F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(name.alias("file"), matter.alias("content"))


@query(
    "search_markdown_sections",
    "SEA14 SRC9",
    r"""WITH d AS (SELECT 'docs/d' || doc_id || '.md' AS file, lang, replace(text, '. ', '.' || chr(10) || '## ') AS x FROM documents),
    m AS (SELECT file, CASE lang WHEN 'de' THEN '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || x WHEN 'fr' THEN '---' || chr(10) || 'title: x' || chr(10) || '# no' || chr(10) || '---' || chr(10) || x ELSE x END AS content, lang FROM d),
    l AS (SELECT file, lang, unnest(string_split(regexp_replace(content, '\r?\n$', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(content, '\r?\n$', ''), chr(10)), 1) AS line FROM m),
    k AS (SELECT * FROM l WHERE NOT (lang = 'fr' AND line <= 4)),
    h AS (SELECT *, regexp_matches(trim(text), '^#{1,6} +\S') AND NOT (lang = 'de' AND line <= 3) AS h FROM k),
    s AS (SELECT *, sum(h::INT) OVER (PARTITION BY file ORDER BY line) AS sec FROM h),
    g AS (SELECT file, sec, max(CASE WHEN h THEN trim(regexp_replace(trim(text), '^#+', '')) END) AS heading, coalesce(max(CASE WHEN h THEN length(regexp_extract(trim(text), '^#+')) END), 0) AS level,
       coalesce(max(CASE WHEN h THEN line END), 1) AS line, regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (NOT h), ''), '^\s+|\s+$', '', 'g') AS content FROM s GROUP BY ALL)
    SELECT file, coalesce(heading, regexp_extract(file, 'docs/(.*)\.md', 1)) AS heading, level::INTEGER AS level, line::INTEGER AS line, content FROM g
    WHERE content <> '' AND (sec > 0 OR (SELECT max(sec) FROM g x WHERE x.file = g.file) = 0)""",
)
def markdown_sections(spark, sf):
    return S.markdown_sections(markdown(spark, sf))


@query(
    "search_strip_tags",
    "SEA15",
    r"""WITH p AS (SELECT page_id, string_split(html, '<') AS s FROM pages),
    c AS (SELECT page_id, replace(s[1], '>', ' ') || coalesce(list_reduce(list_transform(s[2:], lambda x: CASE WHEN contains(x, '>') THEN regexp_replace(left(x, instr(x, '>') - 1), '[^\n]', '', 'g') || ' ' || replace(substr(x, instr(x, '>') + 1), '>', ' ')
        ELSE regexp_replace(x, '[^\n]', '', 'g') END), lambda a, b: a || b), '') AS t FROM p),
    l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l FROM c)
    SELECT page_id, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) || chr(10) ELSE '' END AS text FROM l""",
)
def strip_tags(spark, sf):
    return T.load(spark, sf, "pages").select("page_id", S.strip_tags(F.col("html")).alias("text"))


@query("search_docs", "SEA12")
def doc_search(spark, sf):
    """Sections of the documents against the benchmark texts, by n-gram vectors."""
    sections = S.markdown_sections(markdown(spark, sf))
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    v = sections.select(place.alias("id"), V.ngram_vector(F.col("content")).alias("vector"))
    b = T.load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), V.ngram_vector(F.col("text")).alias("vector"))
    out = S.doc_search(V.nearest(v, b, 3))
    return out.select("qid", "id", "label", F.round("score", 6).alias("score"))


@query("search_communities", "SEA13")
def community_search(spark, sf):
    c, f = cut_lineage(T.call_pairs(spark, sf)), T.functions(spark, sf)
    comp = A.weak_components(c, f)
    members = comp.join(f, "id")
    out = S.community_search(A.community_summaries(c, f, comp), members, asked(spark, sf))
    return out.withColumn("score", F.round("score", 6))
