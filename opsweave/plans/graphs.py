"""Graph algorithm queries over the call graph of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import code_queries as Q
from opsweave.operators import graph_algos as A
from opsweave.plans.codegraph import SQL_FILES, SQL_FN, sql_calls
from opsweave.plans.registry import query
from opsweave.session import cut_lineage, freed_shuffles
from opsweave.sources import tables as T


@query(
    "graph_file_chain",
    "GRA11 REL10",
    f"""WITH RECURSIVE {SQL_FN}, {sql_calls()}, {SQL_FILES}, st AS (SELECT min(file) AS a FROM fn),
    r(node, d) AS (SELECT dst, 1 FROM fg JOIN st ON src = a UNION SELECT fg.dst, d + 1 FROM r JOIN fg ON fg.src = r.node WHERE d < 40),
    m AS (SELECT node, min(d) AS d FROM r GROUP BY 1)
    SELECT (SELECT a FROM st) AS start, node AS goal, d::INTEGER AS hops FROM m WHERE node <> (SELECT a FROM st)""",
)
def file_chain(spark, sf):
    f = T.functions(spark, sf)
    files = Q.file_graph(T.call_pairs(spark, sf), f)
    pairs = f.agg(F.min("file").alias("start")).crossJoin(f.select(F.col("file").alias("goal")).distinct())
    return A.shortest_paths(files, pairs.where("start <> goal")).drop("path")


@query(
    "graph_call_paths",
    "GRA12",
    f"""WITH RECURSIVE {sql_calls()}, st AS (SELECT src AS a FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    p(node, path) USING KEY (node) AS (SELECT a, [a] FROM st
      UNION SELECT n.dst, min(list_append(n.path, n.dst)) FROM (SELECT p.path, calls.dst FROM p JOIN calls ON calls.src = p.node) n
      LEFT JOIN recurring.p AS old ON old.node = n.dst WHERE old.node IS NULL GROUP BY n.dst)
    SELECT a AS start, node AS goal, array_to_string(path, '>') AS path, (len(path) - 1)::INTEGER AS hops FROM p, st WHERE node <> a""",
)
def call_paths(spark, sf):
    """Shortest call paths, of any length, from the function with most callees to every other
    (ties: smallest path)."""
    with freed_shuffles(spark):
        c, f = cut_lineage(T.call_pairs(spark, sf)), T.functions(spark, sf)
    start = c.groupBy(F.col("src").alias("start")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "start").limit(1)
    pairs = F.broadcast(start.select("start")).crossJoin(f.select(F.col("id").alias("goal"))).where("start <> goal")
    p = A.shortest_paths(c, pairs)
    return p.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(
    "graph_weak_components",
    "GRA16",
    f"""WITH RECURSIVE {sql_calls()}, u AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls),
    cc(id, component) USING KEY (id) AS (SELECT p_partkey, p_partkey FROM part
      UNION (SELECT u.b AS id, min(cc.component) AS component FROM cc JOIN u ON u.a = cc.id JOIN recurring.cc AS old ON old.id = u.b GROUP BY u.b HAVING min(cc.component) < min(old.component)))
    SELECT id, component FROM cc""",
)
def weak_components(spark, sf):
    return A.weak_components(T.call_pairs(spark, sf), T.functions(spark, sf))


@query(
    "graph_strong_components",
    "GRA13",
    f"""WITH RECURSIVE {sql_calls()}, r(a, b) AS (SELECT src, dst FROM calls UNION SELECT r.a, calls.dst FROM r JOIN calls ON calls.src = r.b),
    m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a)
    SELECT id, component FROM m""",
)
def strong_components(spark, sf):
    return A.strong_components(T.call_pairs(spark, sf))


@query(
    "graph_page_rank",
    "GRA14",
    f"""WITH RECURSIVE {sql_calls()}, nodes AS (SELECT src AS id FROM calls UNION SELECT dst FROM calls UNION SELECT p_partkey FROM part),
    n AS (SELECT count(*)::DOUBLE AS n FROM nodes), od AS (SELECT src AS id, count(*) AS o FROM calls GROUP BY 1),
    inn AS (SELECT dst AS id, count(*) AS callers FROM calls GROUP BY 1),
    pr(i, id, score) AS (SELECT 0, id, 1 / n FROM nodes, n
      UNION ALL SELECT c.i + 1, t.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(c.dm, 0) / n.n + 0.85::DOUBLE * coalesce(s.sc, 0)
      FROM nodes t CROSS JOIN n CROSS JOIN (SELECT max(i) AS i, sum(score) FILTER (id NOT IN (SELECT src FROM calls)) AS dm FROM pr WHERE i < 100) c
      LEFT JOIN (SELECT dst AS id, sum(score / o) AS sc FROM pr JOIN calls ON src = pr.id JOIN od ON od.id = pr.id GROUP BY dst) s ON s.id = t.id WHERE c.i IS NOT NULL)
    SELECT pr.id, round(score, 8) AS score, coalesce(callers, 0) AS callers, coalesce(o, 0) AS callees FROM pr LEFT JOIN inn ON inn.id = pr.id LEFT JOIN od ON od.id = pr.id WHERE i = 100""",
)
def page_rank(spark, sf):
    r = A.page_rank(T.call_pairs(spark, sf), T.functions(spark, sf))
    return r.withColumn("score", F.round("score", 8))


@query(
    "graph_betweenness",
    "GRA15",
    f"""WITH RECURSIVE {sql_calls()}, nodes AS (SELECT src AS id FROM calls UNION SELECT dst FROM calls UNION SELECT p_partkey FROM part),
    z AS (SELECT count(*) AS n, greatest(1, count(*) // 200) AS step FROM nodes), nr AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes),
    so AS (SELECT id AS source FROM nr, z WHERE n <= 200 OR (i % step = 0 AND i < step * 200)),
    lv(source, node, lvl, sigma) USING KEY (source, node) AS (SELECT source, source, 0, 1.0::DOUBLE FROM so
      UNION SELECT x.source, x.dst, x.lvl + 1, sum(x.sigma) FROM (SELECT lv.source, calls.dst, lv.lvl, lv.sigma FROM lv JOIN calls ON calls.src = lv.node) x
      LEFT JOIN recurring.lv AS old ON old.source = x.source AND old.node = x.dst WHERE old.node IS NULL GROUP BY x.source, x.dst, x.lvl),
    b(source, node, lvl, sigma, delta) AS (SELECT source, node, lvl, sigma, 0.0::DOUBLE FROM lv WHERE lvl = (SELECT max(lvl) FROM lv)
      UNION ALL SELECT u.source, u.node, u.lvl, u.sigma, coalesce(sum(u.sigma / d.sigma * (1 + d.delta)), 0) FROM lv u JOIN (SELECT DISTINCT lvl - 1 AS lvl FROM b) k ON k.lvl = u.lvl
      LEFT JOIN (SELECT b.source, b.sigma, b.delta, calls.src FROM b JOIN calls ON calls.dst = b.node) d ON d.source = u.source AND d.src = u.node
      GROUP BY u.source, u.node, u.lvl, u.sigma),
    c AS (SELECT node, sum(delta) AS d FROM b WHERE node <> source GROUP BY 1)
    SELECT id, round(coalesce(d, 0) / ((n - 1) * (n - 2)), 9) AS centrality FROM nodes CROSS JOIN z LEFT JOIN c ON c.node = id""",
)
def betweenness(spark, sf):
    b = A.betweenness(T.call_pairs(spark, sf), T.functions(spark, sf))
    return b.withColumn("centrality", F.round("centrality", 9))


@query("graph_communities", "GRA17")
def communities(spark, sf):
    return A.community_summaries(cut_lineage(T.call_pairs(spark, sf)), T.functions(spark, sf))


@query("graph_matching_communities", "GRA18")
def matching_communities(spark, sf):
    c, f = cut_lineage(T.call_pairs(spark, sf)), T.functions(spark, sf)
    comp = A.weak_components(c, f)
    members = comp.join(f, "id")
    return Q.matching_communities(A.community_summaries(c, f, comp), members, "ring")
