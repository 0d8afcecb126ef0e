"""Code-graph queries: parts are functions, order lines are calls and history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsweave.operators import code_queries as Q
from opsweave.operators import codegraph as G
from opsweave.operators import index_store as X
from opsweave.plans.registry import query
from opsweave.session import cut_lineage, shared_folder
from opsweave.sources import tables as T

SQL_FN = """fn AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
    'src/' || replace(p_brand, '#', '/') || '/m' || p_size || '.py' AS file, p_size AS line FROM part)"""


def sql_calls() -> str:
    return """calls AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""


SQL_MOD = """md AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS fn FROM lineitem),
  modi AS (SELECT md.commit, fn, o_custkey AS author, o_orderdate AS date, o_orderpriority || ' ' || o_orderstatus AS message FROM md JOIN orders ON o_orderkey = md.commit)"""
SQL_CHANGES = f"""{SQL_FN}, ch AS (SELECT l_orderkey AS commit, file, min(CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'A' ELSE 'M' END) AS change
    FROM lineitem JOIN fn ON fn.id = l_partkey GROUP BY ALL),
  chg AS (SELECT ch.*, o_custkey AS author, o_orderdate AS date FROM ch JOIN orders ON o_orderkey = ch.commit)"""


def pages_as_code(spark, sf):
    p = T.load(spark, sf, "pages")
    return p.select(
        F.lit("function").alias("kind"), F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("name"),
        F.col("url").alias("file"), F.col("html").alias("body"),
    )


@query(
    "code_call_sites",
    "GRA1",
    r"""WITH c AS (SELECT url AS caller_file, 'page_' || page_id AS caller_name, unnest(regexp_extract_all(html, '([\p{L}\p{N}_]+)\s*\(', 1)) AS callee_name FROM pages)
    SELECT DISTINCT * FROM c WHERE strlen(callee_name) > 1 AND regexp_matches(callee_name, '^\p{Ll}') AND callee_name NOT IN
      ('if', 'for', 'while', 'return', 'switch', 'catch', 'new', 'typeof', 'await', 'import', 'require', 'console', 'let', 'test', 'format', 'match', 'use')""",
)
def call_sites(spark, sf):
    return G.call_sites(pages_as_code(spark, sf))


def small_index(spark, sf):
    """Entities with repeated names (part names) and call sites that need stubs."""
    p = T.load(spark, sf, "part")
    name = F.regexp_replace("p_name", " ", "_")
    file = T.functions(spark, sf).select("id", "file", "line")
    ent = p.select(F.col("p_partkey").alias("id"), name.alias("name")).join(file, "id")
    ent = ent.select(F.lit("function").alias("kind"), "id", "name", "file", "line")
    c = T.call_pairs(spark, sf)
    a = ent.select(F.col("id").alias("src"), F.col("name").alias("an"), F.col("file").alias("af"), F.col("line").alias("al"))
    b = ent.select(F.col("id").alias("dst"), F.col("name").alias("bn"), F.col("line").alias("bl"))
    j = c.join(a, "src").join(b, "dst")
    sites = j.select(
        F.when(F.col("al") > 45, F.concat(F.lit("run_"), F.col("an"))).otherwise(F.col("an")).alias("caller_name"),
        F.when(F.col("al") < 5, F.lit("gone.py")).otherwise(F.col("af")).alias("caller_file"),
        F.when(F.col("bl") > 40, F.concat(F.lit("lib_"), F.col("bn"))).otherwise(F.col("bn")).alias("callee_name"),
    )
    return ent, sites


SQL_INDEX = f"""{SQL_FN}, ent AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, fn.file, fn.line FROM part JOIN fn ON fn.id = p_partkey), {sql_calls()},
  sites AS (SELECT DISTINCT CASE WHEN a.line > 45 THEN 'run_' || a.name ELSE a.name END AS caller_name, CASE WHEN a.line < 5 THEN 'gone.py' ELSE a.file END AS caller_file,
     CASE WHEN b.line > 40 THEN 'lib_' || b.name ELSE b.name END AS callee_name FROM calls JOIN ent a ON a.id = src JOIN ent b ON b.id = dst),
  fns AS (SELECT name, file, min(line) AS line FROM ent GROUP BY ALL), firsts AS (SELECT name, arg_min(file, (file, line)) AS ff FROM fns GROUP BY 1),
  sc AS (SELECT caller_name AS name, min(caller_file) AS ff FROM sites WHERE caller_name NOT IN (SELECT name FROM firsts) GROUP BY 1),
  k1 AS (SELECT * FROM firsts UNION ALL SELECT * FROM sc),
  se AS (SELECT DISTINCT callee_name AS name, '' AS ff FROM sites WHERE callee_name NOT IN (SELECT name FROM k1)),
  names AS (SELECT * FROM k1 UNION ALL SELECT * FROM se)"""


@query(
    "code_graph_nodes",
    "GRA2",
    f"WITH {SQL_INDEX} SELECT name, file, line FROM fns UNION ALL SELECT name, ff, 0 FROM sc UNION ALL SELECT name, ff, 0 FROM se",
)
def graph_nodes(spark, sf):
    return G.build_graph(*small_index(spark, sf))[0]


@query(
    "code_graph_edges",
    "GRA2",
    f"""WITH {SQL_INDEX}, e AS (SELECT DISTINCT s.caller_name AS src_name, CASE WHEN f.name IS NOT NULL THEN s.caller_file ELSE a.ff END AS src_file, s.callee_name AS dst_name, b.ff AS dst_file
      FROM sites s LEFT JOIN fns f ON f.name = s.caller_name AND f.file = s.caller_file JOIN names a ON a.name = s.caller_name JOIN names b ON b.name = s.callee_name)
    SELECT * FROM e WHERE NOT (src_name = dst_name AND src_file = dst_file)""",
)
def graph_edges(spark, sf):
    return G.build_graph(*small_index(spark, sf))[1]


def imports(spark, sf):
    """Imports: the file of the calling part imports the called part's module by a
    relative, a workspace or an outside path."""
    f = T.functions(spark, sf)
    a = f.select(F.col("id").alias("src"), F.col("file").alias("file"), F.col("line").alias("al"))
    b = f.select(F.col("id").alias("dst"), F.col("name").alias("bn"), F.col("file").alias("bf"))
    j = T.call_pairs(spark, sf).join(a, "src").join(b, "dst")
    module = F.regexp_replace("bf", r"\.py$", "")
    source = (
        F.when(F.col("al") % 3 == 0, F.concat(F.lit("./../"), F.regexp_replace(module, "^src/Brand/", "")))
        .when(F.col("al") % 3 == 1, F.concat(F.lit("@shop/brands"), F.regexp_replace(module, "^src/Brand", "")))
        .otherwise(F.lit("numpy"))
    )
    return j.select("file", source.alias("import_source"), F.array("bn").alias("import_names"))


def packages(spark, sf):
    r = T.load(spark, sf, "region").where("r_regionkey = 0")
    return r.select(F.lit("@shop/brands").alias("package"), F.lit("src/Brand").alias("dir"))


SQL_IMPORTS = f"""{SQL_FN}, {sql_calls()}, imp AS (SELECT a.file AS importer, b.name, CASE WHEN a.line % 3 = 2 THEN 'numpy'
      WHEN a.line % 3 = 0 THEN regexp_replace(b.file, '\\.py$', '') ELSE regexp_replace(b.file, '\\.py$', '') END AS resolved
      FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst),
  edges AS (SELECT DISTINCT importer, imp.name, fn.file FROM imp JOIN fn ON fn.name = imp.name AND starts_with(fn.file, imp.resolved))"""


@query("code_import_resolution", "GRA3", f"WITH {SQL_IMPORTS} SELECT DISTINCT importer AS file, resolved FROM imp")
def import_resolution(spark, sf):
    return G.resolve_imports(imports(spark, sf), packages(spark, sf)).select("file", "resolved").distinct()


def import_edges(spark, sf):
    resolved = G.resolve_imports(imports(spark, sf), packages(spark, sf))
    return G.import_edges(resolved, T.functions(spark, sf))


@query("code_import_edges", "GRA3", f"WITH {SQL_IMPORTS} SELECT * FROM edges")
def code_import_edges(spark, sf):
    return import_edges(spark, sf)


def functions_with_bodies(spark, sf):
    """Bodies name the called functions of the sparse graph (in upper case when odd)."""
    f = T.functions(spark, sf)
    b = f.select(F.col("id").alias("dst"), F.col("name").alias("bn"))
    c = T.call_pairs(spark, sf).join(b, "dst")
    word = F.when(F.col("dst") % 2 == 1, F.upper("bn")).otherwise(F.col("bn"))
    bodies = c.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(word)), "(); ").alias("body"))
    return f.join(bodies, "id", "left").fillna("", ["body"])


SQL_BODIES = f"""{SQL_FN}, {sql_calls()}, bodies AS (SELECT src AS id, string_agg(CASE WHEN dst % 2 = 1 THEN upper(name) ELSE name END, '(); ' ORDER BY CASE WHEN dst % 2 = 1 THEN upper(name) ELSE name END) AS body
    FROM calls JOIN fn ON fn.id = dst GROUP BY 1), fb AS (SELECT fn.*, coalesce(body, '') AS body FROM fn LEFT JOIN bodies USING (id))"""


@query(
    "code_cross_file_calls",
    "GRA4",
    f"""WITH {SQL_IMPORTS}, bodies AS (SELECT src AS id, string_agg(CASE WHEN dst % 2 = 1 THEN upper(name) ELSE name END, '(); ') AS body FROM calls JOIN fn ON fn.id = dst GROUP BY 1),
    fb AS (SELECT fn.*, coalesce(body, '') AS body FROM fn LEFT JOIN bodies USING (id))
    SELECT DISTINCT fb.name AS caller, fb.file AS caller_file, edges.name AS callee, edges.file AS callee_file FROM fb JOIN edges ON edges.importer = fb.file
    WHERE contains(lower(body), lower(edges.name)) AND NOT (fb.name = edges.name AND fb.file = edges.file)""",
)
def cross_file_calls(spark, sf):
    return G.cross_file_calls(functions_with_bodies(spark, sf), import_edges(spark, sf))


@query(
    "code_validation_edges",
    "GRA5",
    f"""WITH {SQL_BODIES}, v AS (SELECT replace(name, 'red_', 'check_') AS name, file, replace(body, 'red_', 'check_') AS body FROM fb)
    SELECT DISTINCT a.name, a.file, b.name AS validator, b.file AS validator_file FROM v a JOIN v b ON contains(lower(a.body), lower(b.name))
    WHERE contains(b.name, 'check') AND NOT (a.name = b.name AND a.file = b.file)""",
)
def validation_edges(spark, sf):
    f = functions_with_bodies(spark, sf)
    f = f.withColumns({c: F.replace(F.col(c), F.lit("red_"), F.lit("check_")) for c in ("name", "body")})
    return G.validation_edges(f)


@query(
    "code_modified_functions",
    "GRA6",
    f"""WITH {SQL_CHANGES} SELECT fn.id AS fn, count(*) AS commits FROM ch JOIN fn USING (file) GROUP BY 1""",
)
def modified_functions(spark, sf):
    return G.modified_functions(T.file_changes(spark, sf), T.functions(spark, sf), counted=True)


def index_states(spark, sf):
    """Old and new modification times per file: the newest order before 1998 and in all."""
    c = T.file_changes(spark, sf)
    old = c.where("date < timestamp'1998-01-01'").groupBy(F.col("file").alias("path")).agg(F.max("commit").alias("mtime"))
    new = c.where("date >= timestamp'1997-06-01'").groupBy(F.col("file").alias("path")).agg(F.max("commit").alias("mtime"))
    return G.file_states(old, new)


SQL_STATES = f"""{SQL_CHANGES}, o AS (SELECT file, max(commit) AS m FROM chg WHERE date < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT file, max(commit) AS m FROM chg WHERE date >= TIMESTAMP '1997-06-01' GROUP BY 1),
  st AS (SELECT coalesce(o.file, n.file) AS path, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'deleted' WHEN o.m = n.m THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.file = n.file)"""


@query("code_file_states", "GRA7", f"WITH {SQL_STATES} SELECT * FROM st")
def file_states(spark, sf):
    return index_states(spark, sf)


@query(
    "code_refresh_index",
    "GRA7",
    f"""WITH {SQL_STATES} SELECT id, name, file FROM fn WHERE file NOT IN (SELECT path FROM st WHERE status IN ('changed', 'deleted'))
    UNION ALL SELECT id, name || '_v2', file FROM fn WHERE file IN (SELECT path FROM st WHERE status IN ('changed', 'added'))""",
)
def refresh_index(spark, sf):
    f, st = T.functions(spark, sf).select("id", "name", "file"), index_states(spark, sf)
    live = st.where("status in ('changed', 'added')").select(F.col("path").alias("file"))
    fresh = f.join(live, "file", "left_semi").select("id", F.concat("name", F.lit("_v2")).alias("name"), "file")
    return G.refresh(f, fresh, st)


def repo_index(spark, sf):
    """Entities and call sites of five repositories (first digit of the brand), with the state of their files."""
    st = index_states(spark, sf).withColumnRenamed("path", "file")
    f = T.functions(spark, sf).select("id", "file", "line").join(st, "file", "left")
    p = T.load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.substring("p_brand", 7, 1).alias("repo"), F.regexp_replace("p_name", " ", "_").alias("name")
    )
    ent = p.join(f, "id").select(
        F.lit("function").alias("kind"), "repo", "id", "name", "file", "line", F.coalesce("status", F.lit("unchanged")).alias("status")
    )
    a = ent.select(F.col("id").alias("src"), "repo", "file", "line", "status", F.col("name").alias("an"))
    b = ent.select(F.col("id").alias("dst"), F.col("name").alias("bn"), F.col("line").alias("bl"))
    j = T.call_pairs(spark, sf).join(a, "src").join(b, "dst")
    sites = j.select(
        "repo", "status", "line", F.when(F.col("line") > 45, F.concat(F.lit("run_"), "an")).otherwise(F.col("an")).alias("caller_name"),
        F.col("file").alias("caller_file"), F.when(F.col("bl") > 40, F.concat(F.lit("lib_"), "bn")).otherwise(F.col("bn")).alias("callee_name"),
    )
    return ent, sites


@query(
    "code_incremental_edges",
    "GRA7",
    f"""WITH {SQL_STATES}, {sql_calls()}, e0 AS (SELECT p_partkey AS id, substr(p_brand, 7, 1) AS repo, replace(p_name, ' ', '_') AS name, fn.file, fn.line,
      CASE WHEN status IN ('changed', 'added') AND fn.line % 2 = 1 THEN 'v2_' ELSE '' END AS v, status FROM part JOIN fn ON fn.id = p_partkey LEFT JOIN st ON path = file),
    ent AS (SELECT repo, v || name AS name, file, line FROM e0 WHERE status IS DISTINCT FROM 'deleted'),
    sites AS (SELECT DISTINCT a.repo, a.v || CASE WHEN a.line > 45 THEN 'run_' ELSE '' END || a.name AS caller_name, a.file AS caller_file,
      CASE WHEN b.line > 40 THEN 'lib_' ELSE '' END || b.name AS callee_name FROM calls JOIN e0 a ON a.id = src JOIN e0 b ON b.id = dst WHERE a.status IS DISTINCT FROM 'deleted'),
    firsts AS (SELECT repo, name, arg_min(file, (file, line)) AS ff FROM ent GROUP BY ALL),
    sc AS (SELECT repo, caller_name AS name, min(caller_file) AS ff FROM sites GROUP BY ALL),
    names AS (SELECT repo, name, coalesce(firsts.ff, sc.ff) AS ff FROM firsts FULL JOIN sc USING (repo, name)),
    own AS (SELECT DISTINCT repo, name, file FROM ent),
    x AS (SELECT DISTINCT s.repo, s.caller_name AS src_name, CASE WHEN o.name IS NOT NULL THEN s.caller_file ELSE a.ff END AS src_file, s.callee_name AS dst_name, coalesce(b.ff, '') AS dst_file
      FROM sites s LEFT JOIN own o ON o.repo = s.repo AND o.name = s.caller_name AND o.file = s.caller_file JOIN names a ON a.repo = s.repo AND a.name = s.caller_name LEFT JOIN names b ON b.repo = s.repo AND b.name = s.callee_name)
    SELECT * FROM x WHERE NOT (src_name = dst_name AND src_file = dst_file)""",
)
def incremental_edges(spark, sf):
    """The index of the old files, then one change set of all files that came, went or changed."""
    ent, sites = (cut_lineage(x) for x in repo_index(spark, sf))
    old, gone, live = "status <> 'added'", "status <> 'unchanged'", "status in ('changed', 'added')"
    again = (F.col("line") % 2 == 1) & (F.col("status") != "unchanged")

    def fresh(rows, name):
        return rows.where(live).withColumn(name, F.when(again, F.concat(F.lit("v2_"), name)).otherwise(F.col(name)))

    with shared_folder(spark, "code-index") as root:
        X.build(root, ent.where(old).drop("status", "id"), sites.where(old), buckets=4)
        X.apply_changes(root, ent.where(gone).select("repo", "file"), fresh(ent, "name"), fresh(sites, "caller_name"), buckets=4)
        return cut_lineage(X.call_edges(spark, root))


# --- queries on the graph -------------------------------------------------------------


@query(
    "code_references_by_file",
    "GRA8 REL16",
    f"""WITH {SQL_FN}, {sql_calls()}, c AS (SELECT dst AS id, a.file AS caller_file, a.name FROM calls JOIN fn a ON a.id = src)
    SELECT id, caller_file, count(*) AS n, array_to_string(list_sort(list(DISTINCT name))[1:50], ',') AS names FROM c GROUP BY ALL""",
)
def references_by_file(spark, sf):
    r = Q.references_by_file(T.call_pairs(spark, sf), T.functions(spark, sf))
    return r.withColumn("names", F.array_join("names", ","))


@query(
    "code_where_used",
    "GRA8",
    f"""WITH {SQL_IMPORTS}, bodies AS (SELECT src AS id, string_agg(CASE WHEN dst % 2 = 1 THEN upper(name) ELSE name END, '(); ') AS body FROM calls JOIN fn ON fn.id = dst GROUP BY 1),
    b AS (SELECT DISTINCT t.id, f.name AS who FROM fn t JOIN fn f ON f.id <> t.id JOIN bodies ON bodies.id = f.id AND contains(body, t.name)),
    br AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY who) AS rn FROM b)
    SELECT dst AS id, 'caller' AS how, name AS who FROM calls JOIN fn ON fn.id = src
    UNION SELECT fn.id, 'import', importer FROM edges JOIN fn ON fn.name = edges.name
    UNION SELECT id, 'body', who FROM br WHERE rn <= 20""",
)
def where_used(spark, sf):
    return Q.where_used(T.call_pairs(spark, sf), import_edges(spark, sf), functions_with_bodies(spark, sf))


def sql_reach(targets: str, depth: int) -> str:
    return f"""r(start, node, d) AS (SELECT id, src, 1 FROM {targets} JOIN calls ON dst = id
      UNION SELECT r.start, calls.src, d + 1 FROM r JOIN calls ON calls.dst = r.node WHERE d < {depth}),
    m AS (SELECT start, node, min(d) AS d FROM r GROUP BY ALL)"""


@query(
    "code_blast_radius",
    "GRA9 REL10",
    f"""WITH RECURSIVE {SQL_FN}, {sql_calls()}, {sql_reach("fn", 3)},
    a AS (SELECT start, count(*) FILTER (d = 1) AS direct, count(*) AS dependents, count(DISTINCT file) AS files FROM m LEFT JOIN fn ON fn.id = node GROUP BY 1),
    z AS (SELECT fn.id, coalesce(direct, 0) AS direct, coalesce(dependents, 0) AS dependents, coalesce(files, 0) AS files FROM fn LEFT JOIN a ON start = fn.id)
    SELECT id, direct, dependents, files, CASE WHEN dependents >= 10 OR files >= 5 THEN 'Critical' WHEN dependents >= 5 OR files >= 3 THEN 'High' WHEN dependents >= 2 OR files >= 2 THEN 'Medium' ELSE 'Low' END AS level FROM z""",
)
def blast_radius(spark, sf):
    c = T.call_pairs(spark, sf)
    return Q.blast_radius(c, T.functions(spark, sf), T.functions(spark, sf).select("id"))


@query(
    "code_impact_analysis",
    "GRA10",
    f"""WITH RECURSIVE {SQL_FN}, {sql_calls()}, {sql_reach("fn", 5)},
    a AS (SELECT start, count(*) FILTER (d = 1) AS direct, count(*) AS dependents, count(DISTINCT file) AS files FROM m LEFT JOIN fn ON fn.id = node GROUP BY 1)
    SELECT fn.id, coalesce(direct, 0) AS direct, coalesce(dependents, 0) AS dependents, coalesce(files, 0) AS files FROM fn LEFT JOIN a ON start = fn.id""",
)
def impact_analysis(spark, sf):
    c = T.call_pairs(spark, sf)
    return Q.blast_radius(c, T.functions(spark, sf), T.functions(spark, sf).select("id"), depth=5).drop("level")


@query(
    "code_name_resolution",
    "GRA12",
    f"""WITH {SQL_FN}, asked AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '_') || '_' || p_partkey) WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', 2) || '_' || p_partkey
       ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS asked FROM part),
    c AS (SELECT asked, 0 AS how, name, id FROM asked JOIN fn ON name = asked UNION ALL SELECT asked, 1, name, id FROM asked JOIN fn ON lower(name) = lower(asked)
      UNION ALL SELECT asked, 2, name, id FROM asked JOIN fn ON ends_with(name, asked) AND split_part(name, '_', -1) = split_part(asked, '_', -1))
    SELECT asked, how, name, id FROM c QUALIFY row_number() OVER (PARTITION BY asked ORDER BY how, name, id) = 1""",
)
def name_resolution(spark, sf):
    k = F.col("p_partkey").cast("string")
    whole = F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), k)
    tail = F.concat_ws("_", F.split("p_name", " ")[1], k)
    m = F.col("p_partkey") % 3
    p = T.load(spark, sf, "part").select(F.when(m == 0, F.upper(whole)).when(m == 1, tail).otherwise(whole).alias("asked"))
    return Q.resolve_names(p, T.functions(spark, sf))


@query(
    "code_hub_files",
    "GRA18",
    f"WITH {SQL_FN}, {sql_calls()} SELECT file, count(*) AS edges FROM calls JOIN fn ON fn.id = src GROUP BY 1 ORDER BY edges DESC, file LIMIT 10",
)
def hub_files(spark, sf):
    return Q.hub_files(T.call_pairs(spark, sf), T.functions(spark, sf))


def brand_modules(spark, sf):
    m = T.load(spark, sf, "part").select(F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", "/"), F.lit("/")).alias("m")).distinct()
    return m.select(F.col("m").alias("from_module"), F.reverse(F.split(F.reverse("m"), "/")[0]).alias("x")).select(
        "from_module", F.lit("src/Brand/1/").alias("to_module")
    )


@query(
    "code_coupling",
    "GRA19",
    f"""WITH {SQL_FN}, {sql_calls()}, b AS (SELECT DISTINCT 'src/' || replace(p_brand, '#', '/') || '/' AS m FROM part),
    e AS (SELECT a.file AS sf, z.file AS df FROM calls JOIN fn a ON a.id = src JOIN fn z ON z.id = dst)
    SELECT m AS from_module, 'src/Brand/1/' AS to_module, count(sf) AS edges FROM b LEFT JOIN e ON starts_with(sf, m) AND starts_with(df, 'src/Brand/1/') GROUP BY 1""",
)
def coupling(spark, sf):
    return Q.coupling(T.call_pairs(spark, sf), T.functions(spark, sf), brand_modules(spark, sf))


@query(
    "code_dead_code",
    "GRA20 REL7",
    f"WITH {SQL_FN}, {sql_calls()} SELECT id, name, file, line FROM fn WHERE id NOT IN (SELECT dst FROM calls)",
)
def dead_code(spark, sf):
    return Q.dead_code(T.functions(spark, sf), T.call_pairs(spark, sf))


@query(
    "code_file_skeleton",
    "GRA21",
    f"WITH {SQL_FN} SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, name)::INTEGER AS position FROM fn",
)
def file_skeleton(spark, sf):
    return Q.file_skeleton(T.functions(spark, sf))


@query(
    "code_module_exports",
    "GRA21 REL16",
    f"WITH {SQL_FN} SELECT file, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM fn GROUP BY 1",
)
def module_exports(spark, sf):
    return Q.module_exports(T.functions(spark, sf), None).withColumn("names", F.array_join("names", ","))


SQL_FILES = """fg AS (SELECT DISTINCT a.file AS src, z.file AS dst FROM calls JOIN fn a ON a.id = calls.src JOIN fn z ON z.id = calls.dst WHERE a.file <> z.file)"""


@query(
    "code_import_tree",
    "GRA22",
    f"""WITH {SQL_FN}, {sql_calls()}, {SQL_FILES}, roots AS (SELECT DISTINCT file FROM fn),
    r AS (SELECT file AS start, dst AS node, 1 AS d FROM roots JOIN fg ON src = file),
    r2 AS (SELECT * FROM r UNION SELECT r.start, fg.dst, 2 FROM r JOIN fg ON fg.src = r.node)
    SELECT start, node, min(d) AS depth FROM r2 GROUP BY ALL""",
)
def import_tree(spark, sf):
    f = T.functions(spark, sf)
    roots = f.select("file").distinct()
    return Q.import_tree(Q.file_graph(T.call_pairs(spark, sf), f), roots)


@query(
    "code_x_ray",
    "GRA23",
    f"""WITH {SQL_FN}, {sql_calls()}, {SQL_MOD},
    a AS (SELECT dst AS id, array_to_string(list_sort(list(name))[1:25], ',') AS callers FROM calls JOIN fn ON fn.id = src GROUP BY 1),
    b AS (SELECT src AS id, array_to_string(list_sort(list(name))[1:15], ',') AS callees FROM calls JOIN fn ON fn.id = dst GROUP BY 1),
    c AS (SELECT fn AS id, array_to_string(list(commit ORDER BY date DESC, commit DESC)[1:5], ',') AS last_commits FROM modi GROUP BY 1)
    SELECT id, name, file, line, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, coalesce(last_commits, '') AS last_commits FROM fn LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)""",
)
def x_ray(spark, sf):
    x = Q.x_ray(T.functions(spark, sf), T.call_pairs(spark, sf), T.modified(spark, sf))
    cols = {c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")) for c in ("callers", "callees", "last_commits")}
    return x.withColumns(cols)


@query(
    "code_search",
    "GRA24",
    f"""WITH {SQL_BODIES} (SELECT 'name' AS place, id, name, file FROM fb WHERE contains(lower(name), 'ring_1') ORDER BY name, file, id LIMIT 50)
    UNION ALL (SELECT 'body', id, name, file FROM fb WHERE contains(lower(body), 'ring_1') ORDER BY name, file, id LIMIT 20)""",
)
def search_code(spark, sf):
    return Q.search_code(functions_with_bodies(spark, sf), "Ring_1")


@query(
    "code_decorated_with",
    "GRA25",
    """SELECT DISTINCT 'Function' AS kind, p_name AS name, p_brand AS file, CASE WHEN p_size % 2 = 0 THEN 'app.' || lower(p_type) ELSE lower(p_type) END AS decorator FROM part WHERE p_type = 'SMALL'""",
)
def decorated_with(spark, sf):
    low = F.lower("p_type")
    d = T.load(spark, sf, "part").select(
        F.lit("Function").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("app."), low)).otherwise(low).alias("decorator"),
    )
    return Q.decorated_with(d, "small")


@query(
    "code_resolves_to",
    "GRA26",
    """SELECT 'definition' AS what, split_part(p_name, ' ', 2) AS name, p_brand AS file, p_size AS line FROM part WHERE split_part(p_name, ' ', 2) = 'ring'
    UNION ALL SELECT 'reference', replace(p_name, ' ', '.'), p_brand, p_size FROM part WHERE split_part(p_name, ' ', 2) = 'ring'""",
)
def resolves_to(spark, sf):
    p = T.load(spark, sf, "part")
    place = (F.col("p_brand").alias("file"), F.col("p_size").alias("line"))
    defs = p.select(F.split("p_name", " ")[1].alias("name"), *place)
    refs = p.select(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")).alias("symbol"), *place)
    return Q.resolves_to(defs, refs, "shop.parts.ring")


SQL_RISK = f"""{SQL_FN}, {sql_calls()}, {SQL_MOD}, {sql_reach("fn", 3)},
  b AS (SELECT start AS id, count(*) AS t FROM m GROUP BY 1), h AS (SELECT fn AS id, count(DISTINCT author) AS a, count(*) FILTER (contains(lower(message), 'fix') OR message LIKE '1-URGENT%') AS x FROM modi GROUP BY 1)"""


@query(
    "code_risk_scores",
    "GRA27",
    f"""WITH RECURSIVE {SQL_RISK}, s AS (SELECT fn.id, coalesce(t, 0) AS transitive, coalesce(a, 0) AS authors, coalesce(x, 0) AS fixes,
      CASE WHEN t > 200 THEN 4.0 WHEN t > 50 THEN 3 WHEN t > 10 THEN 2 WHEN t > 0 THEN 1 ELSE 0 END + CASE WHEN a IS NULL THEN 0.0 WHEN a = 1 THEN 3 WHEN a = 2 THEN 2 ELSE 1 END
      + CASE WHEN x >= 2 THEN 1.0 WHEN x = 1 THEN 0.5 ELSE 0 END AS score FROM fn LEFT JOIN b USING (id) LEFT JOIN h USING (id))
    SELECT id, transitive, authors, fixes, score::DOUBLE AS score, CASE WHEN score < 3 THEN 'LOW' WHEN score < 6 THEN 'MEDIUM' WHEN score < 8 THEN 'HIGH' ELSE 'VERY HIGH' END AS verdict FROM s""",
)
def risk_scores(spark, sf):
    m = T.modified(spark, sf).withColumn(
        "message", F.when(F.col("message").startswith("1-URGENT"), F.concat(F.lit("Hotfix "), F.col("message"))).otherwise(F.col("message"))
    )
    return Q.risk_scores(T.call_pairs(spark, sf), m, T.functions(spark, sf))


@query(
    "code_pre_change_warning",
    "GRA28",
    f"""WITH RECURSIVE {SQL_FN}, {sql_calls()}, {SQL_MOD}, {sql_reach("fn", 3)},
    b AS (SELECT start AS id, count(*) FILTER (d = 1) AS direct, count(*) AS transitive FROM m GROUP BY 1),
    l AS (SELECT fn AS id, arg_max(author, (date, commit)) AS last_author FROM modi GROUP BY 1),
    t AS (SELECT fn AS id, author, count(*) AS n FROM modi GROUP BY ALL), t3 AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, author) <= 3),
    k AS (SELECT id, string_agg(author::VARCHAR, ',' ORDER BY n DESC, author) AS maintainers, count(*) AS c FROM t3 GROUP BY 1)
    SELECT fn.id, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, last_author, maintainers, coalesce(direct, 0) > 50 OR coalesce(transitive, 0) > 200 AS high_blast,
      coalesce(c = 1, false) AS bus_factor_one FROM fn LEFT JOIN b USING (id) LEFT JOIN l USING (id) LEFT JOIN k USING (id)""",
)
def pre_change_warning(spark, sf):
    c = T.call_pairs(spark, sf)
    w = Q.pre_change_warning(c, T.modified(spark, sf), T.functions(spark, sf).select("id")).drop("last_date")
    return w.withColumn("maintainers", F.array_join(F.col("maintainers").cast("array<string>"), ","))


@query(
    "code_co_change",
    "GRA29 REL9",
    f"""WITH {SQL_MOD}, p AS (SELECT a.fn AS target, b.fn AS partner, count(*) AS shared FROM md a JOIN md b ON b.commit = a.commit AND b.fn <> a.fn GROUP BY 1, 2)
    SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY shared DESC, partner) <= 10""",
)
def co_change(spark, sf):
    return Q.co_change_partners(T.modified(spark, sf), T.functions(spark, sf).select(F.col("id").alias("fn")), "fn")


@query(
    "code_recall_history",
    "GRA30 REL14",
    """(SELECT 'fact' AS kind, c_name || ' buys ' || c_mktsegment AS content FROM customer WHERE contains(c_name, 'URN') OR contains(c_mktsegment, 'URN') ORDER BY content LIMIT 15)
    UNION ALL (SELECT 'commit', left(o_orderpriority || ' ' || o_orderstatus, 200) FROM orders WHERE contains(o_orderpriority || ' ' || o_orderstatus, 'URN') ORDER BY o_orderkey LIMIT 10)""",
)
def recall_history(spark, sf):
    facts = T.load(spark, sf, "customer").select(
        F.col("c_name").alias("subject"), F.lit("buys").alias("predicate"), F.col("c_mktsegment").alias("object")
    )
    return Q.recall_history(facts, T.commits(spark, sf), "URN")


def diff_lines(spark, sf):
    d = T.load(spark, sf, "documents").select(F.col("doc_id").alias("pr"), F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    sign = F.when(F.col("pos") % 3 == 0, "-").when(F.col("pos") % 3 == 1, "+").otherwise(" ")
    tail = F.when(F.col("l").contains("the"), " ?? 0").otherwise(" x.map(f)")
    return d.select("pr", F.concat(sign, "l", tail).alias("line"))


@query(
    "code_diff_risk",
    "GRA31",
    r"""WITH l AS (SELECT doc_id AS pr, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    x AS (SELECT pr, CASE pos % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END || l || CASE WHEN contains(l, 'the') THEN ' ?? 0' ELSE ' x.map(f)' END AS line FROM l),
    d AS (SELECT pr, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---') AND regexp_matches(line, '\?\?|\?\.|!= null|!== null|!== undefined')) AS guards,
      count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++') AND regexp_matches(line, '\.split\(|\.map\(|\.filter\(|\.forEach\(') AND NOT regexp_matches(line, '\?\?|\?\.|\|\| \[\]|\|\| ''''')) AS unguarded FROM x GROUP BY 1),
    c AS (SELECT doc_id AS pr, (lang = 'de')::BIGINT AS schemas, (lang IN ('de', 'fr') AND n_chars % 2 = 0)::BIGINT AS deleted FROM documents)
    SELECT pr, guards, unguarded, schemas, deleted, CASE WHEN guards > 3 OR (deleted > 0 AND schemas > 0) THEN 'HIGH' WHEN guards > 0 OR schemas > 0 OR unguarded > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
      CASE WHEN guards = 0 AND unguarded <= 3 AND schemas = 0 AND deleted = 0 THEN 'none found' ELSE concat_ws('; ', CASE WHEN guards > 0 THEN 'null guards taken out: ' || guards END,
        CASE WHEN unguarded > 3 THEN 'unguarded calls added: ' || unguarded END, CASE WHEN schemas > 0 THEN 'touches the schema' END,
        CASE WHEN deleted > 0 THEN 'files removed: ' || deleted END) END AS risk_details FROM d JOIN c USING (pr)""",
)
def diff_risk(spark, sf):
    lang = F.col("lang")
    c = T.load(spark, sf, "documents").select(
        F.col("doc_id").alias("pr"), F.when(lang == "de", "db/migration/1.sql").otherwise("src/a.ts").alias("file"),
        F.when(lang.isin("de", "fr") & (F.col("n_chars") % 2 == 0), "D").otherwise("M").alias("status"),
    )
    return Q.diff_risk(diff_lines(spark, sf), c).drop("files_changed")


def pr_changes(spark, sf):
    """Open PRs: open orders; their lines' files with the return flag as change."""
    o = T.load(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("pr"))
    c = T.file_changes(spark, sf).select(F.col("commit").alias("pr"), "file", F.col("change").alias("change_type"))
    return c.join(o, "pr", "left_semi")


SQL_PRS = f"""{SQL_CHANGES}, prc AS (SELECT commit AS pr, file, change AS change_type FROM chg WHERE commit IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')),
  hit AS (SELECT DISTINCT pr, fn.id AS fn, name, file, change_type FROM prc JOIN fn USING (file))"""


@query(
    "code_affected_functions",
    "GRA32",
    f"WITH {SQL_PRS} SELECT pr, fn, name, change_type FROM hit",
)
def affected_functions(spark, sf):
    return Q.affected_functions(pr_changes(spark, sf), T.functions(spark, sf)).drop("file")


def code_messages(spark, sf):
    """Conversation turns that name the function with the id of their conversation."""
    c = T.load(spark, sf, "conversations")
    f = T.functions(spark, sf).select(F.col("id").alias("conv_id"), "name")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    mark = F.when(F.col("role") == "user", "?").otherwise(".")
    return c.join(f, "conv_id").join(last, "conv_id").select(
        F.concat(F.col("text"), F.lit(" see "), F.upper("name"), mark).alias("text"),
        F.when(F.col("turn") % 2 == 0, "prod-errors").otherwise("general").alias("channel"),
        (F.col("role") == "user").alias("has_symptom"), (F.col("last") - F.col("turn")).alias("reply_count"),
    )


@query(
    "code_pr_checks",
    "GRA33 GRA32 REL12",
    f"""WITH {SQL_PRS}, {sql_calls()}, {SQL_MOD}, msg AS (SELECT text || ' see ' || upper(name) || CASE WHEN role = 'user' THEN '?' ELSE '.' END AS text, CASE WHEN turn % 2 = 0 THEN 'prod-errors' ELSE 'general' END AS channel,
      role = 'user' AS has_symptom, max(turn) OVER (PARTITION BY conv_id) - turn AS reply_count FROM conversations JOIN fn ON fn.id = conv_id),
    touched AS (SELECT DISTINCT fn, name FROM hit), named AS (SELECT fn, msg.* FROM touched JOIN msg ON contains(lower(text), lower(name))),
    own AS (SELECT pr, commit, count(*) AS own FROM (SELECT DISTINCT pr, file FROM prc) f JOIN ch USING (file) GROUP BY ALL),
    missing AS (SELECT pr, ch.file, sum(own)::BIGINT AS n FROM own JOIN ch USING (commit) WHERE NOT EXISTS (SELECT 1 FROM prc WHERE prc.pr = own.pr AND prc.file = ch.file) GROUP BY ALL HAVING sum(own) >= 3)
    SELECT pr, 'functions' AS check, name AS detail, 1::BIGINT AS n FROM hit
    UNION ALL SELECT pr, 'prod_history', name, n FROM hit JOIN (SELECT fn, count(*) AS n FROM named WHERE has_symptom AND channel = 'prod-errors' AND fn IN (SELECT fn FROM md) GROUP BY 1) USING (fn)
    UNION ALL SELECT pr, 'co_change', file, n FROM missing
    UNION ALL SELECT pr, 'callers', name, n FROM hit JOIN (SELECT dst AS fn, count(*) AS n FROM calls GROUP BY 1 HAVING count(*) >= 2) USING (fn)
    UNION ALL SELECT pr, 'unanswered', name, n FROM hit JOIN (SELECT fn, count(*) AS n FROM named WHERE contains(text, '?') AND reply_count = 0 GROUP BY 1) USING (fn)
    UNION ALL SELECT pr, 'churn', name, n FROM hit JOIN (SELECT fn, count(*) AS n FROM md GROUP BY 1 HAVING count(*) >= 5) USING (fn)
    UNION ALL SELECT o_orderkey, 'ticket', 'SHOP-' || o_custkey || CASE WHEN o_totalprice > 200000 THEN ' Done' ELSE ' To Do' END, 1 FROM orders WHERE o_orderkey IN (SELECT pr FROM prc) AND (o_totalprice > 200000 OR o_totalprice < 50000)
    UNION ALL SELECT pr, 'known_issue', name, n FROM hit JOIN (SELECT fn, count(*) AS n FROM named WHERE has_symptom GROUP BY 1) USING (fn)""",
)
def pr_checks(spark, sf):
    price = F.col("o_totalprice")
    tickets = T.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pr"), F.concat(F.lit("SHOP-"), F.col("o_custkey").cast("string")).alias("key"),
        F.when(price > 200000, "Done").when(price < 50000, "To Do").otherwise("Open").alias("status"),
    )
    return Q.pr_checks(
        pr_changes(spark, sf), T.functions(spark, sf), T.call_pairs(spark, sf), T.modified(spark, sf),
        T.file_changes(spark, sf), code_messages(spark, sf), tickets,
    )


def entities(spark, sf):
    """Parts as entities: type = kind, size the first line, brand number the length."""
    p = T.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand")
    kind = F.when(F.col("p_type") == "SMALL", "class").when(F.col("p_type") == "ECONOMY", "interface").otherwise("function")
    f = T.functions(spark, sf).join(p, "id")
    return f.select("id", kind.alias("kind"), "name", "file", "line", (F.col("line") + F.col("id") % 40).alias("end_line"))


@query(
    "code_file_summary",
    "GRA34",
    f"""WITH {SQL_CHANGES}, e AS (SELECT fn.*, CASE p_type WHEN 'SMALL' THEN 'class' WHEN 'ECONOMY' THEN 'interface' ELSE 'function' END AS kind, fn.line + fn.id % 40 AS end_line FROM fn JOIN part ON p_partkey = fn.id),
    a AS (SELECT file, max(end_line) AS lines, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind <> 'function') AS classes,
      coalesce(array_to_string((list(name ORDER BY end_line - line DESC, name) FILTER (kind = 'function'))[1:5], ','), '') AS key_functions FROM e GROUP BY 1),
    l AS (SELECT file, arg_max(author, (date, commit)) AS last_author FROM chg GROUP BY 1)
    SELECT a.*, coalesce(last_author, -1) AS last_author FROM a LEFT JOIN l USING (file)""",
)
def file_summary(spark, sf):
    s = Q.file_summary(entities(spark, sf), T.file_changes(spark, sf)).drop("last_date")
    return s.withColumn("key_functions", F.coalesce(F.array_join("key_functions", ","), F.lit(""))).fillna(-1, ["last_author"])


@query(
    "code_callers_by_file",
    "GRA34",
    f"""WITH {SQL_FN}, {sql_calls()} SELECT z.file, count(*) AS calls, count(DISTINCT a.file) AS files FROM calls JOIN fn a ON a.id = src JOIN fn z ON z.id = dst WHERE a.file <> z.file GROUP BY 1""",
)
def callers_by_file(spark, sf):
    return Q.callers_by_file(T.call_pairs(spark, sf), T.functions(spark, sf))


@query(
    "code_recent_changes",
    "GRA34",
    f"WITH {SQL_CHANGES} SELECT file, commit, author FROM chg QUALIFY row_number() OVER (PARTITION BY file ORDER BY date DESC, commit DESC) <= 5",
)
def recent_changes(spark, sf):
    return Q.recent_changes(T.file_changes(spark, sf)).select("file", "commit", "author")


BRIEF = "1999-06-01"


@query(
    "code_brief_totals",
    "GRA35",
    f"""WITH {SQL_CHANGES} SELECT count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, count(DISTINCT file) AS files,
    count(*) FILTER (change = 'A') AS added, count(*) FILTER (change = 'M') AS modified, count(*) FILTER (change = 'D') AS deleted FROM chg WHERE date >= TIMESTAMP '{BRIEF}'""",
)
def brief_totals(spark, sf):
    return Q.change_brief(T.file_changes(spark, sf), BRIEF)["totals"]


@query(
    "code_brief_folders",
    "GRA35",
    f"WITH {SQL_CHANGES} SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS folder, count(*) AS changes FROM chg WHERE date >= TIMESTAMP '{BRIEF}' GROUP BY 1",
)
def brief_folders(spark, sf):
    return Q.change_brief(T.file_changes(spark, sf), BRIEF)["folders"]


@query(
    "code_brief_functions",
    "GRA35 REL8",
    f"""WITH {SQL_CHANGES}, {sql_calls()}, n AS (SELECT dst AS id, count(*) AS callers FROM calls GROUP BY 1)
    SELECT id, name, file, coalesce(callers, 0) AS callers FROM fn LEFT JOIN n USING (id) WHERE file IN (SELECT file FROM chg WHERE date >= TIMESTAMP '{BRIEF}')""",
)
def brief_functions(spark, sf):
    return Q.brief_functions(T.file_changes(spark, sf), BRIEF, T.functions(spark, sf), T.call_pairs(spark, sf))


@query(
    "code_conventions",
    "GRA36",
    """WITH e AS (SELECT p_brand AS repo, CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2)
       ELSE upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) END AS name, CASE p_type WHEN 'SMALL' THEN 'try { x } catch (e)' WHEN 'ECONOMY' THEN 'try: x except ' WHEN 'LARGE' THEN 'if err != nil { return }' ELSE 'p.catch(f)' END AS body,
       CASE WHEN p_size < 10 THEN 'models/' WHEN p_size < 20 THEN 'views/' ELSE 'shop/' END || CASE WHEN p_size % 5 = 0 THEN 'test_a' || p_size || '.py' WHEN p_size % 5 = 1 THEN 'b' || p_size || '.spec.ts' ELSE 'c.py' END AS file FROM part),
    v AS (SELECT repo, count(*) FILTER (regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)+')) AS sn, count(*) FILTER (regexp_full_match(name, '[a-z][a-zA-Z0-9]*')) AS ca, count(*) FILTER (regexp_full_match(name, '[A-Z][a-zA-Z0-9]*')) AS pa,
       count(*) FILTER (contains(body, 'try:') OR contains(body, 'except ')) AS e0, count(*) FILTER (contains(body, 'if err != nil')) AS e1, count(*) FILTER (contains(body, '.catch(')) AS e3, count(*) FILTER (contains(body, 'try {') OR contains(body, 'catch (') OR contains(body, 'catch(')) AS e4 FROM e GROUP BY 1),
    t AS (SELECT repo, count(DISTINCT file) FILTER (contains(file, '/test_')) AS tp, count(DISTINCT file) FILTER (contains(file, '.spec.ts')) AS ts, count(DISTINCT split_part(file, '/', 1)) FILTER (file LIKE 'models/%' OR file LIKE 'views/%') AS lay,
       count(DISTINCT split_part(file, '/', 1)) FILTER (file LIKE 'shop/%') AS fea FROM e GROUP BY 1)
    SELECT repo, CASE greatest(ca, sn, pa) WHEN 0 THEN 'mixed' WHEN ca THEN 'camelCase' WHEN sn THEN 'snake_case' ELSE 'PascalCase' END AS naming,
      CASE greatest(e0, e1, e3, e4) WHEN e0 THEN 'try/except' WHEN e1 THEN 'if err != nil' WHEN e3 THEN '.catch' ELSE 'try/catch' END AS errors,
      CASE WHEN tp = 0 AND ts = 0 THEN 'unknown' WHEN ts >= tp THEN '*.spec.ts' ELSE 'test_*.py' END AS tests, CASE WHEN lay >= 2 THEN 'layer-based' WHEN fea > lay THEN 'feature-based' ELSE 'mixed' END AS structure, '' AS patterns FROM v JOIN t USING (repo)""",
)
def conventions(spark, sf):
    size, name = F.col("p_size"), F.col("p_name")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    styled = (
        F.when(size % 3 == 0, F.regexp_replace(name, " ", "_")).when(size % 3 == 1, F.concat(first, F.initcap(second)))
        .otherwise(F.initcap(first))
    )
    t = F.col("p_type")
    body = (
        F.when(t == "SMALL", "try { x } catch (e)").when(t == "ECONOMY", "try: x except ")
        .when(t == "LARGE", "if err != nil { return }").otherwise("p.catch(f)")
    )
    folder = F.when(size < 10, "models/").when(size < 20, "views/").otherwise("shop/")
    base = (
        F.when(size % 5 == 0, F.concat(F.lit("test_a"), size.cast("string"), F.lit(".py")))
        .when(size % 5 == 1, F.concat(F.lit("b"), size.cast("string"), F.lit(".spec.ts"))).otherwise("c.py")
    )
    e = T.load(spark, sf, "part").select(
        F.col("p_brand").alias("repo"), F.lit("function").alias("kind"), styled.alias("name"), body.alias("body"),
        F.concat(folder, base).alias("file"),
    )
    return Q.conventions(e).withColumn("patterns", F.array_join("patterns", ","))


@query(
    "code_similar_functions",
    "GRA37",
    f"""WITH {SQL_FN}, q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS qid FROM part),
    f AS (SELECT fn.id, fn.name, fn.file || ':' || fn.line AS place, list_distinct(regexp_split_to_array(fn.name, '_')) AS nt, list_distinct(regexp_split_to_array(lower(p_type || '#' || p_brand || '#' || p_size), '[^a-z0-9]+')) AS bt FROM fn JOIN part ON p_partkey = fn.id),
    qt AS (SELECT qid, list_distinct(string_split(qid, ' ')) AS t FROM q),
    s AS (SELECT qid, id, name, place,
       len(list_intersect(t, nt)) AS ns, len(list_filter(t, lambda x: len(list_filter(nt, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS nn,
       len(list_intersect(t, bt)) AS bs, len(list_filter(t, lambda x: len(list_filter(bt, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS bn, len(t) AS tq, len(nt) AS ln, len(bt) AS lb FROM qt, f),
    z AS (SELECT *, round_even(CASE WHEN ns > 0 THEN 0.7::DOUBLE * (ns / tq) + 0.3::DOUBLE * (ns / ln) ELSE nn / tq * 0.5::DOUBLE END, 2) AS a, round_even(CASE WHEN bs > 0 THEN 0.7::DOUBLE * (bs / tq) + 0.3::DOUBLE * (bs / lb) ELSE bn / tq * 0.5::DOUBLE END, 2) AS b FROM s),
    w AS (SELECT *, round_even(0.6::DOUBLE * a + 0.4::DOUBLE * b, 2) AS score FROM z)
    SELECT qid, id, name, place, score FROM w WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, name, id) <= 10""",
)
def similar_functions(spark, sf):
    p = T.load(spark, sf, "part")
    text = F.concat_ws(" ", "p_name", F.lower("p_type"))
    asked = p.select(text.alias("qid"), text.alias("description")).distinct()
    body = p.select(F.col("p_partkey").alias("id"), F.concat_ws("#", "p_type", F.lower("p_brand"), F.col("p_size").cast("string")).alias("body"))
    return Q.similar_functions(asked, T.functions(spark, sf).join(body, "id"))


@query(
    "code_changed_functions",
    "GRA38",
    f"""WITH {SQL_FN}, e AS (SELECT *, line + id % 40 AS end_line FROM fn), h AS (SELECT DISTINCT file, l_linenumber * 9 AS s, l_linenumber * 9 + (l_quantity % 5)::INTEGER AS z FROM lineitem JOIN fn ON fn.id = l_partkey)
    SELECT DISTINCT e.id, e.name, e.file FROM e JOIN h ON h.file = e.file AND s <= end_line AND z >= line""",
)
def changed_functions(spark, sf):
    f = T.functions(spark, sf)
    li = T.load(spark, sf, "lineitem")
    start = F.col("l_linenumber") * 9
    hunks = li.select(
        F.col("l_partkey").alias("id"), start.alias("start_line"), (start + (F.col("l_quantity") % 5).cast("int")).alias("end_line")
    ).join(f.select("id", "file"), "id").select("file", "start_line", "end_line").distinct()
    return Q.changed_functions(hunks, f.withColumn("end_line", F.col("line") + F.col("id") % 40))
