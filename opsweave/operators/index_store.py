"""A code index kept as partitioned tables and maintained by change sets.

``build`` writes four tables into one folder; ``apply_changes`` takes the changed files of one or more
repositories, with the fresh parse of these files, and rewrites only the partitions that they touch:

* ``entities(repo, kind, name, file, line, ...)`` and ``sites(repo, caller_name, caller_file, callee_name)``,
  partitioned by repository and bucket of the file;
* ``names(repo, name, file, line, role)``: the files that define a name (``fn``), that it calls from
  (``caller``) or that call it (``callee``), partitioned by repository and bucket of the name;
* ``edges(repo, caller_name, caller_file, callee_name, src_file, dst_file)``: every site with the files its
  names stand for, partitioned like the sites.

A name stands for the first file that defines it in its repository, else the first that calls from it, else
for nothing (``""``); names of two repositories never meet. A change set alters the edges of its own
files and of the sites elsewhere that mention a name whose first file has changed; ``names`` finds those
without reading the other sites.

The tables are written in the order edges, names, sites, entities. What a change set replaces is read from
the last two, so a change set that was interrupted is repaired by applying it again, and applying one twice
changes nothing. Rows without a repository, file or name are left out. Repeated rows count once in names and
edges. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.session import cut_lineage

BUCKETS = 16
SITE = ("repo", "caller_name", "caller_file", "callee_name")
EDGE = (*SITE, "src_file", "dst_file")
NAME = ("repo", "name", "file", "line", "role")
TABLES = {"entities": ("repo", "file"), "sites": ("repo", "caller_file"), "names": ("repo", "name"), "edges": ("repo", "caller_file")}


def _part(repo: str, key: str, buckets: int) -> Column:
    """The folder of a row; a letter in front keeps Spark from reading it as a number."""
    return F.concat_ws(
        "_", F.lit("p"), F.hex(F.xxhash64(F.col(repo))), F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("string")
    )


def _placed(table: str, rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("part", _part(*TABLES[table], buckets))


def _parts(rows: DataFrame) -> list[str]:
    """The folders of some rows: no more than the table has."""
    return [r["part"] for r in rows.select("part").distinct().collect()]


def _write(table: str, rows: DataFrame, root: str, buckets: int, parts: Sequence[str] | None = None) -> None:
    """Replace the given folders, or the whole table. Each replaced folder gets a row without a key, so
    that a folder with nothing left is overwritten as well; so does an empty table, which keeps its schema."""
    rows = _placed(table, rows, buckets)
    marks = rows.sparkSession.createDataFrame([(p,) for p in (["p"] if parts is None else parts)], "part string")
    rows = rows.unionByName(marks, allowMissingColumns=True)
    mode = "static" if parts is None else "dynamic"
    spread = rows.hint("rebalance", "part")  # one file a folder, more for a large one
    spread.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("part").parquet(f"{root}/{table}")


def _stored(spark: SparkSession, root: str, table: str, parts: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{table}")
    if parts is not None:
        rows = rows.where(F.col("part").isin(list(parts)))
    return rows.where(F.col(TABLES[table][1]).isNotNull())


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of ``entities``, ``sites``, ``names`` or ``edges``."""
    return _stored(spark, root, table).drop("part")


def call_edges(spark: SparkSession, root: str) -> DataFrame:
    """Distinct edges ``(repo, src_name, src_file, dst_name, dst_file)`` without calls to itself."""
    e = read(spark, root, "edges").select(
        "repo", F.col("caller_name").alias("src_name"), "src_file", F.col("callee_name").alias("dst_name"), "dst_file"
    )
    return e.where("not (src_name = dst_name and src_file = dst_file)").distinct()


def _known(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.dropna(subset=list(columns))


def _entities(rows: DataFrame) -> DataFrame:
    return _known(rows, ("repo", "name", "file"))


def _sites(rows: DataFrame) -> DataFrame:
    return _known(rows, SITE).select(*SITE).distinct()


def postings(entities: DataFrame, sites: DataFrame) -> DataFrame:
    """``(repo, name, file, line, role)``, each name once per file and role."""
    fns = entities.where("kind = 'function'").groupBy("repo", "name", "file").agg(F.min("line").cast("int").alias("line"))
    out = fns.withColumn("role", F.lit("fn"))
    for role in ("caller", "callee"):
        named = sites.select("repo", F.col(f"{role}_name").alias("name"), F.col("caller_file").alias("file")).distinct()
        out = out.unionByName(named.withColumns({"line": F.lit(None).cast("int"), "role": F.lit(role)}))
    return out


def first_files(names: DataFrame) -> DataFrame:
    """``(repo, name, first_file)``."""
    defined = F.min(F.when(F.col("role") == "fn", F.struct("file", "line")))["file"]
    called_from = F.min(F.when(F.col("role") == "caller", F.col("file")))
    return names.groupBy("repo", "name").agg(F.coalesce(defined, called_from, F.lit("")).alias("first_file"))


def resolve(sites: DataFrame, names: DataFrame) -> DataFrame:
    """The sites with ``src_file`` and ``dst_file``. ``names`` holds all rows of the names they use."""
    first = first_files(names)
    own = names.where("role = 'fn'").select(
        "repo", F.col("name").alias("caller_name"), F.col("file").alias("caller_file"), F.lit(True).alias("_own")
    )
    caller = first.withColumnsRenamed({"name": "caller_name", "first_file": "_first"})
    callee = first.withColumnsRenamed({"name": "callee_name", "first_file": "dst_file"})
    rows = sites.join(own, ["repo", "caller_name", "caller_file"], "left")
    rows = rows.join(caller, ["repo", "caller_name"]).join(callee, ["repo", "callee_name"])
    src = F.when(F.col("_own"), F.col("caller_file")).otherwise(F.col("_first"))
    return rows.select(*SITE, src.alias("src_file"), "dst_file")


def build(root: str, entities: DataFrame, sites: DataFrame, buckets: int = BUCKETS) -> None:
    """Write the whole index; whatever stood in the folder's tables is replaced."""
    entities, sites = _entities(entities), cut_lineage(_sites(sites))
    names = cut_lineage(postings(entities, sites))
    _write("edges", resolve(sites, names), root, buckets)
    _write("names", names, root, buckets)
    _write("sites", sites, root, buckets)
    _write("entities", entities, root, buckets)


def apply_changes(
    root: str, changed: DataFrame, entities: DataFrame, sites: DataFrame, buckets: int = BUCKETS
) -> dict[str, list[str]]:
    """Replace what the index holds of the files ``changed(repo, file)``.

    ``entities`` and ``sites`` are the fresh parse of those files; a deleted file has no rows there, and
    rows of files that are not in the change set are left out. ``buckets`` must be that of ``build``.
    Returns the folders rewritten per table.
    """
    spark = changed.sparkSession
    changed = cut_lineage(_known(changed, ("repo", "file")).select("repo", "file").distinct())
    callers = changed.withColumnRenamed("file", "caller_file")
    entities = cut_lineage(_entities(entities).join(changed, ["repo", "file"], "left_semi"))
    sites = cut_lineage(_sites(sites).join(callers, ["repo", "caller_file"], "left_semi"))
    file_parts = _parts(changed.withColumn("part", _part("repo", "file", buckets)))
    if not file_parts:
        return {t: [] for t in TABLES}

    old_entities = _stored(spark, root, "entities", file_parts).drop("part")
    old_sites = _stored(spark, root, "sites", file_parts).drop("part")
    gone = postings(
        old_entities.join(changed, ["repo", "file"], "left_semi"), old_sites.join(callers, ["repo", "caller_file"], "left_semi")
    )
    come = cut_lineage(postings(entities, sites))
    touched = gone.select("repo", "name").unionByName(come.select("repo", "name")).distinct()
    name_parts = _parts(_placed("names", touched, buckets))
    old_names = _stored(spark, root, "names", name_parts).drop("part")
    names = cut_lineage(old_names.join(changed, ["repo", "file"], "left_anti").unionByName(come).select(*NAME))

    # names that stand for another file now, and the files elsewhere that mention them
    before = first_files(old_names).withColumnRenamed("first_file", "_before")
    moved = first_files(names).join(before, ["repo", "name"], "left").where("not first_file <=> _before")
    moved = cut_lineage(moved.select("repo", "name"))
    mention = names.where("role <> 'fn'").join(moved, ["repo", "name"], "left_semi").select("repo", "file")
    edge_parts = _parts(mention.unionByName(changed).withColumn("part", _part("repo", "file", buckets)))

    def by(role: str) -> DataFrame:
        return moved.withColumnRenamed("name", f"{role}_name")

    others = _stored(spark, root, "sites", edge_parts).drop("part").join(callers, ["repo", "caller_file"], "left_anti")
    stale = sites
    for role in ("caller", "callee"):
        stale = stale.unionByName(others.join(by(role), ["repo", f"{role}_name"], "left_semi").select(*SITE))
    stale = cut_lineage(stale.distinct())
    used = stale.select("repo", F.col("caller_name").alias("name")).unionByName(
        stale.select("repo", F.col("callee_name").alias("name"))
    )
    used = used.distinct()
    elsewhere = [p for p in _parts(_placed("names", used, buckets)) if p not in set(name_parts)]
    lookup = names.unionByName(_stored(spark, root, "names", elsewhere).drop("part"))
    edges = _stored(spark, root, "edges", edge_parts).drop("part").join(stale, list(SITE), "left_anti")
    edges = edges.join(callers, ["repo", "caller_file"], "left_anti")
    edges = cut_lineage(edges.unionByName(resolve(stale, lookup.join(used, ["repo", "name"], "left_semi"))).select(*EDGE))

    _write("edges", edges, root, buckets, edge_parts)
    _write("names", names, root, buckets, name_parts)
    kept = old_sites.join(callers, ["repo", "caller_file"], "left_anti").unionByName(sites)
    _write("sites", cut_lineage(kept.select(*SITE)), root, buckets, file_parts)
    kept = old_entities.join(changed, ["repo", "file"], "left_anti").unionByName(entities, allowMissingColumns=True)
    _write("entities", cut_lineage(kept.select(*old_entities.columns)), root, buckets, file_parts)
    return {"entities": file_parts, "sites": file_parts, "names": name_parts, "edges": edge_parts}


def drop_repos(root: str, repos: DataFrame, buckets: int = BUCKETS) -> dict[str, list[str]]:
    """Take the repositories ``repos(repo)`` out of the index, as before a full parse."""
    spark = repos.sparkSession
    own = read(spark, root, "entities").select("repo", "file").unionByName(
        read(spark, root, "sites").select("repo", F.col("caller_file").alias("file"))
    )
    changed = own.join(repos.select("repo").distinct(), "repo", "left_semi")
    none = read(spark, root, "entities").where("false"), read(spark, root, "sites").where("false")
    return apply_changes(root, changed, *none, buckets=buckets)
