"""Building the code graph: calls, nodes and edges, imports, history, refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.functions.sizes import broadcast_if_small, shuffled
from opsweave.functions.text import any_of, contains_join
from opsweave.session import cut_lineage, freed_shuffles

# Words before "(" that are not calls.
NOT_CALLS = (
    "if", "for", "while", "return", "switch", "catch", "new", "typeof", "await", "import",
    "require", "console", "Math", "let", "mut", "pub", "fn", "mod", "use", "impl", "struct",
    "enum", "match", "Some", "None", "Ok", "Err", "println", "eprintln", "format", "vec",
    "assert", "assert_eq", "panic", "todo", "unimplemented", "include_str", "cfg", "derive",
    "test", "allow", "warn", "deny",
)
VALIDATION_WORDS = ("validate", "retry", "guard", "assert", "check", "sanitize", "verify")


def call_sites(entities: DataFrame) -> DataFrame:
    """Distinct calls found in function bodies: a word before ``(`` that starts in lower
    case, is no keyword and not the function itself."""
    called = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?U)(\w+)\s*\("), 1)))
    f = entities.where("kind = 'function'").select(
        F.col("file").alias("caller_file"), F.col("name").alias("caller_name"), called.alias("callee_name")
    )
    c = F.col("callee_name")
    keep = (
        (F.octet_length(c) > 1) & ~c.isin(*NOT_CALLS) & (c != F.col("caller_name")) & c.rlike(r"^\p{Ll}")
    )
    return f.where(keep).distinct()


def build_graph(entities: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(name, file, line)`` and edges ``(src_name, src_file, dst_name, dst_file)``.

    A caller is the function of that name in its file, else the first function of
    that name, else a stub; a callee is the first function of the name or a stub
    without file. "First" is the smallest (file, line).
    """
    fns = entities.where("kind = 'function'").groupBy("name", "file").agg(F.min("line").alias("line"))
    first = fns.groupBy("name").agg(F.min(F.struct("file", "line"))["file"].alias("first_file"))
    calls = sites.select("caller_name", "caller_file", "callee_name").distinct()
    stub_callers = (
        calls.groupBy(F.col("caller_name").alias("name")).agg(F.min("caller_file").alias("first_file"))
        .join(first, "name", "left_anti")
    )
    known = first.unionByName(stub_callers)
    stub_callees = (
        calls.select(F.col("callee_name").alias("name")).distinct().join(known, "name", "left_anti")
        .withColumn("first_file", F.lit(""))
    )
    names = known.unionByName(stub_callees)
    stubs = stub_callers.unionByName(stub_callees).select(
        "name", F.col("first_file").alias("file"), F.lit(0).alias("line")
    )
    nodes = fns.unionByName(stubs)
    exact = fns.select(
        F.col("name").alias("caller_name"), F.col("file").alias("caller_file"), F.lit(True).alias("_own")
    )
    lookup = broadcast_if_small(names)
    resolved = (
        calls.join(exact, ["caller_name", "caller_file"], "left")
        .join(lookup.withColumnsRenamed({"name": "caller_name", "first_file": "_caller_first"}), "caller_name")
        .join(lookup.withColumnsRenamed({"name": "callee_name", "first_file": "dst_file"}), "callee_name")
    )
    edges = resolved.select(
        F.col("caller_name").alias("src_name"),
        F.when(F.col("_own"), F.col("caller_file")).otherwise(F.col("_caller_first")).alias("src_file"),
        F.col("callee_name").alias("dst_name"),
        "dst_file",
    ).distinct()
    return nodes, edges.where("not (src_name = dst_name and src_file = dst_file)")


def _resolved_relative(file: Column, source: Column) -> Column:
    folder = F.regexp_replace(file, "[^/]*$", "")
    steps = F.split(F.concat(folder, source), "/")
    start = F.array().cast("array<string>")

    def walk(done, part):
        back = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(part == "..", back)
            .when(part.isin("", "."), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(steps, start, walk), "/")


def resolve_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Add ``resolved``: a repo path for relative and workspace imports, else the source.

    ``imports(file, import_source, …)``, ``packages(package, dir)``.
    """
    source = F.col("import_source")
    scoped = F.regexp_extract(source, "^(@[^/]*/[^/]*|[^/]*)", 1)
    keyed = imports.withColumn("_pkg", scoped)
    whole = packages.select(F.col("package").alias("import_source"), F.col("dir").alias("_whole"))
    part = packages.select(F.col("package").alias("_pkg"), F.col("dir").alias("_dir"))
    joined = keyed.join(broadcast_if_small(whole), "import_source", "left").join(
        broadcast_if_small(part), "_pkg", "left"
    )
    rest = F.regexp_replace(F.expr("substring(import_source, length(_pkg) + 1)"), "^/+", "")
    below = F.when(rest == "", F.col("_dir")).otherwise(F.concat_ws("/", "_dir", rest))
    resolved = F.when(source.startswith("."), _resolved_relative(F.col("file"), source)).otherwise(
        F.coalesce("_whole", F.when(F.col("_dir").isNotNull(), below), source)
    )
    return joined.select(*imports.columns, resolved.alias("resolved"))


def import_edges(resolved: DataFrame, functions: DataFrame) -> DataFrame:
    """IMPORTS edges file -> function of the imported name whose file starts with the
    resolved path. Functions of imported names are filed under every prefix of their
    path, so this is an equi join on (name, path). Both sides are shuffled: a row per prefix is
    far more than Spark expects of a compressed table. The imports are computed and shuffled once;
    those that come twice go with the last step."""
    wanted = resolved.select(
        F.col("file").alias("importer"), F.explode("import_names").alias("name"), F.col("resolved").alias("_path")
    )
    prefixes = F.transform(F.sequence(F.lit(0), F.length("file")), lambda i: F.substring("file", 1, i))
    own = functions.select("name", "file").distinct()
    filed = own.select("name", "file", F.explode(F.array_distinct(prefixes)).alias("_path"))
    return wanted.join(shuffled(filed), ["name", "_path"]).select("importer", "name", "file").distinct()


def cross_file_calls(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS edges from functions whose body names a function their file imports. Both are computed once."""
    with freed_shuffles(functions.sparkSession):
        imports = cut_lineage(imports.select("importer", "name", "file"))
        functions = cut_lineage(functions.select("name", "file", "body"))
    bodies = functions.select(
        F.col("name").alias("caller"), F.col("file").alias("importer"), F.lower("body").alias("_body")
    )
    wanted = imports.select(
        "importer", F.col("name").alias("callee"), F.col("file").alias("callee_file"),
        F.lower("name").alias("_name"),
    )
    hits = contains_join(bodies, "_body", wanted, "_name", on=["importer"], min_length=1)
    same = (F.col("caller") == F.col("callee")) & (F.col("caller_file") == F.col("callee_file"))
    return (
        hits.select("caller", F.col("importer").alias("caller_file"), "callee", "callee_file")
        .distinct().where(~same)
    )


def validation_edges(functions: DataFrame) -> DataFrame:
    """USES_VALIDATION edges: the body names a validating function."""
    checks = functions.where(any_of(F.lower("name"), VALIDATION_WORDS)).select(
        F.col("name").alias("validator"), F.col("file").alias("validator_file"), F.lower("name").alias("_v")
    )
    bodies = functions.select("name", "file", F.lower("body").alias("_body"))
    hits = contains_join(bodies, "_body", checks, "_v")
    return hits.where("not (name = validator and file = validator_file)").select(
        "name", "file", "validator", "validator_file"
    ).distinct()


def modified_functions(changes: DataFrame, functions: DataFrame, counted: bool = False) -> DataFrame:
    """Commit -> function through the touched file; ``counted``: ``(fn, commits)``, their number per function.

    The pairs grow with commits times functions of a file. Counts don't need them: a function of one file has the
    commits of that file; only functions of several files are paired with their commits.
    """
    rows = changes.select("commit", "file").distinct()
    own = functions.select(F.col("id").alias("fn"), "file").distinct()
    if not counted:
        return rows.join(own, "file").select("commit", "fn").distinct()
    homes = own.groupBy("fn").agg(F.count("*").alias("_files"), F.min("file").alias("file"))
    per_file = rows.groupBy("file").agg(F.count("*").alias("commits"))
    one = homes.where("_files = 1").join(per_file, "file").select("fn", "commits")
    several = homes.where("_files > 1").select(F.col("fn").alias("_fn"))
    pairs = own.join(several, F.col("fn").eqNullSafe(F.col("_fn")), "left_semi").join(rows, "file").select("commit", "fn")
    return one.unionByName(pairs.distinct().groupBy("fn").agg(F.count("*").alias("commits")))


def file_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per path: added, changed, unchanged or deleted, by modification time."""
    o = old.select("path", F.col("mtime").alias("_o"))
    n = new.select("path", F.col("mtime").alias("_n"))
    status = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted")
        .when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    )
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def refresh(index: DataFrame, fresh: DataFrame, states: DataFrame, path: str = "file") -> DataFrame:
    """Rows of changed and deleted files leave the index, rows of the fresh parse enter."""
    stale = states.where(F.col("status").isin("changed", "deleted")).select(F.col("path").alias(path))
    return index.join(stale, path, "left_anti").unionByName(fresh)


def prune(index: DataFrame, repos: Sequence[str], column: str = "repo") -> DataFrame:
    """The index without the given repositories (before a full re-index)."""
    return index.where(~F.col(column).isin(*repos))
