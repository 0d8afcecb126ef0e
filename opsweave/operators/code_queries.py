"""Questions to the code graph, each for all functions, files or PRs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k
from opsweave.functions.sizes import shuffled
from opsweave.functions.text import contains_join
from opsweave.operators.graph_algos import reach, reach_sizes
from opsweave.session import cut_lineage, enough_partitions, freed_shuffles

# Frames: functions(id, name, file, line, …), calls(src, dst) on ids,
# modified(commit, fn, author, date, message), changes(commit, file, change, author, date, message).


def callers(calls: DataFrame, functions: DataFrame, include_tests: bool = True) -> DataFrame:
    """Caller name and file per called function."""
    f = functions.select(F.col("id").alias("src"), F.col("name").alias("caller"), F.col("file").alias("caller_file"))
    out = calls.join(f, "src").select(F.col("dst").alias("id"), "caller", "caller_file")
    return out if include_tests else out.where(~F.col("caller_file").startswith("tests/"))


def references_by_file(calls: DataFrame, functions: DataFrame, k: int = 50) -> DataFrame:
    """Per function and calling file: count and up to ``k`` caller names."""
    c = callers(calls, functions)
    counted = c.groupBy("id", "caller_file").agg(F.count("*").alias("n"))
    few = top_k(c.distinct(), ["id", "caller_file"], [F.col("caller")], k)
    names = few.groupBy("id", "caller_file").agg(F.array_sort(F.collect_list("caller")).alias("names"))
    return counted.join(names, ["id", "caller_file"])


def where_used(calls: DataFrame, imports: DataFrame, functions: DataFrame, k: int = 20) -> DataFrame:
    """Where each function is used: callers, importing files and bodies that name it
    (at most ``k`` of the last per function). Imports and functions are computed once; names and bodies are shuffled."""
    with freed_shuffles(functions.sparkSession):
        imports = cut_lineage(imports.select("importer", "name"))
        functions = shuffled(cut_lineage(functions.select("id", "name", "file", "body")))
    names = functions.select(F.col("id"), F.col("name"))
    a = callers(calls, functions).select("id", F.lit("caller").alias("how"), F.col("caller").alias("who"))
    i = imports.select("name", F.col("importer").alias("who")).join(names, "name").select(
        "id", F.lit("import").alias("how"), "who"
    )
    bodies = functions.select(F.col("id").alias("by"), F.col("name").alias("who"), "body")
    hits = contains_join(bodies, "body", names, "name", min_length=1).where("by <> id")
    b = top_k(hits.select("id", "who").distinct(), ["id"], [F.col("who")], k)
    return a.unionByName(i).unionByName(b.select("id", F.lit("body").alias("how"), "who")).distinct()


def impact_level(functions: Column, files: Column) -> Column:
    return (
        F.when((functions >= 10) | (files >= 5), "Critical")
        .when((functions >= 5) | (files >= 3), "High")
        .when((functions >= 2) | (files >= 2), "Medium")
        .otherwise("Low")
    )


def blast_radius(calls: DataFrame, functions: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """Direct and transitive callers of every target ``(id)``, affected files and level."""
    first = functions.groupBy("file").agg(F.min("id").alias("mark"))  # a file's number: its first function
    marks = functions.select("id", "file").join(first, "file").select("id", "mark")
    sizes = reach_sizes(calls, depth, {"dependents": None, "files": marks})
    out = targets.select("id").distinct().join(sizes, "id", "left")
    out = out.fillna(0, ["direct", "dependents", "files"])
    return out.withColumn("level", impact_level(F.col("dependents"), F.col("files")))


def file_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct calls between files."""
    f = functions.select("id", "file")
    return (
        calls.join(f.toDF("src", "sf"), "src").join(f.toDF("dst", "df"), "dst").where("sf <> df")
        .select(F.col("sf").alias("src"), F.col("df").alias("dst")).distinct()
    )


def resolve_names(asked: DataFrame, functions: DataFrame) -> DataFrame:
    """Names to functions: exact, else the same ignoring case, else a name ending in it."""
    f = functions.select("id", "name")
    a = asked.select("asked").distinct()
    exact = a.join(f, F.col("asked") == F.col("name")).select("asked", F.lit(0).alias("how"), "name", "id")
    loose = a.join(f, F.lower("asked") == F.lower("name")).select("asked", F.lit(1).alias("how"), "name", "id")
    ends = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), i))
    tails = f.select("id", "name", F.explode(ends).alias("asked"))
    suffix = a.join(tails, "asked").select("asked", F.lit(2).alias("how"), "name", "id")
    every = exact.unionByName(loose).unionByName(suffix)
    return every.groupBy("asked").agg(F.min(F.struct("how", "name", "id")).alias("b")).select(
        "asked", "b.how", "b.name", "b.id"
    )


def hub_files(calls: DataFrame, functions: DataFrame, k: int = 10) -> DataFrame:
    f = functions.select(F.col("id").alias("src"), "file")
    per = calls.join(f, "src").groupBy("file").agg(F.count("*").alias("edges"))
    return per.orderBy(F.desc("edges"), "file").limit(k)


def matching_communities(communities: DataFrame, members: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Communities whose name, description or a member's name contains the text."""
    q = text.lower()
    by_member = members.where(F.lower("name").contains(q)).select("component").distinct()
    flagged = communities.join(by_member.withColumn("_m", F.lit(True)), "component", "left")
    hit = F.lower("name").contains(q) | F.lower("description").contains(q) | F.coalesce("_m", F.lit(False))
    return flagged.where(hit).drop("_m").orderBy(F.desc("functions"), "component").limit(k)


def coupling(calls: DataFrame, functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Call edges between path prefixes ``pairs(from_module, to_module)``.

    Files are filed under the prefixes of the asked lengths, so both ends are equi joins.
    """

    def inside(side: str) -> DataFrame:
        asked = pairs.select(F.col(side)).distinct()
        files = functions.select("file").distinct()
        cuts = F.transform(F.sequence(F.lit(1), F.length("file")), lambda i: F.substring("file", 1, i))
        return files.select("file", F.explode(cuts).alias(side)).join(asked, side, "left_semi")

    f = functions.select("id", "file")
    ends = calls.join(f.toDF("src", "sf"), "src").join(f.toDF("dst", "df"), "dst")
    edges = ends.groupBy("sf", "df").agg(F.count("*").alias("n"))
    a = inside("from_module").withColumnRenamed("file", "sf")
    b = inside("to_module").withColumnRenamed("file", "df")
    found = edges.join(a, "sf").join(b, "df").groupBy("from_module", "to_module").agg(F.sum("n").alias("edges"))
    return pairs.distinct().join(found, ["from_module", "to_module"], "left").fillna(0, ["edges"])


def dead_code(functions: DataFrame, calls: DataFrame, k: int | None = None) -> DataFrame:
    """Functions nobody calls; private names, tests and mocks are left out."""
    called = calls.select(F.col("dst").alias("id")).distinct()
    out = functions.where(
        ~F.col("name").startswith("_") & ~F.col("file").contains("test") & ~F.col("file").contains("__mock")
    ).join(called, "id", "left_anti")
    return out.orderBy("file", "line", "name").limit(k) if k else out


def file_skeleton(entities: DataFrame) -> DataFrame:
    """Entities per file in line order (one row each, with position)."""
    w = Window.partitionBy("file").orderBy("line", "name")  # a file has few entities
    return entities.withColumn("position", F.row_number().over(w))


def module_exports(functions: DataFrame, k: int | None = 100) -> DataFrame:
    """Public names per file: how many, and the first ``k``, or all of them for None."""
    public = functions.where(~F.col("name").startswith("_")).select("file", "name").distinct()
    n = public.groupBy("file").agg(F.count("*").alias("n"))
    few = public if k is None else top_k(public, ["file"], [F.col("name")], k)
    return n.join(few.groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("names")), "file")


def import_tree(file_edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    return reach(file_edges, roots.select(F.col("file").alias("start")), depth)


def x_ray(
    functions: DataFrame, calls: DataFrame, modified: DataFrame,
    callers_k: int = 25, callees_k: int = 15, commits_k: int = 5,
) -> DataFrame:
    """Location, callers, callees and last commits of every function."""
    names = functions.select("id", "name")

    def side(own: str, other: str, k: int, label: str) -> DataFrame:
        n = calls.join(names.toDF(other, "other"), other).select(F.col(own).alias("id"), "other")
        few = top_k(n, ["id"], [F.col("other")], k)
        return few.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias(label))

    last = top_k(modified, ["fn"], [F.desc("date"), F.desc("commit")], commits_k)
    commits = last.groupBy(F.col("fn").alias("id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("date", "commit")), asc=False), lambda x: x["commit"]
        ).alias("last_commits")
    )
    out = functions.select("id", "name", "file", "line")
    for part in (side("dst", "src", callers_k, "callers"), side("src", "dst", callees_k, "callees"), commits):
        out = out.join(part, "id", "left")
    return out


def search_code(functions: DataFrame, pattern: str, names_k: int = 50, bodies_k: int = 20) -> DataFrame:
    p = pattern.lower()
    order = ["name", "file", "id"]
    a = functions.where(F.lower("name").contains(p)).orderBy(*order).limit(names_k)
    b = functions.where(F.lower("body").contains(p)).orderBy(*order).limit(bodies_k)
    return a.select(F.lit("name").alias("place"), "id", "name", "file").unionByName(
        b.select(F.lit("body").alias("place"), "id", "name", "file")
    )


def decorated_with(decorations: DataFrame, name: str) -> DataFrame:
    """Symbols with the decorator or one ending in ``.name``."""
    d = F.col("decorator")
    return decorations.where((d == name) | d.endswith(f".{name}")).distinct()


def resolves_to(entities: DataFrame, references: DataFrame, symbol: str) -> DataFrame:
    """Definitions and string references of a dotted symbol's last part."""
    last = symbol.split(".")[-1]
    defs = entities.where(F.col("name") == last).select(F.lit("definition").alias("what"), "name", "file", "line")
    refs = references.where(F.element_at(F.split("symbol", r"\."), -1) == last).select(
        F.lit("reference").alias("what"), F.col("symbol").alias("name"), "file", "line"
    )
    return defs.unionByName(refs)


# --- history and risk -----------------------------------------------------------------


def risk_scores(calls: DataFrame, modified: DataFrame, targets: DataFrame) -> DataFrame:
    """Risk of changing each target: callers within three steps (0-4), few
    contributors (0-3), fix commits (0-1); shown out of ten."""
    blast = reach_sizes(calls, 3, {"transitive": None}).drop("direct")
    fix = F.lower("message").contains("fix")
    mine = modified.withColumnRenamed("fn", "id").join(targets.select("id").distinct(), "id", "left_semi")
    hist = mine.groupBy("id").agg(F.countDistinct("author").alias("authors"), F.count_if(fix).alias("fixes"))
    out = targets.select("id").distinct().join(blast, "id", "left").join(hist, "id", "left")
    out = out.fillna(0, ["transitive", "authors", "fixes"])
    t, a, x = F.col("transitive"), F.col("authors"), F.col("fixes")
    score = (
        F.when(t > 200, 4.0).when(t > 50, 3.0).when(t > 10, 2.0).when(t > 0, 1.0).otherwise(0.0)
        + F.when(a == 0, 0.0).when(a == 1, 3.0).when(a == 2, 2.0).otherwise(1.0)
        + F.when(x >= 2, 1.0).when(x == 1, 0.5).otherwise(0.0)
    )
    s = F.col("score")
    verdict = F.when(s < 3, "LOW").when(s < 6, "MEDIUM").when(s < 8, "HIGH").otherwise("VERY HIGH")
    return out.withColumn("score", score).withColumn("verdict", verdict)


def pre_change_warning(calls: DataFrame, modified: DataFrame, targets: DataFrame) -> DataFrame:
    """Callers, last touch, top maintainers and the warnings that follow."""
    blast = reach_sizes(calls, 3, {"transitive": None})
    mine = modified.withColumnRenamed("fn", "id").join(targets.select("id").distinct(), "id", "left_semi")
    last = mine.groupBy("id").agg(
        F.max("date").alias("last_date"), F.max_by("author", F.struct("date", "commit")).alias("last_author")
    )
    touches = mine.groupBy("id", "author").agg(F.count("*").alias("touches"))
    best = top_k(touches, ["id"], [F.desc("touches"), F.col("author")], 3).groupBy("id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("touches")).alias("neg"), "author"))),
            lambda x: x["author"],
        ).alias("maintainers")
    )
    out = targets.select("id").distinct()
    for part in (blast, last, best):
        out = out.join(part, "id", "left")
    out = out.fillna(0, ["direct", "transitive"])
    return out.withColumns(
        {
            "high_blast": (F.col("direct") > 50) | (F.col("transitive") > 200),
            "bus_factor_one": F.coalesce(F.size("maintainers") == 1, F.lit(False)),
        }
    )


def co_change_partners(
    changes: DataFrame, targets: DataFrame, item: str, k: int | None = 10, at_least: int = 1
) -> DataFrame:
    """For each target the items that share commits with it, most often first.

    ``changes(commit, item)``; only commits of a target are expanded, so the work
    is one row per target commit and partner, never all pairs of a commit. Partitions
    are as many as these rows ask for, so that no task counts more of them as tables grow.
    """
    rows = changes.select("commit", F.col(item).alias("partner")).distinct()
    mine = rows.join(targets.select(F.col(item).alias("partner")).distinct(), "partner", "left_semi")
    pairs = mine.select("commit", F.col("partner").alias("target")).join(rows, "commit")
    counted = pairs.where("partner <> target").groupBy("target", "partner").agg(F.count("*").alias("shared"))
    counted = counted.where(F.col("shared") >= at_least)
    out = top_k(counted, ["target"], [F.desc("shared"), F.col("partner")], k) if k else counted
    sizes = rows.where("commit is not null").groupBy("commit").agg(F.count("*").alias("n"))
    most = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    with enough_partitions(rows.sparkSession, most):
        return cut_lineage(out)


def recall_history(facts: DataFrame, commits: DataFrame, text: str) -> DataFrame:
    """Facts (15) and commits (10) that contain the text."""
    f = facts.where(F.col("subject").contains(text) | F.col("object").contains(text))
    f = f.select(F.lit("fact").alias("kind"), F.concat_ws(" ", "subject", "predicate", "object").alias("content"))
    c = commits.where(F.col("message").contains(text)).orderBy("commit").limit(10)
    c = c.select(F.lit("commit").alias("kind"), F.substring("message", 1, 200).alias("content"))
    return f.orderBy("content").limit(15).unionByName(c)


# Null guards and calls that need one.
NULL_GUARDS = ("??", "?.", "!= null", "!== null", "!== undefined")
RISKY_CALLS = (".split(", ".map(", ".filter(", ".forEach(")
SAFE_MARKS = ("??", "?.", "|| []", "|| ''")


def _has(line: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | line.contains(w)
    return test


def diff_risk(diffs: DataFrame, changes: DataFrame) -> DataFrame:
    """Risk level per PR from its diff lines ``(pr, line)`` and files ``(pr, file, status)``."""
    line = F.col("line")
    removed = line.startswith("-") & ~line.startswith("---") & _has(line, NULL_GUARDS)
    added = (
        line.startswith("+") & ~line.startswith("+++") & _has(line, RISKY_CALLS) & ~_has(line, SAFE_MARKS)
    )
    d = diffs.groupBy("pr").agg(F.count_if(removed).alias("guards"), F.count_if(added).alias("unguarded"))
    schema = F.col("file").contains("migration") | F.col("file").contains("schema.prisma")
    c = changes.groupBy("pr").agg(
        F.count_if(schema).alias("schemas"), F.count_if(F.col("status") == "D").alias("deleted"),
        F.count("*").alias("files_changed"),
    )
    out = d.join(c, "pr", "full_outer").fillna(0)
    g, u, s, x = (F.col(n) for n in ("guards", "unguarded", "schemas", "deleted"))
    level = (
        F.when((g > 3) | ((x > 0) & (s > 0)), "HIGH")
        .when((g > 0) | (s > 0) | (u > 3), "MEDIUM").otherwise("LOW")
    )
    text = F.concat_ws(
        "; ",
        F.when(g > 0, F.concat(F.lit("null guards taken out: "), g.cast("string"))),
        F.when(u > 3, F.concat(F.lit("unguarded calls added: "), u.cast("string"))),
        F.when(s > 0, F.lit("touches the schema")),
        F.when(x > 0, F.concat(F.lit("files removed: "), x.cast("string"))),
    )
    return out.withColumns(
        {
            "risk_level": level,
            "risk_details": F.when(text == "", "none found").otherwise(text),
        }
    )


def affected_functions(changes: DataFrame, functions: DataFrame) -> DataFrame:
    """PR -> functions of its files. Both sides are made distinct, so the pairs are, and none is shuffled."""
    f = functions.select(F.col("id").alias("fn"), "name", "file").distinct()
    c = changes.select("pr", "file", "change_type").distinct()
    return c.join(f, "file").select("pr", "fn", "name", "file", "change_type")


#: Pairs of files changed together that may be broadcast.
TOGETHER_ROWS = 2_000_000


def forgotten_files(changes: DataFrame, file_changes: DataFrame, at_least: int = 3) -> DataFrame:
    """``(pr, file, n)``: files outside a PR that share commits with its files. A commit counts once per own file it
    touches, so n is a sum over the PR's files of the commits that two files share; these are counted once for all PRs.
    """
    files = changes.select("pr", "file").distinct()
    fc = file_changes.select("commit", "file").distinct()
    own = fc.join(files.select("file").distinct(), "file", "left_semi")
    pairs = own.join(fc.withColumnRenamed("file", "other"), "commit").groupBy("file", "other").agg(F.count("*").alias("_n"))
    pairs = cut_lineage(pairs)
    if pairs.limit(TOGETHER_ROWS + 1).count() <= TOGETHER_ROWS:
        # one row per file, so that the rows of a PR stay where they are
        lists = pairs.groupBy("file").agg(F.collect_list(F.struct("other", "_n")).alias("_with"))
        met = files.repartition("pr").join(F.broadcast(lists), "file").select("pr", "file", F.inline("_with"))
    else:
        met = files.join(shuffled(pairs), "file")
    # every file of a commit is paired with itself, which shows the PR's own files
    same = F.coalesce(F.col("other") == F.col("file"), F.lit(False))  # a file without a name is nobody's own
    mine = F.bool_or(same) & F.col("pr").isNotNull()
    out = met.groupBy("pr", "other").agg(F.sum("_n").alias("n"), mine.alias("_mine"))
    return out.where((F.col("n") >= at_least) & ~F.col("_mine")).select("pr", F.col("other").alias("file"), "n")


def pr_checks(
    changes: DataFrame, functions: DataFrame, calls: DataFrame, modified: DataFrame,
    file_changes: DataFrame, messages: DataFrame, tickets: DataFrame,
) -> DataFrame:
    """All eight checks of open PRs as rows ``(pr, check, detail, n)``.

    ``messages(text, channel, has_symptom, reply_count)``, ``tickets(pr, key, status)``.
    Rows per check are whole; cut them with ``top_k`` for a report.
    """
    own = functions.select(F.col("id").alias("fn"), "name", "file").distinct()
    touched = own.join(changes.select("file").distinct(), "file", "left_semi").select("fn", "name").distinct()
    named = contains_join(
        messages.withColumn("_text", F.lower("text")), "_text",
        touched.withColumn("_name", F.lower("name")), "_name", min_length=1,
    )
    bad = named.where("has_symptom").groupBy("fn").agg(F.count("*").alias("n"))
    prod = named.where(
        F.col("has_symptom") & F.col("channel").isin("prod-errors", "engineering-alerts-prod")
    ).groupBy("fn").agg(F.count("*").alias("n"))
    asked = named.where(F.col("text").contains("?") & (F.col("reply_count") == 0)).groupBy("fn").agg(
        F.count("*").alias("n")
    )
    mod = modified.groupBy("fn").agg(F.count("*").alias("n"))
    had = modified.select("fn").distinct()
    in_calls = calls.groupBy(F.col("dst").alias("fn")).agg(F.count("*").alias("n"))

    def per(check: str, per_fn: DataFrame) -> DataFrame:
        return per_fn.select("fn", F.lit(check).alias("check"), "n")

    # what is known of each function goes to the function, then once to the PRs of its file: no pair is shuffled
    facts = [
        per("prod_history", prod.join(had, "fn", "left_semi")), per("callers", in_calls.where("n >= 2")),
        per("unanswered", asked), per("churn", mod.where("n >= 5")), per("known_issue", bad),
    ]
    told = facts[0]
    for more in facts[1:]:
        told = told.unionByName(more)
    told = own.join(told, "fn").unionByName(own.withColumns({"check": F.lit("functions"), "n": F.lit(1).cast("long")}))
    per_pr = changes.select("pr", "file", "change_type").distinct().join(told, "file")
    mismatch = tickets.where(F.col("status").isin("To Do", "Done")).join(
        changes.select("pr").distinct(), "pr", "left_semi"
    )
    parts = [
        per_pr.select("pr", "check", F.col("name").alias("detail"), "n"),
        forgotten_files(changes, file_changes).select("pr", F.lit("co_change").alias("check"), F.col("file").alias("detail"), "n"),
        mismatch.select("pr", F.lit("ticket").alias("check"), F.concat_ws(" ", "key", "status").alias("detail"), F.lit(1).cast("long").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_summary(entities: DataFrame, changes: DataFrame, k: int = 5) -> DataFrame:
    """Per file: lines, functions, classes, the largest functions, last change."""
    per = entities.groupBy("file").agg(
        F.max("end_line").alias("lines"),
        F.count_if(F.col("kind") == "function").alias("functions"),
        F.count_if(F.col("kind").isin("class", "interface")).alias("classes"),
    )
    size = (F.col("end_line") - F.col("line")).alias("size")
    fns = entities.where("kind = 'function'").select("file", "name", size)
    big = top_k(fns, ["file"], [F.desc("size"), F.col("name")], k).groupBy("file").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "name"))), lambda x: x["name"]
        ).alias("key_functions")
    )
    last = changes.groupBy("file").agg(
        F.max("date").alias("last_date"), F.max_by("author", F.struct("date", "commit")).alias("last_author")
    )
    return per.join(big, "file", "left").join(last, "file", "left")


def callers_by_file(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Per file: incoming calls from other files and how many files they come from."""
    f = functions.select("id", "file")
    e = calls.join(f.toDF("src", "sf"), "src").join(f.toDF("dst", "file"), "dst").where("sf <> file")
    return e.groupBy("file").agg(F.count("*").alias("calls"), F.countDistinct("sf").alias("files"))


def recent_changes(changes: DataFrame, k: int = 5) -> DataFrame:
    """The last ``k`` commits of every file."""
    return top_k(changes, ["file"], [F.desc("date"), F.desc("commit")], k)


def change_brief(changes: DataFrame, since: str) -> dict[str, DataFrame]:
    """Summary since a day: totals, change kinds, authors, top folders."""
    live = changes.where(F.col("date") >= F.lit(since).cast("timestamp"))
    folder = F.array_join(F.slice(F.split("file", "/"), 1, 2), "/")
    return {
        "totals": live.agg(
            F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"),
            F.countDistinct("file").alias("files"),
            *[F.count_if(F.col("change") == c).alias(n) for c, n in (("A", "added"), ("M", "modified"), ("D", "deleted"))],
        ),
        "authors": live.groupBy("author").agg(F.countDistinct("commit").alias("commits")),
        "folders": live.groupBy(folder.alias("folder")).agg(F.count("*").alias("changes")),
    }


def brief_functions(changes: DataFrame, since: str, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions of the files changed since a day, with their caller counts."""
    live = changes.where(F.col("date") >= F.lit(since).cast("timestamp")).select("file").distinct()
    n = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = functions.join(live, "file", "left_semi").join(n, "id", "left")
    return out.select("id", "name", "file", F.coalesce("callers", F.lit(0)).alias("callers"))


def changed_functions(hunks: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions whose lines a diff touches: ``hunks(file, start_line, end_line)``.

    Lines are cut into blocks of 64, so a large file does not pair all its hunks
    with all its functions.
    """
    block = lambda c: F.floor(c / 64)
    h = hunks.withColumn("_b", F.explode(F.sequence(block(F.col("start_line")), block(F.col("end_line")))))
    f = functions.select("id", "name", "file", "line", "end_line").withColumn(
        "_b", F.explode(F.sequence(block(F.col("line")), block(F.col("end_line"))))
    )
    hit = (
        h.join(f.withColumnRenamed("end_line", "last_line"), ["file", "_b"])
        .where("start_line <= last_line and end_line >= line")
    )
    return hit.select("id", "name", "file").distinct()


# --- conventions ------------------------------------------------------------------------


def conventions(entities: DataFrame, by: str = "repo") -> DataFrame:
    """Dominant naming, error handling, test files, structure and patterns per repository.

    Ties go to the first of the fixed order below.
    """
    name, body, file = F.col("name"), F.coalesce("body", F.lit("")), F.col("file")
    low = F.lower("name")
    base = F.element_at(F.split(file, "/"), -1)
    snake = name.rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$")
    style = (F.col("kind") == "function") & (name != "") & ~name.startswith("_")
    # Signals and their order.
    naming = {
        "camelCase": style & ~snake & name.rlike("^[a-z][a-zA-Z0-9]*$"),
        "snake_case": style & snake,
        "PascalCase": style & name.rlike("^[A-Z][a-zA-Z0-9]*$"),
    }
    errors = {
        "try/except": _has(body, ("try:", "except ")),
        "if err != nil": _has(body, ("if err != nil",)),
        "Result<T, Error>": _has(body, ("Result<", "-> Result")),
        ".catch": _has(body, (".catch(", ".catch ")),
        "try/catch": _has(body, ("try {", "catch (", "catch(")),
    }
    patterns = {
        "dependency injection": _has(F.lower(body), ("inject", "provider", "container", "dependency"))
        | _has(low, ("inject", "provider", "container")),
        "repository pattern": _has(low, ("repository",)) | (low == "repo"),
        "middleware chain": _has(low, ("middleware",)),
        "factory pattern": _has(low, ("factory",)) | low.startswith("create_") | low.startswith("make_"),
        "observer pattern": _has(low, ("observer", "listener", "emitter", "on_event", "emit")),
        "singleton pattern": _has(low, ("singleton", "get_instance")) | (low == "instance"),
        "builder pattern": _has(low, ("builder",)),
    }
    layers = ("controllers", "models", "services", "views", "routes", "handlers", "middleware", "utils")
    top = F.when(F.size(F.split(file, "/")) > 1, F.lower(F.split(file, "/")[0]))

    def counted(flags: dict[str, Column], prefix: str) -> list[Column]:
        return [F.count_if(F.coalesce(c, F.lit(False))).alias(f"{prefix}{i}") for i, c in enumerate(flags.values())]

    def winner(flags, prefix: str, nothing: str) -> Column:
        best = F.greatest(*[F.col(f"{prefix}{i}") for i in range(len(flags))])
        out = F.lit(nothing)
        for i, n in reversed(list(enumerate(flags))):
            out = F.when((F.col(f"{prefix}{i}") == best) & (best > 0), n).otherwise(out)
        return out

    main = entities.groupBy(by).agg(*counted(naming, "_n"), *counted(errors, "_e"), *counted(patterns, "_p"))
    dirs = entities.select(by, top.alias("top")).where("top is not null").distinct().groupBy(by).agg(
        F.count_if(F.col("top").isin(*layers)).alias("_layer"), F.count_if(~F.col("top").isin(*layers)).alias("_feature")
    )
    tests = entities.select(by, base.alias("base")).where(F.lower("base").rlike("test|spec")).distinct()
    b = F.col("base")
    kind = (
        F.when(b.startswith("test_") & b.endswith(".py"), "test_*.py").when(b.endswith(".test.ts"), "*.test.ts")
        .when(b.endswith(".test.js"), "*.test.js").when(b.endswith(".spec.ts"), "*.spec.ts")
        .when(b.endswith(".spec.js"), "*.spec.js").when(b.endswith("_test.go"), "*_test.go")
        .when(b.endswith("_test.py"), "*_test.py").when(b.startswith("test_"), "test_*")
    )
    voted = tests.withColumn("kind", kind).where("kind is not null").groupBy(by, "kind").agg(F.count("*").alias("n"))
    test = voted.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "kind"))["kind"].alias("tests"))
    out = main.join(dirs, by, "left").join(test, by, "left").fillna(0)
    structure = (
        F.when(F.col("_layer") >= 2, "layer-based")
        .when(F.col("_feature") > F.col("_layer"), "feature-based").otherwise("mixed")
    )
    found = F.array_compact(F.array(*[F.when(F.col(f"_p{i}") > 0, n) for i, n in enumerate(patterns)]))
    return out.select(
        by, winner(naming, "_n", "mixed").alias("naming"), winner(errors, "_e", "unknown").alias("errors"),
        F.coalesce("tests", F.lit("unknown")).alias("tests"), structure.alias("structure"), found.alias("patterns"),
    )


# --- similar functions --------------------------------------------------------------------


def word_tokens(text: Column) -> Column:
    """Distinct lower-case words of a text, camelCase split."""
    spaced = F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.array_distinct(F.filter(F.transform(F.split(spaced, "[^a-zA-Z0-9]+"), F.lower), lambda w: w != ""))


def _token_scores(queries: DataFrame, targets: DataFrame, related: DataFrame) -> DataFrame:
    """Score per (qid, id) that shares or contains a token; targets: ``(id, n, tokens)``, n tokens in all."""
    q = queries.select("qid", F.size("tokens").alias("_qn"), F.explode("tokens").alias("qt"))
    t = targets.select("id", F.col("n").alias("_tn"), F.explode("tokens").alias("tt"))
    pairs = q.join(related, "qt").join(t, "tt").groupBy("qid", "id").agg(
        F.first("_qn").alias("qn"), F.first("_tn").alias("tn"),
        F.count_if(F.col("qt") == F.col("tt")).alias("same"), F.countDistinct("qt").alias("near"),
    )
    covered = 0.7 * (F.col("same") / F.col("qn")) + 0.3 * (F.col("same") / F.col("tn"))
    loose = F.col("near") / F.col("qn") * 0.5
    return pairs.select(
        "qid", "id", F.bround(F.when(F.col("same") > 0, covered).otherwise(loose), 2).alias("score")
    )


def similar_functions(
    queries: DataFrame, functions: DataFrame, threshold: float = 0.3, k: int = 10
) -> DataFrame:
    """Functions similar to each description ``(qid, description)``: 0.6 name + 0.4 body.

    Equal and substring-related words are found once between the two vocabularies;
    functions then meet queries only through a related word. Functions that hold the same related words
    among as many words have equal scores, so such a group is scored once and lists its first ``k``.
    """
    functions = functions.where("id is not null")
    q = queries.select("qid", word_tokens(F.col("description")).alias("tokens"))
    names = functions.select("id", word_tokens(F.col("name")).alias("tokens"))
    bodies = functions.select("id", word_tokens(F.coalesce("body", F.lit(""))).alias("tokens"))
    qv = q.select(F.explode("tokens").alias("qt")).distinct()
    tv = names.unionByName(bodies).select(F.explode("tokens").alias("tt")).distinct()
    inside = contains_join(tv, "tt", qv, "qt", min_length=1).select("qt", "tt")
    around = contains_join(qv, "qt", tv, "tt", min_length=1).select("qt", "tt")
    related = cut_lineage(inside.unionByName(around).distinct())
    used = related.select("tt").distinct()

    def held(targets: DataFrame, words: str, n: str) -> DataFrame:
        each = targets.select("id", F.size("tokens").alias(n), F.explode("tokens").alias("tt")).join(used, "tt")
        return each.groupBy("id").agg(F.first(n).alias(n), F.array_sort(F.collect_list("tt")).alias(words))

    alike = ["_nw", "_nn", "_bw", "_bn"]
    described = held(names, "_nw", "_nn").join(held(bodies, "_bw", "_bn"), "id", "full_outer")
    members = top_k(functions.select("id", "name", "file", "line").join(described, "id"), alike, [F.col("name"), F.col("id")], k)
    members = cut_lineage(members.withColumn("_one", F.min("id").over(Window.partitionBy(*alike))))
    ones = members.where("id = _one").dropDuplicates(["id"])
    by_name = _token_scores(q, ones.select("id", F.col("_nn").alias("n"), F.col("_nw").alias("tokens")), related)
    by_body = _token_scores(q, ones.select("id", F.col("_bn").alias("n"), F.col("_bw").alias("tokens")), related)
    by_name, by_body = by_name.withColumnRenamed("score", "name_score"), by_body.withColumnRenamed("score", "body_score")
    both = by_name.join(by_body, ["qid", "id"], "full_outer").fillna(0.0)
    scored = both.withColumn("score", F.bround(0.6 * F.col("name_score") + 0.4 * F.col("body_score"), 2))
    kept = scored.where(F.col("score") >= threshold).withColumnRenamed("id", "_one").join(members, "_one")
    return top_k(kept, ["qid"], [F.desc("score"), F.col("name"), F.col("id")], k).select(
        "qid", "id", "name", F.concat_ws(":", "file", F.col("line").cast("string")).alias("place"), "score"
    )
