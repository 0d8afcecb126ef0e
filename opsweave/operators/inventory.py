"""Inventory snapshots: flattening, diffs, dependencies and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k

WAITING_REASONS = ("CrashLoopBackOff", "ImagePullBackOff", "ErrImagePull")

POD_SCHEMA = """
  metadata struct<name: string, namespace: string, resourceVersion: string,
    labels: map<string, string>, ownerReferences: array<struct<kind: string, name: string>>>,
  spec struct<nodeName: string,
    containers: array<struct<name: string, image: string,
      envFrom: array<struct<configMapRef: struct<name: string>, secretRef: struct<name: string>>>,
      env: array<struct<name: string, valueFrom: struct<configMapKeyRef: struct<name: string>,
        secretKeyRef: struct<name: string>>>>>>,
    volumes: array<struct<configMap: struct<name: string>, secret: struct<secretName: string>>>>,
  status struct<phase: string, containerStatuses: array<struct<restartCount: int, ready: boolean,
    state: struct<waiting: struct<reason: string>>>>>
"""


def pods(raw: DataFrame) -> DataFrame:
    """Typed pods of raw objects (``POD_SCHEMA``): status, restarts, readiness, owner, image, node."""
    statuses = F.coalesce(F.col("status.containerStatuses"), F.array())
    reasons = F.transform("status.containerStatuses", lambda s: s["state"]["waiting"]["reason"])
    waiting = F.get(F.filter(reasons, lambda r: r.isin(*WAITING_REASONS)), F.lit(0))
    owner = F.get("metadata.ownerReferences", F.lit(0))
    none = F.lit("")
    return raw.select(
        "metadata.name", "metadata.namespace",
        F.col("metadata.resourceVersion").alias("resource_version"),
        F.col("metadata.labels").alias("labels"),
        F.coalesce(waiting, "status.phase", F.lit("Unknown")).alias("status"),
        F.aggregate(
            F.transform(statuses, lambda s: s["restartCount"]), F.lit(0), lambda a, x: a + x
        ).alias("restart_count"),
        F.forall(statuses, lambda s: s["ready"]).alias("ready"),
        F.coalesce(F.get("spec.containers", F.lit(0))["image"], none).alias("image"),
        F.coalesce("spec.nodeName", none).alias("node_name"),
        F.coalesce(owner["kind"], none).alias("owner_kind"),
        F.coalesce(owner["name"], none).alias("owner_name"),
    )


def reads(raw: DataFrame) -> DataFrame:
    """READS edges pod -> ConfigMap/Secret of volumes, envFrom and env."""

    def each(items: Column, cm, sec) -> Column:
        return F.transform(items, lambda x: F.struct(cm(x).alias("cm"), sec(x).alias("sec")))

    containers = F.coalesce("spec.containers", F.array())
    none = F.array().cast("array<struct<cm:string,sec:string>>")
    refs = F.concat(
        F.coalesce(
            each(F.col("spec.volumes"), lambda v: v["configMap"]["name"], lambda v: v["secret"]["secretName"]), none
        ),
        F.flatten(
            F.transform(
                containers,
                lambda c: F.coalesce(
                    each(c["envFrom"], lambda e: e["configMapRef"]["name"], lambda e: e["secretRef"]["name"]), none
                ),
            )
        ),
        F.flatten(
            F.transform(
                containers,
                lambda c: F.coalesce(
                    each(
                        c["env"], lambda e: e["valueFrom"]["configMapKeyRef"]["name"],
                        lambda e: e["valueFrom"]["secretKeyRef"]["name"],
                    ),
                    none,
                ),
            )
        ),
    )
    named = F.flatten(
        F.transform(
            refs,
            lambda r: F.array(
                F.struct(F.lit("ConfigMap").alias("kind"), r["cm"].alias("target")),
                F.struct(F.lit("Secret").alias("kind"), r["sec"].alias("target")),
            ),
        )
    )
    kept = F.array_distinct(F.filter(named, lambda r: r["target"].isNotNull()))
    return raw.select(
        "metadata.namespace", F.col("metadata.name").alias("pod"), F.inline(kept)
    )


def contains_edges(resources: DataFrame) -> DataFrame:
    """CONTAINS edges cluster -> namespace -> resource of ``(cluster, namespace, kind, name)``."""
    top = resources.select(
        F.lit("Cluster").alias("src_kind"), F.col("cluster").alias("src"),
        F.lit("Namespace").alias("dst_kind"), F.col("namespace").alias("dst"), "cluster",
    )
    low = resources.select(
        F.lit("Namespace").alias("src_kind"), F.col("namespace").alias("src"),
        F.col("kind").alias("dst_kind"), F.col("name").alias("dst"), "cluster",
    )
    return top.unionByName(low).distinct()


def flat_labels(labels: Column) -> Column:
    """``k=v,k=v`` in sorted order."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit(""))


def services(raw: DataFrame) -> DataFrame:
    """``ports`` as port/protocol text, the selector flattened; never any secret value."""
    ports = F.transform(
        "spec.ports",
        lambda p: F.concat_ws("/", p["port"].cast("string"), F.coalesce(p["protocol"], F.lit("TCP"))),
    )
    return raw.select(
        "metadata.name", "metadata.namespace", F.coalesce("spec.type", F.lit("ClusterIP")).alias("type"),
        F.array_join(ports, ",").alias("ports"), flat_labels(F.col("spec.selector")).alias("selector"),
    )


def key_names(raw: DataFrame) -> DataFrame:
    """ConfigMaps and Secrets with the names of their keys only."""
    return raw.select(
        "metadata.name", "metadata.namespace", F.array_sort(F.map_keys("data")).alias("key_names")
    )


# --- diffs ----------------------------------------------------------------------------


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Status of every key: added, updated, unchanged or deleted."""
    keys = list(keys)
    o = old.select(*keys, F.col(version).alias("old_version"))
    n = new.select(*keys, F.col(version).alias("new_version"))
    status = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted")
        .when(F.col("old_version").eqNullSafe(F.col("new_version")), "unchanged").otherwise("updated")
    )
    joined = o.withColumn("_o", F.lit(1)).join(n.withColumn("_n", F.lit(1)), keys, "full_outer")
    return joined.select(*keys, "old_version", "new_version", status.alias("status"))


def series_diff(snapshots: DataFrame, snap: str, keys: Sequence[str], version: str) -> DataFrame:
    """The diff of every snapshot against the one before it."""
    order = snapshots.select(snap).distinct()  # one row per snapshot
    w = Window.orderBy(snap)
    steps = order.withColumn("_next", F.lead(snap).over(w))
    first = order.agg(F.min(snap).alias("_first"))
    shifted = (
        snapshots.join(F.broadcast(steps.where("_next is not null")), snap)
        .drop(snap).withColumnRenamed("_next", snap)
    )
    diff = snapshot_diff(shifted, snapshots, [snap, *keys], version)
    return diff.join(F.broadcast(first), F.col(snap) != F.col("_first")).drop("_first")


def diff_stats(diff: DataFrame, by: Sequence[str]) -> DataFrame:
    return diff.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "unchanged", "deleted")]
    )


def apply_deletes(resources: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current resources without the deleted ones (a later upsert revives a key)."""
    dead = deletes.groupBy(*keys).agg(F.max("ts").alias("_dead"))
    kept = resources.join(dead, list(keys), "left")
    return kept.where("_dead is null or ts > _dead").drop("_dead")


# --- views ----------------------------------------------------------------------------


def counts_by(resources: DataFrame, by: Sequence[str]) -> DataFrame:
    return resources.groupBy(*by).agg(F.count("*").alias("n"))


def busiest_namespaces(pod_rows: DataFrame, k: int = 10) -> DataFrame:
    return counts_by(pod_rows, ["namespace"]).orderBy(F.desc("n"), "namespace").limit(k)


def list_pods(
    pod_rows: DataFrame,
    namespace: str | None = None,
    status: str | None = None,
    name_contains: str | None = None,
    k: int = 100,
) -> DataFrame:
    out = pod_rows
    for col, value in (("namespace", namespace), ("status", status)):
        if value is not None:
            out = out.where(F.col(col) == value)
    if name_contains is not None:
        out = out.where(F.lower("name").contains(name_contains.lower()))
    return out.orderBy("namespace", "name").limit(k)


def show(table: DataFrame, field: str | None = None, value: str | None = None, k: int = 50) -> DataFrame:
    """Rows of a resource table by an optional equality, ordered by name. ``status``
    finds the table's own state column."""
    if field is not None:
        aliases = {"status": ("status", "active_state", "state")}
        name = next((c for c in aliases.get(field, (field,)) if c in table.columns), field)
        table = table.where(F.col(name).cast("string") == value)
    return table.orderBy("name").limit(k)


def workload_pods(workloads: DataFrame, pod_rows: DataFrame) -> DataFrame:
    """Workloads with the pods whose owner name starts with the workload's name.

    Owner names extend the workload name by ``-<hash>``; every dash-prefix of the
    owner name is looked up, so this is an equi join. Names that end inside a
    dash part are found by their full length as well.
    """
    p = pod_rows.select(
        "namespace", F.col("name").alias("pod"), "status", "owner_name",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.length("owner_name")), lambda i: F.substring("owner_name", 1, i))
        ).alias("workload"),
    )
    w = workloads.select("namespace", F.col("name").alias("workload"), "replicas_desired", "replicas_ready")
    return p.join(w, ["namespace", "workload"])


def pod_dependencies(read_edges: DataFrame, keyed: DataFrame) -> DataFrame:
    """READS edges with the key names of their target ``(kind, namespace, name, key_names)``."""
    target = keyed.select("kind", "namespace", F.col("name").alias("target"), "key_names")
    return read_edges.join(target, ["kind", "namespace", "target"], "left")


def namespace_summary(pod_rows: DataFrame, workloads: DataFrame) -> DataFrame:
    """Per namespace: pods, running pods, workloads and how many are healthy."""
    healthy = (F.col("replicas_ready") == F.col("replicas_desired")) & (F.col("replicas_desired") > 0)
    w = workloads.groupBy("namespace").agg(
        F.count("*").alias("workloads"), F.count_if(healthy).alias("healthy")
    )
    p = pod_rows.groupBy("namespace").agg(
        F.count("*").alias("pods"), F.count_if(F.col("status") == "Running").alias("running"),
        F.sum("restart_count").alias("restarts"),
    )
    return p.join(w, "namespace", "full_outer").fillna(0)


def federated_symbol(tables: dict[str, tuple[DataFrame, str, str]], symbol: str) -> DataFrame:
    """Where a symbol appears: ``tables[place] = (frame, searched column, name column)``."""
    out = None
    for place, (df, searched, name) in tables.items():
        hit = df.where(F.lower(searched).contains(symbol.lower())).select(
            F.lit(place).alias("place"), F.col(name).cast("string").alias("name")
        )
        out = hit if out is None else out.unionByName(hit)
    return out


def top_processes(procs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k by memory and the k by CPU of every host, without repeats."""
    mem = top_k(procs, keys, [F.desc("memory_mb"), F.col("pid")], k)
    cpu = top_k(procs, keys, [F.desc("cpu"), F.col("pid")], k)
    return mem.unionByName(cpu).distinct()


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def dependents(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Who reads or calls the targets: reverse lookup on ``edges(src, dst, edge_type)``."""
    return edges.join(targets.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")
