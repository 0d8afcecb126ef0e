"""Inventory queries: raw objects are built from the events, snapshots from days."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import inventory as I
from opsweave.plans.correlation import SQL_DAILY, daily_resources
from opsweave.plans.logs import host_tables
from opsweave.plans.policy import SQL_EVENTS
from opsweave.plans.registry import query
from opsweave.sources import tables as T


def raw_pods(spark, sf):
    """One JSON object per event, parsed with the pod schema."""
    k, u = F.col("k"), F.col("user_id")
    text = F.format_string(
        '{"metadata":{"name":"pod-%d","namespace":"ns%d","resourceVersion":"%d","labels":{"tier":"t%d","app":"a%d"},'
        '"ownerReferences":[{"kind":"ReplicaSet","name":"web%d-%d"}]},'
        '"spec":{"nodeName":"node-%d","containers":[{"name":"main","image":"%s:%d",'
        '"envFrom":[{"configMapRef":{"name":"cm-%d"}},{"secretRef":{"name":"sec-%d"}}],'
        '"env":[{"name":"A","valueFrom":{"configMapKeyRef":{"name":"cm-%d"}}},{"name":"B"}]},{"name":"side","image":"side"}],'
        '"volumes":[{"secret":{"secretName":"sec-%d"}},{"name":"tmp"}]},'
        '"status":{"phase":"%s","containerStatuses":[{"restartCount":%d,"ready":%s,"state":{}},'
        '{"restartCount":%d,"ready":true,"state":{"waiting":{"reason":"%s"}}}]}}',
        "event_id", u % 10, k, k % 4, k % 3, u % 10, k, u % 5, "event_type", k, k % 10, k % 7, k % 9, k % 5,
        F.when(k < 20, "Failed").otherwise("Running"), k % 6, F.when(k % 4 == 0, "false").otherwise("true"),
        k % 11, F.when(k > 90, "CrashLoopBackOff").otherwise("ContainerCreating"),
    )
    j = T.events(spark, sf).select(text.alias("j"))
    return j.select(F.from_json("j", I.POD_SCHEMA).alias("o")).select("o.*")


SQL_PODS = f"""{SQL_EVENTS}, pods AS (SELECT 'pod-' || event_id AS name, 'ns' || user_id % 10 AS namespace, k::VARCHAR AS resource_version,
    CASE WHEN k > 90 THEN 'CrashLoopBackOff' WHEN k < 20 THEN 'Failed' ELSE 'Running' END AS status, (k % 6 + k % 11)::INTEGER AS restart_count, k % 4 <> 0 AS ready,
    event_type || ':' || k AS image, 'node-' || user_id % 5 AS node_name, 'ReplicaSet' AS owner_kind, 'web' || user_id % 10 || '-' || k AS owner_name,
    'app=a' || k % 3 || ',tier=t' || k % 4 AS labels, k FROM ev)"""


@query(
    "inventory_pods",
    "SRC3 INV2 INV3",
    f"WITH {SQL_PODS} SELECT * EXCLUDE (k) FROM pods",
)
def inventory_pods(spark, sf):
    return I.pods(raw_pods(spark, sf)).withColumn("labels", I.flat_labels(F.col("labels")))


@query(
    "inventory_reads",
    "INV4",
    f"""WITH {SQL_PODS} SELECT DISTINCT namespace, name AS pod, kind, target FROM (
     SELECT namespace, name, 'ConfigMap' AS kind, 'cm-' || k % 10 AS target FROM pods UNION ALL SELECT namespace, name, 'ConfigMap', 'cm-' || k % 9 FROM pods
     UNION ALL SELECT namespace, name, 'Secret', 'sec-' || k % 7 FROM pods UNION ALL SELECT namespace, name, 'Secret', 'sec-' || k % 5 FROM pods)""",
)
def inventory_reads(spark, sf):
    return I.reads(raw_pods(spark, sf))


@query(
    "inventory_contains",
    "INV5 REL15",
    f"""WITH {SQL_PODS} SELECT DISTINCT 'Cluster' AS src_kind, 'main' AS src, 'Namespace' AS dst_kind, namespace AS dst, 'main' AS cluster FROM pods
    UNION ALL SELECT DISTINCT 'Namespace', namespace, 'Pod', name, 'main' FROM pods""",
)
def inventory_contains(spark, sf):
    p = I.pods(raw_pods(spark, sf))
    return I.contains_edges(p.select(F.lit("main").alias("cluster"), "namespace", F.lit("Pod").alias("kind"), "name"))


@query(
    "inventory_services",
    "INV6",
    """SELECT 'svc-' || c_custkey AS name, 'ns' || c_nationkey AS namespace, CASE WHEN c_acctbal > 5000 THEN 'LoadBalancer' ELSE 'ClusterIP' END AS type,
    c_nationkey || '/TCP,443/UDP' AS ports, 'app=' || c_mktsegment || ',zone=z' || c_nationkey AS selector FROM customer""",
)
def inventory_services(spark, sf):
    c = T.load(spark, sf, "customer")
    raw = c.select(
        F.struct(
            F.concat(F.lit("svc-"), F.col("c_custkey").cast("string")).alias("name"),
            F.concat(F.lit("ns"), F.col("c_nationkey").cast("string")).alias("namespace"),
        ).alias("metadata"),
        F.struct(
            F.when(F.col("c_acctbal") > 5000, "LoadBalancer").alias("type"),
            F.array(
                F.struct(F.col("c_nationkey").alias("port"), F.lit(None).cast("string").alias("protocol")),
                F.struct(F.lit(443).alias("port"), F.lit("UDP").alias("protocol")),
            ).alias("ports"),
            F.create_map(
                F.lit("zone"), F.concat(F.lit("z"), F.col("c_nationkey").cast("string")), F.lit("app"), F.col("c_mktsegment")
            ).alias("selector"),
        ).alias("spec"),
    )
    return I.services(raw)


@query(
    "inventory_key_names",
    "INV6",
    """SELECT 'cfg-' || s_suppkey AS name, 'ns' || s_nationkey AS namespace, 'balance,key-' || s_nationkey || ',name' AS key_names FROM supplier""",
)
def inventory_key_names(spark, sf):
    s = T.load(spark, sf, "supplier")
    nation = F.col("s_nationkey").cast("string")
    raw = s.select(
        F.struct(
            F.concat(F.lit("cfg-"), F.col("s_suppkey").cast("string")).alias("name"),
            F.concat(F.lit("ns"), nation).alias("namespace"),
        ).alias("metadata"),
        F.create_map(
            F.lit("name"), F.col("s_name"), F.concat(F.lit("key-"), nation), nation, F.lit("balance"), F.col("s_acctbal").cast("string")
        ).alias("data"),
    )
    return I.key_names(raw).withColumn("key_names", F.array_join("key_names", ","))


@query(
    "inventory_snapshot_diff",
    "INV1",
    f"""WITH {SQL_DAILY} SELECT kind, day, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated,
    count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted FROM diff GROUP BY ALL""",
)
def snapshot_diff(spark, sf):
    diff = I.series_diff(daily_resources(spark, sf), "day", ["kind", "namespace", "name"], "version")
    return I.diff_stats(diff, ["kind", "day"])


@query(
    "inventory_order_diff",
    "INV1",
    """WITH o AS (SELECT l_orderkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1),
    n AS (SELECT l_orderkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
    SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' WHEN o.v = n.v THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1""",
)
def order_diff(spark, sf):
    li = T.load(spark, sf, "lineitem")

    def shot(cond):
        return li.where(cond).groupBy("l_orderkey").agg(F.max("l_linenumber").alias("version"))

    old, new = shot("l_shipdate < timestamp_ntz'1998-01-01'"), shot("l_shipdate >= timestamp_ntz'1997-01-01'")
    return I.snapshot_diff(old, new, ["l_orderkey"], "version").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "inventory_apply_deletes",
    "INV7",
    f"""WITH {SQL_EVENTS}, up AS (SELECT user_id AS name, max(t) AS ts FROM ev WHERE event_type <> 'error' GROUP BY 1),
    d AS (SELECT user_id AS name, max(t) AS dead FROM ev WHERE event_type = 'error' GROUP BY 1)
    SELECT up.name FROM up LEFT JOIN d USING (name) WHERE dead IS NULL OR ts > dead""",
)
def apply_deletes(spark, sf):
    e = T.events(spark, sf).select(F.col("user_id").alias("name"), F.col("t").alias("ts"), "event_type")
    up = e.where("event_type <> 'error'").groupBy("name").agg(F.max("ts").alias("ts"))
    return I.apply_deletes(up, e.where("event_type = 'error'"), ["name"]).select("name")


@query("inventory_pods_by_status", "INV8", f"WITH {SQL_PODS} SELECT status, count(*) AS n FROM pods GROUP BY ALL")
def pods_by_status(spark, sf):
    return I.counts_by(I.pods(raw_pods(spark, sf)), ["status"])


@query("inventory_busiest_namespaces", "INV8", f"WITH {SQL_PODS} SELECT namespace, count(*) AS n FROM pods GROUP BY 1 ORDER BY n DESC, namespace LIMIT 10")
def busiest_namespaces(spark, sf):
    return I.busiest_namespaces(I.pods(raw_pods(spark, sf)))


@query(
    "inventory_list_pods",
    "INV9 REL1 REL3",
    f"""WITH {SQL_PODS} SELECT namespace, name, status FROM pods WHERE namespace = 'ns3' AND contains(lower(name), 'pod-1') ORDER BY namespace, name LIMIT 100""",
)
def list_pods(spark, sf):
    p = I.list_pods(I.pods(raw_pods(spark, sf)), namespace="ns3", name_contains="POD-1")
    return p.select("namespace", "name", "status")


@query(
    "inventory_show",
    "REL1 INV15",
    f"""WITH {SQL_EVENTS} SELECT name FROM (SELECT DISTINCT user_id, 'unit-' || k AS name FROM ev WHERE event_type = 'error') ORDER BY name LIMIT 50""",
)
def show(spark, sf):
    _, _, units, _ = host_tables(spark, sf)
    return I.show(units.distinct(), "status", "failed").select("name")


SQL_WORKLOADS = """wl AS (SELECT 'ns' || user_id % 10 AS namespace, 'web' || user_id % 10 AS name, (count(*) % 4)::INTEGER AS replicas_desired, (max(k) % 4)::INTEGER AS replicas_ready
    FROM ev GROUP BY user_id % 10)"""


def workloads(spark, sf):
    u = (F.col("user_id") % 10).cast("string")
    return (
        T.events(spark, sf).groupBy(F.concat(F.lit("ns"), u).alias("namespace"), F.concat(F.lit("web"), u).alias("name"))
        .agg((F.count("*") % 4).cast("int").alias("replicas_desired"), (F.max("k") % 4).cast("int").alias("replicas_ready"))
    )


@query(
    "inventory_workload_pods",
    "INV10",
    f"""WITH {SQL_PODS}, {SQL_WORKLOADS} SELECT p.namespace, p.name AS pod, w.name AS workload, replicas_desired, replicas_ready, status
    FROM pods p JOIN wl w ON p.namespace = w.namespace AND starts_with(p.owner_name, w.name)""",
)
def workload_pods(spark, sf):
    return I.workload_pods(workloads(spark, sf), I.pods(raw_pods(spark, sf))).drop("owner_name")


@query(
    "inventory_pod_dependencies",
    "INV11",
    f"""WITH {SQL_PODS}, r AS (SELECT DISTINCT namespace, name AS pod, 'ConfigMap' AS kind, 'cm-' || unnest([k % 10, k % 9]) AS target FROM pods),
    keys AS (SELECT 'ns' || n_nationkey % 10 AS namespace, 'cm-' || n_nationkey % 10 AS name, max(n_name) AS key_names FROM nation GROUP BY 1, 2)
    SELECT r.namespace, pod, target, coalesce(key_names, '') AS key_names FROM r LEFT JOIN keys ON keys.namespace = r.namespace AND keys.name = r.target""",
)
def pod_dependencies(spark, sf):
    n = (F.col("n_nationkey") % 10).cast("string")
    keyed = (
        T.load(spark, sf, "nation")
        .groupBy(F.lit("ConfigMap").alias("kind"), F.concat(F.lit("ns"), n).alias("namespace"), F.concat(F.lit("cm-"), n).alias("name"))
        .agg(F.array(F.max("n_name")).alias("key_names"))
    )
    edges = I.reads(raw_pods(spark, sf)).where("kind = 'ConfigMap'")
    d = I.pod_dependencies(edges, keyed)
    return d.select("namespace", "pod", "target", F.coalesce(F.array_join("key_names", ","), F.lit("")).alias("key_names"))


@query(
    "inventory_namespace_summary",
    "INV12",
    f"""WITH {SQL_PODS}, {SQL_WORKLOADS}, p AS (SELECT namespace, count(*) AS pods, count(*) FILTER (status = 'Running') AS running, sum(restart_count)::BIGINT AS restarts FROM pods GROUP BY 1),
    w AS (SELECT namespace, count(*) AS workloads, count(*) FILTER (replicas_ready = replicas_desired AND replicas_desired > 0) AS healthy FROM wl GROUP BY 1)
    SELECT namespace, coalesce(pods, 0) AS pods, coalesce(running, 0) AS running, coalesce(restarts, 0) AS restarts, coalesce(workloads, 0) AS workloads, coalesce(healthy, 0) AS healthy FROM p FULL JOIN w USING (namespace)""",
)
def namespace_summary(spark, sf):
    return I.namespace_summary(I.pods(raw_pods(spark, sf)), workloads(spark, sf))


@query(
    "inventory_federated_symbol",
    "INV13 REL14",
    """SELECT 'function' AS place, p_partkey::VARCHAR AS name FROM part WHERE contains(lower(p_name), 'ring')
    UNION ALL SELECT 'service', c_custkey::VARCHAR FROM customer WHERE contains(lower(c_mktsegment), 'ring')
    UNION ALL SELECT 'image', s_suppkey::VARCHAR FROM supplier WHERE contains(lower(s_name), 'ring')
    UNION ALL SELECT 'config', n_nationkey::VARCHAR FROM nation WHERE contains(lower(n_name), 'ring')
    UNION ALL SELECT 'document', doc_id::VARCHAR FROM documents WHERE contains(lower(text), 'ring')""",
)
def federated_symbol(spark, sf):
    return I.federated_symbol(
        {
            "function": (T.load(spark, sf, "part"), "p_name", "p_partkey"),
            "service": (T.load(spark, sf, "customer"), "c_mktsegment", "c_custkey"),
            "image": (T.load(spark, sf, "supplier"), "s_name", "s_suppkey"),
            "config": (T.load(spark, sf, "nation"), "n_name", "n_nationkey"),
            "document": (T.load(spark, sf, "documents"), "text", "doc_id"),
        },
        "Ring",
    )


@query(
    "inventory_top_processes",
    "INV14",
    f"""WITH {SQL_EVENTS}, r AS (SELECT 'host-' || user_id AS hostname, event_id AS pid, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS m,
       row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS c FROM ev) SELECT hostname, pid FROM r WHERE m <= 8 OR c <= 8""",
)
def top_processes(spark, sf):
    *_, procs = host_tables(spark, sf)
    return I.top_processes(procs, ["hostname"], 8).select("hostname", "pid")


COUNTED = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "inventory_table_counts",
    "INV15 REL17",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in COUNTED),
)
def table_counts(spark, sf):
    return I.table_counts({t: T.load(spark, sf, t) for t in COUNTED})


@query(
    "inventory_dependents",
    "INV16",
    f"""WITH {SQL_PODS}, e AS (SELECT namespace || '/' || name AS src, 'cm-' || unnest([k % 10, k % 9]) AS dst FROM pods)
    SELECT DISTINCT src, dst, 'READS' AS edge_type FROM e WHERE dst IN ('cm-3', 'cm-9')""",
)
def dependents(spark, sf):
    r = I.reads(raw_pods(spark, sf)).where("kind = 'ConfigMap'")
    edges = r.select(F.concat_ws("/", "namespace", "pod").alias("src"), F.col("target").alias("dst"), F.lit("READS").alias("edge_type"))
    wanted = r.where(F.col("target").isin("cm-3", "cm-9")).select(F.col("target").alias("name"))
    return I.dependents(edges, wanted)
