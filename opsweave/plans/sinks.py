"""Export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.plans.policy import SQL_LOG, audit_log
from opsweave.plans.registry import query
from opsweave.sources import sinks as S
from opsweave.sources import tables as T


@query(
    "export_batches",
    "SNK3",
    f"""WITH {SQL_LOG}, r AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM log)
    SELECT event_id, (i - 150) // 200 AS batch, CASE WHEN action = 'block' THEN 'blocked' ELSE 'allowed' END AS result, strlen(detail)::VARCHAR AS context_hash,
    CASE WHEN action = 'block' THEN left(detail, 120) ELSE '' END AS action, coalesce(CASE WHEN reason = 'guard_rule' THEN left(detail, 200) END, '') AS matched_rule FROM r WHERE i >= 150""",
)
def export_batches(spark, sf):
    b = S.export_batches(audit_log(spark, sf), 150).fillna("", ["matched_rule"])
    return b.select("event_id", "batch", "result", "context_hash", "action", "matched_rule")


@query("export_audit_summary", "SNK5", f"WITH {SQL_LOG} SELECT tool, action, reason, count(*) AS n FROM log GROUP BY ALL")
def audit_summary(spark, sf):
    return S.audit_summary(audit_log(spark, sf))


@query(
    "upsert_customers",
    "SNK1",
    """WITH o AS (SELECT o_custkey AS k, min(o_orderdate) AS f, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, min(o_orderdate) AS f, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
    SELECT coalesce(o.k, n.k) AS customer, strftime(coalesce(o.f, n.f), '%Y-%m-%d') AS first_seen, coalesce(n.v, o.v) AS value FROM o FULL JOIN n ON o.k = n.k""",
)
def upsert_customers(spark, sf):
    o = T.load(spark, sf, "orders")

    def half(cond):
        return o.where(cond).groupBy(F.col("o_custkey").alias("customer")).agg(
            F.min("o_orderdate").alias("first_seen"), F.max("o_totalprice").alias("value")
        )

    cut = "o_orderdate {} timestamp_ntz'1998-01-01'"
    merged = S.upserted(half(cut.format("<")), half(cut.format(">=")), ["customer"], ["first_seen"])
    return merged.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd"))
