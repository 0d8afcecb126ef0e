"""Cloud cost: rollups, trends, drill-down, estimates.

``billing(provider, project, service, sku, usage_ts, cost, currency, usage_amount, unit)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _exact(col: str) -> Column:
    """Costs are added as decimals, so totals do not depend on the order of rows."""
    return F.sum(F.col(col).cast("decimal(28,6)"))


def _since(day: str, days: int) -> Column:
    return F.to_date("usage_ts") >= F.date_sub(F.lit(day).cast("date"), days)


def service_costs(billing: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Cost per service and currency over the last days, above one cent."""
    per = billing.where(_since(today, days)).groupBy("service", "currency").agg(_exact("cost").alias("c"))
    return per.where("c > 0.01").select("service", "currency", F.round("c", 2).cast("double").alias("cost"))


def daily_trend(billing: DataFrame, today: str, days: int = 7) -> DataFrame:
    per = billing.where(_since(today, days)).groupBy("service", F.to_date("usage_ts").alias("day")).agg(_exact("cost").alias("c"))
    return per.select("service", "day", F.round("c", 2).cast("double").alias("cost"))


def sku_costs(billing: DataFrame, service: str, today: str, days: int = 30) -> DataFrame:
    per = billing.where(_since(today, days) & (F.col("service") == service)).groupBy("sku", "unit").agg(
        _exact("cost").alias("c"), _exact("usage_amount").alias("u")
    )
    return per.where("c > 0.01").select(
        "sku", "unit", F.round("c", 2).cast("double").alias("cost"), F.round("u", 2).cast("double").alias("usage_amount")
    )


MONTHLY_SCHEMA = """
  ResultsByTime array<struct<Groups: array<struct<Keys: array<string>,
    Metrics: struct<UnblendedCost: struct<Amount: string>>>>>>
"""


def monthly_costs(results: DataFrame) -> DataFrame:
    """Service costs of nested monthly results (``MONTHLY_SCHEMA``), one cent and more."""
    groups = results.select(F.explode("ResultsByTime").alias("p")).select(F.explode("p.Groups").alias("g"))
    amount = F.coalesce(F.col("g.Metrics.UnblendedCost.Amount").try_cast("double"), F.lit(0.0))
    service = F.coalesce(F.get("g.Keys", F.lit(0)), F.lit("unknown"))
    return groups.select(service.alias("service"), amount.alias("cost")).where("cost >= 0.01")


def expensive(costs: DataFrame, limit: float = 50.0) -> DataFrame:
    return costs.where(F.col("cost") > limit).orderBy(F.desc("cost"), "service")


# Monthly prices by machine type or tier; first match wins.
MACHINE_PRICES = (
    ("e2-micro", 6.11), ("e2-small", 12.23), ("e2-medium", 24.46), ("e2-standard-2", 48.91),
    ("e2-standard-4", 97.83), ("e2-standard-8", 195.66), ("e2-standard-16", 391.31),
    ("n2-standard-2", 71.40), ("n2-standard-4", 142.80), ("n2-standard-8", 285.61),
    ("t2a-standard-1", 27.39), ("f1-micro", 3.88), ("g1-small", 13.13),
)
DATABASE_PRICES = (
    ("=db-f1-micro", 7.67), ("=db-g1-small", 25.55), ("db-custom-1", 51.10),
    ("db-custom-2", 102.20), ("db-custom-4", 204.40), ("=db-n1-standard-1", 51.10),
    ("=db-n1-standard-2", 102.20),
)


def _priced(text: Column, prices, default: float) -> Column:
    out = F.lit(default)
    for pattern, price in reversed(prices):
        hit = text == pattern[1:] if pattern.startswith("=") else text.contains(pattern)
        out = F.when(hit, price).otherwise(out)
    return out


def estimated_costs(resources: DataFrame) -> DataFrame:
    """``resources(kind, name, machine_type, nodes)`` -> monthly estimate; clusters cost
    per node, databases by tier, other machines once."""
    machine = _priced(F.col("machine_type"), MACHINE_PRICES, 50.0)
    database = _priced(F.col("machine_type"), DATABASE_PRICES, 30.0)
    cost = F.when(F.col("kind") == "cluster", machine * F.col("nodes")).when(
        F.col("kind") == "database", database
    ).otherwise(machine)
    return resources.withColumn("cost", F.round(cost, 2))
