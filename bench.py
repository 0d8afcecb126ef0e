"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Every query is written to the noop sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from opsweave.plans import load_all
from opsweave.session import local_session

HEADLINE = (
    "policy_verdicts", "policy_all_matches", "policy_cooloff", "policy_session_approvals",
    "policy_fsm_replay", "policy_risk_enrichment", "log_pod_buckets", "log_kernel_buckets",
    "log_mentions", "log_postmortem_services", "metric_percentiles", "metric_outages",
    "metric_network_report", "correlate_caused_by", "correlate_restart_storms",
    "inventory_snapshot_diff", "code_graph_edges", "code_blast_radius", "code_co_change",
    "code_x_ray", "graph_weak_components", "graph_page_rank", "search_nearest",
    "search_keyword_scores", "search_document_vectors", "search_strip_tags",
    "search_markdown_sections", "diagnose_document_patterns", "chat_radar", "cost_daily_trend",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "opsweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    # start the engine and compile the common code before anything is timed
    entries[names[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in ("policy_verdicts", "log_pod_buckets", "correlate_caused_by"):
        if name in took:
            rates[name] = round(events / took[name])
    if "graph_page_rank" in took:
        rates["graph_page_rank_sec_per_iteration"] = round(took["graph_page_rank"] / 100, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_wall", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "rows_per_sec": rates, "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
