"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query writes to Spark's no-op sink, so that all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "report_order_summary", "report_top_orders", "sales_by_category_city", "customer_windows", "function_tour",
    "retail_fact_load", "retail_daily_upsert", "text_to_partitioned_orc", "join_salted", "star_join", "anti_join_null_aware",
    "top_orders_per_customer", "merge_order_periods", "surrogate_keys", "collect_sorted_lists", "column_profile", "row_difference",
    "keyed_difference", "reconcile_same_result", "fingerprint_many_tables", "synthetic_columns", "audit_documents", "audit_scripts",
    "rewrite_scripts", "script_variables", "notebook_warnings", "usage_by_directory", "workflow_predecessors", "event_predecessors",
    "schedule_links", "report_conversion_status", "hierarchy_expansion", "missing_schedule_slots", "streamed_daily_summary",
)


def main() -> None:
    from warehaul import plans
    from warehaul.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    # one small job so that the first query does not pay for the start of the JVM
    spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in HEADLINES:
        begin = time.perf_counter()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
