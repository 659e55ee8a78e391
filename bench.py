"""Times the headline queries and prints one JSON line.

Every query runs twice; the second, warm run counts, the first is reported as ``cold``.
Results are computed in full and dropped (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from goldweave.plans.all_queries import CATALOG  # noqa: E402
from goldweave.plans.catalog import Tables  # noqa: E402
from goldweave.session import build_session  # noqa: E402

HEADLINE = [
    "golden_parts", "golden_two_sources", "clean_text_documents", "ruleset_customer", "contact_identifier_rules",
    "infer_column_types", "mask_pii_documents", "profile_table", "profile_columns", "outliers_iqr", "orphans",
    "exact_key_duplicates", "waterfall_parts", "salted_join", "fuzzy_jw_pairs", "edit_distance_pairs", "pair_metrics",
    "clusters_components", "hybrid_match", "vector_match_pairs", "golden_row", "golden_field", "golden_lineage",
    "golden_preview", "review_queue", "confidence_grade", "pair_conflicts", "decisions_applied", "audit_daily", "er_kpis",
    "latest_per_key", "merge_upsert", "incremental_load", "stream_clean", "stream_match",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.log.level": "ERROR"})
    tables = Tables(spark, folder)
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            start = time.perf_counter()
            CATALOG[name].build(tables).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "sum of warm query times", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
