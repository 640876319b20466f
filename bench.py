"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.  Each query is
executed once to warm up and then timed; results are written to the no-op sink, so every row is
produced and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from paperroute.plans.registry import all_queries
from paperroute.session import local_session

HEADLINE = [
    "plan_auto_filing", "job_confidence", "job_filing_outcome", "jn_evidence_verify", "job_suggest_names",
    "wn_collision_suffix", "prj_inbox_row", "flt_review_queue", "wn_latest_decision", "topk_per_folder",
    "ag_dashboard", "ag_override_signals", "jn_ledger_claim", "jn_duplicate_report", "wn_stability_probe",
    "wn_retry_schedule", "jn_feedback_snapshot", "job_land_responses", "job_flatten_fields",
    "job_validate_fields", "ag_extraction_quality", "jn_field_truth", "jn_drug_lexicon", "job_redact",
    "ag_page_text", "jn_eval_labels", "ag_eval_by_block", "ag_gate_quality", "jn_run_compare",
    "jn_price_prefix", "ag_cost_per_doc", "ag_cost_summary", "ag_usage_scope", "jn_storage_reconcile",
    "ag_folder_rollup", "st_ingest", "st_readiness", "st_ledger_state", "st_route", "st_dashboard", "st_usage", "st_upsert",
    "st_throughput", "jn_term_lexicon", "jn_inbox_page", "ag_gate_curve", "job_land_extractions", "src_inbound_files", "st_ingest_files",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            seen = Observation()
            result = queries[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("rows"))
            result.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            rows[name] = seen.get["rows"]
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "rows": rows,
                "rows_per_sec": {n: round(rows[n] / max(s, 1e-3)) for n, s in seconds.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
