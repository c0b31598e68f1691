"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once cold and then once more; the second run is reported. A run
covers building the plan, running it and writing all rows to the no-op sink.
"""

import json
import os
import time

import querygrove.workloads.all  # noqa: F401
from querygrove.session import local_session
from querygrove.workloads.registry import QUERIES

HEADLINE = (
    "top_diagnosis_per_day", "classify_files", "tokenize", "split_statements", "statement_kinds", "admit_read_only", "rule_coverage",
    "security_scan", "extract_tables", "opt_004", "schema_state", "plan_summary", "top_sections", "proposal_ddl", "retain_by_size",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of headline queries, second run", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
