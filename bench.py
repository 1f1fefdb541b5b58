"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from plumbline.session import local_session
from plumbline.workload import queries

HEADLINE = [
    "version_extremes",
    "advisory_match",
    "threat_enrichment",
    "risk_score",
    "typosquat",
    "dependency_closure",
    "call_paths",
    "diff_changes",
    "mined_spans",
    "lock_packages",
    "sarif_rules",
    "scan_findings",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
