"""Time the headline queries on $BENCH_SF_DIR (default sf0.1) with local[$BENCH_CPUS]; prints one JSON line.

usage: python bench.py [name ...]     (names default to the headline list; 'all' times every registered query)
"""

from __future__ import annotations

import json
import os
import sys
import time

from passledger import catalog
from passledger.session import local_session

HEADLINE = [
    "review_state", "fold_candidates", "fold_map", "consolidated_history", "unit_coverage", "convergence", "validate_observations",
    "corpus_profile", "detector_sweep", "custom_detectors", "file_classes", "corpus_fingerprint", "redact_text", "redaction_counts", "leak_check",
    "apply_verdicts", "conservation", "pending_verdicts", "tier_tally", "match_slots", "resolve_paths", "prior_dispositions", "heat_split",
    "ledger_reduction", "orphan_reconciliation", "usage_summary", "visitation", "report_rows", "report_suite", "sarif_results", "verdict_batches",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    seconds = {}
    for name in names:
        started = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
