"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkwell.plans import catalog  # noqa: E402
from sparkwell.session import build_session  # noqa: E402

HEADLINE = (
    "pool_filter_by_gene", "filter_funnel", "pool_summary", "liability_flags", "gc_content", "codon_translate", "homopolymer_runs", "kmer_screen", "plate_health", "call_ratio_and_z", "caller_summary",
    "plate_features", "normalise_plan", "tecan_worklist", "artifact_lineage", "upsert_latest", "assign_propose", "golden_gate_fragments", "mott_trim", "resolve_reruns", "length_bins", "diversity_sample",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))
    spark = build_session("bench", f"local[{cpus}]", int(cpus), spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start-up is not a query's time
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
