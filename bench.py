"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional), BENCH_REPEAT (best of N, default 2: the first
run of a query also pays for code generation and JIT warm-up).
Each query is executed in full with the ``noop`` sink (nothing is collected to
the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "t4_headline_kpis", "t5_daily_spend", "t7_model_mix", "t8_quality_histogram", "t9_daily_escalation",
    "p1_p2_p4_prompts", "p3_prompt_recurrence", "f12_routing_features_corpus",
    "f13_diagnostic_features_documents", "d6_stratified_split", "d12_classification_report",
    "s8_normalised_responses", "r2_model_lookup", "r4_request_cost", "v7_dispatch_sync",
    "v8_captured_savings", "e2_e5_flexible_sla", "w2_current_log", "s1_s3_request_log_roundtrip",
    "d1_labelled_corpus", "d8_train_and_evaluate", "d15_training_matrix", "d16_retrain", "w3_continuous_verification",
    "w4_stream_request_telemetry", "w5_live_daily_rollup", "w6_stream_failure_capture",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from tierlens.plans.catalog import QUERIES
    from tierlens.session import build_session

    spark = build_session(f"local[{cpus}]", app="tierlens-bench", shuffle_partitions=2 * cpus)
    spark.conf.set("spark.tierlens.spreadPartitions", str(4 * cpus))  # the tables here are single files
    QUERIES["t9_daily_escalation"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up

    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
