"""Plan lint over every registered query: no Cartesian products, no nested-loop
joins, no window or sort that gathers all rows into one partition, no Python
UDF evaluation in the physical plan, and no filter that parses text (a filter on a
parsed value is pushed into the scan and parses every row a second time)."""

import re

import pytest

from tierlens.plans import catalog

from .conftest import SF_SMALL

SKIP = {"d8_train_and_evaluate", "d9_model_route", "d16_retrain",   # ML fit runs eagerly
        "w3_continuous_verification", "w4_stream_request_telemetry", "w5_live_daily_rollup",
        "w6_stream_failure_capture", "s1_s3_request_log_roundtrip", "s1_day_partitions",
        "s2_s4_failures_roundtrip"}                                  # write first, then scan
NAMES = sorted(n for n in catalog.QUERIES if n not in SKIP)
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas"]
UNPARTITIONED_WINDOW = re.compile(r"Window \[.*\], \[\], \[")


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_distributed(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [f for f in FORBIDDEN if f in plan]
    assert not found, f"{name}: {found}"
    assert not UNPARTITIONED_WINDOW.search(plan), f"{name}: window without partition key"
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # only partial aggregates (one row per partition) may meet in one partition
            assert "partial_" in lines[i + 1], f"{name}: {lines[i + 1][:200]}"


PARSING_FILTER = re.compile(r"^[\s+\-:]*Filter .*(from_json|RLIKE|regexp_)")


@pytest.mark.parametrize("name", NAMES)
def test_no_filter_parses_text(spark, name):
    plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    bad = [line.strip()[:160] for line in plan.splitlines() if PARSING_FILTER.search(line)]
    assert not bad, f"{name}: {bad}"
