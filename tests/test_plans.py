"""Physical plans: no pair-building joins, no Python rows, scans pruned."""

import re

import pytest

from checks import all_checks
from voltlake import fixtures as X

SF = "/root/testdata/sf0.001"
HARD = (
    "fleet_dashboard", "vehicle_rankings", "cell_balance", "cell_balance_nearest", "battery_health", "driving_patterns",
    "driving_sessions", "segments", "charging_sessions", "charging_sessions_by_current", "nearest_join", "interval_join",
    "mean_within", "step_efficiency", "temperature_series", "forecast_soh_linear", "fleet_summary",
)


@pytest.mark.parametrize("name", HARD)
def test_no_nested_loops_and_no_python(spark, name):
    plan = all_checks()[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "InPandas", "InArrow"):
        assert word not in plan


def scans(spark, name: str) -> int:
    """Scans in a plan, without those of slice borders and hot cells (no row where nothing is overfull)."""
    plan = all_checks()[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and not re.search("_cuts|_salts|_parts", line) for line in plan.splitlines())


@pytest.mark.parametrize("name, bms, gps", [
    ("driving_patterns", 2, 1), ("battery_health", 2, 1), ("cell_balance_daily", 1, 1), ("driving_performance", 1, 1),
    ("nearest_join", 1, 1), ("bms_response", 2, 0), ("temp_volt_response", 2, 0), ("forecast_soh_linear", 2, 0),
    ("interval_join", 2, 2), ("cell_balance", 2, 2),
])
def test_ordered_passes_read_their_input_at_most_twice(spark, name, bms, gps):
    assert scans(spark, name) <= bms + gps


@pytest.mark.parametrize("name, most", [("charging_sessions_by_current", 3), ("vehicle_rankings", 5), ("health_rank", 5), ("paginate_rn", 2)])
def test_written_passes_are_scanned_little(spark, name, most):
    assert scans(spark, name) <= most


def test_global_order_has_no_constant_key(spark):
    """One task sees at most one row per range."""
    plan = all_checks()["vehicle_rankings"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[_range" in lines[i + 1]


def test_scans_read_only_what_a_query_needs(spark):
    plan = X.bms(spark, SF).where("soc > 50").select("soc")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<event_id:bigint>", plan)


def test_every_name_is_registered_once():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry_sets_only_what_a_running_session_allows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert entry.queries()["list_devices"](spark, SF).count() > 0
