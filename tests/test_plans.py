"""The physical plans the engine is meant to have over its stored table."""

import json

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from usagelens.operators import outliers, reshape, sessions, tools, usage, users, workforce
from usagelens.sources import driver_tables, employees, envelopes, store


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The driver events and employees as stored tables."""
    folder = tmp_path_factory.mktemp("store")
    events, staff = str(folder / "events"), str(folder / "staff")
    rows = driver_tables.events(spark, SF)
    from pyspark.sql import functions as F

    store.write_load(rows.withColumn("raw_message", F.lit("")), events, "fixture")
    employees.replace(driver_tables.employees(spark, SF), staff)
    return store.read_events(spark, events), employees.read_employees(spark, staff)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ON_EVENTS = {
    "kpi": usage.kpi_summary,
    "practice": usage.token_usage_by_practice,
    "model": usage.token_usage_by_model,
    "time": usage.cost_over_time,
    "hour": usage.peak_usage_by_hour,
    "weekday": usage.peak_usage_by_weekday,
    "efficiency": usage.cost_efficiency_by_model,
    "cache": usage.cache_efficiency,
    "errors": usage.api_error_analysis,
    "tools": tools.tool_usage_stats,
    "tools by practice": tools.tool_accept_by_practice,
    "tool results": tools.tool_result_performance,
    "prompts": users.prompt_length_distribution,
    "top users": users.top_users_by_cost,
    "terminals": users.terminal_type_distribution,
    "sessions": sessions.session_stats,
    "session features": sessions.session_features,
    "durations": sessions.session_duration_stats,
    "histogram": reshape.duration_histogram,
    "box": reshape.duration_box,
}
ON_BOTH = {
    "level": workforce.cost_by_level,
    "location": workforce.cost_by_location,
    "tools by level": workforce.tool_acceptance_by_level,
    "per user": workforce.avg_cost_per_user_by_practice_level,
}
SINGLE_EVENT = ("practice", "model", "time", "efficiency", "cache", "tools", "tool results", "prompts")


@pytest.mark.parametrize("name", [*ON_EVENTS, *ON_BOTH])
def test_no_cross_join_no_python_no_raw_message(tables, name):
    events, staff = tables
    text = plan(ON_EVENTS[name](events) if name in ON_EVENTS else ON_BOTH[name](events, staff))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoop", "Python", "raw_message", "InMemory"):
        assert forbidden not in text.replace("InMemoryFileIndex", "")


@pytest.mark.parametrize("name", SINGLE_EVENT)
def test_event_type_prunes_folders(tables, name):
    text = plan(ON_EVENTS[name](tables[0]))
    assert "PartitionFilters: [isnotnull(event_name" in text


@pytest.mark.parametrize("name", list(ON_EVENTS))
def test_raw_rows_meet_a_hash_aggregate(tables, name):
    """The aggregate next to the scan hashes; it does not sort raw rows."""
    lines = plan(ON_EVENTS[name](tables[0])).splitlines()
    scan = max(i for i, text in enumerate(lines) if "FileScan" in text)
    nearest = next(text for text in reversed(lines[:scan]) if "Aggregate(" in text)
    assert "HashAggregate(" in nearest


@pytest.mark.parametrize("name", list(ON_BOTH))
def test_events_are_summed_before_the_join(tables, name):
    text = plan(ON_BOTH[name](*tables))
    join = text.index("Join")
    assert "HashAggregate(" in text[join:]
    assert "ReadSchema" in text


def test_predicates_reach_the_files(tables):
    text = plan(usage.cost_efficiency_by_model(tables[0]))
    assert "GreaterThan(cost_usd,0.0)" in text and "IsNotNull(model)" in text


def test_messages_are_parsed_once(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps({"messageType": "DATA_MESSAGE", "logEvents": []}))
    staged = envelopes.stage(envelopes.read_lines(spark, str(path))).where(envelopes.storable())
    # The plain parse and its fallback for bare NaN.
    assert plan(staged).count("parseJson") == 2


def test_top_k_is_not_a_full_sort(tables):
    text = plan(sessions.session_stats(tables[0], 50))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_forest_moves_samples_only(tables):
    """Scoring is one narrow Python step; the shuffle carries candidate rows of the trees."""
    features = sessions.session_features(tables[0])
    drawn = outliers._draw(features, "session_id", outliers.SESSION_INPUTS, 256, 10**9)
    text = plan(drawn.groupBy("tree").applyInPandas(outliers._grow(256), outliers._NODES))
    assert text.index("FlatMapGroupsInPandas") < text.index("hashpartitioning(tree")


def test_registered_queries_read_the_driver_tables(spark):
    for name in ("kpi_summary", "cost_by_level", "session_stats"):
        assert "events.parquet" in plan(entry.queries()[name](spark, SF))
