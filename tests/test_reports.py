"""Report semantics the driver tables do not reach: NULLs, ties, empty input, skew."""

import json

import pytest

from usagelens.operators import reshape, sessions, tools, usage, users, workforce
from usagelens.plans import catalog
from usagelens.schema import EMPLOYEES
from usagelens.sources.records import to_records, write_records


def at(hour, minute=0, day=4):
    return f"2024-03-{day:02d}T{hour:02d}:{minute:02d}:00.000Z"


def test_tokens_add_only_when_both_sides_are_known(make_events):
    events = make_events(
        [
            {"event_name": "api_request", "user_practice": "p", "input_tokens": 5},
            {"event_name": "api_request", "user_practice": "p", "input_tokens": 5, "output_tokens": 2},
        ]
    )
    row = usage.token_usage_by_practice(events).first()
    assert (row.input_tokens, row.output_tokens, row.total_tokens) == (10, 2, 7)
    assert (row.total_cost_usd, row.avg_cost_per_call) == (None, None)


def test_sums_of_money_are_exact(make_events):
    costs = [0.1] * 10 + [1e-9] * 3 + [0.285, 1e9]
    events = make_events([{"event_name": "api_request", "cost_usd": c} for c in costs])
    assert usage.kpi_summary(events).first().total_cost_usd == 1000000001.285000003


def test_no_events(make_events):
    empty = make_events([])
    kpi = usage.kpi_summary(empty).first()
    assert tuple(kpi) == (0, 0, 0, 0.0, 0, 0, 0)
    for report in (
        usage.token_usage_by_practice,
        usage.peak_usage_by_hour,
        sessions.session_stats,
        sessions.session_durations,
        sessions.session_duration_stats,
        users.top_users_by_cost,
        reshape.duration_histogram,
        reshape.duration_box,
    ):
        assert report(empty).count() == 0
    assert sessions.prompt_cost_correlation(empty).first().n == 0


def test_unreadable_times_share_a_group(make_events):
    events = make_events(
        [
            {"event_name": "api_request", "event_timestamp": "soon", "cost_usd": 1.0},
            {"event_name": "api_request", "event_timestamp": at(7), "cost_usd": 2.0},
            {"event_name": "api_request", "cost_usd": 4.0},
        ]
    )
    assert [tuple(r) for r in usage.cost_over_time(events).select("period", "cost_usd").collect()] == [
        (None, 1.0),
        ("2024-03-04 07:00", 2.0),
    ]
    assert [tuple(r) for r in usage.peak_usage_by_hour(events).collect()] == [(None, 1, 1.0), (7, 1, 2.0)]
    assert [r.weekday for r in usage.peak_usage_by_weekday(events).collect()] == [None, "Monday"]


def test_session_takes_who_from_its_earliest_event(make_events):
    rows = [
        {"session_id": "s", "event_timestamp": at(9), "user_practice": "late", "user_email": "z"},
        {"session_id": "s", "event_timestamp": at(8), "user_practice": None, "user_email": "first"},
        {"session_id": "s", "user_practice": "undated", "user_email": "a"},
    ]
    row = sessions.session_stats(make_events(rows)).first()
    assert (row.user_practice, row.user_email) == (None, "first")
    assert (row.session_start, row.session_end) == (at(8), at(9))
    features = sessions.session_features(make_events(rows)).first()
    assert (features.user_practice, features.user_email) == (None, "first")
    assert features.duration_min == 60.0


def test_session_bounds_are_smallest_and_largest_texts(make_events):
    texts = [at(9), at(8), "2024-03-04T07:30:00+01:00", "soon", None, "2024-03-04 10:00:00"]
    rows = [{"session_id": "s", "event_timestamp": text} for text in texts]
    row = sessions.session_stats(make_events(rows)).first()
    known = [text for text in texts if text is not None]
    assert (row.session_start, row.session_end) == (min(known), max(known))
    running = sessions.running_profiles(make_events(rows)).first()
    assert running == row


def test_durations_that_round_to_zero_drop_out(make_events):
    rows = [
        {"session_id": "short", "event_timestamp": "2024-03-04T10:00:00.000Z"},
        {"session_id": "short", "event_timestamp": "2024-03-04T10:00:00.200Z"},
        {"session_id": "long", "event_timestamp": "2024-03-04T10:00:00.000Z"},
        {"session_id": "long", "event_timestamp": "2024-03-04T10:00:00.600Z"},
    ]
    assert [tuple(r) for r in sessions.session_durations(make_events(rows)).collect()] == [
        ("long", None, 0.01)
    ]


def test_efficiency_without_tokens(make_events):
    row = usage.cost_efficiency_by_model(
        make_events([{"event_name": "api_request", "model": "m", "cost_usd": 1.0}])
    ).first()
    assert (row.total_tokens, row.tokens_per_dollar, row.cost_per_1k_tokens) == (None, 0, 0.0)


def test_cache_rate_without_input(make_events):
    row = usage.cache_efficiency(
        make_events([{"event_name": "api_request", "user_practice": "p", "cache_read_tokens": 3}])
    ).first()
    assert (row.cache_read_tokens, row.cache_creation_tokens, row.cache_hit_rate_pct) == (3, 0, None)


def test_error_groups_need_more_than_five_events(make_events):
    rows = [{"event_name": "api_request", "user_practice": "p", "model": "m"}] * 5
    rows += [{"event_name": "api_error", "user_practice": "p"}] * 6
    assert [tuple(r) for r in usage.api_error_analysis(make_events(rows)).collect()] == [
        ("p", None, 0, 6, 100.0)
    ]


def test_success_of_json_true(make_events):
    rows = [{"event_name": "tool_result", "tool_name": "t", "success": s} for s in ("true", "false", None)]
    row = tools.tool_result_performance(make_events(rows)).first()
    assert (row.executions, row.successes, row.success_rate_pct) == (3, 1, 33.3)


def test_prompts_without_practice_are_a_group(make_events):
    rows = [{"event_name": "user_prompt", "prompt_length": 4}]
    assert users.prompt_length_distribution(make_events(rows)).first().user_practice is None


@pytest.fixture
def staff(spark):
    rows = [("a", "A", "Data", "L1", "Oslo"), ("b", "B", "Data", "L10", "Oslo"), ("c", "C", "Ops", "L2", "Bonn")]
    return spark.createDataFrame(rows, EMPLOYEES)


def hot_events(make_events):
    """One user holds most events; one email is unknown, one is missing."""
    rows = [
        {"event_name": "api_request", "user_email": "a", "session_id": f"s{i % 40}", "cost_usd": 0.01}
        for i in range(2000)
    ]
    rows += [{"event_name": "api_request", "user_email": "b", "session_id": "s1", "cost_usd": 3.0}]
    rows += [{"event_name": "user_prompt", "user_email": "c", "session_id": "s2"}]
    rows += [{"event_name": "api_request", "user_email": "x", "session_id": "s3", "cost_usd": 5.0}]
    rows += [{"event_name": "api_request", "session_id": "s4", "cost_usd": 7.0}]
    return make_events(rows)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_workforce_reports_with_and_without_broadcast(spark, make_events, staff, broadcast):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, broadcast)
    try:
        events = hot_events(make_events)
        levels = [tuple(r) for r in workforce.cost_by_level(events, staff).collect()]
        assert levels == [("L1", 40, 1, 20.0, 0.01, None), ("L10", 1, 1, 3.0, 3.0, None)]
        places = [tuple(r) for r in workforce.cost_by_location(events, staff).collect()]
        assert places == [("Oslo", 2, 23.0, None, 2001), ("Bonn", 1, None, None, 0)]
        pivot = reshape.practice_level_pivot(events, staff, ["L1", "L2", "L10"]).collect()
        assert [tuple(r) for r in pivot] == [("Data", 20.0, 0.0, 3.0)]
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_top_users_break_ties_by_email(make_events):
    rows = [
        {"event_name": "api_request", "user_email": e, "cost_usd": 1.0} for e in ("b", "a", "c", "")
    ]
    top = users.top_users_by_cost(make_events(rows), limit=2).collect()
    assert [r.user_email for r in top] == ["a", "b"]


def test_histogram_of_equal_durations(make_events):
    rows = [
        {"session_id": f"s{i}", "user_practice": "p", "event_timestamp": at(8, minute)}
        for i in range(3)
        for minute in (0, 5)
    ]
    assert [tuple(r) for r in reshape.duration_histogram(make_events(rows)).collect()] == [
        (1, 5.0, 5.0, "p", 3)
    ]


def test_anomaly_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "is_anomaly boolean")
    assert tuple(reshape.anomaly_summary(empty).first()) == (0, 0, 0.0)
    scored = spark.createDataFrame([(True, 1), (False, 2), (False, 3)], "is_anomaly boolean, x int")
    assert tuple(reshape.anomaly_summary(scored).first()) == (3, 1, 33.3)
    assert reshape.anomalies_only(scored).count() == 1
    assert reshape.normal_only(scored).count() == 2


# --- reports by name -----------------------------------------------------------


def test_catalog_has_every_report(make_events, staff):
    rows = [
        {
            "event_name": "api_request",
            "event_timestamp": at(8, day=d),
            "cost_usd": 1.0,
            "input_tokens": 1,
            "output_tokens": 1,
            "user_email": "a",
            "session_id": f"s{d}",
        }
        for d in (1, 2, 3)
    ]
    events = make_events(rows)
    assert len(catalog.REPORTS) == 21
    for name in catalog.REPORTS:
        for row in catalog.records(name, events, staff).collect():
            json.loads(row.value)


def test_forecast_document(make_events):
    rows = [
        {"event_name": "api_request", "event_timestamp": at(8, day=d), "cost_usd": float(d)}
        for d in (1, 2, 3)
    ]
    document = json.loads(
        catalog.run("predictions/cost-forecast", make_events(rows), days=1).first().value
    )
    assert document["meta"] == {"r2": 1.0, "slope_per_day": 1.0}
    assert document["data"][-1] == {"date": "2024-03-04", "cost_usd": 4.0, "type": "forecast"}
    empty = json.loads(catalog.run("predictions/cost-forecast", make_events([])).first().value)
    assert empty == {"meta": {"r2": None, "slope_per_day": None}, "data": []}


@pytest.mark.parametrize(
    "name, params",
    [
        ("nothing", {}),
        ("kpi", {"limit": 1}),
        ("sessions", {"limit": 0}),
        ("sessions", {"limit": 5001}),
        ("sessions", {"limit": "many"}),
        ("users/top", {"limit": 201}),
        ("cost/over-time", {"granularity": "week"}),
        ("predictions/cost-forecast", {"days": 91}),
        ("predictions/session-anomalies", {"contamination": 0.6}),
        ("employees/cost-by-level", {}),
    ],
)
def test_bad_requests(make_events, name, params):
    with pytest.raises(ValueError):
        catalog.run(name, make_events([]), **params)


def test_records_keep_nulls_and_drop_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert json.loads(to_records(df).first().value) == {"a": 1, "b": None, "c": None}


def test_written_records_read_back(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "x")], "a int, b double, c string")
    write_records(df, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted(lines, key=lambda r: r["a"]) == [
        {"a": 1, "b": None, "c": None},
        {"a": 2, "b": 0.5, "c": "x"},
    ]


def test_corrupt_costs_do_not_end_a_report(make_events):
    """One huge cost is summed like any other, beside the exact sum of the rest."""
    rows = [
        {
            "id": str(i),
            "event_name": "api_request",
            "event_timestamp": "2024-01-01T10:00:00.000Z",
            "session_id": "s",
            "user_email": "a@x",
            "user_practice": "p",
            "model": "m",
            "cost_usd": cost,
        }
        for i, cost in enumerate([0.25, 0.5, 1e13, 1e300, None])
    ]
    events = make_events(rows)
    assert usage.kpi_summary(events).first()["total_cost_usd"] == 1e300
    assert usage.token_usage_by_model(events).first()["total_cost_usd"] == 1e300
    assert users.top_users_by_cost(events).first()["total_cost_usd"] == 1e300
    ordinary = make_events(rows[:2] + rows[4:])
    assert usage.kpi_summary(ordinary).first()["total_cost_usd"] == 0.75
    large = make_events(rows[:3])
    assert usage.kpi_summary(large).first()["total_cost_usd"] == 1e13 + 0.75
