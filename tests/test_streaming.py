"""Streams store and report the same as a batch, also when a batch is repeated."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from usagelens.operators import sessions, usage
from usagelens.sources import envelopes, snapshots, store
from usagelens.streaming import live


def message(i):
    kind = ("api_request", "user_prompt", "tool_decision")[i % 3]
    attributes = {
        "event.name": kind,
        "event.timestamp": f"2024-03-04T{i % 24:02d}:00:{i % 60:02d}.000Z",
        "session.id": f"s{i % 4}",
        "user.email": f"u{i % 2}@x",
        "cost_usd": i / 10,
        "input_tokens": i,
        "output_tokens": 1,
    }
    return json.dumps({"attributes": attributes, "resource": {"user.practice": f"p{i % 2}"}})


def line(*numbers):
    events = [{"id": f"e{i}", "timestamp": i, "message": message(i)} for i in numbers]
    return json.dumps({"messageType": "DATA_MESSAGE", "logEvents": events})


@pytest.fixture
def arriving(tmp_path):
    """Five files: events, one overlapping file, one with damage."""
    folder = tmp_path / "in"
    folder.mkdir()
    files = [
        [line(*range(0, 10))],
        [line(*range(10, 20)), ""],
        [line(*range(15, 25))],
        ["{bad", line(25), json.dumps({"messageType": "OTHER", "logEvents": []})],
        [line(*range(26, 40))],
    ]
    for i, lines in enumerate(files):
        (folder / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
    return str(folder)


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CHECKED = ("id", "event_name", "session_id", "cost_usd", "event_ts")


@pytest.mark.parametrize("ingest", [live.ingest_stream, live.ingest_stream_with_state])
def test_stream_equals_batch(spark, tmp_path, arriving, ingest):
    batch, stream = str(tmp_path / "batch"), str(tmp_path / "stream")
    store.ingest_jsonl(spark, arriving, batch)
    lines = live.stream_lines(spark, arriving, files_per_batch=2)
    done(ingest(lines, stream, str(tmp_path / "state")))
    expected = rows(store.read_events(spark, batch), *CHECKED)
    assert len(expected) == 40
    assert rows(store.read_events(spark, stream), *CHECKED) == expected
    # Nothing new: a restarted query adds nothing.
    done(ingest(live.stream_lines(spark, arriving, 2), stream, str(tmp_path / "state")))
    assert rows(store.read_events(spark, stream), *CHECKED) == expected


def test_repeated_batch_is_stored_once(spark, tmp_path, arriving):
    table = str(tmp_path / "events")
    lines = envelopes.read_lines(spark, arriving)
    for _ in range(2):
        store.append_lines(lines, table, "stream-000000000")
    assert store.read_events(spark, table).count() == 40


def test_live_reports_equal_batch_reports(spark, tmp_path, arriving):
    table = str(tmp_path / "events")
    store.ingest_jsonl(spark, arriving, table)
    events = store.read_events(spark, table)
    reports = {
        "cost": (live.live_cost, ("period",), usage.cost_over_time(events)),
        "sessions": (live.live_sessions, ("session_id",), sessions.session_stats(events)),
    }
    for name, (report, keys, expected) in reports.items():
        stream = live.once_per_id(live.parsed_stream(live.stream_lines(spark, arriving, 1)))
        current = report(stream)
        path = str(tmp_path / name)
        done(live.keep_changes(current, path, str(tmp_path / f"{name}-state"), *keys))
        got = live.latest(spark, path, current.schema, *keys)
        assert rows(got, *expected.columns) == rows(expected, *expected.columns)


def test_delay_bounds_state(spark, tmp_path, arriving):
    stream = live.parsed_stream(live.stream_lines(spark, arriving), delay="2 days")
    current = live.live_cost(live.once_per_id(stream, bounded=True), "day")
    path = str(tmp_path / "daily")
    done(live.keep_changes(current, path, str(tmp_path / "state"), "period"))
    total = live.latest(spark, path, current.schema, "period").agg(F.sum("api_calls")).first()[0]
    assert total == len([i for i in range(40) if i % 3 == 0])


def test_events_without_id_all_stay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    event = {"id": None, "timestamp": 1, "message": "{}"}
    body = {"messageType": "DATA_MESSAGE", "logEvents": [event, event]}
    (folder / "a.jsonl").write_text(json.dumps(body))
    for i, ingest in enumerate((live.ingest_stream, live.ingest_stream_with_state)):
        table = str(tmp_path / f"events{i}")
        done(ingest(live.stream_lines(spark, str(folder)), table, str(tmp_path / f"state{i}")))
        assert store.read_events(spark, table).count() == 2


def test_batches_write_logs_of_their_changes(spark, tmp_path, arriving):
    def run():
        lines = live.stream_lines(spark, arriving, 1)
        current = live.live_sessions(live.once_per_id(live.parsed_stream(lines)))
        done(live.keep_changes(current, path, str(state), "session_id"))
        return live.latest(spark, path, current.schema, "session_id").agg(F.sum("session_tokens")).first()[0]

    path, state = str(tmp_path / "live"), tmp_path / "state"
    assert run() == sum(i + 1 for i in range(40))
    logged = {f.name for f in (state / "state").rglob("*.changelog")}
    assert logged >= {f"{n}.changelog" for n in range(1, 6)}
    # A restarted query reads its state back from the logs: copies are still known.
    with open(f"{arriving}/9.jsonl", "w") as more:
        more.write(line(*range(35, 45)))
    assert run() == sum(i + 1 for i in range(45))


def _states(state):
    """Batches that committed state; each has a file in the log of commits."""
    return [f.name for f in (state / "commits").iterdir() if f.name.isdigit()]


@pytest.mark.parametrize("query", ["stream_ingest_with_state", "stream_cost_by_hour", "stream_session_rollup"])
def test_registered_streams_take_a_file_for_each_core(spark, tmp_path, monkeypatch, query):
    folders = [tmp_path / "logs" / "1-sent", tmp_path / "logs" / "2-sent-again"]
    cores = spark.sparkContext.defaultParallelism
    for folder in folders:
        folder.mkdir(parents=True)
    for i in range(2 * cores):
        (folders[0] / f"{i:02d}.txt").write_text(line(*range(10 * i, 10 * i + 10)) + "\n")
    again = json.loads(line(*range(0, 20 * cores, 3)))
    for event in again["logEvents"]:
        event["message"] = event["message"].replace('"cost_usd": ', '"cost_usd": 9')
    (folders[1] / "00.txt").write_text(json.dumps(again) + "\n")
    os.utime(folders[1] / "00.txt", (time.time() + 5,) * 2)
    paths = {name: tmp_path / name for name in ("logs", "events", "live", "state")}
    monkeypatch.setattr(entry, "_logs", lambda *_: [str(f) for f in folders])
    monkeypatch.setattr(entry, "scratch_path", lambda _, label: str(paths[label]))

    got = entry.queries()[query](spark, "")
    # Two batches of what is sent, one of what is sent again, which is known by then.
    assert len(_states(paths["state"])) == 3
    batch = str(tmp_path / "batch")
    store.ingest_jsonl(spark, str(folders[0]), batch)
    events = store.read_events(spark, batch)
    expected = {
        "stream_ingest_with_state": events.select(entry._COMPARED),
        "stream_cost_by_hour": usage.cost_over_time(events),
        "stream_session_rollup": sessions.session_stats(events),
    }[query]
    assert rows(got, *expected.columns) == rows(expected, *expected.columns)
    if query == "stream_ingest_with_state":
        assert got.count() == 20 * cores
        assert sum(len(p.loads) for p in snapshots.current(spark, str(paths["events"])).parts) == 3
