"""The stored table under many small loads: whole versions, few files, pruned lookups, rollups."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import arriving, done, line, rows  # noqa: F401
from usagelens.operators import rollups, sessions, usage
from usagelens.sources import employees, envelopes, snapshots, store
from usagelens.streaming import live


@pytest.fixture
def load(spark, tmp_path):
    """Append the events of some numbers to the table as one load."""
    table = str(tmp_path / "events")

    def run(load_id, *numbers):
        path = tmp_path / f"{load_id}.jsonl"
        path.write_text(line(*numbers) + "\n")
        return store.append_lines(envelopes.read_lines(spark, str(path)), table, load_id, flat=True)

    return table, run


def ids(spark, table):
    return sorted(r["id"] for r in store.read_events(spark, table).select("id").collect())


def numbered(*numbers):
    return sorted(f"e{i}" for i in numbers)


# --- snapshots -----------------------------------------------------------------


def test_many_commits_leave_few_parts(spark, tmp_path):
    """As many levels as a thousand loads have with the usual fan-out, and one more."""
    path, written, most, n = str(tmp_path), 0, 0, 200

    def fold(parts, name):
        nonlocal written
        written += sum(p.rows for p in parts)
        return sum(p.rows for p in parts)

    for i in range(n):
        base = snapshots.current(spark, path)
        snapshots.commit(spark, path, base, (*base.parts, snapshots.Part(f"p{i}", (str(i),), rows=1)))
        snapshots.fold(spark, path, fold, fan_out=4)
        most = max(most, len(snapshots.current(spark, path).parts))
        if i % 100 == 99:
            snapshots.vacuum(spark, path, ["rows"], 0)
    last = snapshots.current(spark, path)
    assert most <= 3 * 4 + 1 and sum(p.rows for p in last.parts) == n and written <= 4 * n
    assert sorted(last.loads(), key=int) == [str(i) for i in range(n)]
    assert [p.loads[0] for p in last.parts] == sorted((p.loads[0] for p in last.parts), key=int)
    assert len([n for n in os.listdir(tmp_path / "_log") if n.endswith(".json") and n[0] != "."]) <= 2


def test_only_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path)
    base = snapshots.current(spark, path)
    snapshots.commit(spark, path, base, (snapshots.Part("a"),))
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, base, (snapshots.Part("b"),))
    assert [p.name for p in snapshots.current(spark, path).parts] == ["a"]


# --- loads ---------------------------------------------------------------------


def test_many_small_loads_are_folded_and_stay_whole(spark, load):
    table, run = load
    for i in range(9):
        run(f"l{i}", 3 * i, 3 * i + 1, 3 * i + 2, 3 * i + 3)
        store.compact(spark, table, fan_out=3)
    parts = snapshots.current(spark, table).parts
    assert len(parts) == 1 and parts[0].level == 2 and parts[0].rows == 28
    assert ids(spark, table) == numbered(*range(28))
    store.vacuum(spark, table, keep_seconds=0)
    assert len(os.listdir(f"{table}/rows")) == len(os.listdir(f"{table}/ids")) == 1
    assert ids(spark, table) == numbered(*range(28))
    assert run("again", *range(28))["rows_written"] == 0


def test_a_folded_load_can_be_repeated(spark, load):
    table, run = load
    run("a", 1, 2)
    run("b", 3, 4)
    store.compact(spark, table, fan_out=2)
    assert run("a", 1, 5, 3)["rows_written"] == 2
    assert ids(spark, table) == numbered(1, 3, 4, 5)


def test_readers_never_see_half_a_load(spark, load, monkeypatch):
    table, run = load
    run("a", 1, 2)
    seen = []
    write, commit = store._write_rows, snapshots.commit

    def watched(*args, **options):
        seen.append(ids(spark, table))
        write(*args, **options)
        seen.append(ids(spark, table))

    def failing(*args):
        seen.append(ids(spark, table))
        raise RuntimeError("lost driver")

    monkeypatch.setattr(store, "_write_rows", watched)
    monkeypatch.setattr(snapshots, "commit", failing)
    with pytest.raises(RuntimeError):
        run("b", 2, 3, 3)
    assert seen and all(s == numbered(1, 2) for s in seen)
    monkeypatch.setattr(snapshots, "commit", commit)
    run("b", 2, 3, 3)
    assert ids(spark, table) == numbered(1, 2, 3)
    store.vacuum(spark, table, keep_seconds=0)
    assert len(os.listdir(f"{table}/rows")) == 2


def test_an_open_frame_survives_a_fold(spark, load):
    table, run = load
    for i in range(4):
        run(f"l{i}", i)
    before = store.read_events(spark, table)
    store.compact(spark, table, fan_out=2)
    store.vacuum(spark, table)
    assert before.count() == 4


def test_new_ids_open_no_old_file(spark, load):
    """The rows of earlier loads are made unreadable: new ids do not need them, a stored one does."""
    table, run = load
    run("a", *range(50))
    for folder, _, files in os.walk(f"{table}/rows"):
        for name in files:
            if name.endswith(".parquet"):
                os.truncate(os.path.join(folder, name), 10)
    assert run("b", *range(50, 90))["rows_written"] == 40
    with pytest.raises(Exception):
        run("c", 7)


def test_only_suspected_days_are_opened(spark, load):
    table, run = load
    run("a", *range(40))
    base = snapshots.current(spark, table)
    asked = spark.createDataFrame([("e3", 1), ("new", 1)], "id string, copies long")
    hits = store.suspects(spark, table, base.parts, asked)
    assert list(hits) == [base.parts[0].name] and len(hits[base.parts[0].name]) == 1
    known = store._known(spark, table, base.parts, hits, asked)
    assert [r["id"] for r in known.collect()] == ["e3"]
    assert store.suspects(spark, table, base.parts, asked.where("id = 'new'")) == {}


def test_a_draft_parses_each_message_once(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps({"messageType": "DATA_MESSAGE", "logEvents": []}))
    draft = store.parsed(envelopes.read_lines(spark, str(path)), "x")
    # The plain parse and its fallback for bare NaN.
    assert draft._jdf.queryExecution().executedPlan().toString().count("parseJson") == 2


def test_ids_are_packed_by_delta_coding(spark, load):
    table, run = load
    run("a", *range(3000))
    folder = f"{table}/ids"
    files = [os.path.join(f, n) for f, _, names in os.walk(folder) for n in names if n.endswith(".parquet")]
    import pyarrow.parquet as pq

    encodings = {e for f in files for e in pq.ParquetFile(f).metadata.row_group(0).column(0).encodings}
    assert "DELTA_BINARY_PACKED" in encodings
    hashes = [h for f in files for h in pq.read_table(f, columns=["hash"]).column(0).to_pylist()]
    assert len(hashes) == 3000 and hashes == sorted(hashes)


def test_stream_batches_are_folded(spark, tmp_path, arriving, monkeypatch):  # noqa: F811
    monkeypatch.setattr(snapshots.due, "__defaults__", (2,))
    monkeypatch.setattr(snapshots.fold, "__defaults__", (2,))
    monkeypatch.setattr(store.compact, "__defaults__", (2,))
    table = str(tmp_path / "events")
    done(live.ingest_stream(live.stream_lines(spark, arriving, 1), table, str(tmp_path / "state")))
    assert len(snapshots.current(spark, table).parts) <= 3
    assert ids(spark, table) == numbered(*range(40))


# --- rollups -------------------------------------------------------------------


def same(a, b):
    assert rows(a, *b.columns) == rows(b, *b.columns)


def test_rollups_equal_reports_after_loads_and_folds(spark, load):
    table, run = load
    for i in range(6):
        run(f"l{i}", *range(7 * i, 7 * i + 9))
        for rollup in rollups.ROLLUPS.values():
            store.refresh(spark, table, rollup)
        store.compact(spark, table, fan_out=2)
    run("last", *range(40, 60))
    events = store.read_events(spark, table)
    cost, whole = store.rolled_up(spark, table, rollups.COST), store.rolled_up(spark, table, rollups.SESSIONS)
    same(rollups.cost_over_time(cost), usage.cost_over_time(events))
    same(rollups.cost_over_time(cost, "day"), usage.cost_over_time(events, "day"))
    same(rollups.session_stats(whole), sessions.session_stats(events))
    kpis = rollups.kpi_summary(store.rolled_up(spark, table, rollups.PRESENCE))
    same(kpis, usage.kpi_summary(events))


def test_reading_a_rollup_opens_no_events_of_refreshed_parts(spark, load):
    table, run = load
    run("a", *range(20))
    run("b", *range(20, 40))
    store.compact(spark, table, fan_out=2)
    expected = store.rolled_up(spark, table, rollups.COST).orderBy("start").collect()
    for folder, _, files in os.walk(f"{table}/rows"):
        for name in files:
            if name.endswith(".parquet"):
                os.truncate(os.path.join(folder, name), 10)
    assert store.rolled_up(spark, table, rollups.COST).orderBy("start").collect() == expected
    run("c", *range(40, 50))
    assert store.rolled_up(spark, table, rollups.COST).agg(F.sum("api_calls")).first()[0] == 17


def test_sketches_merge_within_the_stated_error(spark, make_events):
    rows_ = [
        {"event_name": "user_prompt", "session_id": f"s{i}", "user_id": f"u{i % 7000}", "event_timestamp": f"2024-03-{1 + i % 5:02d}T{i % 24:02d}:00:00.000Z"}
        for i in range(40_000)
    ]
    events = make_events(rows_)
    halves = [events.where(F.crc32("session_id") % 2 == r) for r in (0, 1)]
    partials = [rollups.PRESENCE.partial(h) for h in halves]
    merged = rollups.PRESENCE.merge(partials[0].unionByName(partials[1]))
    found = rollups.kpi_summary(merged).first()
    assert abs(found["total_sessions"] - 40_000) <= 4 * rollups.SKETCH_ERROR * 40_000
    assert abs(found["total_users"] - 7000) <= 4 * rollups.SKETCH_ERROR * 7000
    from datetime import datetime

    days = rollups.kpi_summary(merged, datetime(2024, 3, 2), datetime(2024, 3, 4)).first()
    assert abs(days["total_sessions"] - 16_000) <= 4 * rollups.SKETCH_ERROR * 16_000
    assert days["total_prompts"] == 16_000


def test_empty_rollup(spark, tmp_path):
    table = str(tmp_path / "none")
    for rollup in rollups.ROLLUPS.values():
        assert store.rolled_up(spark, table, rollup).count() == 0
    assert rollups.kpi_summary(store.rolled_up(spark, table, rollups.PRESENCE)).first()["total_sessions"] == 0


# --- changes of live reports, employees ------------------------------------------


def test_changes_are_folded_to_the_newest_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "live")
    schema = "k string, n long"
    typed = spark.createDataFrame([], schema).schema
    for batch in range(7):
        part = snapshots.Part(snapshots.new_name("batch"), (str(batch),), rows=1)
        changed = [(k, 10 * batch, batch) for k in "abc" if (batch + ord(k)) % 2] + [(None, batch, batch)]
        spark.createDataFrame(changed, f"{schema}, batch long").write.parquet(live._changes(path, part))
        base = snapshots.current(spark, path)
        snapshots.commit(spark, path, base, (*base.parts, part))
        live.fold_changes(spark, path, typed, "k", fan_out=2)
    assert len(snapshots.current(spark, path).parts) <= 3
    got = {r["k"]: r["n"] for r in live.latest(spark, path, typed, "k").collect()}
    assert got == {"a": 60 if (6 + ord("a")) % 2 else 50, "b": 60 if (6 + ord("b")) % 2 else 50, "c": 60 if (6 + ord("c")) % 2 else 50, None: 6}


def test_a_failed_upsert_leaves_the_old_employees(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "staff")
    (tmp_path / "a.csv").write_text("email,level\na@x,L1\n")
    (tmp_path / "b.csv").write_text("email,level\na@x,L2\nb@x,L1\n")
    employees.ingest_csv(spark, str(tmp_path / "a.csv"), table)
    commit = snapshots.commit

    def failing(*args):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(snapshots, "commit", failing)
    with pytest.raises(RuntimeError):
        employees.ingest_csv(spark, str(tmp_path / "b.csv"), table)
    assert [tuple(r)[0::3] for r in employees.read_employees(spark, table).collect()] == [("a@x", "L1")]
    monkeypatch.setattr(snapshots, "commit", commit)
    employees.ingest_csv(spark, str(tmp_path / "b.csv"), table)
    employees.vacuum(spark, table, 0)
    assert employees.read_employees(spark, table).count() == 2 and len(os.listdir(f"{table}/rows")) == 1


# --- limits, extreme counts -----------------------------------------------------


@pytest.mark.parametrize("limit", [1, 7, 25, 26, 40])
def test_the_first_lines_by_file_and_place(spark, tmp_path, limit):
    for f in range(4):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}-{i:03d}\n" for i in range(3 + 4 * f)))
    lines = envelopes.read_lines(spark, str(tmp_path / "*.txt"), limit)
    expected = [f"{f}-{i:03d}" for f in range(4) for i in range(3 + 4 * f)][:limit]
    assert sorted(r["value"] for r in lines.collect()) == expected
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrdered" not in plan


def test_large_blocks_are_counted_one_by_one(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i:06d}{'x' * 90}\n" for i in range(30_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        lines = envelopes.read_lines(spark, str(tmp_path / "a.txt"), 17_003)
        got = sorted(r["value"][:6] for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"{i:06d}" for i in range(17_003)]


def test_token_counts_at_the_limit_end_no_report(spark, make_events):
    from usagelens.operators import forecast, users

    top = (1 << 63) - 1
    base = {"event_name": "api_request", "user_practice": "p", "model": "m", "session_id": "s", "user_email": "u@x", "user_id": "u", "cost_usd": 0.5, "event_timestamp": "2024-03-04T05:00:00.000Z"}
    counts = [(top, 1), (5, 6), (top, top), (-3, 1), (None, 4)]
    events = make_events([{**base, "input_tokens": a, "output_tokens": b, "cache_read_tokens": a, "prompt_length": a} for a, b in counts])
    for report in (
        usage.kpi_summary, usage.token_usage_by_practice, usage.token_usage_by_model, usage.cost_over_time,
        usage.cost_efficiency_by_model, usage.cache_efficiency, sessions.session_stats, sessions.session_features,
        users.user_features, forecast.token_forecast,
    ):
        report(events).collect()
    row = usage.token_usage_by_practice(events).first()
    assert row["total_tokens"] is None and row["output_tokens"] is None and row["api_calls"] == 5
    few = events.where("input_tokens < 10")
    assert usage.token_usage_by_practice(few).first()["total_tokens"] == 9
    assert usage.token_usage_by_practice(events.where("output_tokens = 1 and input_tokens < 0")).first()["total_tokens"] == -2


# --- writes that move and sort no whole rows -------------------------------------


def test_a_flat_load_is_written_where_it_is_read(spark, tmp_path):
    """Each task writes the lines it read: no shuffle brings the rows of files together."""
    folder, table = tmp_path / "in", str(tmp_path / "events")
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.jsonl").write_text(line(*range(10 * i, 10 * i + 10)) + "\n")
    store.append_lines(envelopes.read_lines(spark, str(folder)), table, "a", flat=True)
    assert ids(spark, table) == numbered(*range(30))
    written = store.read_events(spark, table).select("id", F.input_file_name().alias("at")).collect()
    held = {}
    for r in written:
        held.setdefault(r["at"], set()).add(int(r["id"][1:]) // 10)
    assert len(held) == 3 and all(len(of) == 1 for of in held.values())


def test_rows_are_not_sorted_for_their_folders(spark, tmp_path):
    spark.sql(f"CREATE TABLE in_folders (v STRING, kind STRING) USING parquet PARTITIONED BY (kind) LOCATION '{tmp_path}/t'")
    try:
        query = "SELECT CAST(id AS STRING), CAST(id % 3 AS STRING) FROM range(9)"
        assert "Sort" not in spark.sql(f"EXPLAIN INSERT INTO in_folders {query}").first()[0]
    finally:
        spark.sql("DROP TABLE in_folders")
