"""Parsing, refusing, storing and upserting on small hand-written files."""

import json

import pytest

from usagelens.sources import employees, envelopes, store


def event(id, message, timestamp=1):
    text = message if isinstance(message, str) else json.dumps(message)
    return {"id": id, "timestamp": timestamp, "message": text}


def named(name, **attributes):
    return {"attributes": {"event.name": name, **attributes}}


def envelope(*events):
    return json.dumps({"messageType": "DATA_MESSAGE", "logEvents": list(events)})


EDGE_LINES = [
    envelope(
        event("e1", named("api_request", input_tokens=10, output_tokens=5, cost_usd=0.25)),
        event("e2", named("user_prompt", prompt_length=42)),
    ),
    "",
    "{bad",
    json.dumps({"messageType": "OTHER", "logEvents": [event("z", named("x"))]}),
    json.dumps({"messageType": "DATA_MESSAGE"}),
    envelope(
        event("e1", named("api_request", cost_usd=9.99)),
        event("e3", "nope"),
        event("e4", named(None)),
        event("e5", {"body": "pkg.api_error"}),
    ),
    envelope(
        event("e6", named("api_request", input_tokens="12.5", output_tokens="12.5", cost_usd="abc")),
        event("e7", named("api_request"), None),
        event("e8", named("tool_decision", source="", decision_source="config")),
    ),
    envelope(event("e9", {})),
    envelope({"id": "e10", "message": "{}"}, event("e11", {"attributes": None})),
]


@pytest.fixture
def write(tmp_path):
    def to_file(lines, name="log.jsonl"):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return to_file


def stored(spark, path):
    return {row.id: row for row in store.read_events(spark, path).collect()}


def test_edge_lines(spark, write, tmp_path):
    table = str(tmp_path / "events")
    figures = store.ingest_jsonl(spark, write(EDGE_LINES), table)
    assert figures == {
        "lines_processed": 9,
        "events_inserted": 8,
        "events_skipped": 5,
        "rows_written": 6,
    }
    rows = stored(spark, table)
    assert set(rows) == {"e1", "e2", "e5", "e6", "e8", "e9"}
    assert rows["e1"].cost_usd == 0.25
    assert rows["e5"].event_name == "api_error"
    assert (rows["e6"].input_tokens, rows["e6"].cost_usd) == (None, None)
    assert rows["e8"].decision_source == "config"
    assert rows["e9"].event_name == "unknown"
    assert rows["e1"].ingested_at is not None


def test_summary_and_quarantine_without_a_table(spark, write):
    lines = envelopes.read_lines(spark, write(EDGE_LINES))
    assert envelopes.summary(lines).first().asDict() == {
        "lines_processed": 9,
        "events_inserted": 8,
        "events_skipped": 5,
    }
    refused = envelopes.quarantine(lines).collect()
    assert sorted(str(r.id) for r in refused) == ["None", "e10", "e11", "e3", "e4"]
    assert [r.line for r in refused if r.id is None] == ["{bad"]


def test_loading_again_adds_nothing(spark, write, tmp_path):
    table, path = str(tmp_path / "events"), write(EDGE_LINES)
    store.ingest_jsonl(spark, path, table)
    assert store.ingest_jsonl(spark, path, table)["rows_written"] == 0
    assert len(stored(spark, table)) == 6


def test_repeating_a_load_replaces_it(spark, write, tmp_path):
    table = str(tmp_path / "events")
    twin = [envelope(event(None, named("a")), event(None, named("a")), event("b", named("c")))]
    for _ in range(2):
        assert store.ingest_jsonl(spark, write(twin), table, load_id="one")["rows_written"] == 3
    assert store.read_events(spark, table).count() == 3


def test_rows_without_id_are_all_kept(spark, write, tmp_path):
    table = str(tmp_path / "events")
    lines = [envelope(event(None, named("a")), event(None, named("a")))]
    assert store.ingest_jsonl(spark, write(lines), table)["rows_written"] == 2
    lines += [envelope(event("twice", named("b")), event("twice", named("c")))]
    assert store.ingest_jsonl(spark, write(lines), table)["rows_written"] == 3
    assert store.ingest_jsonl(spark, write(lines), table)["rows_written"] == 2


def test_incomplete_rows_do_not_claim_their_id(spark, write, tmp_path):
    table = str(tmp_path / "events")
    lines = [envelope(event("x", named("first"), None)), envelope(event("x", named("second"), 5))]
    store.ingest_jsonl(spark, write(lines), table)
    assert stored(spark, table)["x"].event_name == "second"


def test_hot_id_collapses_to_its_first_row(spark, write, tmp_path):
    table = str(tmp_path / "events")
    lines = [envelope(event("hot", named("a", cost_usd=i)), event(f"n{i}", named("b"))) for i in range(500)]
    figures = store.ingest_jsonl(spark, write(lines), table)
    assert figures["rows_written"] == 501
    assert stored(spark, table)["hot"].cost_usd == 0.0


def test_nothing_to_load(spark, write, tmp_path):
    table = str(tmp_path / "events")
    figures = store.ingest_jsonl(spark, write(["", "{bad"]), table)
    assert figures == {
        "lines_processed": 2,
        "events_inserted": 0,
        "events_skipped": 1,
        "rows_written": 0,
    }


@pytest.mark.parametrize("limit, lines", [(2, 2), (0, 9), (None, 9)])
def test_line_limit(spark, write, tmp_path, limit, lines):
    figures = store.ingest_jsonl(spark, write(EDGE_LINES), str(tmp_path / "events"), limit=limit)
    assert figures["lines_processed"] == lines


def test_value_types(spark, write, tmp_path):
    table = str(tmp_path / "events")
    messages = {
        "numbers": '{"attributes": {"event.name": "n", "input_tokens": 12.7, "output_tokens": true,'
        ' "duration_ms": " 12 ", "cost_usd": NaN}}',
        "infinite": '{"attributes": {"event.name": "n", "cost_usd": "Infinity"}}',
        "repeated": '{"attributes": {"event.name": "a", "event.name": "b.c"}}',
        "dotted": '{"body": "x.y.z"}',
        "numeric text": '{"attributes": {"event.name": "n", "session.id": 5}}',
        "garbage time": '{"attributes": {"event.name": "n", "event.timestamp": "soon"}}',
    }
    refused = {
        "list": "[1]",
        "text": '"s"',
        "number for attributes": '{"attributes": 5}',
        "list for resource": '{"attributes": {"event.name": "a"}, "resource": [1]}',
        "number for name": '{"body": 7}',
        "null name": '{"body": null}',
    }
    lines = [envelope(*[event(k, m) for k, m in {**messages, **refused}.items()])]
    figures = store.ingest_jsonl(spark, write(lines), table)
    assert figures["events_skipped"] == len(refused)
    rows = stored(spark, table)
    assert set(rows) == set(messages)
    n = rows["numbers"]
    assert (n.input_tokens, n.output_tokens, n.duration_ms, n.cost_usd) == (12, 1, 12, None)
    assert rows["infinite"].cost_usd is None
    assert rows["repeated"].event_name == "c"
    assert rows["dotted"].event_name == "z"
    assert rows["numeric text"].session_id == "5"
    assert rows["garbage time"].event_timestamp == "soon" and rows["garbage time"].event_ts is None


def test_employee_files_are_read_in_splits(spark, tmp_path):
    """Only a file whose quoted cells may hold line breaks is read whole."""
    head = "\ufeffemail,full_name,practice,level,location\n"
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text(head + "".join(f'u{i % 900}@x,"N ""{i}"", B",P,L{i},\n' for i in range(4000)))
    broken.write_text(head + "".join(f'b{i}@x,"N\n{i}",P,L,C\n' for i in range(300)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert employees.read_csv(spark, str(plain)).rdd.getNumPartitions() > 4
        rows = employees.read_csv(spark, [str(plain), str(broken)])
        assert rows.count() == 4300
        last = {r["email"]: r for r in employees.latest(rows).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(last) == 1200 and last["b7@x"]["full_name"] == "N\n7"
    for i in range(3100, 4000):
        assert (last[f"u{i % 900}@x"]["full_name"], last[f"u{i % 900}@x"]["level"]) == (f'N "{i}", B', f"L{i}")


def test_employees_upsert(spark, tmp_path):
    table = str(tmp_path / "employees")
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text(
        "email,full_name,practice,level,location\n"
        " a@x ,Ann,,L1,Berlin\na@x,Ann2,,L2,Paris\n\n"
        'c@x,"Cy, ""Jr""",Data,,\n',
        encoding="utf-8-sig",
    )
    second.write_text("level,email\nL9,a@x\n")
    assert employees.ingest_csv(spark, str(first), table) == {"rows_inserted": 3}
    rows = {r.email: r for r in employees.read_employees(spark, table).collect()}
    assert set(rows) == {"a@x", "c@x"}
    assert tuple(rows["a@x"]) == ("a@x", "Ann2", "", "L2", "Paris")
    assert tuple(rows["c@x"]) == ("c@x", 'Cy, "Jr"', "Data", "", "")
    assert employees.ingest_csv(spark, str(second), table) == {"rows_inserted": 1}
    rows = {r.email: r for r in employees.read_employees(spark, table).collect()}
    assert tuple(rows["a@x"]) == ("a@x", "", "", "L9", "")
    assert rows["c@x"].practice == "Data"


def test_rendered_logs_are_compressed_files_of_bounded_length(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from usagelens.sources import driver_tables

    monkeypatch.setattr(driver_tables, "LINES_PER_FILE", 100, raising=False)
    rows = spark.range(0, 4000, 1, 2).select(
        F.col("id").alias("event_id"),
        F.expr("timestamp_seconds(1700000000 + id)").alias("ts"),
        (F.col("id") % 9).alias("user_id"),
        F.lit("purchase").alias("event_type"),
        F.lit(0.5).alias("value"),
        F.lit('{"k": 6}').alias("props"),
    )
    rows.unionByName(rows.limit(1)).write.parquet(f"{tmp_path}/events.parquet")
    users = spark.range(5).select(F.col("id").alias("c_custkey"), F.lit("team").alias("c_mktsegment"))
    users.write.parquet(f"{tmp_path}/customer.parquet")
    first, again = driver_tables.write_logs(spark, str(tmp_path), str(tmp_path / "logs"))
    staged = envelopes.stage(envelopes.read_lines(spark, [first, again])).where(envelopes.storable())
    events = staged.select("id", "cost_usd", "user_practice", "event_ts")
    normal = driver_tables.events(spark, str(tmp_path)).select(events.columns)
    sent = normal.where(F.col("id").cast("long") >= 0)
    resent = sent.where("floor(cast(id AS long) / 4) % 30 = 7").withColumn("cost_usd", F.lit(9999.0))
    want = sent.unionByName(resent)
    assert events.exceptAll(want).count() == want.exceptAll(events).count() == 0
    files = spark.read.text(first).groupBy(F.col("_metadata.file_path")).count().collect()
    assert all(r[0].endswith(".gz") and r[1] <= 100 for r in files)
