"""Continuous ingest and live reports with Structured Streaming.

Lines are parsed and stored by the very functions of the batch load. No row is ever
late: whatever its event time, it is stored and counted in its period. A watermark
can be given to bound the state of a live report, at the price of dropping rows
that arrive later than it allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter, StreamingQuery

from usagelens.functions.columns import API_REQUEST, is_event
from usagelens.operators.sessions import running_profiles
from usagelens.operators.usage import PERIOD_COLUMNS, period_label, period_sums
from usagelens.schema import PARSED_COLUMNS
from usagelens.session import configure
from usagelens.sources import envelopes, snapshots, store


def _reader(spark: SparkSession, files_per_batch: int | None) -> DataStreamReader:
    reader = configure(spark).readStream
    return reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader


def _started(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    timing = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**timing).start()


def stream_lines(spark: SparkSession, source: str, files_per_batch: int | None = None) -> DataFrame:
    """New log files under ``source`` as a stream of lines."""
    return _reader(spark, files_per_batch).text(source).select("value", "_metadata")


def ingest_stream(
    lines: DataFrame,
    table: str,
    checkpoint: str,
    name: str = "stream",
    every: str | None = None,
) -> StreamingQuery:
    """Append each micro-batch to the event table.

    A batch is stored as the load ``<name>-<batch>``. When a batch is run again after
    a failure it replaces what its first run wrote, and ids already stored by other
    loads are skipped, so every id is stored once. Each batch reads the lists of id hashes
    of the table, a few bytes an id; see ``ingest_stream_with_state`` for tables too large
    for that. Batches are folded into larger parts as they come. Without ``every`` the
    query stops when the files at hand are done.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        store.append_lines(
            envelopes.with_place(batch), table, f"{name}-{batch_id:09d}", flat=True
        )
        _tidy(batch.sparkSession, table)

    writer = lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return _started(writer, every)


def ingest_stream_with_state(
    lines: DataFrame,
    table: str,
    checkpoint: str,
    name: str = "stream",
    every: str | None = None,
    delay: str | None = None,
) -> StreamingQuery:
    """Append the events of a stream that alone fills its table.

    Seen ids are kept as stream state instead of being looked up in the table, so the
    work of a batch depends on the batch only. Of copies that come in the same batch
    any one may be stored. With a ``delay`` ids are forgotten after that time.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        store.write_load(batch, table, f"{name}-{batch_id:09d}", flat=True)
        _tidy(batch.sparkSession, table)

    writer = (
        once_per_id(parsed_stream(lines, delay), bounded=delay is not None)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
    )
    return _started(writer, every)


def _tidy(spark: SparkSession, table: str) -> None:
    """Fold parts when enough of a level have come, and drop what was replaced long ago."""
    if snapshots.due(snapshots.current(spark, table)):
        store.compact(spark, table)
        store.vacuum(spark, table)


def parsed_stream(lines: DataFrame, delay: str | None = None) -> DataFrame:
    """Complete events of a stream of lines, for live reports; malformed input drops out.

    ``delay`` sets the watermark that bounds the state of everything built on it.
    """
    placed = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.lit(0).cast("bigint").alias("line_no"),
    )
    staged = envelopes.stage(placed).where(envelopes.storable()).select(PARSED_COLUMNS)
    return staged.withWatermark("event_ts", delay) if delay else staged


def once_per_id(events: DataFrame, bounded: bool = False) -> DataFrame:
    """Drop repeated ids of a stream; events without an id all stay.

    Exact by default, with one state row per id ever seen. ``bounded`` keeps ids only
    as long as the watermark of the stream, so a copy that comes later counts again.
    """
    keyed = events.withColumn("_key", F.coalesce("id", F.uuid()))
    once = keyed.dropDuplicatesWithinWatermark if bounded else keyed.dropDuplicates
    return once(["_key"]).drop("_key")


def live_cost(events: DataFrame, granularity: str = "hour", bounded: bool = False) -> DataFrame:
    """Cost, tokens and calls per hour or day of a stream of events.

    Events whose timestamp text cannot be read share one NULL period, as in the batch
    report. ``bounded`` closes a period when the watermark of the stream passes it; events
    without a readable time belong to no period then and are left out.
    """
    unit = "hour" if granularity == "hour" else "day"
    asked = events.where(is_event(API_REQUEST) & F.col("event_timestamp").isNotNull())
    if bounded:
        timed = asked.where(F.col("event_ts").isNotNull())
        periods = timed.groupBy(F.window("event_ts", f"1 {unit}").alias("w"))
        return periods.agg(*period_sums()).select(
            period_label(F.col("w.start"), unit), *PERIOD_COLUMNS
        )
    periods = asked.groupBy(F.date_trunc(unit, "event_ts").alias("start"))
    return periods.agg(*period_sums()).select(period_label(F.col("start"), unit), *PERIOD_COLUMNS)


def live_sessions(events: DataFrame) -> DataFrame:
    """Running profile of every session of a stream, one state row per session."""
    return running_profiles(events)


def keep_changes(
    report: DataFrame, path: str, checkpoint: str, *keys: str, every: str | None = None
) -> StreamingQuery:
    """Write the rows of a live report that each micro-batch changed.

    A batch becomes visible in one step, and a batch that is run again replaces what its
    first run wrote. Batches are folded: of the rows of a key (``keys``) only the newest
    stays, so ``latest`` reads about as many rows as there are keys, and the newest batches.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base, load = snapshots.current(spark, path), f"{batch_id:09d}"
        part = snapshots.Part(snapshots.new_name("batch"), (load,), rows=1)
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.parquet(_changes(path, part))
        others = tuple(p for p in base.parts if p.loads != (load,))
        snapshots.commit(spark, path, base, (*others, part))
        fold_changes(spark, path, report.schema, *keys)

    writer = (
        report.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
    )
    return _started(writer, every)


def _changes(path: str, part: snapshots.Part) -> str:
    return f"{path}/rows/part={part.name}"


def _newest(
    spark: SparkSession, path: str, schema: T.StructType, parts: list[snapshots.Part], *keys: str
) -> DataFrame:
    """The newest row of each key in some parts, and its batch."""
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(stored).parquet(*[_changes(path, p) for p in parts])
    newest = F.max_by(F.struct(*stored.names), "batch").alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(newest).select("row.*")


def fold_changes(
    spark: SparkSession, path: str, schema: T.StructType, *keys: str, fan_out: int = snapshots.FAN_OUT
) -> None:
    """Fold the changes of many batches into the newest row of each key; drop what is old."""

    def write(parts: list[snapshots.Part], name: str) -> int:
        rows = _newest(spark, path, schema, parts, *keys)
        rows.write.parquet(f"{path}/rows/part={name}")
        return 1

    before = snapshots.current(spark, path)
    if snapshots.fold(spark, path, write, fan_out) != before:
        snapshots.vacuum(spark, path, ["rows"], store.KEEP_SECONDS)


def latest(spark: SparkSession, path: str, schema: T.StructType, *keys: str) -> DataFrame:
    """The current rows of a live report: the newest one of each key."""
    parts = list(snapshots.current(spark, path).parts)
    if not parts:
        return spark.createDataFrame([], schema)
    return _newest(spark, path, schema, parts, *keys).select(schema.names)
