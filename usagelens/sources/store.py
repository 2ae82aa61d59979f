"""The stored event table: partitioned Parquet under a log of snapshots, loaded idempotently.

A load parses its lines once, into a folder of its own that no reader sees yet. Figures and
ids come from that folder; if no id repeats and none is stored already, it becomes part
of the table as it is. Beside the rows each part keeps a sorted list of 48-bit hashes of its
ids by day, which delta coding packs into a few bytes an id. A load joins its ids with these
lists, and only the days of the parts where a hash occurs are opened for the exact join.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from usagelens import schema
from usagelens.operators.rollups import ROLLUPS, Rollup
from usagelens.session import configure, scratch_path
from usagelens.sources import envelopes, snapshots
from usagelens.sources.snapshots import Part

_STORED = T.StructType(
    [f for f in schema.EVENTS if f.name != "event_name"] + list(schema.PARTITIONS)
)
_DRAFT = T.StructType(
    [
        *[f for f in schema.EVENTS if f.name != "event_name"],
        T.StructField("load_id", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("bad_line", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        *[f for f in schema.PARTITIONS if f.name in ("event_name", "event_date")],
    ]
)
_IDS = "hash long, event_date date, part string"
#: Folders of a table besides the log; rollups have one folder more for each name.
_ROWS, _ID_LISTS, _ROLLUPS = "rows", "ids", "rollups"
#: How long replaced folders stay for readers of older snapshots.
KEEP_SECONDS = 24 * 3600.0


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as of now. Filters on event_name and event_date prune its folders."""
    return _rows(spark, path, snapshots.current(spark, path).parts)


def _accepted() -> Column:
    """Rows of a draft that belong in the table."""
    return F.col("kind") == "event"


def _folder(path: str, part: str, sub: str = _ROWS) -> str:
    return f"{path}/{sub}/part={part}"


def _rows(spark: SparkSession, path: str, parts: tuple[Part, ...]) -> DataFrame:
    """The rows of some parts: one scan of those in folders by column, one of flat ones."""
    scans = []
    for flat in (False, True):
        folders = [f"{_folder(path, p.name)}/kind=event" for p in parts if p.rows and p.flat == flat]
        if folders:
            reader = spark.read.schema(_STORED).option("basePath", f"{path}/{_ROWS}")
            scans.append(reader.parquet(*folders).select(_STORED.names))
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], _STORED)


def ensure_table(spark: SparkSession, path: str) -> DataFrame:
    """The event table, created empty if it is absent."""
    if not snapshots.current(spark, path).version:
        snapshots.commit(spark, path, snapshots.Snapshot(), ())
    return read_events(spark, path)


def id_hash(name: str = "id") -> Column:
    return F.shiftrightunsigned(F.xxhash64(name), 16).alias("hash")


def _write_rows(
    rows: DataFrame, folder: str, *more: str, flat: bool = False, in_place: bool = False
) -> None:
    """Write rows with a ``kind``, in folders by event name and day unless ``flat``.

    The rebalance hint lets adaptive execution split large and merge small
    partitions, so a hot event type or day becomes several files of even size. Rows that are
    read from files of a fair size need no shuffle to be written flat, ``in_place``.
    """
    stored = [c for c in _STORED.names if c != "part"]
    by = ("kind",) if flat else ("kind", "event_name", "event_date")
    chosen = rows.select(*stored, *more, "kind")
    even = chosen if in_place else chosen.hint("rebalance", *by)
    even.write.partitionBy(*by).parquet(folder)


def _stamped(rows: DataFrame, load_id: str) -> DataFrame:
    return rows.withColumns(
        {
            "ingested_at": F.current_timestamp(),
            "event_date": F.to_date("event_ts"),
            "load_id": F.lit(load_id),
        }
    )


def _write_ids(lists: DataFrame, folder: str) -> None:
    """A sorted list of hashes; the options select delta coding for them."""
    (
        lists.select("hash", "event_date")
        .hint("rebalance")
        .sortWithinPartitions("hash")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .parquet(folder)
    )


def _list_ids(spark: SparkSession, path: str, part: Part) -> None:
    rows = _rows(spark, path, (part,)).where(F.col("id").isNotNull())
    _write_ids(rows.select(id_hash(), "event_date"), _folder(path, part.name, _ID_LISTS))


def _id_lists(spark: SparkSession, path: str, parts: tuple[Part, ...]) -> DataFrame:
    reader = spark.read.schema(_IDS).option("basePath", f"{path}/{_ID_LISTS}")
    return reader.parquet(*[_folder(path, p.name, _ID_LISTS) for p in parts])


def suspects(spark: SparkSession, path: str, parts: tuple[Part, ...], ids: DataFrame) -> dict[str, list]:
    """The parts, and their days, that may hold one of ``ids``: as a rule those that do.

    Two different ids share a hash with probability 2^-48. One row per part and day is
    collected at most.
    """
    parts = tuple(p for p in parts if p.rows)
    if not parts:
        return {}
    lists = _id_lists(spark, path, parts)
    hits = lists.join(ids.select(id_hash()), "hash", "left_semi").select("part", "event_date")
    found: dict[str, list] = {}
    for row in hits.distinct().collect():
        found.setdefault(row["part"], []).append(row["event_date"])
    return found


def _known(spark: SparkSession, path: str, parts: tuple[Part, ...], hits: dict[str, list], ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that the suspected days hold; other files are not opened."""
    rows = _rows(spark, path, tuple(p for p in parts if p.name in hits))
    within = F.lit(False)
    for part, days in hits.items():
        dated = F.col("event_date").isin([d for d in days if d is not None])
        day = dated | F.col("event_date").isNull() if None in days else dated
        within = within | ((F.col("part") == part) & day)
    return rows.where(within).select("id").join(ids, "id", "left_semi")


def _first_rows(draft: DataFrame, fresh: DataFrame) -> DataFrame:
    """The first row of each id of ``fresh``; copies collapse before they are shuffled."""
    kept = [c for c in _DRAFT.names if c != "id"]
    first = F.min_by(F.struct(*kept), F.struct(*[F.col(c) for c in envelopes.ORDER]))
    rows = draft.join(fresh, "id", "left_semi").groupBy("id").agg(first.alias("row"))
    return rows.select("id", "row.*").select(_DRAFT.names)


def _without_contested(
    draft: DataFrame, ids: DataFrame, known: DataFrame | None
) -> DataFrame:
    """The draft's rows: none of known ids, the first one of repeated ids."""
    contested = ids.where(F.col("copies") > 1).select("id")
    fresh = contested
    if known is not None:
        fresh = contested.join(known, "id", "left_anti")
        contested = contested.unionByName(known).distinct()
    once = draft.join(contested, "id", "left_anti").select(_DRAFT.names)
    return once.unionByName(_first_rows(draft, fresh))


def _replaced(
    spark: SparkSession, path: str, base: snapshots.Snapshot, load_id: str
) -> tuple[Part, ...]:
    """The table's parts without what an earlier attempt of the load wrote."""
    out = []
    for part in base.parts:
        if load_id not in part.loads:
            out.append(part)
        elif part.loads != (load_id,):
            rows = _rows(spark, path, (part,)).where(F.col("load_id") != load_id)
            name = snapshots.new_name("fold")
            _write_rows(rows.withColumn("kind", F.lit("event")), _folder(path, name))
            loads = tuple(x for x in part.loads if x != load_id)
            out.append(_counted(spark, path, Part(name, loads, part.level)))
            _list_ids(spark, path, out[-1])
    return tuple(out)


def _counted(spark: SparkSession, path: str, part: Part) -> Part:
    """The part with its number of rows, which the files' footers give."""
    folder = _folder(path, part.name)
    whole = spark.read.schema(_DRAFT).parquet(folder)
    return replace(part, rows=whole.where(_accepted()).count())


def write_load(rows: DataFrame, path: str, load_id: str, flat: bool = False) -> None:
    """Write parsed events as one load. Repeating a load replaces what its earlier attempt wrote.

    A small load is better written ``flat``, as a few files; it gets folders by event
    name and day when it is folded with others.
    """
    spark = rows.sparkSession
    base = snapshots.current(spark, path)
    part = Part(snapshots.new_name("load"), (load_id,), flat=flat)
    events = _stamped(rows, load_id).withColumn("kind", F.lit("event"))
    _write_rows(events, _folder(path, part.name), flat=flat)
    part = _counted(spark, path, part)
    _list_ids(spark, path, part)
    snapshots.commit(spark, path, base, (*_replaced(spark, path, base, load_id), part))


def parsed(lines: DataFrame, load_id: str) -> DataFrame:
    """The rows of a draft: events that can be stored, and the marks of everything else."""
    kind = F.when(envelopes.storable(), "event").otherwise("other")
    staged = envelopes.stage(lines).withColumn("kind", kind)
    return _stamped(staged, load_id).withColumn(
        "raw_message", F.when(F.col("kind") == "event", F.col("raw_message"))
    )


def append_lines(lines: DataFrame, path: str, load_id: str, flat: bool = False) -> dict[str, int]:
    """Parse lines and add their new events to the table; returns the load figures.

    ``events_inserted`` counts readable events, ``rows_written`` those that were
    new and complete. The table changes in one step at the end; an attempt that fails
    before leaves folders that nobody reads, which ``vacuum`` removes.
    """
    spark = lines.sparkSession
    configure(spark)
    base = snapshots.current(spark, path)
    name = snapshots.new_name("load")
    marks = [c for c in _DRAFT.names if c not in (*_STORED.names, "kind")]
    _write_rows(parsed(lines, load_id), _folder(path, name), *marks, flat=flat, in_place=flat)
    draft = spark.read.schema(_DRAFT).parquet(_folder(path, name))

    scratch = scratch_path(spark, "tallies")
    envelopes.tallies(draft, _accepted()).write.partitionBy("kind").parquet(scratch)
    tallies = spark.read.schema("id string, copies long, kind string").parquet(scratch)
    ids = tallies.where(F.col("kind") == "id").select("id", "copies")
    # Figures as they are; of the ids, how many repeat.
    counted = F.when(F.col("kind") == "id", (F.col("copies") > 1).cast("long")).otherwise(F.col("copies"))
    totals = {r["kind"]: r["n"] for r in tallies.groupBy("kind").agg(F.sum(counted).alias("n")).collect()}
    figures = {k: totals.get(k, 0) for k in envelopes.figures()}
    part = Part(name, (load_id,), rows=totals.get("rows", 0), flat=flat)

    others = _replaced(spark, path, base, load_id)
    hits = suspects(spark, path, others, ids)
    if totals.get("id", 0) or hits:
        known = _known(spark, path, others, hits, ids) if hits else None
        clean = _without_contested(draft.where(_accepted()), ids, known)
        part = Part(snapshots.new_name("load"), (load_id,), flat=flat)
        _write_rows(clean, _folder(path, part.name), flat=flat)
        part = _counted(spark, path, part)
        snapshots.drop(spark, _folder(path, name))
    _list_ids(spark, path, part)
    snapshots.commit(spark, path, base, (*others, part))
    snapshots.drop(spark, scratch)
    return {**figures, "rows_written": part.rows}


def compact(spark: SparkSession, path: str, fan_out: int = snapshots.FAN_OUT) -> None:
    """Fold small parts into larger ones, with their lists of ids and their rollups."""

    def write(parts: list[Part], name: str) -> int:
        rows = _rows(spark, path, tuple(parts)).withColumn("kind", F.lit("event"))
        _write_rows(rows, _folder(path, name))
        _write_ids(_id_lists(spark, path, tuple(parts)), _folder(path, name, _ID_LISTS))
        for rollup in ROLLUPS.values():
            if {p.name for p in parts} <= _rolled(spark, path, rollup):
                merged = rollup.merge(_partials(spark, path, rollup, parts))
                merged.write.parquet(f"{_rollup_folder(path, rollup)}/part={name}")
        return sum(p.rows for p in parts)

    snapshots.fold(spark, path, write, fan_out)


def vacuum(spark: SparkSession, path: str, keep_seconds: float = KEEP_SECONDS) -> None:
    """Remove folders and snapshots that were replaced longer ago."""
    rollups = [f"{_ROLLUPS}/{name}" for name in ROLLUPS]
    snapshots.vacuum(spark, path, [_ROWS, _ID_LISTS, *rollups], keep_seconds)


def ingest_jsonl(
    spark: SparkSession,
    source: str | list[str],
    path: str,
    limit: int | None = None,
    load_id: str | None = None,
) -> dict[str, int]:
    """Load raw log files into the event table at ``path``.

    The first row of an id wins, within the load and against the table. Pass a
    ``load_id`` to make a repeated attempt replace the first one.
    """
    lines = envelopes.read_lines(configure(spark), source, limit)
    return append_lines(lines, path, load_id or uuid.uuid4().hex)


# --- reports kept as partial aggregates ---------------------------------------


def _rollup_folder(path: str, rollup: Rollup) -> str:
    return f"{path}/{_ROLLUPS}/{rollup.name}"


def _rolled(spark: SparkSession, path: str, rollup: Rollup) -> set[str]:
    """Parts whose partial aggregates are complete."""
    folder = _rollup_folder(path, rollup)
    names = snapshots.written_names(spark, folder)
    return {n for n in names if snapshots.complete(spark, f"{folder}/part={n}")}


def _partials(spark: SparkSession, path: str, rollup: Rollup, parts: list[Part]) -> DataFrame:
    folder = _rollup_folder(path, rollup)
    reader = spark.read.schema(rollup.schema(spark)).option("basePath", folder)
    return reader.parquet(*[f"{folder}/part={p.name}" for p in parts]).drop("part")


def refresh(spark: SparkSession, path: str, rollup: Rollup) -> list[Part]:
    """Write the partial aggregates of parts that have none yet; earlier parts are not read again."""
    parts = [p for p in snapshots.current(spark, path).parts if p.rows]
    done = _rolled(spark, path, rollup)
    for part in parts:
        if part.name not in done:
            rows = rollup.partial(_rows(spark, path, (part,)))
            target = f"{_rollup_folder(path, rollup)}/part={part.name}"
            rows.write.mode("overwrite").parquet(target)
    return parts


def rolled_up(spark: SparkSession, path: str, rollup: Rollup) -> DataFrame:
    """One row of summed parts per key over the whole table, for ``rollup``'s reports.

    Reads the partial aggregates of all parts and the events of new parts only.
    """
    parts = refresh(spark, path, rollup)
    if not parts:
        return spark.createDataFrame([], rollup.schema(spark))
    return rollup.merge(_partials(spark, path, rollup, parts))
