"""The employee table: CSV scan and upsert by email."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens import schema
from usagelens.sources import snapshots
from usagelens.sources.envelopes import strip

_COLUMNS = schema.EMPLOYEES.names
_PLACE = ("priority", "file", "block", "line_no")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Employee rows by column name, stripped, with their place in the load.

    Files may order their columns differently: those that share a header are read
    together, and rows are matched by name. Absent columns and empty cells give ``''``; a
    byte-order mark and blank lines are ignored, doubled quotes inside quotes are one
    quote, and a quoted cell may hold line breaks. Only a file with a line of an odd number
    of quotes can have such a cell; any other is read in splits.
    """
    parts = [
        _read_alike(spark, row["files"], row["open_quotes"]) for row in _files(spark, path).collect()
    ]
    return reduce(DataFrame.unionByName, parts) if parts else _read_alike(spark, [], False)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files of each ``header``, apart by whether lines have ``open_quotes``."""
    line = F.regexp_replace("value", "^\ufeff", "")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(
        line.alias("line"),
        (quotes % 2 == 1).alias("open_quotes"),
        F.col("_metadata.file_path").alias("file"),
        place.alias("place"),
    )
    return (
        lines.where(F.trim("line") != "")
        .groupBy("file")
        .agg(F.min_by("line", "place").alias("header"), F.max("open_quotes").alias("open_quotes"))
        .groupBy("header", "open_quotes")
        .agg(F.sort_array(F.collect_list("file")).alias("files"))
    )


def _read_alike(spark: SparkSession, files: list[str], open_quotes: bool) -> DataFrame:
    """The rows of files that have one header."""
    if files:
        raw = spark.read.csv(files, header=True, escape='"', multiLine=open_quotes)
    else:
        raw = spark.read.schema(schema.EMPLOYEES).csv([])
    place = raw.select("*", "_metadata.file_path", "_metadata.file_block_start")

    def cell(name: str) -> Column:
        text = strip(F.col(name)) if name in raw.columns else F.lit("")
        return F.coalesce(text, F.lit("")).alias(name)

    return place.select(
        *[cell(c) for c in _COLUMNS],
        F.lit(1).alias("priority"),
        F.col("file_path").alias("file"),
        F.col("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each email; copies collapse before the shuffle."""
    return (
        rows.groupBy("email")
        .agg(F.max_by(F.struct(*_COLUMNS), F.struct(*_PLACE)).alias("row"))
        .select("row.*")
    )


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    """The employee table as of now; empty where there is none yet."""
    parts = snapshots.current(spark, path).parts
    if not parts:
        return spark.createDataFrame([], schema.EMPLOYEES)
    return spark.read.schema(schema.EMPLOYEES).parquet(*[_folder(path, p.name) for p in parts])


def _folder(path: str, part: str) -> str:
    return f"{path}/rows/part={part}"


def replace(rows: DataFrame, path: str) -> None:
    """Make ``rows`` the whole table, in one step.

    They may be computed from the table: its folder stays until ``vacuum`` removes it, and
    readers see it until the new one is complete, also if the writer fails on the way.
    """
    spark = rows.sparkSession
    base, part = snapshots.current(spark, path), snapshots.Part(snapshots.new_name("staff"), rows=1)
    rows.select(_COLUMNS).write.parquet(_folder(path, part.name))
    snapshots.commit(spark, path, base, (part,))


def vacuum(spark: SparkSession, path: str, keep_seconds: float = 24 * 3600.0) -> None:
    """Remove tables that were replaced longer ago."""
    snapshots.vacuum(spark, path, ["rows"], keep_seconds)


def ingest_csv(spark: SparkSession, source: str | list[str], path: str) -> dict[str, int]:
    """Upsert employee files into the table at ``path``; returns the number of rows read.

    Of equal emails the last row of the files counts, else the row of the table. The
    table changes in one step.
    """
    rows = read_csv(spark, source)
    old = read_employees(spark, path).select(
        "*",
        F.lit(0).alias("priority"),
        F.lit("").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("line_no"),
    )
    replace(latest(old.unionByName(rows)), path)
    return {"rows_inserted": rows.count()}
