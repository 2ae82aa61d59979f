"""What the operators of this subpackage share: tables, Arrow passes, driver-side figures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema as arrow_schema

from usagelens.session import configure

#: Rows in one Arrow batch: whole texts are long, so batches hold few of them.
BATCH_ROWS = 512
#: Parts into which the rows of one key are spread for a join.
_SPREAD = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder, with the session prepared for long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text is an empty one, other columns play no part."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def map_columns(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """Apply ``function`` to each Arrow batch, as lists or arrays by column name."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                given = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                yield record_batch(function(given), arrow)

    return df.mapInArrow(run, fields)


def record_batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_array(columns[f.name], f.type) for f in schema], schema=schema
    )


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def spread_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    by: str,
    how: str = "inner",
    into: int = _SPREAD,
    grows: bool = False,
) -> DataFrame:
    """Join in which the rows of one key in ``many`` are spread over ``into`` parts by ``by``.

    Of ``few`` there are ``into`` copies, which Spark does not see in its size: where it ``grows``
    with the input it is never broadcast.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(into - 1))).alias("part")
    copies = few.select("*", parts)
    return (
        many.withColumn("part", F.pmod(F.xxhash64(by), F.lit(into)).cast("int"))
        .join(sorted_side(copies) if grows else copies, [*keys, "part"], how)
        .drop("part")
    )


def sorted_side(rows: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and sorted whatever size Spark expects; so is the other.

    Packed files and pruned columns make a table that grows with the input look several
    times smaller than its rows are in the driver, which would build the broadcast.
    """
    return rows.hint("merge")
