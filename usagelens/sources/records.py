"""Results as JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _clean(df: DataFrame) -> DataFrame:
    """NaN has no JSON form and becomes null."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row in the text column ``value``; nulls are kept as null."""
    return _clean(df).select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    )


def write_records(df: DataFrame, path: str) -> None:
    """Write one JSON object per line."""
    _clean(df).write.option("ignoreNullFields", "false").json(path)


def dated(forecast: DataFrame) -> DataFrame:
    """A forecast with its date as ``yyyy-MM-dd`` text."""
    return forecast.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def forecast_document(forecast: DataFrame, fit: DataFrame) -> DataFrame:
    """A forecast and its fit as one JSON document ``{"meta": …, "data": […]}``.

    The rows gathered are calendar days, so their number does not grow with the events.
    """
    rows = _clean(dated(forecast))
    value = rows.columns[1]
    ordered = F.sort_array(F.collect_list(F.struct("date", value, "type"))).alias("data")
    one = fit.select(F.struct("*")).scalar()
    gathered = rows.agg(ordered).withColumn("fit", one)
    meta = F.struct(*[F.col(f"fit.{c}").alias(c) for c in fit.columns])
    document = F.struct(meta.alias("meta"), "data")
    return gathered.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))
