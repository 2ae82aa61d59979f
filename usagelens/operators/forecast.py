"""Straight-line forecasts of daily cost and tokens.

After the daily aggregate there is one row per calendar day, so the window over
all days and the one-row fit are bounded by the calendar, not by the events. The
fit, the forecast and the actual days come from a single scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.functions.columns import API_REQUEST, is_event, money_sum, token_sum

MIN_DAYS = 3


def _daily(events: DataFrame, kept: Column, total: Column) -> DataFrame:
    """Total per day with its day number; days without events stay out."""
    start = F.min("date").over(Window.partitionBy())
    return (
        events.where(is_event(API_REQUEST) & F.col("event_ts").isNotNull() & kept)
        .groupBy(F.to_date("event_ts").alias("date"))
        .agg(total.alias("total"))
        .withColumn("x", F.datediff("date", start).cast("double"))
        .withColumn("y", F.col("total").cast("double"))
    )


def _daily_cost(events: DataFrame) -> DataFrame:
    cost = F.col("cost_usd")
    return _daily(events, cost.isNotNull(), money_sum(cost).cast("double"))


def _daily_tokens(events: DataFrame) -> DataFrame:
    return _daily(events, F.lit(True), token_sum())


def _forecast(daily: DataFrame, name: str, days: int) -> DataFrame:
    if days < 1:
        raise ValueError("days must be at least 1")
    every = Window.partitionBy()
    fitted = daily.select(
        "date",
        "x",
        F.col("total").cast("double").alias("value"),
        F.regr_slope("y", "x").over(every).alias("slope"),
        F.regr_intercept("y", "x").over(every).alias("intercept"),
        F.count("*").over(every).alias("days"),
        F.max("date").over(every).alias("last"),
    ).where(F.col("days") >= MIN_DAYS)

    def ahead(i: Column) -> Column:
        line = F.col("intercept") + F.col("slope") * (F.col("x") + i)
        return F.struct(
            F.date_add("date", i).alias("date"),
            F.greatest(line, F.lit(0.0)).alias(name),
            F.lit("forecast").alias("type"),
        )

    actual = F.array(
        F.struct(F.col("date"), F.col("value").alias(name), F.lit("actual").alias("type"))
    )
    future = F.transform(F.sequence(F.lit(1), F.lit(days)), ahead)
    rows = F.when(F.col("date") == F.col("last"), F.concat(actual, future)).otherwise(actual)
    return fitted.select(F.explode(rows).alias("row")).select("row.*").orderBy("date")


def _fit(daily: DataFrame) -> DataFrame:
    return (
        daily.agg(
            F.round(F.regr_r2("y", "x"), 4).alias("r2"),
            F.round(F.regr_slope("y", "x"), 6).alias("slope_per_day"),
            F.round(F.regr_intercept("y", "x"), 6).alias("intercept"),
            F.count("*").alias("days"),
        )
        .where(F.col("days") >= MIN_DAYS)
        .drop("days")
    )


def cost_forecast(events: DataFrame, forecast_days: int = 7) -> DataFrame:
    """Daily cost and its continuation, never below zero; empty for fewer than three days."""
    return _forecast(_daily_cost(events), "cost_usd", forecast_days)


def cost_forecast_fit(events: DataFrame) -> DataFrame:
    """Goodness, slope and intercept of the cost line."""
    return _fit(_daily_cost(events))


def token_forecast(events: DataFrame, forecast_days: int = 7) -> DataFrame:
    """Daily tokens and their continuation; a day whose sum is NULL does not shape the line."""
    return _forecast(_daily_tokens(events), "total_tokens", forecast_days)


def token_forecast_fit(events: DataFrame) -> DataFrame:
    return _fit(_daily_tokens(events)).select("r2")
