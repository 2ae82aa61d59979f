"""Cost, token, model, cache and error reports over the event table.

Every report is one partial and one final hash aggregate: a hot practice, model
or hour is combined before the shuffle, and only the columns named here are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.columns import (
    API_ERROR,
    API_REQUEST,
    PERIOD_FORMATS,
    USER_PROMPT,
    is_event,
    money_avg,
    money_parts,
    money_sum,
    money_total,
    percent,
    rounded,
    token_parts,
    token_sum,
    token_total,
    weekday_name,
    weekday_number,
    whole_sum,
)


def kpi_summary(events: DataFrame) -> DataFrame:
    """One row of headline figures.

    Events are summed per (session, user, practice) in one pass, and the three distinct
    counts are taken of the few rows left.
    """
    cost = F.col("cost_usd")
    parts = events.groupBy("session_id", "user_id", "user_practice").agg(
        *money_parts(cost),
        *token_parts(),
        F.count_if(is_event(API_REQUEST)).alias("calls"),
        F.count_if(is_event(USER_PROMPT)).alias("prompts"),
    )
    return parts.agg(
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct("user_practice").alias("total_practices"),
        F.coalesce(money_total(), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(token_total(), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("total_api_calls"),
        F.coalesce(F.sum("prompts"), F.lit(0)).alias("total_prompts"),
    )


def token_usage_by_practice(events: DataFrame) -> DataFrame:
    cost = F.col("cost_usd")
    return (
        events.where(is_event(API_REQUEST) & F.col("user_practice").isNotNull())
        .groupBy("user_practice")
        .agg(
            F.count("*").alias("api_calls"),
            whole_sum(F.col("input_tokens")).alias("input_tokens"),
            whole_sum(F.col("output_tokens")).alias("output_tokens"),
            whole_sum(F.col("cache_read_tokens")).alias("cache_read_tokens"),
            token_sum().alias("total_tokens"),
            rounded(money_sum(cost), 4).alias("total_cost_usd"),
            F.round(money_avg(cost), 6).alias("avg_cost_per_call"),
        )
        .orderBy(F.desc("total_cost_usd"), "user_practice")
    )


def token_usage_by_model(events: DataFrame) -> DataFrame:
    return (
        events.where(is_event(API_REQUEST) & F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            F.count("*").alias("api_calls"),
            token_sum().alias("total_tokens"),
            rounded(money_sum(F.col("cost_usd")), 4).alias("total_cost_usd"),
            F.round(F.avg("duration_ms"), 0).alias("avg_duration_ms"),
        )
        .orderBy(F.desc("total_cost_usd"), "model")
    )


PERIOD_COLUMNS = ("cost_usd", "total_tokens", "api_calls")


def period_sums() -> list[Column]:
    """Sums of one period, for batches and streams."""
    return [
        rounded(money_sum(F.col("cost_usd")), 6).alias("cost_usd"),
        token_sum().alias("total_tokens"),
        F.count("*").alias("api_calls"),
    ]


def period_label(start: Column, unit: str) -> Column:
    return F.date_format(start, PERIOD_FORMATS[unit]).alias("period")


def cost_over_time(events: DataFrame, granularity: str = "hour") -> DataFrame:
    """Cost, tokens and calls per hour, or per day for any other granularity.

    Grouping is on the truncated instant; the label is written once per period.
    Events whose timestamp text cannot be read share one NULL period.
    """
    unit = "hour" if granularity == "hour" else "day"
    return (
        events.where(is_event(API_REQUEST) & F.col("event_timestamp").isNotNull())
        .groupBy(F.date_trunc(unit, "event_ts").alias("start"))
        .agg(*period_sums())
        .select(period_label(F.col("start"), unit), *PERIOD_COLUMNS)
        .orderBy("period")
    )


def peak_usage_by_hour(events: DataFrame) -> DataFrame:
    """Events of every type and their cost per hour of the day."""
    return (
        events.where(F.col("event_timestamp").isNotNull())
        .groupBy(F.hour("event_ts").alias("hour_of_day"))
        .agg(
            F.count("*").alias("event_count"),
            rounded(money_sum(F.col("cost_usd")), 4).alias("cost_usd"),
        )
        .orderBy("hour_of_day")
    )


def peak_usage_by_weekday(events: DataFrame) -> DataFrame:
    """Events of every type and their cost per weekday, Sunday first."""
    return (
        events.where(F.col("event_timestamp").isNotNull())
        .groupBy(F.dayofweek("event_ts").alias("day"))
        .agg(
            F.count("*").alias("event_count"),
            rounded(money_sum(F.col("cost_usd")), 4).alias("cost_usd"),
        )
        .select(
            weekday_name(F.col("day")).alias("weekday"),
            weekday_number(F.col("day")).alias("weekday_num"),
            "event_count",
            "cost_usd",
        )
        .orderBy("weekday_num")
    )


def cost_efficiency_by_model(events: DataFrame) -> DataFrame:
    """Tokens per dollar and dollars per thousand tokens, from the rounded cost."""
    cost, count = F.col("total_cost_usd"), F.col("total_tokens")
    per_dollar = F.bround(count / cost, 0).cast("bigint")
    per_thousand = F.bround(cost / count * 1000, 6)
    return (
        events.where(
            is_event(API_REQUEST) & F.col("model").isNotNull() & (F.col("cost_usd") > 0)
        )
        .groupBy("model")
        .agg(
            F.count("*").alias("api_calls"),
            token_sum().alias("total_tokens"),
            rounded(money_sum(F.col("cost_usd")), 6).alias("total_cost_usd"),
            F.round(F.avg("duration_ms"), 0).alias("avg_latency_ms"),
        )
        .withColumns(
            {
                "tokens_per_dollar": F.coalesce(F.when(cost > 0, per_dollar), F.lit(0)),
                "cost_per_1k_tokens": F.coalesce(F.when(count > 0, per_thousand), F.lit(0.0)),
            }
        )
        .orderBy(F.desc("total_cost_usd"), "model")
    )


def cache_efficiency(events: DataFrame) -> DataFrame:
    """Cache reads as a share of input tokens; NULL without input, may exceed 100."""
    reads = F.coalesce(whole_sum(F.col("cache_read_tokens")), F.lit(0))
    return (
        events.where(is_event(API_REQUEST) & F.col("user_practice").isNotNull())
        .groupBy("user_practice")
        .agg(
            whole_sum(F.col("input_tokens")).alias("total_input_tokens"),
            reads.alias("cache_read_tokens"),
            F.coalesce(whole_sum(F.col("cache_creation_tokens")), F.lit(0)).alias("cache_creation_tokens"),
            percent(reads, whole_sum(F.col("input_tokens")), 2).alias("cache_hit_rate_pct"),
        )
        .orderBy(F.desc("cache_hit_rate_pct"), "user_practice")
    )


def api_error_analysis(events: DataFrame) -> DataFrame:
    """Error rate per practice and model, for groups of more than five events."""
    requests, errors = F.col("api_requests"), F.col("api_errors")
    return (
        events.where(
            F.col("event_name").isin(API_REQUEST, API_ERROR)
            & F.col("user_practice").isNotNull()
        )
        .groupBy("user_practice", "model")
        .agg(
            F.count_if(is_event(API_REQUEST)).alias("api_requests"),
            F.count_if(is_event(API_ERROR)).alias("api_errors"),
        )
        .where(requests + errors > 5)
        .withColumn("error_rate_pct", percent(errors, requests + errors, 2))
        .orderBy(F.desc("error_rate_pct"), "user_practice", "model")
    )
