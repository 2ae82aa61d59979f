"""Tool acceptance and tool result reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.columns import TOOL_DECISION, TOOL_RESULT, is_event, percent

_ACCEPTED = "accept"
_REJECTED = "reject"


def decisions(events: DataFrame) -> DataFrame:
    """Tool decisions that name a tool."""
    return events.where(is_event(TOOL_DECISION) & F.col("tool_name").isNotNull())


def accepted() -> Column:
    return F.count_if(F.col("decision") == _ACCEPTED)


def tool_usage_stats(events: DataFrame) -> DataFrame:
    return (
        decisions(events)
        .groupBy("tool_name")
        .agg(
            F.count("*").alias("total_uses"),
            accepted().alias("accepted"),
            F.count_if(F.col("decision") == _REJECTED).alias("rejected"),
            percent(accepted(), F.count("*"), 1).alias("accept_rate_pct"),
        )
        .orderBy(F.desc("total_uses"), "tool_name")
    )


def tool_accept_by_practice(events: DataFrame) -> DataFrame:
    return (
        decisions(events)
        .where(F.col("user_practice").isNotNull())
        .groupBy("user_practice", "tool_name")
        .agg(
            F.count("*").alias("uses"),
            percent(accepted(), F.count("*"), 1).alias("accept_rate_pct"),
        )
        .orderBy("user_practice", F.desc("uses"), "tool_name")
    )


def tool_result_performance(events: DataFrame) -> DataFrame:
    successes = F.count_if(F.col("success") == "true")
    return (
        events.where(is_event(TOOL_RESULT) & F.col("tool_name").isNotNull())
        .groupBy("tool_name")
        .agg(
            F.count("*").alias("executions"),
            successes.alias("successes"),
            percent(successes, F.count("*"), 1).alias("success_rate_pct"),
            F.round(F.avg("duration_ms"), 0).alias("avg_duration_ms"),
        )
        .orderBy(F.desc("executions"), "tool_name")
    )
