"""Reports by seniority, location and practice of the employee dimension.

Events are always summed per email (and session or tool) before the join, so one
row per email or less than the number of sessions meets the dimension instead of
every event. No side is broadcast by hint: the optimizer broadcasts the employee
table when its measured size is below the threshold and otherwise sort-merge
joins, splitting skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions.columns import (
    API_REQUEST,
    is_event,
    money_parts,
    money_total,
    percent,
    rounded,
    token_parts,
    token_total,
)
from usagelens.operators.tools import accepted, decisions


def _with_employee(per_email: DataFrame, employees: DataFrame, *attributes: str) -> DataFrame:
    """Inner join on the email; rows without a known employee drop out."""
    side = employees.select("email", *attributes)
    return per_email.join(side, per_email.user_email == side.email)


def _summed(events: DataFrame, *keys: str) -> DataFrame:
    cost = F.col("cost_usd")
    return (
        events.where(F.col("user_email").isNotNull())
        .groupBy("user_email", *keys)
        .agg(
            *money_parts(cost),
            F.count(cost).alias("costs"),
            *token_parts(),
            F.count_if(is_event(API_REQUEST)).alias("calls"),
        )
    )


def cost_by_level(events: DataFrame, employees: DataFrame) -> DataFrame:
    """API cost and tokens per level; levels sort as text."""
    mean = money_total() / F.nullif(F.sum("costs"), F.lit(0))
    known = employees.where(F.col("level").isNotNull())
    return (
        _with_employee(_summed(events.where(is_event(API_REQUEST)), "session_id"), known, "level")
        .groupBy("level")
        .agg(
            F.countDistinct("session_id").alias("sessions"),
            F.countDistinct("user_email").alias("users"),
            rounded(money_total(), 4).alias("total_cost_usd"),
            F.round(mean, 6).alias("avg_cost_per_call"),
            token_total().alias("total_tokens"),
        )
        .orderBy("level")
    )


def cost_by_location(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Users with any event, their cost, tokens and API calls per location."""
    known = employees.where(F.col("location").isNotNull())
    return (
        _with_employee(_summed(events), known, "location")
        .groupBy("location")
        .agg(
            F.count("*").alias("users"),
            rounded(money_total(), 4).alias("total_cost_usd"),
            token_total().alias("total_tokens"),
            F.sum("calls").alias("api_calls"),
        )
        .orderBy(F.desc("total_cost_usd"), "location")
    )


def tool_acceptance_by_level(events: DataFrame, employees: DataFrame) -> DataFrame:
    per_email = (
        decisions(events)
        .where(F.col("user_email").isNotNull())
        .groupBy("user_email", "tool_name")
        .agg(F.count("*").alias("n"), accepted().alias("yes"))
    )
    return (
        _with_employee(per_email, employees, "level")
        .groupBy("level", "tool_name")
        .agg(
            F.sum("n").alias("uses"),
            percent(F.sum("yes"), F.sum("n"), 1).alias("accept_rate_pct"),
        )
        .orderBy("level", F.desc("uses"), "tool_name")
    )


def avg_cost_per_user_by_practice_level(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Mean API cost per user, by the employee table's practice and level."""
    return (
        _with_employee(_summed(events.where(is_event(API_REQUEST))), employees, "practice", "level")
        .groupBy("practice", "level")
        .agg(F.round(money_total() / F.count("*"), 4).alias("avg_cost_per_user"))
        .orderBy("practice", "level")
    )
