"""User reports: prompts, top spenders, terminals and the user feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions.columns import (
    API_REQUEST,
    USER_PROMPT,
    earliest_key,
    filled,
    is_event,
    MONEY_PARTS,
    money_parts,
    money_total,
    rounded,
    TOKEN_PARTS,
    token_parts,
    token_total,
    whole_columns,
    whole_parts,
    whole_total,
)


def prompt_length_distribution(events: DataFrame) -> DataFrame:
    """Prompt lengths per practice; prompts without a practice form a group of their own."""
    return (
        events.where(is_event(USER_PROMPT) & F.col("prompt_length").isNotNull())
        .groupBy("user_practice")
        .agg(
            F.round(F.avg("prompt_length"), 0).alias("avg_prompt_length"),
            F.min("prompt_length").alias("min_prompt_length"),
            F.max("prompt_length").alias("max_prompt_length"),
            F.count("*").alias("prompt_count"),
        )
        .orderBy(F.desc("avg_prompt_length"), "user_practice")
    )


def user_rollup(events: DataFrame) -> DataFrame:
    """Activity per email, with NULL where a user has no cost, tokens or prompt lengths.

    Events are summed per (email, session) first, which spreads a user with a third
    of all events over their sessions and leaves one row per session to count. That
    aggregate of raw events also tells practices apart and keeps their earliest instant,
    so it can hash, and the practice of the earliest event follows from the few rows left.
    """
    cost, prompt = F.col("cost_usd"), is_event(USER_PROMPT)
    length = F.when(prompt, F.col("prompt_length"))
    known = events.where(filled("user_email"))
    sums = (*MONEY_PARTS, *TOKEN_PARTS, "calls", "prompts", *whole_columns("length"), "lengths")
    earliest = earliest_key(F.col("first_ts"), F.col("user_practice"))
    return (
        known.groupBy("user_email", "session_id", "user_practice")
        .agg(
            F.min("event_ts").alias("first_ts"),
            *money_parts(cost),
            *token_parts(),
            F.count_if(is_event(API_REQUEST)).alias("calls"),
            F.count_if(prompt).alias("prompts"),
            *whole_parts("length", length),
            F.count(length).alias("lengths"),
        )
        .groupBy("user_email", "session_id")
        .agg(F.min(earliest).alias("first"), *[F.sum(c).alias(c) for c in sums])
        .groupBy("user_email")
        .agg(
            F.min("first").alias("first"),
            F.count("session_id").alias("sessions"),
            money_total().alias("cost"),
            token_total().alias("tokens"),
            F.sum("calls").alias("api_calls"),
            F.sum("prompts").alias("prompts"),
            (whole_total("length") / F.nullif(F.sum("lengths"), F.lit(0))).alias("mean_prompt_len"),
        )
        .withColumn("user_practice", F.col("first.k3"))
        .drop("first")
    )


def top_users_by_cost(events: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` dearest users; equal costs are ordered by email."""
    return (
        user_rollup(events)
        .select(
            "user_email",
            "user_practice",
            "sessions",
            rounded(F.col("cost"), 4).alias("total_cost_usd"),
            F.col("tokens").alias("total_tokens"),
            "prompts",
        )
        .orderBy(F.desc("total_cost_usd"), "user_email")
        .limit(limit)
    )


def user_features(events: DataFrame) -> DataFrame:
    """Inputs of the user segments and the user outlier model, one row per email."""
    return user_rollup(events).select(
        "user_email",
        "user_practice",
        "sessions",
        F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("total_cost"),
        F.coalesce("tokens", F.lit(0)).alias("total_tokens"),
        "api_calls",
        "prompts",
        F.coalesce("mean_prompt_len", F.lit(0.0)).alias("avg_prompt_len"),
    )


def terminal_type_distribution(events: DataFrame) -> DataFrame:
    """Distinct sessions and users per terminal."""
    return (
        events.where(F.col("terminal_type").isNotNull())
        .select("terminal_type", "session_id", "user_id")
        .distinct()
        .groupBy("terminal_type")
        .agg(
            F.countDistinct("session_id").alias("sessions"),
            F.countDistinct("user_id").alias("users"),
        )
        .orderBy(F.desc("sessions"), "terminal_type")
    )
