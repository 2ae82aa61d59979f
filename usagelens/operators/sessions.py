"""Session reports: profiles, durations, prompt-cost correlation, model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.columns import (
    API_REQUEST,
    TOOL_DECISION,
    USER_PROMPT,
    earliest_key,
    is_event,
    minutes_between,
    money_parts,
    money_sum,
    money_total,
    rounded,
    token_parts,
    token_sum,
    token_total,
    whole_parts,
    whole_total,
)
from usagelens.functions.stats import correlation_p_value, exact_percentiles


# The usual form of a timestamp text, as a LIKE pattern and as a format.
USUAL_TEXT = "____-__-__T__:__:__.___Z"
USUAL_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _parts(events: DataFrame, *extra: Column) -> DataFrame:
    """Sums per session, practice and email: nearly one row per session.

    All buffers are fixed-width, so raw events meet a hash aggregate and are not
    sorted; the text columns are grouping keys here, and only the few rows left of
    each session are compared to find its earliest practice and email.
    """
    cost, prompt = F.col("cost_usd"), is_event(USER_PROMPT)
    length = F.when(prompt, F.col("prompt_length"))
    return (
        events.where(F.col("session_id").isNotNull())
        .groupBy("session_id", "user_practice", "user_email", *extra)
        .agg(
            F.min("event_ts").alias("first_ts"),
            F.max("event_ts").alias("last_ts"),
            *money_parts(cost),
            *token_parts(),
            F.count_if(is_event(API_REQUEST)).alias("calls"),
            F.count_if(prompt).alias("prompts"),
            F.count_if(is_event(TOOL_DECISION)).alias("decisions"),
            *whole_parts("length", length),
            F.count(length).alias("lengths"),
        )
    )


def _who() -> Column:
    """Practice and email of the earliest event, from the parts of a session."""
    earliest = earliest_key(F.col("first_ts"), F.col("user_practice"), F.col("user_email"))
    return F.min_by(F.struct("user_practice", "user_email"), earliest).alias("who")


def session_parts(events: DataFrame) -> DataFrame:
    """Partial sums of the session profiles, which ``session_profiles`` finishes.

    Start and end are the smallest and largest timestamp *texts*. Texts of the usual
    form sort like their instants and are written back from those; any other text is
    a grouping key of its own.
    """
    text = F.col("event_timestamp")
    usual = text.like(USUAL_TEXT) & F.col("event_ts").isNotNull()
    return _parts(events, F.when(~usual, text).alias("other_text"))


def session_profiles(parts: DataFrame) -> DataFrame:
    """One row per session from its partial sums; practice and email come from its earliest event."""

    def shown(instant: str) -> Column:
        return F.coalesce("other_text", F.date_format(instant, USUAL_FORMAT))

    return (
        parts.groupBy("session_id")
        .agg(
            _who(),
            F.min(shown("first_ts")).alias("session_start"),
            F.max(shown("last_ts")).alias("session_end"),
            F.sum("prompts").alias("prompts"),
            F.sum("calls").alias("api_calls"),
            F.sum("decisions").alias("tool_decisions"),
            rounded(money_total(), 6).alias("session_cost_usd"),
            token_total().alias("session_tokens"),
        )
        .select("session_id", "who.*", *PROFILE_COLUMNS)
    )


def session_stats(events: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per session, dearest first. With ``limit`` the sort becomes a top-k."""
    ordered = session_profiles(session_parts(events)).orderBy(
        F.desc("session_cost_usd"), "session_id"
    )
    return ordered if limit is None else ordered.limit(limit)


PROFILE_COLUMNS = (
    "session_start",
    "session_end",
    "prompts",
    "api_calls",
    "tool_decisions",
    "session_cost_usd",
    "session_tokens",
)


def running_profiles(events: DataFrame) -> DataFrame:
    """Session profiles in a single aggregate, as a stream needs them; unordered."""
    who = F.min_by(
        F.struct("user_practice", "user_email"),
        earliest_key(F.col("event_ts"), F.col("user_practice"), F.col("user_email")),
    )
    return (
        events.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            who.alias("who"),
            F.min("event_timestamp").alias("session_start"),
            F.max("event_timestamp").alias("session_end"),
            F.count_if(is_event(USER_PROMPT)).alias("prompts"),
            F.count_if(is_event(API_REQUEST)).alias("api_calls"),
            F.count_if(is_event(TOOL_DECISION)).alias("tool_decisions"),
            rounded(money_sum(F.col("cost_usd")), 6).alias("session_cost_usd"),
            token_sum().alias("session_tokens"),
        )
        .select("session_id", "who.*", *PROFILE_COLUMNS)
    )


def session_features(events: DataFrame) -> DataFrame:
    """Inputs of the session outlier model, one row per session."""
    mean_length = whole_total("length") / F.nullif(F.sum("lengths"), F.lit(0))
    return (
        _parts(events)
        .groupBy("session_id")
        .agg(
            _who(),
            F.coalesce(money_total(), F.lit(0.0)).alias("total_cost"),
            F.coalesce(token_total(), F.lit(0)).alias("total_tokens"),
            F.sum("calls").alias("api_calls"),
            F.sum("prompts").alias("prompts"),
            F.coalesce(mean_length, F.lit(0.0)).alias("avg_prompt_len"),
            minutes_between(F.min("first_ts"), F.max("last_ts"), 1).alias("duration_min"),
        )
        .select(
            "session_id",
            "who.user_email",
            "who.user_practice",
            "total_cost",
            "total_tokens",
            "api_calls",
            "prompts",
            "avg_prompt_len",
            "duration_min",
        )
    )


def prompt_cost_correlation(events: DataFrame, p_value: bool = True) -> DataFrame:
    """Pearson correlation of mean prompt length and total cost over sessions, one row.

    Below five sessions, and where one side does not vary, only ``n`` is given.
    """
    length = F.when(is_event(USER_PROMPT), F.col("prompt_length"))
    cost = F.when(is_event(API_REQUEST), F.col("cost_usd"))
    per_session = (
        events.where(
            F.col("session_id").isNotNull()
            & F.col("event_name").isin(USER_PROMPT, API_REQUEST)
        )
        .groupBy("session_id")
        .agg(F.avg(length).alias("x"), money_sum(cost).cast("double").alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    # A correlation of a constant divides by zero, so it is built from the covariance.
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    r = F.covar_pop("x", "y") / F.nullif(spread, F.lit(0.0))
    known = (F.count("*") >= 5) & (spread > 0)
    moments = per_session.agg(
        F.when(known, F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)).alias("r"),
        F.count("*").alias("n"),
    )
    columns = {"correlation": F.round("r", 4), "n": F.col("n"), "interpretation": _strength()}
    if p_value:
        columns["p_value"] = F.round(correlation_p_value(F.col("r"), F.col("n")), 6)
    return moments.select(*[c.alias(name) for name, c in columns.items()])


# Lower bounds of r (exclusive) and their descriptions.
STRENGTHS = (
    (0.7, "Strong positive"),
    (0.4, "Moderate positive"),
    (0.1, "Weak positive"),
    (-0.1, "Negligible"),
)
WEAKEST = "Negative"


def _strength() -> Column:
    r = F.col("r")
    above = [F.when(r > bound, F.lit(text)) for bound, text in STRENGTHS]
    return F.when(r.isNotNull(), F.coalesce(*above, F.lit(WEAKEST)))


def _timed(events: DataFrame) -> DataFrame:
    """Events of a session at a known instant; others cannot change a duration."""
    return events.where(F.col("session_id").isNotNull() & F.col("event_ts").isNotNull())


def _spans(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy("session_id", *keys).agg(
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts")
    )


def session_durations(events: DataFrame) -> DataFrame:
    """Sessions lasting more than 0.00 minutes after rounding, with their duration."""
    practice = F.min_by("user_practice", earliest_key(F.col("first_ts"), F.col("user_practice")))
    return (
        _spans(_timed(events), "user_practice")
        .groupBy("session_id")
        .agg(
            practice.alias("user_practice"),
            minutes_between(F.min("first_ts"), F.max("last_ts"), 2).alias("duration_min"),
        )
        .where(F.col("duration_min") > 0)
    )


def hundredths(durations: DataFrame) -> DataFrame:
    """Durations as whole hundredths of a minute in column ``h``."""
    return durations.withColumn("h", F.round(F.col("duration_min") * 100).cast("bigint"))


# Reported percentiles of the session duration.
DURATION_PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def session_duration_stats(events: DataFrame) -> DataFrame:
    """Mean, spread and percentiles of the session duration in minutes; no row without sessions.

    The practice of a session plays no part here, so one aggregate per session is enough.
    """
    minutes = minutes_between(F.col("first_ts"), F.col("last_ts"), 2).alias("duration_min")
    lasting = _spans(_timed(events)).select(minutes).where(F.col("duration_min") > 0)
    stats = exact_percentiles(hundredths(lasting), "h", DURATION_PERCENTILES | {"max": 1.0})
    return stats.where(F.col("n") > 0).select(
        *[
            F.round(F.col(name) / 100, 2).alias(name)
            for name in ("mean", "median", "std", "p25", "p75", "p90", "p95", "max")
        ],
        F.col("n").alias("count"),
    )
