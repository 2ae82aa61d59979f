"""Reports that are kept as partial aggregates of each load and merged when they are read.

A rollup has three steps: events to partial rows, partial rows of several loads to one
row per key, and those rows to the report. Merging is associative, so partial rows of
folded loads are merged once and for all, and a report costs the rows of the keys, not
the events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from usagelens.functions.columns import (
    API_REQUEST,
    MONEY_PARTS,
    TOKEN_PARTS,
    USER_PROMPT,
    is_event,
    money_parts,
    money_total,
    rounded,
    token_parts,
    token_total,
    whole_columns,
)
from usagelens.operators import sessions
from usagelens.operators.usage import PERIOD_COLUMNS, period_label
from usagelens.schema import EVENTS

#: Registers of a sketch, as a power of two: a standard error of 1.04 / sqrt(2**12), 1.6 %.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5


@dataclass(frozen=True)
class Rollup:
    name: str
    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merged: Callable[[], list[Column]]

    def merge(self, partials: DataFrame) -> DataFrame:
        """One row per key; NULL keys are keys."""
        return partials.groupBy(*self.keys).agg(*self.merged())

    def schema(self, spark: SparkSession) -> T.StructType:
        return self.partial(spark.createDataFrame([], EVENTS)).schema


def _summed(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def _hour() -> Column:
    return F.date_trunc("hour", F.col("event_ts")).alias("start")


def _cost_parts(events: DataFrame) -> DataFrame:
    asked = events.where(is_event(API_REQUEST) & F.col("event_timestamp").isNotNull())
    return asked.groupBy(_hour()).agg(
        *money_parts(F.col("cost_usd")), *token_parts(), F.count("*").alias("api_calls")
    )


COST = Rollup("cost", ("start",), _cost_parts, lambda: _summed(*MONEY_PARTS, *TOKEN_PARTS, "api_calls"))


def cost_over_time(rolled: DataFrame, granularity: str = "hour") -> DataFrame:
    """``usage.cost_over_time`` from the hourly sums of ``COST``."""
    unit = "hour" if granularity == "hour" else "day"
    return (
        rolled.groupBy(F.date_trunc(unit, "start").alias("start"))
        .agg(
            rounded(money_total(), 6).alias("cost_usd"),
            token_total().alias("total_tokens"),
            F.sum("api_calls").alias("api_calls"),
        )
        .select(period_label(F.col("start"), unit), *PERIOD_COLUMNS)
        .orderBy("period")
    )


SESSIONS = Rollup(
    "sessions",
    ("session_id", "user_practice", "user_email", "other_text"),
    sessions.session_parts,
    lambda: [
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        *_summed(
            *MONEY_PARTS, *TOKEN_PARTS, "calls", "prompts", "decisions", *whole_columns("length"), "lengths"
        ),
    ],
)


def session_stats(rolled: DataFrame, limit: int | None = None) -> DataFrame:
    """``sessions.session_stats`` from the sums of ``SESSIONS``."""
    ordered = sessions.session_profiles(rolled).orderBy(F.desc("session_cost_usd"), "session_id")
    return ordered if limit is None else ordered.limit(limit)


def _presence_parts(events: DataFrame) -> DataFrame:
    def sketch(name: str) -> Column:
        return F.hll_sketch_agg(name, SKETCH_BITS).alias(name)

    return events.groupBy(_hour()).agg(
        sketch("session_id"),
        sketch("user_id"),
        sketch("user_practice"),
        *money_parts(F.col("cost_usd")),
        *token_parts(),
        F.count_if(is_event(API_REQUEST)).alias("calls"),
        F.count_if(is_event(USER_PROMPT)).alias("prompts"),
    )


PRESENCE = Rollup(
    "presence",
    ("start",),
    _presence_parts,
    lambda: [
        *[F.hll_union_agg(c).alias(c) for c in ("session_id", "user_id", "user_practice")],
        *_summed(*MONEY_PARTS, *TOKEN_PARTS, "calls", "prompts"),
    ],
)


def kpi_summary(
    rolled: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """``usage.kpi_summary`` over the hours from ``start`` to before ``end``, from ``PRESENCE``.

    Distinct sessions, users and practices are estimates with a standard error of
    ``SKETCH_ERROR``; sums and counts are exact. Without bounds every event counts, one
    without a readable time too.
    """
    if start is not None:
        rolled = rolled.where(F.col("start") >= F.lit(start))
    if end is not None:
        rolled = rolled.where(F.col("start") < F.lit(end))

    def distinct(name: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0))

    return rolled.agg(
        distinct("session_id").alias("total_sessions"),
        distinct("user_id").alias("total_users"),
        distinct("user_practice").alias("total_practices"),
        F.coalesce(money_total(), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(token_total(), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("total_api_calls"),
        F.coalesce(F.sum("prompts"), F.lit(0)).alias("total_prompts"),
    )


ROLLUPS = {r.name: r for r in (COST, SESSIONS, PRESENCE)}
