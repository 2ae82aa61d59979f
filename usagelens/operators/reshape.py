"""Tables behind charts: pivots, shares, long forms, histograms, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.functions.stats import exact_percentiles
from usagelens.operators import sessions, tools, usage, users, workforce
from usagelens.session import written

HISTOGRAM_BINS = 50


def practice_level_pivot(
    events: DataFrame, employees: DataFrame, levels: list[str] | None = None
) -> DataFrame:
    """Mean cost per user, practices down and levels across; absent pairs are 0.

    Without ``levels`` the cells are written once, and their levels are looked up there.
    """
    cells = workforce.avg_cost_per_user_by_practice_level(events, employees)
    if levels is None:
        cells = written(cells, "pivot-cells")
    value = F.first("avg_cost_per_user")
    return cells.groupBy("practice").pivot("level", levels).agg(value).na.fill(0.0).orderBy("practice")


def tool_practice_heatmap(events: DataFrame) -> DataFrame:
    """One row per tool and practice with its accept rate."""
    return tools.tool_accept_by_practice(events).select(
        "tool_name", "user_practice", "accept_rate_pct"
    )


def level_tool_heatmap(events: DataFrame, employees: DataFrame) -> DataFrame:
    """One row per level and tool with its accept rate."""
    return workforce.tool_acceptance_by_level(events, employees).select(
        "level", "tool_name", "accept_rate_pct"
    )


def _share(report: DataFrame, label: str, measure: str) -> DataFrame:
    """Percent of the total per label; the report has one row per label."""
    total = F.nullif(F.sum(measure).over(Window.partitionBy()), F.lit(0))
    return report.select(
        label, measure, F.round(100.0 * F.col(measure) / total, 2).alias("share_pct")
    )


def cost_share_by_model(events: DataFrame) -> DataFrame:
    return _share(usage.token_usage_by_model(events), "model", "total_cost_usd")


def session_share_by_terminal(events: DataFrame) -> DataFrame:
    return _share(users.terminal_type_distribution(events), "terminal_type", "sessions")


def cost_share_by_location(events: DataFrame, employees: DataFrame) -> DataFrame:
    return _share(workforce.cost_by_location(events, employees), "location", "total_cost_usd")


def tokens_long(events: DataFrame) -> DataFrame:
    """Input, output and cache-read tokens per practice, one row per kind."""
    return usage.token_usage_by_practice(events).unpivot(
        "user_practice", ["input_tokens", "output_tokens", "cache_read_tokens"], "kind", "n"
    )


def decisions_long(events: DataFrame) -> DataFrame:
    """Accepted and rejected uses per tool, one row per kind."""
    return tools.tool_usage_stats(events).unpivot("tool_name", ["accepted", "rejected"], "kind", "n")


def duration_histogram(events: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Sessions per equal-width duration bin and practice; the last bin is closed.

    Durations are counted by value first. The range comes from a scalar subquery
    over the same counts, grouped so that their shuffle is reused, not repeated.
    """
    counts = (
        sessions.hundredths(sessions.session_durations(events))
        .groupBy("user_practice", "h")
        .agg(F.count("*").alias("c"))
        .where("c > 0")
    )
    span = (
        counts.groupBy("user_practice")
        .agg(F.min("h").alias("low"), F.max("h").alias("high"))
        .agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high")))
        .scalar()
    )
    ranged = counts.withColumn("span", span).select("user_practice", "h", "c", "span.*")
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0))
    index = F.floor((F.col("h") - F.col("low")) * bins / width)
    binned = F.least(F.coalesce(index, F.lit(0)), F.lit(bins - 1)) + 1

    def edge(i: Column) -> Column:
        return F.round((F.col("low") + (F.col("high") - F.col("low")) * i / bins) / 100, 4)

    return (
        ranged.groupBy(binned.cast("int").alias("bin"), "user_practice", "low", "high")
        .agg(F.sum("c").alias("sessions"))
        .select(
            "bin",
            edge(F.col("bin") - 1).alias("from_min"),
            edge(F.col("bin")).alias("to_min"),
            "user_practice",
            "sessions",
        )
        .orderBy("bin", "user_practice")
    )


# The five numbers of a box summary.
BOX = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def duration_box(events: DataFrame) -> DataFrame:
    """Five-number summary of the session duration per practice."""
    durations = sessions.hundredths(sessions.session_durations(events))
    box = exact_percentiles(durations, "h", BOX, keys=["user_practice"])
    return box.select(
        "user_practice",
        *[F.round(F.col(name) / 100, 4).alias(name) for name in BOX],
        F.col("n").alias("sessions"),
    ).orderBy("user_practice")


def top_sessions(events: DataFrame, limit: int = 50) -> DataFrame:
    return sessions.session_stats(events, limit)


def kpi_header(events: DataFrame) -> DataFrame:
    """The five figures shown in the page header."""
    return usage.kpi_summary(events).select(
        "total_sessions", "total_users", "total_api_calls", "total_cost_usd", "total_tokens"
    )


# Column titles of the model table.
MODEL_TITLES = {
    "model": "Model",
    "api_calls": "API Calls",
    "total_tokens": "Total Tokens",
    "total_cost_usd": "Cost (USD)",
    "avg_duration_ms": "Avg Latency (ms)",
}


def model_table(events: DataFrame) -> DataFrame:
    """Token usage by model under display titles."""
    return usage.token_usage_by_model(events).withColumnsRenamed(MODEL_TITLES)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Rows, flagged rows and their percentage (0 for no rows)."""
    flagged = F.count_if("is_anomaly")
    share = F.round(100.0 * flagged / F.nullif(F.count("*"), F.lit(0)), 1)
    return scored.agg(
        F.count("*").alias("total"),
        flagged.alias("anomalies"),
        F.coalesce(share, F.lit(0.0)).alias("anomaly_pct"),
    )


def anomalies_only(scored: DataFrame) -> DataFrame:
    return scored.where("is_anomaly")


def normal_only(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("is_anomaly"))


def anomalous_users_by_cost(scored: DataFrame) -> DataFrame:
    """Flagged users, dearest first."""
    return anomalies_only(scored).orderBy(F.desc("total_cost"), "user_email")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Size and means of each user segment."""

    def mean(name: str) -> Column:
        return F.bround(F.avg(name), 2)

    return (
        clustered.groupBy("cluster")
        .agg(
            F.count("user_email").alias("users"),
            mean("total_cost").alias("avg_cost"),
            mean("sessions").alias("avg_sessions"),
            mean("api_calls").alias("avg_api_calls"),
            mean("prompts").alias("avg_prompts"),
        )
        .orderBy("cluster")
    )
