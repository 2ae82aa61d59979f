"""Reports by name, with checked parameters.

The names and defaults are those of the query service the reports replace; the
result of every report is a DataFrame, or a JSON document for a forecast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from usagelens.operators import forecast, outliers, sessions, tools, usage, users, workforce
from usagelens.sources.records import forecast_document, to_records


@dataclass(frozen=True)
class Within:
    """A number between two bounds, both allowed."""

    default: float
    low: float
    high: float

    def check(self, name: str, value: Any) -> Any:
        kinds = (int, float) if isinstance(self.default, float) else int
        if isinstance(value, bool) or not isinstance(value, kinds):
            raise ValueError(f"{name} must be a number of the type of {self.default}")
        if not self.low <= value <= self.high:
            raise ValueError(f"{name} must be between {self.low} and {self.high}")
        return value


@dataclass(frozen=True)
class OneOf:
    """One of a few words."""

    default: str
    choices: tuple[str, ...]

    def check(self, name: str, value: Any) -> Any:
        if value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(self.choices)}")
        return value


@dataclass(frozen=True)
class Report:
    build: Callable[..., DataFrame]
    params: dict[str, Within | OneOf] = field(default_factory=dict)
    employees: bool = False


# Parameter defaults and ranges.
_GRANULARITY = OneOf("day", ("hour", "day"))
_SESSIONS = Within(100, 1, 5000)
_TOP = Within(20, 1, 200)
_DAYS = Within(7, 1, 90)
_CONTAMINATION = Within(0.05, 0.01, 0.5)


def _cost_document(events: DataFrame, days: int) -> DataFrame:
    fit = forecast.cost_forecast_fit(events).select("r2", "slope_per_day")
    return forecast_document(forecast.cost_forecast(events, days), fit)


def _token_document(events: DataFrame, days: int) -> DataFrame:
    return forecast_document(forecast.token_forecast(events, days), forecast.token_forecast_fit(events))


REPORTS: dict[str, Report] = {
    "kpi": Report(usage.kpi_summary),
    "tokens/by-practice": Report(usage.token_usage_by_practice),
    "tokens/by-model": Report(usage.token_usage_by_model),
    "cost/over-time": Report(usage.cost_over_time, {"granularity": _GRANULARITY}),
    "sessions": Report(sessions.session_stats, {"limit": _SESSIONS}),
    "usage/by-hour": Report(usage.peak_usage_by_hour),
    "usage/by-weekday": Report(usage.peak_usage_by_weekday),
    "usage/terminal-types": Report(users.terminal_type_distribution),
    "tools/usage": Report(tools.tool_usage_stats),
    "tools/acceptance-by-practice": Report(tools.tool_accept_by_practice),
    "tools/performance": Report(tools.tool_result_performance),
    "users/top": Report(users.top_users_by_cost, {"limit": _TOP}),
    "users/prompts": Report(users.prompt_length_distribution),
    "employees/cost-by-level": Report(workforce.cost_by_level, employees=True),
    "employees/cost-by-location": Report(workforce.cost_by_location, employees=True),
    "employees/tool-acceptance-by-level": Report(workforce.tool_acceptance_by_level, employees=True),
    "employees/cost-heatmap": Report(
        workforce.avg_cost_per_user_by_practice_level, employees=True
    ),
    "predictions/cost-forecast": Report(_cost_document, {"days": _DAYS}),
    "predictions/token-forecast": Report(_token_document, {"days": _DAYS}),
    "predictions/session-anomalies": Report(
        outliers.session_anomalies, {"contamination": _CONTAMINATION}
    ),
    "predictions/user-anomalies": Report(
        outliers.user_anomalies, {"contamination": _CONTAMINATION}
    ),
}


def run(
    name: str, events: DataFrame, employees: DataFrame | None = None, **params: Any
) -> DataFrame:
    """Build the report ``name``; raises ``ValueError`` for unknown names and bad parameters."""
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}")
    report = REPORTS[name]
    unknown = set(params) - set(report.params)
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    values = {
        key: rule.check(key, params.get(key, rule.default)) for key, rule in report.params.items()
    }
    if report.employees:
        if employees is None:
            raise ValueError(f"{name} needs the employee table")
        return report.build(events, employees, **values)
    return report.build(events, **values)


def records(
    name: str, events: DataFrame, employees: DataFrame | None = None, **params: Any
) -> DataFrame:
    """The report as JSON text in column ``value``: one record per row, or one document."""
    result = run(name, events, employees, **params)
    return result if result.columns == ["value"] else to_records(result)
