"""Column helpers shared by the operators."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, functions as F

# Event names the reports tell apart.
API_REQUEST = "api_request"
USER_PROMPT = "user_prompt"
TOOL_DECISION = "tool_decision"
TOOL_RESULT = "tool_result"
API_ERROR = "api_error"


def is_event(name: str) -> Column:
    return F.col("event_name") == name


def filled(name: str) -> Column:
    """True where a text column is neither NULL nor empty."""
    return F.col(name).isNotNull() & (F.col(name) != "")


# --- whole numbers and money ---------------------------------------------------
# A sum of whole numbers is kept as two sums: of the value's upper bits and of its lower
# 24 bits. Both stay fixed-width in the hash aggregate and neither overflows before eight
# million rows at the 64-bit limit, so no event can end a report; a total beyond 64 bits
# is NULL. Sums of doubles depend on the order of rows, so costs are summed as
# micro-dollars in this way and the rest in 1e-12 dollars: the same under any partitioning,
# as fine as the doubles themselves. A corrupt cost of 1e12 dollars or more goes to a lane
# of doubles beside the sum.

_LANE = 1 << 24
_BEYOND = 1e12


def _lanes(*values: Column) -> tuple[Column, Column]:
    """Upper and lower part of the sum of some columns of a row; NULL if one is NULL."""
    upper = [F.shiftright(v.cast("bigint"), 24) for v in values]
    lower = [v.cast("bigint").bitwiseAND(F.lit(_LANE - 1)) for v in values]
    return reduce(Column.__add__, upper), reduce(Column.__add__, lower)


def _exact(upper: Column, lower: Column) -> Column:
    """The sum that two lanes hold, as a decimal."""
    scale = F.lit(Decimal(_LANE)).cast("decimal(8,0)")
    return upper.cast("decimal(19,0)") * scale + lower.cast("decimal(19,0)")


def whole_parts(name: str, *values: Column) -> list[Column]:
    """Aggregates ``<name>_upper`` and ``<name>_lower`` of the sum of whole numbers."""
    upper, lower = _lanes(*values)
    return [F.sum(upper).alias(f"{name}_upper"), F.sum(lower).alias(f"{name}_lower")]


def whole_columns(name: str) -> tuple[str, str]:
    return f"{name}_upper", f"{name}_lower"


def whole_total(name: str) -> Column:
    """The sum over rows that hold the parts of their groups; NULL without any, or beyond 64 bits."""
    upper, lower = whole_columns(name)
    return _exact(F.sum(upper), F.sum(lower)).try_cast("bigint")


def whole_sum(*values: Column) -> Column:
    """``SUM`` of whole numbers; NULL when no row has one, or beyond 64 bits."""
    upper, lower = _lanes(*values)
    return _exact(F.sum(upper), F.sum(lower)).try_cast("bigint")


# Tokens of an event are its input and output tokens; with either NULL it adds nothing.


def _tokens() -> tuple[Column, Column]:
    return F.col("input_tokens"), F.col("output_tokens")


def token_parts() -> list[Column]:
    return whole_parts("tokens", *_tokens())


def token_total() -> Column:
    return whole_total("tokens")


def token_sum() -> Column:
    return whole_sum(*_tokens())


TOKEN_PARTS = whole_columns("tokens")


def _ordinary(cost: Column) -> Column:
    """The cost, 0 in place of one beyond, NULL where it is NULL."""
    return F.when(F.abs(cost) < _BEYOND, cost).when(cost.isNotNull(), F.lit(0.0))


def money_parts(cost: Column) -> list[Column]:
    """Aggregates of a cost, named as ``MONEY_PARTS``."""
    plain = _ordinary(cost)
    micros = (plain * 1e6).cast("bigint")
    rest = F.rint((plain * 1e6 - micros) * 1e6).cast("bigint")
    beyond = F.when(F.abs(cost) >= _BEYOND, cost)
    return [*whole_parts("micros", micros), F.sum(rest).alias("rest"), F.sum(beyond).alias("beyond")]


MONEY_PARTS = (*whole_columns("micros"), "rest", "beyond")


def money_from_parts(upper: Column, lower: Column, rest: Column, beyond: Column) -> Column:
    """The summed parts as dollars; NULL where no row has a cost."""
    exact = _exact(upper, lower).cast("decimal(24,0)") * F.lit(Decimal("0.000001")) + rest.cast(
        "decimal(20,0)"
    ) * F.lit(Decimal("0.000000000001"))
    plain = exact.cast("double")
    return F.when(beyond.isNull(), plain).otherwise(plain + beyond)


def money_total() -> Column:
    """The dollars of rows that hold the parts of their groups."""
    return money_from_parts(*[F.sum(c) for c in MONEY_PARTS])


def money_sum(cost: Column) -> Column:
    """``SUM(cost)``; NULL when no row has a cost."""
    return money_from_parts(*money_parts(cost))


def money_avg(cost: Column) -> Column:
    return money_sum(cost) / F.nullif(F.count(cost), F.lit(0))


def rounded(value: Column, places: int) -> Column:
    """Round half up and return a double."""
    return F.round(value, places).cast("double")


# --- ratios ------------------------------------------------------------------


def percent(part: Column, whole: Column, places: int) -> Column:
    """``100 * part / whole`` rounded; NULL when the whole is zero."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), places)


# --- time --------------------------------------------------------------------

# Weekday names by number, 0 = Sunday.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# How a period of each granularity is written.
PERIOD_FORMATS = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}


def weekday_number(day: Column) -> Column:
    """Weekday as text, 0 = Sunday, from ``dayofweek``."""
    return (day - 1).cast("string")


def weekday_name(day: Column) -> Column:
    """English name of a ``dayofweek`` number."""
    return F.when(day.isNotNull(), F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), day))


def minutes_between(start: Column, end: Column, places: int) -> Column:
    """Minutes from ``start`` to ``end``, rounded."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 6e7, places)


# --- the value on the earliest event -----------------------------------------


def earliest_key(ts: Column, *values: Column) -> Column:
    """Ordering for ``min_by``: earliest instant first, unknown instants last, ties by value.

    The flags keep NULLs out of the comparisons, and no unique id has to be read
    just to break ties.
    """
    parts = [ts.isNull(), ts]
    for value in values:
        parts += [value.isNull(), value]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
