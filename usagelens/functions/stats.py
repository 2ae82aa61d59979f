"""Distribution statistics that stay distributed whatever the number of rows."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Values per bucket: 2 ** BUCKET_BITS distinct integers at most.
BUCKET_BITS = 12


def exact_percentiles(
    df: DataFrame,
    value: str,
    wanted: dict[str, float],
    keys: list[str] | None = None,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Exact linearly interpolated percentiles of an integer column, per group.

    The built-in ``percentile`` gathers every distinct value of a group in one
    task. Here equal values are first counted, then ranked in two steps: totals
    per bucket of neighbouring values, and a running count inside each bucket. A
    window never sees more than ``2 ** bits`` values, or the number of buckets in
    the range of the values, so no task grows with the rows or with a hot group.

    Returns ``keys``, ``n``, ``mean``, ``std`` (sample) and one double per name
    in ``wanted``.
    """
    keys = keys or []
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count("*").alias("c"))
        .withColumn("b", F.shiftright("v", bits))
        # The join below asks this of one side only; asked of both, they share a shuffle.
        .where(F.col("b").isNotNull())
    )
    by_bucket = Window.partitionBy(*keys).orderBy("b")
    buckets = (
        counts.groupBy(*keys, "b")
        .agg(F.sum("c").alias("bc"))
        .select(
            *[F.col(k).alias(f"_{k}") for k in keys],
            F.col("b").alias("_b"),
            (F.sum("bc").over(by_bucket) - F.col("bc")).alias("before"),
            F.sum("bc").over(Window.partitionBy(*keys)).alias("n"),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("b") == F.col("_b")]
    inside = Window.partitionBy(*keys, "b").orderBy("v")
    ranked = counts.join(buckets, reduce(Column.__and__, same)).select(
        *keys, "v", "c", "n", (F.col("before") + F.sum("c").over(inside)).alias("upto")
    )

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    columns = []
    for name, p in wanted.items():
        position = F.lit(p) * (F.col("n") - 1)
        low, high = at(F.floor(position)), at(F.ceil(position))
        part = F.lit(p) * (F.max("n") - 1)
        columns.append((low + (high - low) * (part - F.floor(part))).alias(name))

    n = F.max("n")
    weighted = F.col("v") * F.col("c")
    total = F.sum(weighted.cast("decimal(19,0)")).cast("double")
    squares = F.sum(F.col("v").cast("decimal(19,0)") * weighted.cast("decimal(19,0)")).cast("double")
    variance = (squares - total * total / n) / F.nullif(n - 1, F.lit(0))
    return ranked.groupBy(*keys).agg(
        n.alias("n"),
        (total / n).alias("mean"),
        F.sqrt(F.when(variance < 0, F.lit(0.0)).otherwise(variance)).alias("std"),
        *columns,
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method).

    NaN if it has not converged after a million steps.
    """
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h, m = d, 1
    while True:
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return h
        if m > 1_000_000:
            return math.nan
        m += 1


def student_t_two_sided(r: float, n: int) -> float | None:
    """Probability of a correlation at least as strong as ``r`` among ``n`` unrelated pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1.0 or r == 0.0:
        return 0.0 if r else 1.0
    a, b, x = (n - 2) / 2.0, 0.5, 1.0 - r * r
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log1p(-r * r)
        + math.log(abs(r))
    )
    if front == 0.0:
        return 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        value = front * _beta_fraction(a, b, x) / a
    else:
        value = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return None if math.isnan(value) else min(1.0, max(0.0, value))


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation; meant for one-row frames."""

    @F.pandas_udf("double")
    def p_value(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(v) else student_t_two_sided(v, int(m)) for v, m in zip(rs, ns)],
            dtype="float64",
        )

    return p_value(r, n)
