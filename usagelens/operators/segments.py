"""User segments by K-means on scaled engagement features.

Features are counted in whole 1024ths of their standard deviation, sums are whole numbers and
random draws are hashes of the restart, the step and the user. So the segments are a
function of the users alone, whatever the partitions. All restarts advance together: one
aggregate picks the next first centre of each, one moves the centres of each. Only
centres and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.operators.users import user_features
from usagelens.session import written

# Inputs of the segments, restarts, first seed, iteration limit.
INPUTS = ("sessions", "api_calls", "prompts", "total_cost", "avg_prompt_len")
RESTARTS = 10
SEED = 42
MAX_ITERATIONS = 300

#: Parts of a standard deviation in which features are counted.
UNIT = 1024

#: A restart ends when its centres together move by a hundredth of a deviation or less.
STILL = UNIT * UNIT // 10_000

Centre = tuple[int, ...]
_AXES = [f"z{j}" for j in range(len(INPUTS))]


def _scaled(users: DataFrame) -> tuple[DataFrame, int]:
    """``users`` with whole-number features ``z0`` … and the number of users."""
    figures = []
    for c in INPUTS:
        figures += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.stddev_pop(c).alias(c)]
    seen = users.agg(F.count("*").alias("n"), *figures).first()

    def whole(name: str) -> Column:
        low, high = seen[f"min_{name}"], seen[f"max_{name}"]
        if low == high:
            return F.lit(0).cast("bigint")
        # Six digits of the deviation do not depend on the order of the additions.
        scale = float(f"{seen[name]:.5e}")
        value = F.col(name).cast("double") - F.lit(float(low))
        return F.floor(value / F.lit(scale) * F.lit(float(UNIT))).cast("bigint")

    return users.withColumns({f"z{j}": whole(c) for j, c in enumerate(INPUTS)}), seen["n"]


def _away(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points to centres, one column for each centre."""
    return ((z[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _distance(centre: Centre) -> Column:
    return sum(((F.col(z) - F.lit(c)) * (F.col(z) - F.lit(c)) for z, c in zip(_AXES, centre)), F.lit(0))


def _shift(old: list[Centre], new: list[Centre]) -> int:
    return sum((a - b) ** 2 for one, other in zip(old, new) for a, b in zip(one, other))


def _first_centres(points: DataFrame, n_clusters: int) -> list[list[Centre]]:
    """k-means++ of every restart: users drawn by squared distance from those drawn before.

    Each user runs for the time -ln(u) / weight, and the first to arrive is drawn. A task
    keeps its first user of each restart.
    """
    drawn: list[list[Centre]] = [[] for _ in range(RESTARTS)]
    kinds = "r long, run double, user_email string, " + ", ".join(f"{z} long" for z in _AXES)
    for step in range(n_clusters):
        known = [np.array(centres, dtype=np.int64) for centres in drawn]

        def race(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                z, who, rows = batch[_AXES].to_numpy(dtype=np.int64), batch["user_email"], []
                for r, centres in enumerate(known):
                    codes = [hashlib.md5(f"{SEED + r}:{step}:{w}".encode()).hexdigest()[:13] for w in who]
                    run = -np.log((np.array([int(c, 16) for c in codes]) + 0.5) / 2.0**52)
                    if len(centres):
                        weight = _away(z, centres).min(axis=1)
                        run = np.where(weight > 0, run / np.maximum(weight, 1), np.inf)
                    order = np.flatnonzero(run == run.min())
                    at = min(order, key=lambda i: who[i])
                    if run[at] < np.inf:
                        rows.append((r, run[at], who[at], *z[at]))
                yield pd.DataFrame(rows, columns=["r", "run", "user_email", *_AXES])

        order = F.struct("run", "user_email")
        first = (
            points.select("user_email", *_AXES)
            .mapInPandas(race, kinds)
            .groupBy("r")
            .agg(F.min_by(F.struct(*_AXES), order).alias("z"))
            .collect()
        )
        found = {row["r"]: tuple(row["z"]) for row in first}
        for r, centres in enumerate(drawn):
            # Without a user away from all centres the first centre is repeated.
            centres.append(found[r] if r in found else centres[0])
    return drawn


def _moved(points: DataFrame, states: dict[int, list[Centre]]) -> dict[int, tuple[int, list[Centre]]]:
    """Total distance of the users to each restart's centres, and the means that replace them."""
    shared = {r: np.array(centres, dtype=np.int64) for r, centres in states.items()}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = batch.to_numpy(dtype=np.int64)
            rows = []
            for r, centres in shared.items():
                away = _away(z, centres)
                label = away.argmin(axis=1)
                least = away[np.arange(len(z)), label]
                for i in np.unique(label):
                    held = label == i
                    rows.append((r, i, held.sum(), least[held].sum(), *z[held].sum(axis=0)))
            yield pd.DataFrame(rows, columns=["r", "i", "n", "cost", *_AXES])

    kinds = ", ".join(f"{c} long" for c in ("r", "i", "n", "cost", *_AXES))
    sums = (
        points.select(_AXES)
        .mapInPandas(partial, kinds)
        .groupBy("r", "i")
        .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "cost", *_AXES)])
        .collect()
    )
    out = {r: (0, list(centres)) for r, centres in states.items()}
    for row in sums:
        cost, centres = out[row["r"]]
        centres[row["i"]] = tuple(int(row[z]) // int(row["n"]) for z in _AXES)
        out[row["r"]] = cost + int(row["cost"]), centres
    return out


def user_engagement_clusters(events: DataFrame, n_clusters: int = 4) -> DataFrame:
    """Users with a ``cluster`` label; segment 0 has the highest mean cost.

    Of ten seeded restarts the centres with the least total squared distance are kept. With
    fewer users than clusters everyone is in segment 0.
    """
    if n_clusters < 1:
        raise ValueError("n_clusters must be at least 1")
    columns = ["user_email", "user_practice", *INPUTS]
    users = written(user_features(events).select(columns), "users")
    scaled, rows = _scaled(users)
    if n_clusters == 1 or rows < n_clusters:
        return users.withColumn("cluster", F.lit(0)).orderBy("user_email")

    points = written(scaled, "points")
    states = dict(enumerate(_first_centres(points, n_clusters)))
    best = None
    for number in range(MAX_ITERATIONS):
        following = {}
        for r, (cost, centres) in _moved(points, states).items():
            best = min(filter(None, [best, (cost, r, number, states[r])]))
            if _shift(states[r], centres) > STILL:
                following[r] = centres
        states = following
        if not states:
            break
    centres = best[-1]
    by_cost = sorted(range(n_clusters), key=lambda i: (-centres[i][INPUTS.index("total_cost")], i))
    pairs = [
        F.struct(_distance(centre).alias("d"), F.lit(i).alias("i"), F.lit(by_cost.index(i)).alias("label"))
        for i, centre in enumerate(centres)
    ]
    nearest = F.array_min(F.array(*pairs))["label"]
    labelled = points.select(*columns, nearest.alias("cluster"))
    return labelled.orderBy("cluster", "user_email")
