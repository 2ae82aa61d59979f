"""Isolation forest over sessions or users (Liu, Ting and Zhou, 2008).

Every tree is grown from a small hash-drawn sample, so the forest has a fixed size
whatever the data: samples are shuffled by tree, the grown nodes are shared with
all tasks, and each row is scored where it lies.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.stats import exact_percentiles
from usagelens.operators.sessions import session_features
from usagelens.operators.users import user_features
from usagelens.session import written

# Size of the forest, of a tree's sample, the seed, and the least
# number of rows worth a model.
TREES = 100
SAMPLE = 256
SEED = 42
MIN_ROWS = 10

SESSION_INPUTS = (
    "total_cost",
    "total_tokens",
    "api_calls",
    "prompts",
    "avg_prompt_len",
    "duration_min",
)
USER_INPUTS = ("sessions", "total_cost", "total_tokens", "api_calls", "prompts")

# Scores are kept as whole billionths: ranks are then exact and independent of the engine.
_UNIT = 1_000_000_000
_BUCKET_BITS = 15

_NODES = "tree int, node int, feature int, split double, low int, high int, length double"


def _average_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _draw(features: DataFrame, key: str, inputs: Sequence[str], sample: int, rows: int) -> DataFrame:
    """Candidate rows of every tree, with the number that orders them.

    Each tree gets about twice the rows it needs, and only these are shuffled. A row
    belongs to each tree with the same chance, independently: one hash of its key decides
    to how many, by the binomial distribution, and seeds the choice of which. The work
    grows with the rows and with the few memberships, whatever the size of the table.
    """
    rate = min(1.0, 2.0 * sample / rows)
    chance, upto = (1 - rate) ** TREES, []
    for k in range(TREES):
        upto.append(chance)
        chance = chance * (TREES - k) / (k + 1) * rate / (1 - rate) if rate < 1 else 0.0
    limits = np.cumsum(upto)

    @F.pandas_udf("array<int>")
    def trees_of(code: pd.Series) -> pd.Series:
        codes = code.to_numpy().astype("uint64")
        counts = np.searchsorted(limits, (codes >> np.uint64(11)) / float(1 << 53), side="right")
        return pd.Series(
            [
                np.random.default_rng(c).choice(TREES, n, replace=False) if n else []
                for c, n in zip(codes.tolist(), counts.tolist())
            ]
        )

    def hashed(*salt: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(key), *salt), 11) / float(1 << 53)

    point = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs])
    trees = F.explode(trees_of(F.xxhash64(F.lit(SEED), F.col(key)))).alias("tree")
    drawn = features.select(F.col(key), point.alias("point"), trees)
    return drawn.select(hashed(F.col("tree")).alias("h"), F.col(key).alias("key"), "point", "tree")


def _grow(sample: int):
    """A function that turns the candidates of one tree into its nodes."""
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(drawn: pd.DataFrame) -> pd.DataFrame:
        tree = int(drawn["tree"].iloc[0])
        chosen = drawn.sort_values(["h", "key"]).head(sample)
        points = np.stack(chosen["point"].to_numpy())
        rng = np.random.default_rng([SEED, tree])
        nodes, waiting = [], [(0, np.arange(len(points)), 0)]
        free = 1
        while waiting:
            node, members, depth = waiting.pop()
            low, high = points[members].min(axis=0), points[members].max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(varied) == 0:
                # A leaf sends everything to itself.
                length = depth + _average_path(len(members))
                nodes.append((tree, node, 0, np.inf, node, node, length))
                continue
            feature = int(rng.choice(varied))
            part = rng.random()
            split = (1 - part) * low[feature] + part * high[feature]
            # Between neighbouring numbers rounding may reach the upper one.
            split = float(np.clip(split, low[feature], np.nextafter(high[feature], low[feature])))
            below = points[members, feature] <= split
            nodes.append((tree, node, feature, split, free, free + 1, 0.0))
            waiting += [(free, members[below], depth + 1), (free + 1, members[~below], depth + 1)]
            free += 2
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])

    return grow


def _scorer(features: DataFrame, forest: pd.DataFrame, sample: int):
    """A vectorised column function giving each row's strength in whole billionths."""
    trees = [
        (
            tree["feature"].to_numpy(dtype="int64"),
            tree["split"].to_numpy(),
            tree[["low", "high"]].to_numpy(dtype="int64").ravel(),
            tree["length"].to_numpy(),
        )
        for _, tree in forest.sort_values("node").groupby("tree")
    ]
    shared = features.sparkSession.sparkContext.broadcast(trees)
    depth = int(np.ceil(np.log2(max(sample, 2))))
    usual = _average_path(sample)

    @F.pandas_udf("bigint")
    def strength(points: pd.DataFrame) -> pd.Series:
        values = points.to_numpy(dtype="float64").ravel()
        first = np.arange(len(points)) * points.shape[1]
        total = np.zeros(len(points))
        for feature, split, children, length in shared.value:
            node = np.zeros(len(points), dtype="int64")
            for _ in range(depth):
                above = values.take(first + feature.take(node)) > split.take(node)
                node = children.take(2 * node + above)
            total += length.take(node)
        return pd.Series(np.rint(2.0 ** (-total / len(shared.value) / usual) * _UNIT).astype("int64"))

    return strength


def isolation_forest(
    features: DataFrame, key: str, inputs: Sequence[str], contamination: float = 0.05
) -> DataFrame:
    """``features`` with ``is_anomaly`` and ``anomaly_score`` (lower is stranger), strangest first.

    A row is flagged when it is stranger than the ``contamination`` quantile of all
    rows. Below ten rows nothing is flagged and every score is 0.
    """
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    features = written(features, "features")
    rows = features.count()
    if rows < MIN_ROWS:
        flags = {"is_anomaly": F.lit(False), "anomaly_score": F.lit(0.0)}
        return features.withColumns(flags).orderBy(key)

    sample = min(SAMPLE, rows)
    drawn = _draw(features, key, inputs, sample, rows)
    # At most TREES * (2 * SAMPLE - 1) nodes, independent of the number of rows.
    forest = drawn.groupBy("tree").applyInPandas(_grow(sample), _NODES).toPandas()

    strength = _scorer(features, forest, sample)
    point = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in inputs])
    scored = written(features.withColumn("strength", strength(point)), "scored")
    threshold = (
        exact_percentiles(scored, "strength", {"q": 1.0 - contamination}, bits=_BUCKET_BITS)
        .select("q")
        .scalar()
    )
    margin = (F.col("threshold") - F.col("strength")) / _UNIT
    return (
        scored.withColumn("threshold", threshold)
        .withColumn("is_anomaly", F.col("strength") > F.col("threshold"))
        .withColumn("anomaly_score", F.bround(margin, 4))
        .drop("strength", "threshold")
        .orderBy("anomaly_score", key)
    )


def session_anomalies(events: DataFrame, contamination: float = 0.05) -> DataFrame:
    """All sessions, with those of unusual cost, tokens, activity or duration flagged."""
    return isolation_forest(session_features(events), "session_id", SESSION_INPUTS, contamination)


def user_anomalies(events: DataFrame, contamination: float = 0.05) -> DataFrame:
    """All users, with those of unusual overall spending flagged."""
    features = user_features(events).drop("avg_prompt_len")
    return isolation_forest(features, "user_email", USER_INPUTS, contamination)
