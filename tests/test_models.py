"""Outlier models, user segments and statistics against planted data and brute force."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from usagelens.functions.stats import exact_percentiles, student_t_two_sided
from usagelens.operators import forecast, outliers, reshape, segments, sessions

INPUTS = ("a", "b", "c")


def planted(spark, partitions=4):
    """500 ordinary rows and five far away, keys o0 … o4."""
    rng = random.Random(7)
    rows = [(f"k{i}", *[10 + rng.random() for _ in INPUTS]) for i in range(500)]
    rows += [(f"o{i}", *[200.0 + i for _ in INPUTS]) for i in range(5)]
    schema = "key string, " + ", ".join(f"{c} double" for c in INPUTS)
    return spark.createDataFrame(rows, schema).repartition(partitions)


def test_planted_outliers_score_lowest(spark):
    scored = outliers.isolation_forest(planted(spark), "key", INPUTS, 0.05).collect()
    assert len(scored) == 505
    assert {r.key for r in scored[:5]} == {f"o{i}" for i in range(5)}
    flagged = [r for r in scored if r.is_anomaly]
    assert 5 <= len(flagged) <= math.ceil(0.05 * 505)
    assert all(r.anomaly_score <= 0 for r in flagged)
    assert [r.anomaly_score for r in scored] == sorted(r.anomaly_score for r in scored)


def test_forest_does_not_depend_on_partitions(spark):
    results = [
        [tuple(r) for r in outliers.isolation_forest(planted(spark, n), "key", INPUTS).collect()]
        for n in (1, 16)
    ]
    assert results[0] == results[1]


def test_every_tree_gets_its_sample_from_a_large_table(spark):
    """About twice the sample each; trees draw independently, a row at most once each."""
    rows = 200_000
    keys = spark.range(rows).select(F.col("id").cast("string").alias("key"), F.lit(1.0).alias("a"))
    drawn = outliers._draw(keys, "key", ("a",), outliers.SAMPLE, rows).persist()
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == outliers.TREES
    assert min(sizes) >= outliers.SAMPLE and max(sizes) < 3 * outliers.SAMPLE
    assert drawn.select("key", "tree").distinct().count() == sum(sizes)
    assert drawn.select("key").distinct().count() < sum(sizes)
    drawn.unpersist()


def test_few_rows_are_never_flagged(spark):
    scored = outliers.isolation_forest(planted(spark).limit(9), "key", INPUTS).collect()
    assert len(scored) == 9
    assert {(r.is_anomaly, r.anomaly_score) for r in scored} == {(False, 0.0)}


def test_equal_rows_are_not_flagged(spark):
    ones = [F.lit(1.0).alias(c) for c in INPUTS]
    same = spark.range(50).select(F.col("id").cast("string").alias("key"), *ones)
    assert not any(r.is_anomaly for r in outliers.isolation_forest(same, "key", INPUTS).collect())


@pytest.mark.parametrize("contamination", [0.0, 0.6])
def test_contamination_is_checked(spark, contamination):
    with pytest.raises(ValueError):
        outliers.isolation_forest(planted(spark), "key", INPUTS, contamination)


def grouped_events(make_events, per_group):
    """Users of three kinds: dear callers, heavy prompters, idle ones."""
    rows = []
    for group, (calls, prompts, cost) in enumerate([(20, 1, 5.0), (1, 20, 0.1), (1, 1, 0.1)]):
        for user in range(per_group):
            who = {"user_email": f"g{group}-{user}", "session_id": f"s{group}-{user}"}
            rows += [{**who, "event_name": "api_request", "cost_usd": cost}] * calls
            rows += [{**who, "event_name": "user_prompt", "prompt_length": 10}] * prompts
    return make_events(rows)


def test_segments_recover_groups(spark, make_events):
    result = segments.user_engagement_clusters(grouped_events(make_events, 20), 3).collect()
    labels = {}
    for row in result:
        labels.setdefault(row.user_email.split("-")[0], set()).add(row.cluster)
    assert all(len(found) == 1 for found in labels.values())
    assert len(set.union(*labels.values())) == 3
    assert labels["g0"] == {0}


def spread_users(spark):
    """400 users in one plane, with repeated points, one far away and one feature that is constant."""
    rng = random.Random(17)
    rows = [(f"u{i}", rng.randrange(9), rng.randrange(40), 3, rng.expovariate(1), rng.random()) for i in range(399)]
    rows.append(("far", 2, 5, 3, 5000.0, 0.5))
    return spark.createDataFrame(rows, "user_email string, sessions long, api_calls long, prompts long, "
                                 "total_cost double, avg_prompt_len double")


def test_segment_rounds_equal_numpy(spark):
    """Draws and rounds under 1, 4 and 16 partitions against a plain loop over the users."""
    users = spread_users(spark)
    points, n = segments._scaled(users)
    names = [r.user_email for r in points.orderBy("user_email").collect()]
    z = np.array([[r[f"z{j}"] for j in range(5)] for r in points.orderBy("user_email").collect()])
    assert n == 400 and (z[:, 2] == 0).all()
    centres = []
    for step in range(4):
        u = [int(hashlib.md5(f"43:{step}:{who}".encode()).hexdigest()[:13], 16) + 0.5 for who in names]
        time = -np.log(np.array(u) / 2**52)
        if centres:
            weight = np.min([((z - c) ** 2).sum(axis=1) for c in centres], axis=0)
            time = np.where(weight > 0, time / np.maximum(weight, 1), np.inf)
        centres.append(tuple(int(v) for v in z[time.argmin()]))
    away = np.stack([((z - c) ** 2).sum(axis=1) for c in centres], axis=1)
    label = away.argmin(axis=1)
    means = [tuple(int(v) for v in z[label == i].sum(axis=0) // (label == i).sum()) for i in range(4)]
    for partitions in (1, 4, 16):
        some = points.repartition(partitions)
        drawn = segments._first_centres(some, 4)
        assert drawn[1] == centres
        cost, moved = segments._moved(some, dict(enumerate(drawn)))[1]
        assert cost == away.min(axis=1).sum() and moved == means


def test_segments_of_equal_users(make_events):
    rows = [{"user_email": f"u{i}", "event_name": "user_prompt", "prompt_length": 7} for i in range(6)]
    result = segments.user_engagement_clusters(make_events(rows), 4).collect()
    assert len(result) == 6 and len({r.cluster for r in result}) == 1


def test_fewer_users_than_segments(spark, make_events):
    result = segments.user_engagement_clusters(grouped_events(make_events, 1), 4)
    assert {r.cluster for r in result.collect()} == {0}
    assert reshape.cluster_summary(result).first().users == 3


def test_percentiles_match_numpy_on_a_hot_value(spark):
    rng = random.Random(3)
    values = [int(rng.expovariate(0.0001)) for _ in range(3000)] + [777] * 2000
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    rows = [(i % 3 if i % 5 else None, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, v bigint").repartition(7)
    whole = exact_percentiles(df, "v", wanted).first()
    for name, p in wanted.items():
        assert whole[name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert whole.n == len(values)
    assert whole.mean == pytest.approx(np.mean(values))
    assert whole["std"] == pytest.approx(np.std(values, ddof=1))
    for row in exact_percentiles(df, "v", wanted, keys=["g"], bits=4).collect():
        group = [v for g, v in rows if g == row.g]
        assert row.n == len(group)
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(group, p), rel=1e-12)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v bigint")
    assert exact_percentiles(empty, "v", {"p": 0.5}).first().n is None


def test_p_value_equals_regression(spark):
    rng = random.Random(5)
    for n, slope in ((6, 0.5), (40, 0.1), (301, 0.02)):
        pairs = [(float(x), slope * x + rng.gauss(0, 5)) for x in range(n)]
        df = spark.createDataFrame(pairs, "x double, y double")
        r = df.stat.corr("x", "y")
        features = VectorAssembler(inputCols=["x"], outputCol="f").transform(df)
        fit = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(features)
        assert student_t_two_sided(r, n) == pytest.approx(fit.summary.pValues[0], abs=1e-9)


@pytest.mark.parametrize(
    "r, n, p", [(1.0, 10, 0.0), (0.0, 10, 1.0), (None, 10, None), (0.5, 2, None), (0.9, 10**9, 0.0)]
)
def test_p_value_limits(r, n, p):
    assert student_t_two_sided(r, n) == p


def pairs_as_events(make_events, pairs):
    rows = []
    for i, (length, cost) in enumerate(pairs):
        rows.append({"session_id": f"s{i}", "event_name": "user_prompt", "prompt_length": length})
        rows.append({"session_id": f"s{i}", "event_name": "api_request", "cost_usd": cost})
    return make_events(rows)


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([(i, 2.0 * i) for i in range(4)], (None, None, 4, None)),
        ([(7, float(i)) for i in range(6)], (None, None, 6, None)),
        ([(i, 2.0 * i) for i in range(6)], (1.0, 0.0, 6, "Strong positive")),
        ([(i, 100.0 - i) for i in range(6)], (-1.0, 0.0, 6, "Negative")),
    ],
)
def test_correlation_guards(make_events, pairs, expected):
    row = sessions.prompt_cost_correlation(pairs_as_events(make_events, pairs)).first()
    assert (row.correlation, row.p_value, row.n, row.interpretation) == expected


def daily(make_events, costs):
    return make_events(
        [
            {
                "event_name": "api_request",
                "event_timestamp": f"2024-03-{day:02d}T10:00:00.000Z",
                "cost_usd": cost,
                "input_tokens": 1,
                "output_tokens": 1,
            }
            for day, cost in costs.items()
        ]
    )


def test_forecast_needs_three_days(make_events):
    two = daily(make_events, {1: 1.0, 2: 2.0})
    assert forecast.cost_forecast(two).count() == 0
    assert forecast.cost_forecast_fit(two).count() == 0


def test_forecast_of_a_line_with_a_gap(make_events):
    line = daily(make_events, {1: 3.0, 2: 5.0, 5: 11.0})
    fit = forecast.cost_forecast_fit(line).first()
    assert (fit.r2, fit.slope_per_day, fit.intercept) == (1.0, 2.0, 3.0)
    rows = [(str(r.date), r.cost_usd, r.type) for r in forecast.cost_forecast(line, 2).collect()]
    assert [r[0] for r in rows] == ["2024-03-01", "2024-03-02", "2024-03-05", "2024-03-06", "2024-03-07"]
    assert [round(r[1], 9) for r in rows] == [3.0, 5.0, 11.0, 13.0, 15.0]
    assert [r[2] for r in rows] == ["actual"] * 3 + ["forecast"] * 2


def test_forecast_stays_above_zero(make_events):
    falling = daily(make_events, {1: 10.0, 2: 5.0, 3: 0.5})
    ahead = forecast.cost_forecast(falling, 5).where("type = 'forecast'").collect()
    assert [r.cost_usd for r in ahead] == [0.0] * 5


def test_token_forecast_of_equal_days(make_events):
    flat = daily(make_events, {1: 1.0, 2: 1.0, 3: 1.0})
    assert forecast.token_forecast_fit(flat).first().r2 == 1.0
    assert {r.total_tokens for r in forecast.token_forecast(flat, 3).collect()} == {2.0}


def test_neighbouring_numbers_split():
    """A split between two adjacent doubles leaves a row on either side."""
    low = 1.0
    high = float(np.nextafter(low, 2.0))
    drawn = pd.DataFrame({"h": [0.1, 0.2], "key": ["a", "b"], "point": [[low], [high]]})
    for tree in range(200):
        nodes = outliers._grow(256)(drawn.assign(tree=tree))
        assert len(nodes) == 3
