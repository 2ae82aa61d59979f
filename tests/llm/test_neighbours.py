"""Nearest neighbours: recall against brute force, copies, awkward vectors."""

import numpy as np
import pytest

from usagelens.llm import neighbours


@pytest.fixture
def make_vectors(spark):
    def make(rows):
        kinds = "vec_id long, embedding array<float>, label int, node long, sim double"
        return spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], kinds)

    return make


def _check(rows, vectors, every, k):
    """Recall by score; ranks, scores and ties are exact."""
    ids = np.array([i for i, _ in vectors])
    table = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == [i for i in ids.tolist() if i % every == 0]
    hits = total = 0
    for q, mine in found.items():
        mine.sort()
        at = int(np.flatnonzero(ids == q)[0])
        scores = table @ table[at]
        others = [(-s, i) for s, i in zip(scores, ids.tolist()) if i != q]
        want = sorted(others)[:k]
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        assert len({i for _, i, _ in mine} | {q}) == len(mine) + 1
        assert mine == sorted(mine, key=lambda x: (-x[2], x[1]))
        for _, i, s in mine:
            assert abs(s - scores[ids == i][0]) < 1e-9
        hits += sum(s >= -want[-1][0] - 1e-9 for _, _, s in mine)
        total += len(want)
    return hits / total


def test_recall(make_vectors):
    rng = np.random.default_rng(51)
    centres = rng.normal(size=(6, 24))
    points = centres[rng.integers(0, 6, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    vectors = [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    rows = neighbours.nearest(make_vectors(vectors)).collect()
    assert _check(rows, vectors, 20, 20) >= 0.95


def test_many_copies_of_one_vector(make_vectors):
    rng = np.random.default_rng(52)
    one = rng.normal(size=8).tolist()
    vectors = [(i, one if i % 3 else rng.normal(size=8).tolist()) for i in range(200)]
    rows = neighbours.nearest(make_vectors(vectors)).collect()
    assert _check(rows, vectors, 20, 20) >= 0.95


def test_awkward_vectors(make_vectors):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (40, [-1.0, 0.5])]
    bad = [(60, None), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [nan, 1.0]), (5, [inf, 1.0])]
    odd = [(140, []), (160, [1.0, 2.0, 3.0])]
    rows = neighbours.nearest(make_vectors([*good, *bad, *odd])).collect()
    assert _check(rows, good, 20, 20) == 1
    repeated = neighbours.nearest(make_vectors([*good, good[0]])).collect()
    assert sorted(repeated) == sorted(rows)
    assert neighbours.nearest(make_vectors([])).count() == 0
    assert neighbours.nearest(make_vectors([(0, [1.0])])).count() == 0


def test_tables_that_grow_are_not_broadcast(make_vectors, monkeypatch):
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    written = neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, *label: written(planned(df), *label))
    rng = np.random.default_rng(53)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows = planned(neighbours.nearest(make_vectors(vectors))).collect()
    assert _check(rows, vectors, 20, 20) >= 0.95
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
