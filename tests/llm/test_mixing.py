"""Mixing: the schedule's deviation, whole results, awkward rows."""

from collections import Counter
from math import isqrt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from usagelens.llm import mixing, registry


@pytest.fixture(scope="module")
def sources(spark):
    sizes = {"a": 900, "b": 400, "c": 90, "d": 7}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string").withColumn(
        "doc_id", F.monotonically_increasing_id()
    )


def _brute(blocks, weights):
    """The source of every slot, slot by slot."""
    used, base, since, out = Counter(), Counter(), 0, []
    left = dict(weights)
    while left:
        total, t = sum(left.values()), len(out)
        ready = [
            (-(-(used[s] - base[s] + 1) * total // w), s)
            for s, w in sorted(left.items())
            if (used[s] - base[s]) * total // w <= t - since
        ]
        s = min(ready)[1]
        used[s] += 1
        out.append(s)
        if used[s] == blocks[s]:
            del left[s]
            base, since = used.copy(), t + 1
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 5.0, "c": 1.5, "d": 0.01}, {"a": 0.5, "b": 0.25, "c": 0.25}])
@pytest.mark.parametrize("block, stretch", [(1, 1024), (4, 3), (64, 1)])
def test_the_schedule_against_a_walk_over_all_slots(sources, weights, block, stretch, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    sizes = {r["source"]: r["n"] for r in sources.groupBy("source").agg(F.count("*").alias("n")).collect()}
    whole = {s: isqrt(n) if weights is None else max(1, round(weights.get(s, 0) * 1e6)) for s, n in sizes.items()}
    rows = mixing.schedule(mixing.sources(sources, weights), block).orderBy("mix_slot").collect()
    order = _brute({s: -(-n // block) for s, n in sizes.items()}, whole)
    assert [r["mix_source"] for r in rows] == order
    assert [r["mix_slot"] for r in rows] == list(range(len(order)))
    seen, start = Counter(), 0
    for r in rows:
        assert (r["mix_block"], r["mix_start"]) == (seen[r["mix_source"]], start)
        start += min(block, sizes[r["mix_source"]] - seen[r["mix_source"]] * block)
        seen[r["mix_source"]] += 1


def test_every_document_has_one_place(sources):
    rows = mixing.mixed(sources, block=4).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in rows] == list(range(sources.count()))
    assert [r["mix_slot"] for r in rows] == sorted(r["mix_slot"] for r in rows)
    for r, after in zip(rows, rows[1:]):
        if r["mix_slot"] == after["mix_slot"]:
            assert (r["source"], r["mix_block"]) == (after["source"], after["mix_block"])


def test_awkward_rows(awkward, make_docs):
    rows = mixing.mixed(awkward).collect()
    assert sorted(r["mix_position"] for r in rows) == list(range(awkward.count()))
    ordered = mixing.in_order(awkward)
    assert ordered.columns == [c for c in awkward.columns if c != "mix_position"]
    assert ordered.count() == awkward.count()
    assert mixing.mixed(make_docs([])).count() == 0


def test_no_python_in_the_plan(awkward, capsys):
    mixing.mixed(awkward).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_the_registered_query_keeps_to_its_weights(spark):
    rows = registry.op10_mixing(spark, SF).orderBy("position").collect()
    counts = Counter(r["source"] for r in rows)
    blocks = {s: -(-n // mixing.BLOCK) for s, n in counts.items()}
    w = {s: isqrt(n) for s, n in counts.items()}
    slots = sorted({(r["slot"], r["source"]) for r in rows})
    assert [t for t, _ in slots] == list(range(sum(blocks.values())))
    seen = Counter()
    for t, source in slots:
        seen[source] += 1
        assert all(abs(seen[s] - (t + 1) * w[s] / sum(w.values())) < 1 for s in w)
        if seen[source] == blocks[source]:
            break


@pytest.mark.parametrize("weights", [None, {"s0": 0.5, "s1": 0.0004} | {f"s{i}": 0.026 for i in range(2, 20)}])
def test_no_drift_from_the_given_weights_over_many_periods(spark, weights):
    """Prefixes while all sources last, against the exact ratios, over many stretches."""
    counts = {f"s{i}": 1600 if i == 0 else 150 for i in range(20)}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    w = weights or {s: isqrt(n) for s, n in counts.items()}
    total, seen, last = sum(w.values()), Counter(), 0
    out = mixing.mixed(docs, weights=weights, block=1).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in out] == list(range(len(rows)))
    assert [r["mix_slot"] for r in out] == list(range(len(rows)))
    for done, r in enumerate(out, 1):
        assert r["mix_block"] == seen[r["source"]]
        seen[r["source"]] += 1
        assert all(abs(seen[s] - done * w[s] / total) < 1 + 1e-6 for s in counts)
        last = done
        if any(seen[s] == counts[s] for s in counts):
            break
    assert last > 60 * 16
