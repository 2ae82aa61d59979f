"""Quality and toxicity: held-out accuracy on the given tables, the discriminant's arithmetic."""

import random

import numpy as np
import pytest

from tests.conftest import SF
from usagelens.llm import quality, registry, toxicity
from usagelens.llm.tables import table


@pytest.mark.parametrize("name, column", [("op7_quality", "quality"), ("op9_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    folder = SF.replace("sf0.001", "sf0.1")
    rows = registry.queries()[name](spark, folder)
    assert rows.count() == table(spark, folder, "documents").count()
    labels = table(spark, folder, "labels")
    held = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert held["score"].between(0, 1).all()
    right = held["predicted"] == held[column]
    assert right.mean() > 0.96
    assert right[held[column] == 1].mean() > 0.92


def test_scores_follow_the_densities():
    rng = np.random.default_rng(1)
    one, zero = rng.normal(0, 1, (500, 3)), rng.normal(3, 2, (400, 3))
    both = [zero, one]
    n = np.array([len(x) for x in both], float)
    sums = np.stack([x.sum(0) for x in both])
    squares = np.stack([x.T @ x for x in both])
    model = quality.from_moments(n, sums, squares, shrink=0.0, pool=0.0)
    x = rng.normal(1, 2, (50, 3))

    def density(data):
        mean, cov = data.mean(0), np.cov(data.T, bias=True) + 1e-3 * np.eye(3)
        d = x - mean
        far = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        return -0.5 * far - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len(data) + 1) / 902)

    want = 1 / (1 + np.exp(density(zero) - density(one)))
    assert np.allclose(model.score(x), want)


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1)], [(0, 0), (1, 1), (2, None), (3, 7)]])
def test_awkward_texts_and_labels(spark, awkward, labels):
    known = spark.createDataFrame(labels, "doc_id long, label int")
    model = quality.fit(awkward, known)
    rows = quality.scored(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r["quality_score"] <= 1 for r in rows)
    scores = [r["toxic_score"] for r in toxicity.scored(awkward, toxicity.fit(awkward, known)).collect()]
    assert len(scores) == awkward.count() and all(0 <= s <= 1 for s in scores)


def test_no_rows(spark, make_docs):
    empty = make_docs([])
    known = spark.createDataFrame([], "doc_id long, label int")
    assert quality.scored(empty, quality.fit(empty, known)).count() == 0
    assert toxicity.scored(empty, toxicity.fit(empty, known)).count() == 0


def test_unseen_misspellings_are_near(words):
    """Words that share a stem with toxic ones are toxic though never seen."""
    import random

    rng = random.Random(3)
    bags, labels = [], []
    for i in range(400):
        bag = set(words(rng, 60).split())
        if i % 2:
            bag |= {"zorblat" + "".join(rng.choices("aeiou", k=2)) for _ in range(2)}
        bags.append(bag)
        labels.append(i % 2)
    model = toxicity.train(bags, np.array(labels, float))
    unseen, plain = model.word_logits(["zorblatyy", "qmenlop"])
    assert unseen > 5 * abs(plain)


def _toxic_sample(toxic, clean, n, seed):
    rng = random.Random(seed)
    weights = [1 / (i + 10) for i in range(len(clean))]
    bags, labels = [], []
    for label in (0, 1):
        for _ in range(n):
            words = rng.choices(clean, weights=weights, k=rng.randint(30, 90))
            bags.append(set(words + (rng.sample(toxic, 2) if label else [])))
            labels.append(label)
    return bags, np.array(labels, float)


@pytest.mark.parametrize("kinds", [20, 100, 200])
def test_toxic_vocabularies_of_any_size(kinds):
    rng = random.Random(99)
    words = sorted({"".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(4, 9))) for _ in range(3200)})
    rng.shuffle(words)
    model = toxicity.train(*_toxic_sample(words[:kinds], words[kinds:], 1500, 1))
    bags, labels = _toxic_sample(words[:kinds], words[kinds:], 300, 2)
    logits = [model.word_logits(sorted(b)).sum() / (len(b) + toxicity.SMOOTH) + model.bias for b in bags]
    flagged = 1 / (1 + np.exp(-np.array(logits))) >= 0.3
    assert flagged[labels == 1].mean() >= 0.85 and flagged[labels == 0].mean() <= 0.05


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    up = toxicity._Mean(rng.integers(0, 6, 20), rng.integers(0, 5, 20), np.full(5, 0.3), 6, 5)
    pool = toxicity._Mean(rng.integers(0, 5, 15), rng.integers(0, 4, 15), np.full(4, 0.2), 5, 4)
    labels, share = np.array([0.0, 1, 1, 0]), np.array([0.2, 0.3, 0.1, 0.4])
    rarity = rng.random((6, 1)).astype(np.float32)
    weights = {
        "table": rng.normal(0, 0.1, (6, 8)).astype(np.float32),
        "out": rng.normal(0, 0.1, 8).astype(np.float32),
        "bias": np.array([0.1], np.float32),
    }
    rest = (up, pool, rarity, labels, share)
    gradient = toxicity._gradient(weights, *rest)
    for name, values in weights.items():
        for at in np.ndindex(values.shape):
            moved = []
            for step in (0.01, -0.01):
                other = {k: v.astype(np.float64).copy() for k, v in weights.items()}
                other[name][at] += step
                moved.append(toxicity._loss_and_error(other, *rest)[0])
            assert gradient[name][at] == pytest.approx((moved[0] - moved[1]) / 0.02, abs=2e-3)
