"""Text quality by a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Spark sums the moments of
the labelled rows per class; from these few figures the class means and covariances
follow, the covariances shrunk towards their diagonal and their pooled form. A score is
the logistic of the difference of the two Gaussian log-densities, each from a
Mahalanobis distance through a Cholesky factor that is computed once.
"""

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.tables import map_columns, texts

#: Statistics of a text, in the order of its vector.
STATISTICS = (
    "words",
    "word_length",
    "distinct_words",
    "distinct_pairs",
    "stutter",
    "capitals",
    "letters_only",
    "symbols",
    "digits",
    "lines",
    "loops",
)

_SYMBOLS = "!#$%&*+/<=>@\\^_|~{}[]"


def _log_share(count: float, total: float) -> float:
    """Log of a share, drawn towards one in fifty while the total is small."""
    return math.log((count + 0.4) / (total + 20))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; an empty one is all constants."""
    words = text.split()
    n, chars = len(words), len(text)
    pairs = list(zip(words, words[1:]))
    kinds, pair_kinds = len(set(words)), len(set(pairs))
    return [
        math.log1p(n),
        math.log1p(sum(map(len, words)) / max(n, 1)),
        math.log1p(kinds) / math.log(n + 2),
        math.log1p(pair_kinds) / math.log(n + 2),
        _log_share(sum(map(eq, words, words[1:])), n),
        _log_share(sum(map(str.isupper, words)), n),
        _log_share(n - sum(map(str.isalpha, words)), n),
        _log_share(sum(map(text.count, _SYMBOLS)), chars),
        _log_share(sum(map(text.count, "0123456789")), chars),
        _log_share(text.count("\n"), n),
        _log_share(max(0, n - 1 - pair_kinds), n),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors, log-determinants and log-priors."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """Probability-like scores of rows of ``vectors``, higher for class 1."""
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = (vectors - mean) @ factor.T
            density.append(offset - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def from_moments(
    n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float, pool: float
) -> Discriminant:
    """The model from per-class counts, sums and sums of products.

    A class without rows takes the other's shape, so that scores stay defined; with no
    labelled row at all every score is one half.
    """
    size = sums.shape[1]
    if n.sum() == 0:
        return Discriminant(np.zeros((2, size)), np.stack([np.eye(size)] * 2), np.zeros(2))
    known = np.maximum(n, 1)[:, None]
    means = np.where(n[:, None] > 0, sums / known, sums.sum(0) / n.sum())
    scatter = squares - n[:, None, None] * means[:, :, None] * means[:, None, :]
    common = scatter.sum(0) / n.sum()
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - pool) * scatter[c] / max(n[c], 1) + pool * common if n[c] else common
        diagonal = np.diag(np.diag(cov))
        cov = (1 - shrink) * cov + shrink * diagonal + 1e-3 * np.eye(size)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        prior = math.log((n[c] + 1) / (n.sum() + 2))
        offsets.append(prior - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.stack(factors), np.array(offsets))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every text."""

    def run(batch):
        rows = [statistics(t) for t in batch["text"]]
        return {"doc_id": batch["doc_id"]} | dict(zip(STATISTICS, map(list, zip(*rows))))

    kinds = ", ".join(f"{c} double" for c in STATISTICS)
    return map_columns(texts(docs), run, f"doc_id long, {kinds}")


def fit(
    docs: DataFrame, labels: DataFrame, shrink: float = 0.2, pool: float = 0.5
) -> Discriminant:
    """Learn from ``labels`` (``doc_id``, ``label`` 0 or 1); other and null labels are ignored.

    All labelled rows count. Only the moments of two classes reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where(
        F.col("label").isin(0, 1)
    )
    size = len(STATISTICS)
    cells = [(i, j) for i in range(size) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)]
    products = [
        F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in cells
    ]
    rows = (
        features(docs)
        .join(known, "doc_id")
        .groupBy("label")
        .agg(F.count("*").alias("n"), *sums, *products)
        .collect()
    )
    n, s, p = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
    for row in rows:
        c = int(row["label"])
        n[c] = row["n"]
        s[c] = [row[f"s{i}"] for i in range(size)]
        for i, j in cells:
            p[c, i, j] = p[c, j, i] = row[f"p{i}_{j}"]
    return from_moments(n, s, p, shrink, pool)


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id`` and ``quality_score`` of every row, from its whole text alone.

    Null and empty texts are scored like any other; repeated rows get equal scores; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batch):
        vectors = np.array([statistics(t) for t in batch["text"]])
        return {"doc_id": batch["doc_id"], "quality_score": model.score(vectors)}

    return map_columns(texts(docs), run, "doc_id long, quality_score double")


def score_column(model: Discriminant):
    """The score as a column function of a text column, for filters that keep all columns."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        vectors = np.array([statistics(t or "") for t in text]).reshape(-1, len(STATISTICS))
        return pd.Series(model.score(vectors))

    return score
