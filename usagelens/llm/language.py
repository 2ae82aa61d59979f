"""Language identification by the nearest of several centroids per language.

A text is the vector of its character n-grams, hashed to buckets: damped counts times
inverse document frequencies, of unit length. Document frequencies are counted over all
learning rows. The vectors of a bounded sample of each language are clustered by cosine,
each language in a task of its own; the unit means of its clusters are its centroids. A
text takes the language of the centroid with the largest cosine, and is marked as rejected
where that cosine lies below what nearly all members of the cluster have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.tables import arrow_schema, map_columns

LONGEST, BUCKET_BITS = 3, 14
BUCKETS = 1 << BUCKET_BITS
#: Rows of each language that the centroids are fitted on, at most (by hash of id and text).
SAMPLE = 1000
CENTROIDS, CLUSTER_ROUNDS = 4, 8
#: Share of a cluster's members below whose cosine a text is rejected.
TAIL = 0.01
#: What is predicted for a text without a letter.
UNDETERMINED = "und"
#: Characters of a text that are hashed at a time.
_PIECE = 1 << 20
#: How much more than the sample is drawn before it is cut to size.
_SURPLUS = 2
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BREAKS = re.compile(r"[\s\d_!-/:-@\[-`{-~\u2000-\u206f]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the 1- to 3-grams of the lowered text's words.

    Digits, punctuation and white space are one blank. The text is hashed in pieces that
    overlap by the longest n-gram less one, so its length does not matter.
    """
    plain = f" {_BREAKS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    hits = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(codes), _PIECE):
        rolled = piece = codes[start : start + _PIECE + LONGEST - 1].astype(np.uint64)
        own = min(_PIECE, len(codes) - start)
        for n in range(1, LONGEST + 1):
            if n > 1:
                rolled = rolled[: len(piece) - n + 1] * _MULTIPLIER + piece[n - 1 :]
            mixed = (rolled[:own] ^ np.uint64(n)) * _MIXER
            hits += np.bincount((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
    return hits


def unit_vector(hits: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that are hit and their weights, of length one."""
    at = np.flatnonzero(hits)
    weights = ((1 + np.log(hits[at])) * idf[at]).astype(np.float32)
    return at, weights / max(float(np.sqrt((weights * weights).sum())), 1e-12)


@dataclass(frozen=True)
class Model:
    """Centroids as columns, their languages and least cosines, and the idf of each bucket."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine of its nearest centroid, and whether that is too far."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        at, weights = unit_vector(counts(text), self.idf)
        cosines = weights @ self.centroids[at]
        best = int(cosines.argmax())
        near = float(min(max(cosines[best], 0.0), 1.0))
        return self.languages[best], near, near < self.least[best]


def inverse_frequencies(docs: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """``ln((1 + documents) / (1 + documents with the bucket)) + 1``, and rows per language.

    Each task sums its own rows; at most one figure per bucket and language is collected.
    """
    schema = "bucket long, n long"
    fields = docs.sparkSession.createDataFrame([], schema).schema
    arrow = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += counts(text) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], schema=arrow)

    found = docs.select("text").mapInArrow(run, fields).groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS)
    for row in found.collect():
        frequency[row["bucket"]] = row["n"]
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    return np.log((1 + sum(sizes.values())) / (1 + frequency)) + 1, sizes


def drawn(docs: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """At most ``sample`` different rows of each language, by the smallest hashes.

    A hash bound that follows from the language's size lets through about twice the sample,
    and equal rows collapse before the shuffle, so no text is shuffled but for these few.
    The bounds are a literal: one figure per language, far less than the model has.
    """
    span = 1 << 40
    bounds = [F.lit(v) for lang, n in sorted(sizes.items())
              for v in (lang, int(span * min(1.0, (_SURPLUS * sample + 20) / n)))]
    if not bounds:
        return docs.select("lang", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("place"), "text").where("false")
    key = F.xxhash64("doc_id", "text")
    placed = docs.withColumn("key", key).withColumn("place", F.pmod("key", F.lit(span)))
    near = placed.where(F.col("place") < F.try_element_at(F.create_map(*bounds), F.col("lang")))
    return near.groupBy("lang", "key", "place").agg(F.first("text").alias("text"))


def cluster(vectors: np.ndarray, k: int, rounds: int = CLUSTER_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and each row's own; seeds are far from earlier seeds by chance."""
    rng = np.random.default_rng(7)
    mean = vectors.sum(axis=0)
    centers = [vectors[int((vectors @ mean).argmax())]]
    for _ in range(min(k, len(vectors)) - 1):
        gap = np.clip(1 - (vectors @ np.array(centers).T).max(axis=1), 0, None) ** 2
        if gap.sum() < 1e-9:
            break
        centers.append(vectors[int(rng.choice(len(vectors), p=gap / gap.sum()))])
    book = np.array(centers)
    for _ in range(rounds):
        own = (vectors @ book.T).argmax(axis=1)
        for c in range(len(book)):
            total = vectors[own == c].sum(axis=0)
            length = float(np.sqrt((total * total).sum()))
            if length > 0:
                book[c] = total / length
    return book, (vectors @ book.T).argmax(axis=1)


def least_cosine(members: np.ndarray) -> float:
    """What nearly all members of a cluster exceed, each against the mean of the others."""
    if len(members) < 2:
        return 0.0
    total = members.sum(axis=0, dtype=np.float64)
    along = members @ total
    others = np.sqrt(np.maximum((total * total).sum() - 2 * along + 1, 1e-12))
    return float(np.quantile((along - 1) / others, TAIL))


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from all rows with a text that has letters and a language (``doc_id``, ``text``, ``lang``).

    Frequencies count every such row. Centroids come from at most ``sample`` rows of each
    language; their vectors have at most one entry per bucket, however long the texts. The
    model grows with the number of languages only. Without any such row the model
    predicts ``und`` for everything. A repeated row counts each time, but is drawn once.
    """
    known = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    idf, sizes = inverse_frequencies(known)

    def vectors(batch):
        pairs = [unit_vector(counts(t), idf) for t in batch["text"]]
        return {
            "lang": batch["lang"],
            "key": batch["key"],
            "place": batch["place"],
            "at": [p[0].astype(np.int32).tobytes() for p in pairs],
            "weights": [p[1].tobytes() for p in pairs],
        }

    def centers(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "key"]).head(sample)
        matrix = np.zeros((len(rows), BUCKETS), np.float32)
        for row, at, weights in zip(matrix, rows["at"], rows["weights"]):
            row[np.frombuffer(at, np.int32)] = np.frombuffer(weights, np.float32)
        book, own = cluster(matrix, centroids)
        least = [least_cosine(matrix[own == c]) for c in range(len(book))]
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[0], "c": range(len(book)), "weights": [b.tobytes() for b in book], "least": least}
        )

    chosen = map_columns(
        drawn(known, sizes, sample), vectors, "lang string, key long, place long, at binary, weights binary"
    )
    found = (
        chosen.groupBy("lang").applyInPandas(centers, "lang string, c int, weights binary, least double").collect()
    )
    found = sorted(found, key=lambda r: (r["lang"], r["c"]))
    matrix = np.array([np.frombuffer(r["weights"], np.float32) for r in found], np.float32)
    return Model(
        idf,
        np.ascontiguousarray(matrix.reshape(len(found), BUCKETS).T),
        [r["lang"] for r in found],
        np.array([r["least"] for r in found]),
    )


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` of every row, from its whole text.

    Of equally near centroids the first language by name counts. Null and empty texts and
    those without a letter are ``und`` with score 0, and so is everything where the model has
    no language. A rejected text keeps the nearest language. Repeated rows get equal
    results; an empty table gives no rows; other columns are ignored.
    """

    def run(batch):
        names, scores, rejected = zip(*map(model.predict, batch["text"]))
        return {"doc_id": batch["doc_id"], "lang_pred": names, "score": scores, "rejected": rejected}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")
