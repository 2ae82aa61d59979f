"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the bag of its character n-grams, hashed to rows of an embedding table, so a
misspelling never seen before shares most vectors with the word it imitates. A text is
the mean over its distinct words. Table and softmax are trained jointly, in numpy, on a
bounded sample of the labelled rows; an n-gram has a vector where its share of texts
differs between the classes by more than chance explains, for either class and however many
there are, and weight decay holds back the rest of the noise. The model is linear after the averaging, so a word
contributes one fixed figure and each task computes it once per distinct word.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.tables import map_columns, texts

#: Rows of each class that the model is trained on, at most (by hash of the id).
SAMPLE = 1500
BUCKET_BITS, WIDTH, EPOCHS, RATE, DECAY = 18, 8, 80, 0.02, 1e-4
BUCKETS = 1 << BUCKET_BITS
#: Standard errors by which an n-gram's shares of the two classes must differ.
EVIDENCE = 3.0
SHORTEST, LONGEST = 4, 6
#: The mean is multiplied by this before the softmax: a text holds few telling words.
SHARPNESS = 40.0
#: Neutral words that every mean includes, so that a short text needs more than a chance resemblance.
SMOOTH = 50
_REMEMBERED = 500_000
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_WORD = r"\w+"


def distinct_words(text: str) -> set[str]:
    return set(re.findall(_WORD, text.lower()))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of ``words``, and for each the position of its word."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    rows, owners, rolled = [], [], codes
    for n in range(2, LONGEST + 1):
        rolled = rolled[: len(codes) - n + 1] * _MULTIPLIER + codes[n - 1 :]
        if n >= SHORTEST:
            inside = word[: len(rolled)] == word[n - 1 :]
            mixed = (rolled[inside] ^ np.uint64(n)) * _MIXER
            rows.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owners.append(word[: len(rolled)][inside])
    return np.concatenate(rows), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """``gram_logit``: each n-gram's vector through the softmax (class 1 less class 0)."""

    gram_logit: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        """The mean over each word's n-grams."""
        if not words:
            return np.zeros(0)
        rows, owners = grams(words)
        sums = np.bincount(owners, self.gram_logit[rows], len(words))
        return sums / np.maximum(np.bincount(owners, minlength=len(words)), 1)


def evidence(bags: list[np.ndarray], gram: np.ndarray, first: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Standard errors between the shares of both classes' texts that hold each n-gram, and its texts.

    ``gram`` lists the n-grams of word ``w`` from ``first[w]`` to ``first[w + 1]``.
    """
    held = np.zeros((2, BUCKETS))
    for bag, label in zip(bags, labels):
        if len(bag):
            held[int(label), np.unique(np.concatenate([gram[first[w] : first[w + 1]] for w in bag]))] += 1
    n = np.array([(labels == c).sum() for c in (0, 1)], float)
    pooled = held.sum(0) / n.sum()
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n).sum())
    return np.abs(held[1] / n[1] - held[0] / n[0]) / error, held.sum(0)


def train(samples: list[set[str]], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit table and softmax by full-batch descent with moments on bags of distinct words.

    Words of a single text teach nothing that carries over and are left out. With one
    class only, or nothing at all, the model is the constant prior.
    """
    prior = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(prior))
    seen = Counter(chain.from_iterable(samples))
    order = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n > 1))}
    bags = [np.array(sorted(order[w] for w in words if w in order), np.int64) for words in samples]
    gram, word_of_gram = grams(list(order)) if order else (np.zeros(0, np.int64),) * 2
    by_word = np.argsort(word_of_gram, kind="stable")
    gram, word_of_gram = gram[by_word], word_of_gram[by_word]
    per_word = np.bincount(word_of_gram, minlength=len(order))
    strength, texts_with = evidence(bags, gram, np.r_[0, np.cumsum(per_word)], labels)
    kept = strength[gram] >= EVIDENCE
    gram, word_of_gram = gram[kept], word_of_gram[kept]
    rows, position = np.unique(gram, return_inverse=True)
    doc_of_word = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    smooth = 1 / np.array([len(s) + SMOOTH for s in samples])
    pool = _Mean(np.concatenate(bags), doc_of_word, smooth, len(order), len(bags))
    up = _Mean(position, word_of_gram, 1 / np.maximum(per_word, 1), len(rows), len(order))
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    rarity = np.sqrt(len(samples) / texts_with[rows]).astype(np.float32)[:, None]

    rng = np.random.default_rng(seed)
    weights = {
        "table": rng.normal(0, 0.01, (len(rows), WIDTH)).astype(np.float32),
        "out": np.full(WIDTH, WIDTH**-0.5, np.float32),
        "bias": np.zeros(1, np.float32),
    }
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}
    for epoch in range(1, EPOCHS + 1):
        gradient = _gradient(weights, up, pool, rarity, labels, share)
        for k, w in weights.items():
            g = gradient[k] + DECAY * w * (k == "table")
            first, second = (0.9 * moments[k][0] + 0.1 * g, 0.99 * moments[k][1] + 0.01 * g * g)
            moments[k] = first, second
            step = first / (1 - 0.9**epoch) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-6)
            weights[k] = w - RATE * (5 if k == "bias" else 1) * step
    full = np.zeros(BUCKETS, np.float32)
    full[rows] = SHARPNESS * (rarity * weights["table"] @ weights["out"])
    return Model(full, float(weights["bias"][0]))


def _loss_and_error(weights, up, pool, rarity, labels, share):
    """The weighted log loss, its slope by each text's logit, and the texts' vectors."""
    mean = pool.forward(up.forward(rarity * weights["table"]))
    logit = np.clip(SHARPNESS * (mean @ weights["out"]) + weights["bias"], -60, 60)
    chance = 1 / (1 + np.exp(-logit))
    loss = -(share * np.log(np.where(labels == 1, chance, 1 - chance))).sum()
    return loss, ((chance - labels) * share).astype(np.float32), mean


def _gradient(weights, up, pool, rarity, labels, share) -> dict[str, np.ndarray]:
    _, error, mean = _loss_and_error(weights, up, pool, rarity, labels, share)
    back = up.backward(pool.backward(error[:, None] * weights["out"][None, :]))
    return {
        "table": SHARPNESS * rarity * back,
        "out": SHARPNESS * (mean.T @ error),
        "bias": error.sum(keepdims=True),
    }


class _Mean:
    """Weighted sums of the rows of ``source`` into ``target``, and the way back."""

    def __init__(self, source, target, weight, n_source: int, n_target: int):
        self.sizes, self.weight = (n_source, n_target), weight.astype(np.float32)[:, None]
        into = np.argsort(target, kind="stable")
        back = np.argsort(source, kind="stable")
        self.into, self.back = source[into].astype(np.int32), target[back].astype(np.int32)
        self.targets, self.into_starts = np.unique(target[into], return_index=True)
        self.sources, self.back_starts = np.unique(source[back], return_index=True)

    def forward(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.sizes[1], values.shape[1]), np.float32)
        if len(self.into):
            out[self.targets] = np.add.reduceat(values[self.into], self.into_starts)
        return out * self.weight

    def backward(self, gradient: np.ndarray) -> np.ndarray:
        out = np.zeros((self.sizes[0], gradient.shape[1]), np.float32)
        if len(self.back):
            weighted = gradient * self.weight
            out[self.sources] = np.add.reduceat(weighted[self.back], self.back_starts)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (``doc_id``, ``label`` 0 or 1); other and null labels are ignored.

    At most ``sample`` ids of each class are used, whole texts, chosen by a hash of the id; of
    rows with equal ids the smallest text. Texts become sets of words on the executors, so
    their length does not matter to the driver, only their vocabulary.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()
    ).distinct()
    picked = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        for c in (0, 1)
    ]
    chosen = (
        texts(docs)
        .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )

    def bags(batch):
        found = [sorted(distinct_words(t)) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "label": batch["label"], "words": found}

    kinds = f"doc_id long, label {chosen.schema['label'].dataType.simpleString()}, words array<string>"
    rows = map_columns(chosen, bags, kinds).toPandas().sort_values(["doc_id", "label"])
    return train([set(w) for w in rows["words"]], rows["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``toxic_score`` (0 to 1) of every row, from its whole text alone.

    A text without words, null or empty, has the score of the bias alone. Repeated rows
    get equal scores; an empty table gives no rows; other columns are ignored.
    """

    def run(batch):
        known = batch_cache
        if len(known) > _REMEMBERED:
            known.clear()
        bags = [distinct_words(t) for t in batch["text"]]
        new = list(set().union(*bags).difference(known))
        known.update(zip(new, model.word_logits(new).tolist()))
        means = [sum(map(known.__getitem__, bag)) / (len(bag) + SMOOTH) for bag in bags]
        logits = np.clip(np.array(means) + model.bias, -700, 700)
        return {"doc_id": batch["doc_id"], "toxic_score": 1 / (1 + np.exp(-logits))}

    batch_cache: dict[str, float] = {}
    return map_columns(texts(docs), run, "doc_id long, toxic_score double")
