"""Language identification: vectors against plain loops, held-out accuracy, rejection, awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from usagelens.llm import language, registry

DOCS = "doc_id long, text string, lang string, score string, bound long, key string, weights int"


def _grams(text):
    """Buckets of all n-grams, one by one in Python numbers."""
    plain = f" {language._BREAKS.sub(' ', text.lower()).strip()} "
    mask, found = (1 << 64) - 1, Counter()
    for n in range(1, language.LONGEST + 1):
        for i in range(len(plain) - n + 1):
            rolled = 0
            for c in plain[i : i + n]:
                rolled = (rolled * int(language._MULTIPLIER) + ord(c)) & mask
            found[((rolled ^ n) * int(language._MIXER) & mask) >> (64 - language.BUCKET_BITS)] += 1
    return found


@pytest.mark.parametrize("text", ["Hello, wörld 12!", "", "a", "x\ud800y", "ab " * 50, "日本語 テキスト"])
def test_counts_against_plain_loops(text, monkeypatch):
    hits = language.counts(text)
    assert dict(enumerate(hits.tolist())) == {b: _grams(text)[b] for b in range(language.BUCKETS)}
    monkeypatch.setattr(language, "_PIECE", 5)
    assert (language.counts(text) == hits).all()


def _sample(rng, lang, n):
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}[lang]
    return " ".join("".join(rng.choices(letters + "e", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(4)
    rows = [(i, _sample(rng, lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return docs, language.fit(docs)


def test_prediction_against_plain_cosines(trained):
    docs, model = trained
    rows = docs.collect()
    frequency = Counter(b for r in rows for b in _grams(r["text"]))
    idf = lambda b: math.log((1 + len(rows)) / (1 + frequency[b])) + 1
    for row in rows[:20]:
        found = {b: (1 + math.log(n)) * idf(b) for b, n in _grams(row["text"]).items()}
        length = math.sqrt(sum(w * w for w in found.values()))
        cosines = [
            sum(w / length * model.centroids[b, c] for b, w in found.items())
            for c in range(len(model.languages))
        ]
        best = max(range(len(cosines)), key=lambda c: cosines[c])
        name, score, _ = model.predict(row["text"])
        assert name == model.languages[best] == row["lang"]
        assert score == pytest.approx(cosines[best], abs=1e-4)
    assert np.linalg.norm(model.centroids, axis=0) == pytest.approx(1, abs=1e-4)
    assert all(1 <= n <= language.CENTROIDS for n in Counter(model.languages).values())


def test_same_model_under_any_partitioning(trained):
    docs, model = trained
    again = language.fit(docs.repartition(11, "text"))
    assert (again.idf == model.idf).all() and (again.centroids == model.centroids).all()


def test_the_sample_is_bounded_and_drawn_from_each_language(trained):
    docs, model = trained
    sizes = {"aa": 60, "bb": 60, "cc": 60}
    few = language.drawn(docs, sizes, 3).groupBy("lang").count().collect()
    assert {r["lang"] for r in few} == set(sizes) and all(r["count"] < 60 for r in few)
    small = language.fit(docs, sample=3)
    assert small.languages and [small.predict(r["text"])[0] == r["lang"] for r in docs.collect()].count(True) >= 175


def test_foreign_text_is_rejected(trained):
    _, model = trained
    rng = random.Random(9)
    assert model.predict("0123 zzzz vvvv wwww yyyy xxxx zvzv")[2]
    kept = [not model.predict(_sample(rng, lang, 30))[2] for lang in ("aa", "bb", "cc") for _ in range(20)]
    assert sum(kept) >= 45


def test_awkward_rows(spark, trained):
    _, model = trained
    texts = [None, "", " \n", "123 !?", "a", "x" * 5000, _sample(random.Random(1), "bb", 200_000), "\x00\U0001f600"]
    rows = [(i, t, "en", "s", 1, "k", 1) for i, t in enumerate(texts)] + [(None, "abc", None, "s", 1, "k", 1)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 3, 7)] == ["und"] * 5
    assert out[6]["lang_pred"] == "bb" and out[None]["lang_pred"] in ("aa", "bb", "cc")
    assert all(0 <= r["score"] <= 1 for r in out.values())
    empty = docs.where("false")
    assert language.identified(empty, language.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs, language.fit(empty)).collect()} == {"und"}
    assert language.fit(docs).languages


def test_held_out_accuracy_of_the_query(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op12_language(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.9 * len(held)
