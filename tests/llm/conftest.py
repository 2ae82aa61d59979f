"""Awkward documents that every operator must take."""

import random

import pytest

#: Columns of ``documents`` and others whose names the operators use inside.
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, start long, score double, "
    "node long, key string, bucket long, spans string, mix_position long, run long, label int"
)


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows; the other columns hold noise or null."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = (*row, None)[:3]
            noise = (i, 0.5, i, "k", -i, "s", i, i, i % 2) if i % 2 else (None,) * 9
            full.append((doc_id, text, "en", source, None if text is None else len(text), *noise))
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture
def awkward(make_docs):
    """Null, empty, blank, tiny, long, repeated and unusual texts; a null id; repeated rows."""
    rng = random.Random(5)
    plain = [(i, _words(rng, 80), f"s{i % 3}") for i in range(20)]
    copy = plain[0][1]
    long = " ".join(_words(rng, 20) + "." for _ in range(3000))
    return make_docs(
        [
            *plain,
            (20, None, "s0"),
            (21, "", None),
            (22, "  \n\t ", "s1"),
            (23, "a", "s1"),
            (24, long, "s2"),
            (25, copy, "s2"),
            (25, copy, "s2"),
            (None, copy, None),
            (26, "mail x@y.org \U0001f600 éè \x00 +1 (555) 555-0100", "s1"),
            (27, "x" * 5000, "s1"),
        ]
    )


@pytest.fixture
def words():
    return _words
