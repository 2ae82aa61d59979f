"""Vector codes: the trie against brute force, the query's SQL cases, awkward rows."""

import hashlib
import random

import numpy as np
import pytest

from usagelens.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, cells int, part string"


def _brute(vectors, rounds):
    """Codes and codebooks in plain loops over rows of Python numbers."""
    cells = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    width = len(next(iter(cells.values()))) // 16
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(cells[i], p) for i in sorted(cells)[:64]] for p in range(16)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((gap(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            held = {}
            for v in cells.values():
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, parts in held.items():
                books[p][k] = tuple(sum(c) // len(parts) for c in zip(*parts))
    found = {i: [near(cut(v, p), books[p]) for p in range(16)] for i, v in cells.items()}
    codes = {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}
    text = ",".join(str(c) for book in books for e in book for c in e)
    return codes, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("width, n", [(1, 40), (2, 150), (3, 90)])
def test_codes_and_codebooks_against_brute_force(spark, width, n):
    rng = random.Random(width)
    rows = [(i * 3, [round(rng.gauss(0, 0.1), 2) for _ in range(16 * width)], i % 3 or None) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    codes, sha = _brute({r[0]: r[1] for r in rows}, 2)
    sums = {}
    for i, _, label in rows:
        sums[label] = sums.get(label, 0) + codes[i][1]
    out = vector_codes.compressed(docs).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in out} == codes
    assert {r["codebooks_sha256"] for r in out} == {sha}
    assert all(r["label_error"] == sums[r["label"]] for r in out)


@pytest.mark.parametrize("subtree", [1, 3, 1000])
def test_traversal_is_the_same_whatever_is_swept(subtree):
    rng = np.random.default_rng(2)
    parts, book = rng.integers(-4, 4, (400, 4)), rng.integers(-4, 4, (30, 4))
    leaves, place = vector_codes.distinct(parts)
    assert (leaves[place] == parts).all() and len(np.unique(parts, axis=0)) == len(leaves)
    nearest, error = vector_codes.traverse(leaves, book, subtree)
    all_pairs = ((leaves[:, None] - book[None]) ** 2).sum(2)
    assert (nearest == all_pairs.argmin(1)).all() and (error == all_pairs.min(1)).all()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.01 * i for i in range(16)]
    rows = [
        (1, good, 1), (1, good, 1), (2, None, 1), (3, [], 1), (4, [nan] * 16, 1), (5, [inf] * 16, None),
        (6, [None] + good[1:], 1), (7, good[:15], 1), (8, good * 2, 1), (None, good, None), (9, [1e300] * 16, None),
        (10, [-1e300] * 16, 2),
    ]
    docs = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA)
    out = {}
    for r in vector_codes.compressed(docs).collect():
        out.setdefault(r["vec_id"], []).append(r)
    assert set(out) == {1, None, 9, 10} and len(out[1]) == 2
    assert len({r["code"] for r in out[1]}) == 1
    assert vector_codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.compressed(docs.where("vec_id = 3")).count() == 0


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, [((i * 7 + j * 3) % 11) / 50 for j in range(32)], 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(vector_codes.compressed(docs.coalesce(1)).collect())
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    assert sorted(vector_codes.compressed(docs.repartition(9)).collect()) == whole
