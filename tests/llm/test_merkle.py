"""Merkle manifest: against a plain tree, tampering found, awkward rows, spread of places."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from usagelens.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def _hash(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _leaf(row):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])
    return _hash(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _tree(digests):
    """All levels, lowest first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_hash(*low[i : i + 3]) for i in range(0, len(low), 3)])
    return levels


def _steps(levels, i):
    for low in levels[:-1]:
        run = i // 3 * 3
        yield low[run:i], low[i + 1 : run + 3]
        i //= 3


def _brute(rows):
    """Result rows in plain loops."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees[s] = _tree([_leaf(r) for r in by_source[s]])
    top = _tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, row in enumerate(by_source[s]):
            steps = [*_steps(trees[s], i), *_steps(top, j)]
            digest = _leaf(row)
            if row["doc_id"] is not None and row["text"] and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                digest = _leaf({**row.asDict(), "text": row["text"].replace("\n", "")})
            for left, right in steps:
                digest = _hash(*left, digest, *right)
            proof = _hash(*(d for left, right in steps for d in left + right))
            root = top[-1][0]
            out.append((row["doc_id"], _leaf(row), trees[s][-1][0], root, proof, digest, digest == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1, 1, 1], [243, 3], [244, 1, 9, 10], [800, 28, 0, 5]])
def test_against_plain_trees(spark, sizes):
    rows = [
        (s * 10_000 + (i * 37) % 9973, f"s{s}" if s else None, "en", i, f"line {i}\nend" if i % 3 else f"öé {i}")
        for s, n in enumerate(sizes)
        for i in range(n)
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert got == _brute(docs.collect())
    altered = sum(zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in r[4] for r in rows)
    assert sum(not r[-1] for r in got) == altered


def test_three_tiers(spark, monkeypatch):
    """Small blocks make high trees of blocks."""
    for name, value in {"HEIGHT": 1, "BLOCK": 3}.items():
        monkeypatch.setattr(merkle, name, value)
    docs = spark.createDataFrame([(i, f"s{i % 7 and 1}{i % 5}", None, None, f"{i}\n") for i in range(300)], DOCS)
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert got == _brute(docs.collect())


def test_awkward_rows(spark, awkward, make_docs):
    got = sorted((tuple(r) for r in merkle.manifest(awkward).collect()), key=str)
    assert got == _brute(awkward.select("doc_id", "source", "lang", "n_chars", "text").collect())
    assert merkle.manifest(make_docs([])).count() == 0
    names = "place long, tree string, total long, digest string, steps string, block int, tie long, file string"
    clash = awkward.select("*", *[F.lit("1").alias(c.split()[0]) for c in names.split(", ") if c.split()[0] not in awkward.columns])
    assert sorted((tuple(r) for r in merkle.manifest(clash).collect()), key=str) == got


def test_one_repeated_row_is_spread(spark):
    """A row that makes up most of the table gets all its places, from many files."""
    row = (5, "hot", "en", 1, "same\ntext")
    docs = spark.createDataFrame([row] * 3000 + [(6, "hot", "en", 1, "x")], DOCS).repartition(8)
    rows = merkle.placed(merkle.leaves(docs), "doc_id", "digest")
    assert sorted(r["place"] for r in rows.collect()) == list(range(3001))
    assert rows.rdd.getNumPartitions() >= 1
    assert len({r["leaf"] for r in merkle.manifest(docs).collect()}) == 2
