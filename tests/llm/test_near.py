"""Near-duplicates: planted copies, links of a brute-force join, sampling, components."""

import random

import numpy as np
import pytest

from usagelens.llm import near
from usagelens.llm.components import components
from usagelens.llm.shingles import pieces, shingles


def _edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = "edited" + str(rng.randrange(10**6))
    return " ".join(words)


@pytest.fixture
def copies(make_docs, words):
    """20 originals with up to 12 lightly edited copies each, 30 loners sharing one passage."""
    rng = random.Random(11)
    rows, i = [], 0
    passage = words(rng, 60)
    for _ in range(20):
        original = words(rng, 200)
        for edits in (0, 0, *[rng.randint(1, 2) for _ in range(rng.randint(1, 10))]):
            rows.append((i, _edited(rng, original, edits)))
            i += 1
    for _ in range(30):
        rows.append((i, words(rng, 60) + " " + passage + " " + words(rng, 60)))
        i += 1
    return rows


def _brute(rows, rare):
    """Class of each row by comparing all pairs."""
    ids = [r[0] for r in rows]
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if find(a) != find(b) and (s == t or near.similar(s, t, rare) >= near.SIMILARITY):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in ids}


def test_classes_equal_brute_force(make_docs, copies):
    docs = make_docs(copies)
    cells, n = near.frequencies(docs)
    assert n == len(copies)
    found = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    assert found == _brute(copies, near.rarity(cells, n))
    assert len(set(found.values())) == 50
    kept = near.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(found.values()))


def test_one_bucket_over_many_tasks(spark, make_docs, words):
    """A class so large that its buckets are cut by the range partitioning."""
    rng = random.Random(12)
    original = words(rng, 150)
    docs = make_docs([(i, _edited(rng, original, 1)) for i in range(400)])
    assert {r["class_id"] for r in near.classes(docs).collect()} == {0}


def test_pairs_among_many_texts_that_share_a_passage(make_docs, words):
    """3,000 texts with one passage (similarity 0.65), among them 200 pairs of 0.84."""
    rng = random.Random(15)
    passage = words(rng, 160).split()
    rows = []

    def text(own):
        return " ".join([*own, *passage])

    for i in range(2600):
        rows.append((i, text(words(rng, 40).split())))
    for i in range(200):
        own = words(rng, 40).split()
        rows.append((3000 + 2 * i, text(own)))
        rows.append((3001 + 2 * i, text([*words(rng, 17).split(), *own[17:]])))
    rng.shuffle(rows)
    rare = near.rarity(np.zeros(1 << near.CELL_BITS, np.int64), len(rows))
    by_id = dict(rows)
    assert near.similar(by_id[0], by_id[1], rare) < 0.7
    assert all(near.similar(by_id[3000 + 2 * i], by_id[3001 + 2 * i], rare) > 0.82 for i in range(200))
    found = {r["doc_id"]: r["class_id"] for r in near.classes(make_docs(rows)).collect()}
    assert found == {i: i if i < 3000 else i - i % 2 for i in by_id}


def test_a_similar_text_shares_a_rare_shingle(words):
    rng = random.Random(16)
    cells = np.random.default_rng(16).integers(0, 1000, 1 << near.CELL_BITS)
    rare = near.rarity(cells, 1000)
    for _ in range(200):
        one = words(rng, rng.randint(5, 120))
        other = _edited(rng, one, min(rng.randint(0, 4), len(one.split())))
        if near.similar(one, other, rare) < near.SIMILARITY:
            continue
        both = []
        for t in (one, other):
            _, codes, counts = shingles(next(pieces([t])))
            both.append(near.prefix(codes, near.weights(codes, counts, rare), cells))
        assert len(np.intersect1d(*both))


def test_awkward_rows(awkward, make_docs):
    rows = near.classes(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by_id[0] == by_id[25] == by_id[None] == {0}
    assert by_id[20] == by_id[21] == {20}
    assert by_id[23] == {23}
    kept = near.representatives(awkward).collect()
    assert len(kept) == len({r["class_id"] for r in rows})
    assert near.classes(make_docs([])).count() == 0


def test_samples_agree_as_often_as_the_sets_are_similar(words):
    rng = random.Random(13)
    rare = np.ones(1 << near.CELL_BITS, np.float32)
    same, want = [], []
    for _ in range(40):
        text = words(rng, 300)
        pair = [text, _edited(rng, text, rng.randint(1, 12))]
        of, codes, counts = shingles(next(pieces(pair)))
        rows = near.samples(of, codes, near.weights(codes, counts, rare), 2)
        same.append((rows[0] == rows[1]).mean())
        want.append(near.similar(*pair, rare))
    assert abs(np.mean(same) - np.mean(want)) < 0.03


def test_shingles_follow_the_definition():
    texts = ["A b, C d e f", "a B c D e f", "", "!!", "x y", "é" * 3 + " a b c d"]
    of, codes, counts = shingles(next(pieces(texts)))
    sets = [dict(zip(codes[of == i].tolist(), counts[of == i].tolist())) for i in range(len(texts))]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 1, 1, 1, 1]
    of, codes, counts = shingles(next(pieces(["a b c d e " * 4])))
    assert sorted(counts.tolist()) == [3, 3, 3, 3, 4]


def test_components(spark):
    rng = random.Random(14)
    chain = [(i, i + 1) for i in range(1000, 1100)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    rng.shuffle(chain)
    links = spark.createDataFrame([*chain, *star, (7, 7), (1, 2), (1, 2)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {
        **{i: 1000 for i in range(1000, 1101)},
        **{i: 5000 for i in range(5000, 5300)},
        1: 1,
        2: 1,
    }
    assert components(links.limit(0)).count() == 0


def test_pairs_whose_rare_shingles_many_texts_share(make_docs, words, monkeypatch):
    """Five groups of 1,000 texts from one form (similarity 0.7); two of each have little of their own."""
    monkeypatch.setattr(near, "BLOCK", 50_000, raising=False)
    rng = random.Random(17)
    rows = []
    for group in range(5):
        form = words(rng, 190).split()
        for i in range(1000):
            own = 11 if i in (300, 700) else 25
            rows.append((1000 * group + i, " ".join([*words(rng, own).split(), *form[: 200 - own]])))
    rng.shuffle(rows)
    docs = make_docs(rows)
    found = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    by_id, rare = dict(rows), near.rarity(*near.frequencies(docs))
    for group in range(0, 5000, 1000):
        pair = [by_id[group + 300], by_id[group + 700]]
        assert near.similar(*pair, rare) >= near.SIMILARITY > near.similar(pair[0], by_id[group], rare)
    assert found == {i: i - 400 if i % 1000 == 700 else i for i in by_id}


def test_cells_hold_only_blocks_that_meet(spark):
    """Of the cells of two blocks go those that lack a block, and any cell of one class."""
    cells = {
        (1, 4, 0, 0): [(False, 1), (False, 2)],  # a block with itself
        (1, 5, 0, 0): [(False, 1), (False, 2)],  # no text of the next weight
        (1, 3, 0, 0): [(True, 1), (True, 2)],
        (2, 4, 0, 0): [(False, 3), (False, 3)],
        (2, 4, 0, 1): [(False, 3), (True, 4)],
        (2, 4, 1, 2): [(False, 3), (False, 4)],
        (2, 5, 0, 1): [(False, 3), (True, 3)],
        (3, 7, 0, 0): [(False, 3), (True, 4)],
    }
    rows = [(*cell, later, i, root, 1) for cell, held in cells.items() for i, (later, root) in enumerate(held)]
    kinds = "code long, heft int, first int, second int, later boolean, node long, root long, nth int"
    found = near.mixed_cells(spark.createDataFrame(rows, kinds)).collect()
    assert len(found) == 6
    assert {tuple(r[c] for c in near.CELL) for r in found} == {(1, 4, 0, 0), (2, 4, 0, 1), (3, 7, 0, 0)}


def test_no_more_links_leave_the_classes(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")
    groups = components(links)
    more = near._widened(groups, spark.createDataFrame([(2, 5), (8, 9)], "a long, b long"))
    assert {r["node"]: r["root"] for r in more.collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}
    monkeypatch.delattr(near, "components")
    same = near._widened(groups, links.limit(0))
    assert {r["node"]: r["root"] for r in same.collect()} == {1: 1, 2: 1, 5: 5, 6: 5}
