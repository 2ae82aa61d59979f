"""Repeated spans: planted passages, a plain loop over the definition, awkward rows."""

import random

import numpy as np

from usagelens.llm import substrings


def _sentences(rng, words, n):
    return " ".join(words(rng, rng.randint(4, 14)).capitalize() + "." for _ in range(n))


def test_planted_passages_go_once(make_docs, words):
    rng = random.Random(21)
    passage = _sentences(rng, words, 8)
    assert len(passage.split()) > 50
    own = [(_sentences(rng, words, 15), _sentences(rng, words, 15)) for _ in range(12)]
    rows = [(i, f"{a[:-1]} {passage} {b}" if i % 2 == 0 else f"{a} {b}") for i, (a, b) in enumerate(own)]
    out = {r["doc_id"]: r for r in substrings.deduplicated(make_docs(rows)).collect()}
    for i, text in rows:
        removed = "".join(text[a:b] for a, b in out[i]["removed"])
        if i % 2 or i == 0:
            assert out[i]["text"] == text and not out[i]["removed"]
        else:
            assert removed in passage and len(removed) > 0.6 * len(passage)
            assert out[i]["text"] == text.replace(removed, "")


def test_runs_follow_the_definition(make_docs, words):
    """All repeated runs and their first places, by a loop over every document."""
    rng = random.Random(22)
    shared = [_sentences(rng, words, 6) for _ in range(5)]
    rows = [
        (i, "\n".join(rng.choice([_sentences(rng, words, 3), rng.choice(shared)]) for _ in range(6)))
        for i in range(60)
    ]
    seen, gone = {}, {}
    bodies = {}
    for doc_id, text in rows:
        body = text.encode()
        _, codes, starts, ends = substrings.runs([body])
        bodies[doc_id] = body
        for code, start, end in zip(codes.tolist(), starts.tolist(), ends.tolist()):
            seen.setdefault(code, []).append((doc_id, start, end))
    for places in seen.values():
        for doc_id, start, end in sorted(places)[1:]:
            gone.setdefault(doc_id, set()).update(range(start, end))
    out = substrings.deduplicated(make_docs(rows)).collect()
    for r in out:
        body = bodies[r["doc_id"]]
        kept = bytes(b for i, b in enumerate(body) if i not in gone.get(r["doc_id"], ()))
        assert r["text"].encode() == kept


def test_awkward_rows(awkward, make_docs):
    rows = substrings.deduplicated(awkward).collect()
    assert len(rows) == awkward.count()
    texts = {}
    for r in rows:
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    assert texts[20] == texts[21] == {""}
    original = awkward.where("doc_id = 0").first()["text"]
    assert texts[None] == {original}  # null ids come first
    assert len(texts[25]) == 1 and len(texts[25].pop()) < len(original) / 2
    assert substrings.deduplicated(make_docs([])).count() == 0


def test_offsets_are_code_points(make_docs, words):
    rng = random.Random(23)
    passage = "é\U0001f600 " + _sentences(rng, words, 8)
    rows = [(i, f"Ünïcödé \U0001f600 {i}. {passage}") for i in range(3)]
    for r in substrings.deduplicated(make_docs(rows)).collect():
        text = dict(rows)[r["doc_id"]]
        kept, at = "", 0
        for a, b in r["removed"]:
            kept, at = kept + text[at:a], b
        assert r["text"] == kept + text[at:]
        assert bool(r["removed"]) == (r["doc_id"] > 0)


def _kinds(rng, words):
    """Running text without marks, and sentences that close in quotes or in other scripts' marks."""
    plain = lambda n: words(rng, n)
    ends = ['."', ".)", "。", "!”", "?»", "…"]
    told = lambda n: " ".join(w + rng.choice(ends) if rng.random() < 0.1 else w for w in words(rng, n).split())
    long = lambda n: " ".join(w + "." if rng.random() < 0.04 else w for w in words(rng, n).split())
    return {"plain": plain, "told": told, "long": long}


def test_any_51_words_hold_a_common_run(words):
    rng = random.Random(24)
    for kind, make in _kinds(rng, words).items():
        for _ in range(300):
            passage = make(51)
            found = []
            for _ in range(2):
                text = f"{make(rng.randint(5, 60))} {passage} {make(rng.randint(5, 60))}".encode()
                _, codes, starts, ends = substrings.runs([text])
                at = text.index(passage.encode())
                inside = (starts >= at) & (ends <= at + len(passage.encode()))
                found.append(set(codes[inside].tolist()))
            assert found[0] & found[1], kind


def test_unmarked_passages_go(make_docs, words):
    rng = random.Random(25)
    passage = words(rng, 51)
    rows = [(i, f"{words(rng, 40 + i)} {passage} {words(rng, 33)}") for i in range(4)]
    rows.append((9, "la " * 200))
    out = {r["doc_id"]: r for r in substrings.deduplicated(make_docs(rows)).collect()}
    assert out[0]["text"] == rows[0][1]
    for i, text in rows[1:4]:
        removed = "".join(text[a:b] for a, b in out[i]["removed"])
        assert removed in passage and len(removed.split()) >= 30
    assert len(out[9]["text"].split()) >= 30


def test_marks_behind_closing_signs_close_sentences():
    ends = ['one."', "one.)", "one。", "one!”", "one?»", "one…", "one.')]", "one؟"]
    data = np.frombuffer(" ".join([*ends, '"', "”", "one)", "é"]).encode(), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], data != 32, [False]))))
    marked = substrings._marked(data, edges[::2], edges[1::2])
    assert marked.tolist() == [True] * len(ends) + [False] * 4
