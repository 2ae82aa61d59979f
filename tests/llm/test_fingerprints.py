"""Fingerprints: chunk boundaries against a plain loop, successors, awkward rows."""

import random

import numpy as np

from usagelens.llm import fingerprints as fp


def _slow_ends(data: bytes):
    """Boundaries by a plain loop over the definition."""
    ends, start = [], 0
    while len(data) - start > fp.LEAST:
        for end in range(start + fp.LEAST, len(data) + 1):
            last = data[max(0, end - fp._WINDOW) : end]
            value = sum(int(fp._GEAR[b]) << i for i, b in enumerate(reversed(last))) % 2**32
            mask = fp._mask(fp.STRICT_BITS if end < start + fp.WANTED else fp.LENIENT_BITS)
            if value & int(mask) == 0 or end - start == fp.MOST or end == len(data):
                break
        ends.append(end)
        start = end
    return ends + ([len(data)] if start < len(data) else [])


def test_boundaries_follow_the_definition():
    rng = random.Random(2)
    for n in (0, 1, 16, 17, 60, 500, 3000):
        data = bytes(rng.choices(b"abcdefgh ", k=n))
        assert fp.chunk_ends(np.frombuffer(data, np.uint8)) == _slow_ends(data)


def test_chunks_move_with_their_content(words):
    text = words(random.Random(4), 2000)
    chunker = fp.Chunker()
    own, moved = chunker.digests(text), chunker.digests("inserted at the front " + text)
    assert fp.containment(own, moved) > 0.95
    assert fp.containment(own, chunker.digests(words(random.Random(5), 2000))) < 0.01
    assert fp.containment({}, {}) == 1 and fp.containment({}, own) == 0
    assert chunker.digests(text * 40).keys() >= set(list(own)[:1])


def test_successors_and_edits(spark, awkward, make_docs):
    rows = {}
    for r in fp.fingerprinted(awkward).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    docs = sorted(
        awkward.collect(), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or "")
    )
    assert sum(map(len, rows.values())) == len(docs)
    chunker = fp.Chunker()
    for one, after in zip(docs, docs[1:] + docs[:1]):
        text, following = one["text"] or "", after["text"] or ""
        found = [r for r in rows[one["doc_id"]] if r["edited"] == fp.edited_text(text, following)]
        assert found and found[0]["n_chars"] == len(text)
        own = chunker.digests(text)
        assert found[0]["fingerprint"] == fp.to_text(own)
        assert found[0]["near_next"] == fp.containment(own, chunker.digests(following))
    assert fp.fingerprinted(make_docs([])).count() == 0
    assert fp.fingerprinted(make_docs([(7, "only one")])).first()["edited"] == "onlyonly"


def test_many_runs(spark, make_docs):
    docs = make_docs([(i * i, f"text number {i} " * 5) for i in range(300)])
    rows = {r["doc_id"]: r["edited"] for r in fp.fingerprinted(docs).collect()}
    texts = [f"text number {i} " * 5 for i in range(300)]
    want = {i * i: fp.edited_text(texts[i], texts[(i + 1) % 300]) for i in range(300)}
    assert rows == want
