"""Packing: an exact round trip, full sequences, awkward rows."""

from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from usagelens.llm import packing
from usagelens.llm.registry import vocabulary


def _check(rows, docs, capacity):
    """Every id of every document lies in one piece, sequences have no gaps."""
    tokenizer = Tokenizer.from_file(vocabulary())
    expected = defaultdict(list)
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        expected[d["doc_id"]].append(ids)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert pieces.keys() == expected.keys()
    for doc_id, lists in expected.items():
        assert sum(len(p[1]) for p in pieces[doc_id]) == sum(map(len, lists))
        if len(lists) == 1:
            assert [i for _, ids, _ in sorted(pieces[doc_id]) for i in ids] == lists[0]
            assert {p[2] for p in pieces[doc_id]} == {len(lists[0])}
    return padding


def test_round_trip(spark, awkward):
    rows = packing.pack(awkward, vocabulary()).collect()
    assert _check(rows, awkward.collect(), 2048) <= 0.02 * sum(r["length"] for r in rows)


def test_small_capacity(spark, awkward):
    rows = packing.pack(awkward.limit(25), vocabulary(), capacity=16).collect()
    _check(rows, awkward.limit(25).collect(), 16)
    with pytest.raises(ValueError):
        packing.pack(awkward, vocabulary(), capacity=1000)


def test_words_equal_the_whole_pipeline():
    """Texts that the short way must leave to the tokenizer."""
    texts = [
        "I'LL don't 'tis l'été ΑΣ Σ ﬁ İx 12.5%!! a_b ¿qué?",
        "zero​width nb space x\x1cy <|endoftext|> é \U0001f600!!",
        "",
        " \n ",
    ]
    tokenizer = Tokenizer.from_file(vocabulary())
    encode = packing.token_source(vocabulary(), 1)
    for text, ids in zip(texts, encode(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert np.frombuffer(ids, "<u4").tolist() == want


def test_classes_hold_a_fixed_count():
    bins = packing.Bins(2048, 0)
    done = []
    for doc in range(20):
        done += [bins.add((doc, 0, b"\0" * 4 * 100, 100))]
    full = [d for d in done if d]
    assert [len(f) for f in full] == [20]  # 2048 // 100
    assert list(bins.cut(5000)) == [2048, 2048, 512, 256, 128, 8]


def test_no_rows(make_docs):
    assert packing.pack(make_docs([]), vocabulary()).count() == 0


def test_texts_that_spell_added_tokens_have_the_tokenizers_ids():
    texts = [
        "text <|endoftext|> more", "a<|endoftext|>b", "<|startoftext|>", "text <|ENDOFTEXT|> more",
        "Plain words, and <|endoftext |> spaced.", "x <|endoftext|><|endoftext|> y <|startoftext|>",
    ]
    tokenizer = Tokenizer.from_file(vocabulary())
    expected = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    got = packing.token_source(vocabulary(), 1)(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == expected
