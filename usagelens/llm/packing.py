"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class ``k`` holds pieces longer than
``capacity/(k+1)`` and at most ``capacity/k``, and each of its bins takes exactly ``k``
pieces. Classes share no state, and neither do workers: every task fills its own bins
in one pass over its documents, so nothing is shuffled.

A document is cut into whole sequences, then into halves, quarters, eighths and
sixteenths of the capacity, which fill their bins without a gap; what is left is shorter
than a sixteenth, and its class wastes at most one part in seventeen of few bins. Bins
that are still open when a task ends are cut at powers of two, and these runs need no
padding where a power of two is a permitted length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.tables import arrow_schema, record_batch, texts

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)

#: Pieces of at least this share of the capacity are cut at powers of two.
_SHARES = 16
#: White space at which a text may be cut before tokenizing; any other sends it whole.
_UNUSUAL_SPACE = r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A word of plain letters, and what may follow it without joining it.
_PLAIN = r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)"
#: Distinct words remembered by one task.
_REMEMBERED = 300_000


def token_source(path: str, end_id: int):
    """A function from a list of texts to their token ids (4 bytes each), ended by ``end_id``.

    The tokenizer drops white space and never joins across it, nor a letter to the
    punctuation behind it. So a text is the concatenation of its words' ids, each distinct
    word is encoded once per task, and a word of plain letters goes straight to the
    tokenizer's merge model; anything else takes its whole pipeline.
    """
    import re

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # A text that spells an added token takes the whole pipeline too, in any case of letters
    # where the token is looked for in the normalised text.
    tokens = tokenizer.get_added_tokens_decoder().values()
    exact = [t.content for t in tokens if not t.normalized]
    loose = [t.content.lower() for t in tokens if t.normalized]

    def spells(text: str) -> bool:
        return any(t in text for t in exact) or bool(loose) and any(t in text.lower() for t in loose)

    merge = tokenizer.model.tokenize
    unusual, plain = re.compile(_UNUSUAL_SPACE), re.compile(_PLAIN).fullmatch
    known: dict[str, bytes] = {}
    cores: dict[str, bytes] = {"": b""}
    end = np.array([end_id], "<u4").tobytes()
    spelled = str.maketrans({b: c for b, c in enumerate(_byte_letters())})

    def whole(texts: list[str]) -> list[bytes]:
        coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def core(letters: str) -> bytes:
        found = cores.get(letters)
        if found is None:
            tokens = merge(letters.encode().decode("latin-1").translate(spelled))
            found = cores[letters] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return found

    def learn(words: list[str]) -> None:
        others = []
        for word in words:
            match = plain(word.lower())
            if match:
                letters, marks = match.groups()
                if marks not in cores:
                    cores[marks] = whole([marks])[0]
                known[word] = core(letters) + cores[marks]
            else:
                others.append(word)
        known.update(zip(others, whole(others)))

    def encode(batch: list[str]) -> list[bytes]:
        for cache in (known, cores):
            if len(cache) > _REMEMBERED:
                cache.clear()
        cores[""] = b""
        split = [None if unusual.search(text) or spells(text) else text.split() for text in batch]
        learn(list(set(chain.from_iterable(s for s in split if s)).difference(known)))
        return [
            (whole([text])[0] if words is None else b"".join(map(known.__getitem__, words))) + end
            for text, words in zip(batch, split)
        ]

    return encode


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Bins:
    """Open bins of one worker; complete ones leave through :meth:`add` and :meth:`flush`."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def cut(self, n: int) -> Iterator[int]:
        """Lengths of the pieces of a document of ``n`` ids."""
        yield from [self.capacity] * (n // self.capacity)
        rest, size = n % self.capacity, self.capacity // 2
        while rest and size >= self.capacity // _SHARES:
            if rest >= size:
                yield size
                rest -= size
            size //= 2
        if rest:
            yield rest

    def add(self, piece: tuple) -> list[tuple]:
        """Put a piece into its class; the bin's pieces if that completes it."""
        k = self.capacity * 4 // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._close(self.open.pop(k)) if len(held) == k else []

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        lengths = [len(p[2]) // 4 for p in pieces]
        offsets = np.cumsum([0, *lengths[:-1]]).tolist()
        self.next_id += 1
        return [(*p, self.next_id - 1, at) for p, at in zip(pieces, offsets)]

    def flush(self) -> Iterator[list[tuple]]:
        """Close what is open: at powers of two, in sequences of powers of two."""
        sizes: dict[int, list[tuple]] = {}
        for piece in chain.from_iterable(self.open.values()):
            doc_id, start, ids, total = piece
            at = 0
            n = len(ids) // 4
            for bit in reversed(range(n.bit_length())):
                if n >> bit & 1:
                    part = (doc_id, start + at, ids[4 * at : 4 * (at + (1 << bit))], total)
                    sizes.setdefault(1 << bit, []).append(part)
                    at += 1 << bit
        self.open = {}
        for size, parts in sorted(sizes.items()):
            most = 1 << (self.capacity // size).bit_length() - 1
            while parts:
                n = min(most, 1 << len(parts).bit_length() - 1)
                yield self._close(parts[:n])
                parts = parts[n:]


def packed(
    documents: Iterable[tuple[int, bytes]], capacity: int, first_id: int
) -> Iterator[list[tuple]]:
    """Complete sequences, each a list of (doc_id, start, ids, doc_tokens, sequence_id, offset).

    Ids are bytes, four each."""
    bins = Bins(capacity, first_id)
    for doc_id, ids in documents:
        start, total = 0, len(ids) // 4
        for length in bins.cut(total):
            done = bins.add((doc_id, start, ids[4 * start : 4 * (start + length)], total))
            if done:
                yield done
            start += length
    yield from bins.flush()


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` ids.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with the end id),
    ``sequence_id`` and ``offset`` in it. ``capacity`` is a power of two.

    Null and empty texts become the end id alone. Repeated rows are packed as often as
    they occur; a null ``doc_id`` stays null. Other columns are ignored, and an empty
    table gives no rows. Sequence ids are unique, not consecutive.
    """
    if capacity < _SHARES or capacity & capacity - 1:
        raise ValueError(f"capacity must be a power of two of at least {_SHARES}")
    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_source(tokenizer, end_id)

        def documents():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()))

        rows = []
        for sequence in packed(documents(), capacity, TaskContext.get().partitionId() << 40):
            rows += sequence
            if len(rows) >= 4096:
                yield _rows(rows, arrow)
                rows = []
        if rows:
            yield _rows(rows, arrow)

    return texts(docs).mapInArrow(run, schema)


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows)
    return record_batch(
        {
            "doc_id": doc,
            "start": start,
            "length": [len(i) // 4 for i in ids],
            "ids": ids,
            "doc_tokens": total,
            "sequence_id": sequence,
            "offset": offset,
        },
        arrow,
    )


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
