"""Shift-resistant document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text; a chunk ends where some of its bits vanish. The
test is normalised: strict before the wanted length and lenient after it, so chunk
lengths gather around that length. Chunks move with their content, so text inserted or
cut elsewhere leaves most of them alone. A fingerprint is the set of a text's chunk
digests with their lengths, and likeness is containment: the share of the one text's
length that lies in chunks which the other has too.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.tables import arrow_schema, record_batch, texts

#: Bytes of a chunk: at least, wanted, at most.
LEAST, WANTED, MOST = 16, 48, 192
#: Bits that must vanish before the wanted length, and after it.
STRICT_BITS, LENIENT_BITS = 7, 4
#: The gear hash forgets what is further back than this many bytes.
_WINDOW = 16
SCHEMA = (
    "doc_id long, n_chars long, edited string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)

_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
_GEAR64 = np.random.default_rng(20240608).integers(0, 1 << 62, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_NULL_ID = -(1 << 63)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mask(bits: int) -> np.uint32:
    """The bits that the oldest bytes of the window still reach."""
    return np.uint32(((1 << bits) - 1) << (_WINDOW - bits))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear sum of the last :data:`_WINDOW` bytes, doubling the window."""
    rolled, width = _GEAR[data], 1
    while width < _WINDOW:
        shifted = rolled.copy()
        shifted[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = shifted, width * 2
    return rolled


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of the bytes end."""
    size = len(data)
    if not size:
        return []
    hashed = gear_hash(data)
    strict = (np.flatnonzero(hashed & _mask(STRICT_BITS) == 0) + 1).tolist()
    lenient = (np.flatnonzero(hashed & _mask(LENIENT_BITS) == 0) + 1).tolist()
    ends, start, i, j = [], 0, 0, 0
    n_strict, n_lenient = len(strict), len(lenient)
    while size - start > LEAST:
        i = bisect_left(strict, start + LEAST, i)
        if i < n_strict and strict[i] < start + WANTED:
            end = strict[i]
        else:
            j = bisect_left(lenient, start + WANTED, j)
            end = lenient[j] if j < n_lenient else size
            end = min(end, start + MOST, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def powers(n: int, base: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i`` below ``n``."""
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Chunker:
    """Chunk digests of texts; remembers powers between texts."""

    def __init__(self):
        self.up, self.down = powers(1024, _BASE), powers(1024, _INVERSE)

    def digests(self, text: str) -> dict[int, int]:
        """Length in bytes by digest, over the distinct chunks."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        size = len(data)
        if not size:
            return {}
        if size > len(self.up):
            self.up, self.down = powers(2 * size, _BASE), powers(2 * size, _INVERSE)
        ends = np.array(chunk_ends(data))
        starts = np.concatenate(([0], ends[:-1]))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_GEAR64[data] * self.up[:size])))
        code = (sums[ends] - sums[starts]) * self.down[starts]
        code ^= (ends - starts).astype(np.uint64) << np.uint64(50)
        code ^= code >> np.uint64(31)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code = code >> np.uint64(16)
        return dict(zip(code.tolist(), (ends - starts).tolist()))


def to_text(chunks: dict[int, int]) -> str:
    """A fingerprint: ``digest:length`` in hexadecimal, by digest, joined by commas."""
    return ",".join(f"{d:012x}:{n:x}" for d, n in sorted(chunks.items()))


def containment(one: dict[int, int], other: dict[int, int]) -> float:
    """The share of the first's chunk length found in the second; two empty ones are alike."""
    total = sum(one.values())
    if not total:
        return 0.0 if other else 1.0
    return sum(map(one.__getitem__, one.keys() & other.keys())) / total


def edited_text(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_runs(docs: DataFrame) -> DataFrame:
    """``id``, ``text``, ``run`` and ``lent``: ranges of ids, each ended by the next range's head.

    A run's first row is also lent to the run before it, the very first one to the last,
    so a task sees the successor of each of its documents. Only the bounds of the ranges
    reach the driver, a few for each shuffle partition.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), "text")
    ids = rows.select("id")
    runs = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / runs for i in range(1, runs)]
    found = ids.approxQuantile("id", cuts, 1 / (20 * runs))
    edges = np.unique(np.array(found, np.float64).astype(np.int64))

    @F.pandas_udf("long")
    def run_of(id_: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, id_.to_numpy(), side="right"))

    heads = ids.groupBy(run_of("id").alias("run")).agg(F.min("id").alias("head")).collect()
    order = sorted((r["run"], r["head"]) for r in heads)
    lent_to = {head: order[k - 1][0] for k, (_, head) in enumerate(order)}

    @F.pandas_udf("array<struct<run: long, lent: boolean>>")
    def places(id_: pd.Series) -> pd.Series:
        own = np.searchsorted(edges, id_.to_numpy(), side="right").tolist()
        return pd.Series(
            [
                [{"run": r, "lent": False}]
                + ([{"run": lent_to[i], "lent": True}] if i in lent_to else [])
                for i, r in zip(id_.tolist(), own)
            ]
        )

    return rows.select("id", "text", F.explode(places("id")).alias("place")).select(
        "id", "text", "place.run", "place.lent"
    )


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, its edited text and that one's fingerprint, and two likenesses.

    Columns as in :data:`SCHEMA`. ``edited`` is the text whose last ``floor(n/2)`` code
    points are replaced by the first as many (or all) of the next document by ascending
    ``doc_id``; the last is followed by the first, a single document by itself. Rows with
    equal ids follow each other by text; null ids come first and stay null. Null texts
    are empty, and an empty text has an empty fingerprint: its likeness is 1 to another
    empty one and 0 to any other. Other columns are ignored; no row gives no row.
    """
    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for pairs in _batched(_successors(_rows(batches))):
            out = [_described(chunker, *pair) for pair in pairs]
            yield record_batch(dict(zip(arrow.names, zip(*out))), arrow)

    rows = in_runs(docs).repartition("run").sortWithinPartitions("run", "lent", "id", "text")
    return rows.mapInArrow(run, schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _successors(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, text, next text) of each row that is not lent, in order."""
    held = None
    for row in rows:
        if held is not None and not held[3] and held[2] == row[2]:
            yield held[0], held[1], row[1]
        held = row


def _batched(pairs: Iterator[tuple], size: int = 256) -> Iterator[list[tuple]]:
    held = []
    for pair in pairs:
        held.append(pair)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _described(chunker: Chunker, id_: int, text: str, following: str) -> tuple:
    edited = edited_text(text, following)
    own, changed, after = map(chunker.digests, (text, edited, following))
    return (
        None if id_ == _NULL_ID else id_,
        len(text),
        edited,
        to_text(own),
        to_text(changed),
        containment(own, changed),
        containment(own, after),
    )
