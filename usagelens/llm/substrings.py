"""Substring deduplication by sliding spans of consecutive sentences.

Texts are split into sentences and clauses: after a word that ends in a mark of
punctuation (closing quotes and brackets may follow it), at a line break, and after words
picked by their hash. The places depend only on the words near them, so a passage is split
alike wherever it stands. From every sentence on, the shortest run of several sentences
and enough words is hashed. Where 50 words in a row hold no such run that their own words
decide, the 30 of them with the smallest hash are a run as well. So any 50 words that two
places share hold a whole run in both, with or without marks. Spark counts the hashes over
all documents; of a run that occurs more than once every occurrence but the first is
removed, with all the words it covers.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.shingles import mix
from usagelens.llm.tables import arrow_schema, record_batch, spread_join, texts
from usagelens.session import written

#: Sentences and words in a run, at least.
SENTENCES, WORDS = 3, 30
#: Words in a row that hold a run, whatever their marks.
WINDOW = 50
#: One word in so many ends a sentence by its hash.
_PICKED = 32
_PIECE = 1_000_000
#: Windows compared at once.
_AT_ONCE = 1 << 16
#: Parts of a join on a run: its rows are few columns wide.
_INTO = 4

_rng = np.random.default_rng(20240603)
_LETTER = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 4096, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".!?;:,")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]}>*_`")] = True


def _codes(chars: str) -> np.ndarray:
    return np.array([int.from_bytes(c.encode(), "big") for c in chars])


#: Marks and closing signs of two and of three bytes.
_MARKS = {2: _codes("\u061f\u061b\u060c\u06d4\u0589\u037e\u0387"), 3: _codes("…‥‼⁇⁈⁉。．！？；：，、।॥።፧")}
_CLOSERS = {2: _codes("»«"), 3: _codes("”’“‘›‹」』】〉》）］｝")}
#: Closing signs looked past at the end of a word.
_DEPTH = 8


def _ends_in(data: np.ndarray, starts: np.ndarray, tails: np.ndarray, signs: dict) -> np.ndarray:
    """Bytes of the sign of ``signs`` that ends before each of ``tails``, or 0."""
    found = np.zeros(len(tails), np.int64)
    for n, known in signs.items():
        at = np.flatnonzero((tails - starts >= n) & (data[tails - 1] >= 128))
        code = np.zeros(len(at), np.int64)
        for k in range(n):
            code = (code << 8) | data[tails[at] - n + k]
        found[at[np.isin(code, known)]] = n
    return found


def _marked(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether each word ends in a mark of punctuation, behind which signs may close."""
    marked = _MARK[data[stops - 1]]
    left = np.flatnonzero(~marked & (_CLOSER[data[stops - 1]] | (data[stops - 1] >= 128)))
    tails = stops[left]
    for _ in range(_DEPTH + 1):
        here = _MARK[data[tails - 1]] | (_ends_in(data, starts[left], tails, _MARKS) > 0)
        marked[left[here]] = True
        size = np.maximum(_CLOSER[data[tails - 1]], _ends_in(data, starts[left], tails, _CLOSERS))
        more = ~here & (size > 0) & (tails - size > starts[left])
        left, tails = left[more], (tails - size)[more]
    return marked


def _fillers(code: np.ndarray, owner: np.ndarray, head: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """First words of the runs of exactly ``WORDS`` words that windows without a run add.

    ``code`` is the hash of the words from each word on; ``reach`` is the last word that a
    run from ``head`` needs to be seen to end there.
    """
    n = len(owner) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    # The word before the run's first one has to be in the window too.
    next_run = np.searchsorted(head, at + 1)
    at = at[np.append(reach, len(owner) + WINDOW)[next_run] > at + WINDOW - 1]
    if not len(at):
        return at
    choices = np.lib.stride_tricks.sliding_window_view(code, WINDOW - WORDS + 1)
    picked = [
        part + choices[part].argmin(axis=1)
        for part in np.split(at, range(_AT_ONCE, len(at), _AT_ONCE))
    ]
    picked = np.unique(np.concatenate(picked))
    # Of equal runs that overlap, as in one word said over and over, the first is enough.
    order = np.lexsort((picked, code[picked]))
    ordered = picked[order]
    same = code[ordered[1:]] == code[ordered[:-1]]
    close = np.concatenate(([False], same & (np.diff(ordered) < WORDS)))
    keep = ~close
    held = 0
    for i in np.flatnonzero(close).tolist():
        if not close[i - 1]:
            held = ordered[i - 1]
        if ordered[i] >= held + WORDS:
            held, keep[i] = ordered[i], True
    return np.sort(ordered[keep])


def runs(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, start, end) of every run in a list of texts; offsets count bytes."""
    sizes = np.array([len(b) for b in bodies])
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, stops = edge[::2], edge[1::2]
    nothing = np.zeros(0, np.int64)
    if not len(starts):
        return nothing, nothing, nothing, nothing
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    place = (np.arange(lengths.sum()) - np.repeat(first, lengths)) & (len(_PLACE) - 1)
    word = np.add.reduceat(_LETTER[data[inside]] * _PLACE[place], first)
    word = mix(word + lengths.astype(np.uint64))
    owner = np.searchsorted(begins + sizes, starts, side="right")
    lines = np.concatenate((np.cumsum(data == 10), [0]))
    last = np.concatenate((owner[1:] != owner[:-1], [True]))
    breaks = np.concatenate((lines[starts[1:]] != lines[stops[:-1]], [True]))
    breaks[:-1] |= data[stops[:-1]] == 10
    picked = (word >> np.uint64(40)) % np.uint64(_PICKED) == 0
    own = _marked(data, starts, stops) | picked
    closes = own | last | breaks
    ends = np.flatnonzero(closes)  # last word of each sentence
    heads = np.concatenate(([0], ends[:-1] + 1))  # first word of each
    of = owner[ends]
    # The sentence that completes both the count and the words, and is still in the text.
    by_count = np.arange(len(ends)) + SENTENCES - 1
    by_words = np.searchsorted(ends, heads + WORDS - 1)
    until = np.maximum(by_count, by_words)
    ok = until < len(ends)
    ok[ok] = of[until[ok]] == of[ok]
    head, stop = heads[ok], ends[until[ok]]
    up = np.full(len(word) + 1, _BASE)
    up[0] = 1
    down = np.full(len(word) + 1, _INVERSE)
    down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * up[:-1])))

    def hashed(head: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop + 1] - sums[head]) * down[head] + (stop - head).astype(np.uint64))

    every = np.arange(max(0, len(word) - WORDS + 1))
    reach = np.where(own[stop], stop, np.where(last[stop], len(word) + WINDOW, stop + 1))
    more = _fillers(hashed(every, every + WORDS - 1), owner, head, reach)
    both = np.unique(np.stack((np.append(head, more), np.append(stop, more + WORDS - 1))), axis=1)
    head, stop = both[0], both[1]
    code = hashed(head, stop)
    text = owner[head]
    return text, code.view(np.int64), starts[head] - begins[text], stops[stop] - begins[text]


def _pieces(bodies: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Lists of encoded texts of bounded size with the place of their first text."""
    held, size, at = [], 0, 0
    for i, body in enumerate(bodies):
        data = body.encode("utf-8", "surrogatepass")
        if held and size + len(data) > _PIECE:
            yield at, held
            held, size, at = [], 0, i
        held.append(data)
        size += len(data)
    if held:
        yield at, held


def spans(docs: DataFrame) -> DataFrame:
    """``code``, ``doc_id``, ``body`` (a hash of the text), ``start`` and ``size`` of all runs."""
    kinds = "code long, doc_id long, body int, start int, size int"
    schema = docs.sparkSession.createDataFrame([], kinds).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for at, bodies in _pieces(batch.column(2).to_pylist()):
                text, code, start, end = runs(bodies)
                rows = pa.array(text + at)
                yield record_batch(
                    {
                        "code": code,
                        "doc_id": ids.take(rows),
                        "body": keys.take(rows),
                        "start": start.astype(np.int32),
                        "size": (end - start).astype(np.int32),
                    },
                    arrow,
                )

    return _keyed(texts(docs)).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.hash("text").alias("body"), "text")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body`` and ``spans`` (start and size in bytes) of what is to be removed."""
    found = spans(docs)
    counted = found.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    shared = written(spread_join(found, counted, ["code"], "doc_id", into=_INTO), "runs-shared")
    place = F.struct("doc_id", "body", "start")
    firsts = shared.groupBy("code").agg(F.min(place).alias("first"))
    return (
        spread_join(shared, firsts, ["code"], "doc_id", into=_INTO)
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "body")
        .agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    )


def merged(spans: list, body: bytes) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the removed ranges in code points."""
    ranges: list[list[int]] = []
    for span in spans:
        end = span["start"] + span["size"]
        if ranges and span["start"] <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([span["start"], end])
    kept, removed, at, chars = [], [], 0, 0
    for start, end in ranges:
        before = body[at:start].decode("utf-8", "surrogatepass")
        gone = len(body[start:end].decode("utf-8", "surrogatepass"))
        chars += len(before)
        removed.append((chars, chars + gone))
        chars += gone
        kept.append(before)
        at = end
    kept.append(body[at:].decode("utf-8", "surrogatepass"))
    return "".join(kept), removed


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` without repeated spans and ``removed``, an array of (start, end).

    Ranges are code points of the original text, ends exclusive. The first occurrence of
    a run is the one with the smallest id, then text hash, then place; later ones go,
    also inside one text. Rows equal in id and text are one occurrence and keep the same
    text; a null id counts as smaller than any. Null and empty texts and those with fewer
    words than a run stay as they are (null as empty). Other columns are ignored; no row
    gives no row.
    """
    gone = repeats(docs).select(
        F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body"), "spans"
    )
    keyed = _keyed(texts(docs))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("body") == F.col("gone_body"))

    @F.pandas_udf("text string, removed array<struct<start: long, end: long>>")
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [
            (t, []) if s is None else merged(s, t.encode("utf-8", "surrogatepass"))
            for t, s in zip(text, found)
        ]
        removed = [[{"start": a, "end": b} for a, b in r] for _, r in rows]
        return pd.DataFrame({"text": [t for t, _ in rows], "removed": removed})

    return (
        keyed.join(gone, same, "left")
        .select("doc_id", cut("text", "spans").alias("cut"))
        .select("doc_id", "cut.text", "cut.removed")
    )
