"""Vector code compression: each part of a vector becomes the index of a codebook entry.

Vectors are scaled to integers and cut into equal consecutive parts; every part position
has a small codebook that a few rounds of means improve. The distinct parts of a block of
rows, in lexicographic order, are the leaves of a trie whose levels are the dimensions of
a part. A depth-first traversal carries the squared distances to all entries, summed over
the dimensions so far, so parts with a common prefix share that work. At a leaf the
vector is complete: its argmin is the code, and the part enters its entry's sums with the
number of rows that hold it.

Each task builds the tries of its own rows, so nothing but the sums of the entries is
shuffled; the codebooks, as large as a few vectors, travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.llm.tables import arrow_schema, spread_join
from usagelens.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components beyond this are clamped to it: squares and sums stay in 64 bits.
LARGEST = 1 << 24
#: Rows whose parts share one trie.
BLOCK_ROWS = 1 << 15
#: Subtrees with at most so many leaves are swept a level at a time, larger ones descended into.
SUBTREE = 1 << 12


def scaled(rows: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``vec_id``, ``label`` and integer ``cells`` of the rows that take part.

    Null vectors and vectors with null or non-finite components go. So do vectors that
    cannot be cut into equal parts like the others: the length of the smallest ``vec_id``
    counts, among vectors with a positive multiple of ``parts`` components.
    """
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    size = F.size("embedding")
    kept = written(
        rows.where(F.col("embedding").isNotNull() & finite & (size > 0) & (size % parts == 0)).select(
            "vec_id", "label", F.transform("embedding", lambda x: whole(x).cast("int")).alias("cells")
        ),
        "vector-cells",
    )
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "cells").select(F.size("cells").alias("n")).first()
    return kept.where(F.size("cells") == (first["n"] if first else 0))


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) from the smallest ids; equal ids by their cells."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "cells").limit(entries).select("cells").collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    cells = np.array([r["cells"] for r in rows], np.int64)
    return cells.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and for each row the place of its equal."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place


def traverse(leaves: np.ndarray, book: np.ndarray, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equals) and squared distance of each leaf.

    ``leaves`` are distinct parts in lexicographic order. The stack holds subtrees as a
    range of leaves, the level reached and the distances summed up to it.
    """
    n, width = leaves.shape
    nearest, error = np.empty(n, np.int64), np.empty(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(book), np.int64))]
    while stack:
        low, high, level, sums = stack.pop()
        if high - low <= subtree or level == width:
            nearest[low:high], error[low:high] = _sweep(leaves[low:high], book, level, sums)
            continue
        values = leaves[low:high, level]
        starts = low + np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        for start, end in zip(starts[::-1], np.r_[starts[1:], high][::-1]):
            step = leaves[start, level] - book[:, level]
            stack.append((start, end, level + 1, sums + step * step))
    return nearest, error


def _sweep(leaves: np.ndarray, book: np.ndarray, level: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The traversal of one small subtree, all nodes of a level at once."""
    nodes, node_of = sums[None, :], np.zeros(len(leaves), np.int64)
    fresh = np.zeros(len(leaves), bool)
    fresh[0] = True
    for d in range(level, leaves.shape[1]):
        fresh[1:] |= leaves[1:, d] != leaves[:-1, d]
        firsts = np.flatnonzero(fresh)
        step = leaves[firsts, d][:, None] - book[:, d][None, :]
        nodes = nodes[node_of[firsts]] + step * step
        node_of = np.cumsum(fresh) - 1
    best = nodes.argmin(axis=1)
    return best[node_of], nodes[np.arange(len(nodes)), best][node_of]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of a task in blocks, each with its cells as a matrix."""

    def block(held):
        table = pa.Table.from_batches(held)
        cells = table.column("cells").combine_chunks()
        cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
        return table, cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(table), -1)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield block(held)
            held = []
    if held:
        yield block(held)


def _over_blocks(kept: DataFrame, books: np.ndarray, run: Callable, schema: T.StructType) -> DataFrame:
    arrow = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, arrow)], schema=arrow
        ) for columns in run(_blocks(batches, BLOCK_ROWS), books))

    return kept.mapInArrow(task, schema)


def _sums(blocks, books):
    """Rows (part, entry, component, rows, sum) of one task: the weighted sums of its leaves."""
    parts, entries, width = books.shape
    counts, totals = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for _, cells in blocks:
        for p in range(parts):
            leaves, place = distinct(cells[:, p * width : (p + 1) * width])
            weight = np.bincount(place, minlength=len(leaves))
            nearest, _ = traverse(leaves, books[p])
            np.add.at(counts[p], nearest, weight)
            np.add.at(totals[p], nearest, leaves * weight[:, None])
    p, e = np.nonzero(counts)
    if len(p):
        at = np.tile(np.arange(width), len(p))
        yield [np.repeat(p, width), np.repeat(e, width), at, np.repeat(counts[p, e], width), totals[p, e].ravel()]


def improved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts; unused ones stay."""
    schema = T._parse_datatype_string("part int, entry int, at int, n long, total long")
    sums = _over_blocks(kept, books, _sums, schema).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    after = books.copy()
    for row in sums.collect():
        after[row["part"], row["entry"], row["at"]] = row["total"] // row["n"]
    return after


def trained(kept: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks after all rounds; no more numbers than ``entries`` vectors hold reach the driver."""
    books = first_books(kept, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = improved(kept, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _codes(blocks, books):
    parts, _, width = books.shape
    names = np.array([f"{i:02x}" for i in range(books.shape[1])])
    for table, cells in blocks:
        codes, errors = [], np.zeros(len(cells), np.int64)
        for p in range(parts):
            leaves, place = distinct(cells[:, p * width : (p + 1) * width])
            nearest, error = traverse(leaves, books[p])
            codes.append(names[nearest[place]])
            errors += error[place]
        same = [table.column(c).combine_chunks() for c in ("vec_id", "label")]
        same = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in same]
        yield [*same, ["".join(row) for row in zip(*codes)], errors]


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and squared ``error`` of every kept row."""
    fields = [kept.schema["vec_id"], kept.schema["label"]]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return _over_blocks(kept, books, _codes, schema)


def compressed(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes, errors and error sums by label of ``rows`` (``vec_id``, ``embedding``, ``label``).

    Null, non-finite and differently long vectors are dropped (see ``scaled``); repeated
    rows each get their code; null ids come last where the smallest are asked for; null
    labels form one group; a label's sum beyond 64 bits is null. With fewer rows than
    entries there are fewer entries; an empty table gives no rows. Other columns are ignored.
    """
    kept = scaled(rows)
    books = trained(kept, rounds)
    label = F.coalesce(F.concat(F.lit("+"), F.col("label").cast("string")), F.lit(""))
    results = written(coded(kept, books).withColumn("label_key", label), "vector-codes")
    exact = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint")
    sums = written(results.groupBy("label_key").agg(exact.alias("label_error")), "label-errors")
    return spread_join(results, sums, ["label_key"], "code").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def sql() -> str:
    """The same codes in SQL: every distinct part against every entry of its codebook."""
    rounds = "".join(
        f""",
near{r} AS (
    SELECT l.p, l.part, l.n, min(list_sum(list_transform(list_zip(l.part, b.entry),
        lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {ENTRIES} + b.k) AS best
    FROM leaf l JOIN book{r} b USING (p) GROUP BY l.p, l.part, l.n
)"""
        + (
            f""",
cell{r} AS (
    SELECT p, best % {ENTRIES} AS k, i, sum(part[i] * n) AS s, sum(n) AS m
    FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM near{r}) GROUP BY ALL
),
mean{r} AS (
    SELECT p, k, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS entry
    FROM cell{r} GROUP BY p, k
),
book{r + 1} AS (
    SELECT b.p, b.k, coalesce(u.entry, b.entry) AS entry
    FROM book{r} b LEFT JOIN mean{r} u ON u.p = b.p AND u.k = b.k
)"""
            if r < ROUNDS
            else ""
        )
        for r in range(ROUNDS + 1)
    )
    return f"""
WITH kept AS (
    SELECT vec_id, label,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS cells
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
    SELECT vec_id, label, p,
        cells[p * (len(cells) // {PARTS}) + 1 : (p + 1) * (len(cells) // {PARTS})] AS part
    FROM kept, range({PARTS}) r(p)
),
leaf AS (SELECT p, part, count(*) AS n FROM parts GROUP BY p, part),
book0 AS (
    SELECT p, k, part AS entry
    FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id, part) - 1 AS k FROM parts)
    WHERE k < {ENTRIES}
){rounds},
sha AS (
    SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, k)) AS codebooks_sha256
    FROM book{ROUNDS}
),
coded AS (
    SELECT vec_id, label,
        string_agg(printf('%02x', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code,
        CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
    FROM parts JOIN near{ROUNDS} USING (p, part)
    GROUP BY vec_id, label
)
SELECT vec_id, code, error,
    CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, sha
"""
