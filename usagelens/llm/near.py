"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Shingles of five words weigh the logarithm of their count in the text times a damped
inverse document frequency, which is counted over all documents in a hashed table of
fixed size. Improved consistent weighted sampling draws from each weighted set samples
that agree between two sets with the probability of their weighted Jaccard similarity.
Samples form bands; texts that share a band are candidates, and candidates are verified by
the weighted Jaccard similarity of their whole shingle sets. Verified links make classes.

Equal texts are one node throughout. Inside a band's bucket a text is compared with the
bucket's first one and its neighbours in the order of further samples, never with all;
buckets are ranges of one sorted table, so a bucket of any size is spread over tasks.

Texts of a larger bucket that are not yet in one class meet once more, by a prefix filter:
of each one the rarest shingles that make up a fifth of its weight. Two texts of similarity
0.8 have one of these in common, and few texts share a rare shingle, however many share
the passage that filled the bucket. Where many share all rare shingles, too, every two of
them are compared by their whole weighted shingles, block by block.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.components import components
from usagelens.llm.shingles import mix, pieces, shingles
from usagelens.llm.tables import (
    arrow_schema,
    map_columns,
    record_batch,
    spread_join,
    texts,
    unused,
)
from usagelens.session import written

SIMILARITY = 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
#: Share of equal samples from which a candidate is verified: 3.5 standard errors below.
PROMISING = 0.6
#: Following neighbours in a bucket with which a text is compared, besides the first.
NEIGHBOURS = 3
#: Share of equal samples from which texts that share a rare shingle are verified: 5 standard errors below.
POSSIBLE = 0.5
#: Texts that share a rare shingle and are compared by samples first; more are compared in whole.
WINDOW = 64
#: Shingles of a block of texts that are compared in whole, about.
BLOCK = 1 << 18
#: Cells of the hashed document frequencies.
CELL_BITS = 18

_SEEDS = np.random.default_rng(20240602).integers(0, 1 << 62, SAMPLES, dtype=np.uint64)
_SPREADER = np.uint64(0xD6E8FEB86659FD93)


def _gamma_quantiles() -> np.ndarray:
    """The quantiles of Gamma(2, 1) in the middle of 65,536 equal shares."""
    x = np.geomspace(1e-4, 60, 1 << 20)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), -np.expm1(-x) - x * np.exp(-x), x)


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)


def _cell(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per cell of the hashed shingle table, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in pieces(batch.column(0).to_pylist()):
                cells += np.bincount(_cell(shingles(part)[1]), minlength=len(cells))
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict(
            {"cell": np.append(used, -1), "n": np.append(cells[used], n)}
        )

    rows = (
        texts(docs)
        .select("text")
        .mapInArrow(count, "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    cell, seen = (rows.column(name).to_numpy() for name in ("cell", "n"))
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[cell[cell >= 0]] = seen[cell >= 0]
    return out, int(seen[cell < 0].sum())


def rarity(cells: np.ndarray, n: int) -> np.ndarray:
    """The weight of a shingle by cell: 1 if rare, three quarters of that if in every document.

    The frequency is smoothed by one document in a hundred, and the narrow range keeps a
    large group of near copies together, whose common shingles are frequent by themselves.
    """
    smooth = n / 100 + 1
    share = np.log((n + smooth) / (np.minimum(cells, n) + smooth))
    share = share / math.log((n + smooth) / smooth)
    return ((3 + np.clip(share, 0, 1)) / 4).astype(np.float32)


def weights(codes: np.ndarray, counts: np.ndarray, rare: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts.astype(np.float32))) * rare[_cell(codes)]


def samples(text: np.ndarray, codes: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of :data:`SAMPLES` 32-bit samples; every text has at least one shingle."""
    starts = np.searchsorted(text, np.arange(n))
    log_weight = np.log(weight)
    out = np.empty((n, SAMPLES), np.uint32)
    for k, seed in enumerate(_SEEDS):
        drawn = mix(codes ^ seed)
        parts = drawn.view(np.uint16).reshape(-1, 4)
        r = _GAMMA[parts[:, 0]]
        beta = ((drawn * _SPREADER) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_weight / r + beta)
        log_a = _LOG_GAMMA[parts[:, 1]] - r * (t - beta + 1)
        level = log_a.view(np.int32)
        order = np.where(level < 0, ~level, level | np.int32(-(1 << 31))).view(np.uint32)
        step = t.astype(np.int64).astype(np.uint64) * _SPREADER
        name = ((drawn >> np.uint64(7)) + step) >> np.uint64(32)
        packed = (order.astype(np.uint64) << np.uint64(32)) | name
        out[:, k] = np.minimum.reduceat(packed, starts).astype(np.uint32)
    return out


def signed(docs: DataFrame, rare: np.ndarray) -> DataFrame:
    """``doc_id``, ``key`` (a digest of the text) and ``signature`` of every row."""
    kinds = "doc_id long, key binary, signature binary"
    schema = docs.sparkSession.createDataFrame([], kinds).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = []
            for part in pieces(batch.column(2).to_pylist()):
                text, codes, counts = shingles(part)
                rows = samples(text, codes, weights(codes, counts, rare), len(part))
                signatures += [row.tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(signatures, pa.binary())], schema=arrow
            )

    keyed = texts(docs).select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    return keyed.mapInArrow(run, schema)


def _place(rows: np.ndarray, first: int = 0) -> np.ndarray:
    """A number that orders texts by four of their samples, from the given one on."""
    after = rows.take(range(first, first + 4), axis=1, mode="wrap").astype(np.uint64)
    after &= np.uint64(0x7FFF)
    place = (after[:, 0] << np.uint64(48)) | (after[:, 1] << np.uint64(32))
    return (place | (after[:, 2] << np.uint64(16)) | after[:, 3]).astype(np.int64)


def _seen(nodes: DataFrame) -> DataFrame:
    """What one pass over the sorted buckets gives, by ``kind``.

    ``pair``: ``a`` < ``b`` that meet in a bucket, with ``alike``, their equal samples;
    ``end``: ``a``, the first text of a task's first or last ``bucket``; ``member``: ``a``
    in a ``bucket`` of more texts than are all compared, or one that may go on in another task.
    """

    def bands(batch):
        rows = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, SAMPLES)
        low = rows.astype(np.uint8)
        out = {"bucket": [], "place": [], "node": [], "low": []}
        for band in range(BANDS):
            code = np.full(len(rows), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                code = mix(code * _SPREADER + rows[:, k].astype(np.uint64))
            out["bucket"] += code.astype(np.int64).tolist()
            out["place"] += _place(rows, (band + 1) * ROWS).tolist()
            out["node"] += batch["node"]
            out["low"] += [r.tobytes() for r in low]
        return out

    banded = map_columns(
        nodes.select("node", "signature"), bands, "bucket long, place long, node long, low binary"
    )
    schema = nodes.sparkSession.createDataFrame(
        [], "kind string, a long, b long, alike int, bucket long"
    ).schema
    arrow = arrow_schema(schema)
    least = math.ceil(PROMISING * SAMPLES)

    def rows_of(kind: str, bucket, node) -> pa.RecordBatch:
        none = [None] * len(node)
        columns = {"kind": [kind] * len(node), "a": node, "b": none, "alike": none}
        return record_batch(columns | {"bucket": bucket}, arrow)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # bucket, node, samples of the first row of the current bucket; its rows so far
        tail = None  # the last rows seen
        edge = None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            node = batch.column(2).to_numpy()
            low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            low = low.reshape(-1, SAMPLES)
            if edge is None:
                edge = (int(bucket[0]), int(node[0]))
            if head is None or head[0] != bucket[0]:
                head = (bucket[0], node[0], low[0], 0)
            carried = 0 if tail is None else len(tail[0])
            if carried:
                bucket = np.concatenate((tail[0], bucket))
                node = np.concatenate((tail[1], node))
                low = np.concatenate((tail[2], low))
            n = len(bucket)
            new = np.arange(n) >= carried
            pairs = []
            for k in range(1, NEIGHBOURS + 1):
                i = np.flatnonzero((bucket[k:] == bucket[:-k]) & new[k:]) + k
                pairs.append((node[i], node[i - k], (low[i] == low[i - k]).sum(axis=1)))
            fresh = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            fresh[:carried] = False
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            i = np.flatnonzero(new & (first >= 0) & (first < np.arange(n)) & (bucket != head[0]))
            pairs.append((node[i], node[first[i]], (low[i] == low[first[i]]).sum(axis=1)))
            i = np.flatnonzero(new & (bucket == head[0]) & (node != head[1]))
            pairs.append((node[i], np.full(len(i), head[1]), (low[i] == head[2]).sum(axis=1)))
            one, other, alike = (np.concatenate(x) for x in zip(*pairs))
            good = (alike >= least) & (one != other)
            one, other, alike = one[good], other[good], alike[good].astype(np.int32)
            if len(one):
                columns = {"a": np.minimum(one, other), "b": np.maximum(one, other)}
                columns |= {"kind": ["pair"] * len(one), "alike": alike, "bucket": [None] * len(one)}
                yield record_batch(columns, arrow)
            going_on = bucket == head[0]
            rank = np.where(going_on, head[3] + np.arange(n) - carried, np.arange(n) - first)
            large = new & ((rank > NEIGHBOURS) | (bucket == edge[0]))
            # The row that makes a bucket large brings those before it.
            i = np.flatnonzero(new & (rank == NEIGHBOURS + 1) & (bucket != edge[0]))
            starts = np.where(going_on[i], head[1], node[first[i]])
            before = [starts, *[node[i - k] for k in range(1, NEIGHBOURS + 1)]]
            members = np.concatenate((node[large], *before))
            if len(members):
                where = np.concatenate((bucket[large], np.tile(bucket[i], NEIGHBOURS + 1)))
                yield rows_of("member", where, members)
            if bucket[-1] != head[0]:
                at = first[-1]
                head = (bucket[-1], node[at], low[at], n - at)
            else:
                head = (*head[:3], int(rank[-1]) + 1)
            tail = (bucket[-NEIGHBOURS:], node[-NEIGHBOURS:], low[-NEIGHBOURS:])
        if edge is not None:
            ends = {edge, (int(head[0]), int(head[1]))}
            yield rows_of("end", *zip(*ends))
            if head[0] != edge[0] and head[3] <= NEIGHBOURS + 1:
                last = {int(head[1]), *tail[1][tail[0] == head[0]].tolist()}
                yield rows_of("member", [int(head[0])] * len(last), list(last))

    ordered = banded.repartitionByRange("bucket", "place", "node").sortWithinPartitions(
        "bucket", "place", "node"
    )
    return written(ordered.mapInArrow(compare, schema), "near-seen")


def candidates(seen: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of nodes that meet in a bucket, and ``alike``, their equal samples."""
    least = math.ceil(PROMISING * SAMPLES)
    # The first rows of one bucket in different tasks, a few for each task, meet here.
    ends = seen.where("kind = 'end'").select("bucket", F.col("a").alias("node"))
    joints = (
        ends.groupBy("bucket")
        .agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
        .where("size(all) > 1")
        .select("a", F.explode("all").alias("b"))
        .where("a < b")
        .withColumn("alike", F.lit(least))
    )
    inside = seen.where("kind = 'pair'").select("a", "b", "alike")
    return inside.unionByName(joints).groupBy("a", "b").agg(F.max("alike").alias("alike"))


def divided(seen: DataFrame, groups: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the texts in large buckets that hold more than one class."""
    members = seen.where("kind = 'member'").select("bucket", F.col("a").alias("node"))
    rooted = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = (
        rooted.groupBy("bucket")
        .agg(F.min("root").alias("least"), F.max("root").alias("most"))
        .where("least <> most")
        .select("bucket")
    )
    return spread_join(rooted, mixed, ["bucket"], "node").select("node", "root").distinct()


def prefix(codes: np.ndarray, weight: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The rarest shingles of a text, of which any similar text has one, too.

    A similar text shares at least 0.8 of this one's weight. What follows the prefix in
    the order of frequency and code, which is the same for all texts, weighs less than that,
    so the first shared shingle lies in the prefixes of both.
    """
    order = np.lexsort((codes, cells[_cell(codes)]))
    ordered = weight[order].astype(np.float64)
    before = np.cumsum(ordered) - ordered
    return codes[order[before <= (1 - SIMILARITY + 1e-6) * ordered.sum()]]


def posted(members: DataFrame, bodies: DataFrame, cells: np.ndarray, rare: np.ndarray) -> DataFrame:
    """``code``, ``node`` and ``root``: the members under each shingle of their prefixes."""

    def post(batch):
        out = {"code": [], "node": [], "root": []}
        for node, root, text in zip(batch["node"], batch["root"], batch["text"]):
            _, codes, counts = shingles(next(pieces([text])))
            chosen = prefix(codes, weights(codes, counts, rare), cells).astype(np.int64).tolist()
            out["code"] += chosen
            out["node"] += [node] * len(chosen)
            out["root"] += [root] * len(chosen)
        return out

    told = members.join(bodies, "node").select("node", "root", "text")
    return written(map_columns(told, post, "code long, node long, root long"), "near-posted")


def shared_codes(postings: DataFrame) -> DataFrame:
    """``code`` and ``n``, its texts, of the codes under which more than one class meets.

    Codes under which the very same texts meet are one: the smallest stands for all.
    """
    counted = postings.groupBy("code").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("who"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("also"),
        F.min("root").alias("least"),
        F.max("root").alias("most"),
    )
    mixed = counted.where("least <> most").groupBy("n", "who", "also").agg(F.min("code").alias("code"))
    return written(mixed.select("code", "n"), "near-shared")


def rare_candidates(postings: DataFrame, shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of different roots among the texts, at most :data:`WINDOW`, of a code."""

    def place(batch):
        rows = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, SAMPLES)
        return {"node": batch["node"], "low": [r.tobytes() for r in rows.astype(np.uint8)]}

    drawn = postings.select("node").distinct().join(nodes.select("node", "signature"), "node")
    placed = map_columns(drawn, place, "node long, low binary")
    schema = nodes.sparkSession.createDataFrame([], "a long, b long").schema
    arrow = arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            code, node, root = (batch.column(i).to_numpy() for i in range(3))
            low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            now = (code, node, root, low.reshape(-1, SAMPLES))
            carried = 0 if tail is None else len(tail[0])
            if carried:
                now = tuple(np.concatenate(both) for both in zip(tail, now))
            code, node, root, low = now
            found = []
            for k in range(1, min(WINDOW, len(code))):
                i = np.arange(max(k, carried), len(code))
                i = i[code[i] == code[i - k]]
                if not len(i):
                    break
                i = i[root[i] != root[i - k]]
                i = i[(low[i] == low[i - k]).sum(axis=1) >= POSSIBLE * SAMPLES]
                found.append((node[i], node[i - k]))
            if found:
                one, other = (np.concatenate(x) for x in zip(*found))
                pairs = np.unique(np.stack((np.minimum(one, other), np.maximum(one, other))), axis=1)
                yield record_batch({"a": pairs[0], "b": pairs[1]}, arrow)
            tail = tuple(column[1 - WINDOW :] for column in now)

    few = shared.where(F.col("n") <= WINDOW).select("code")
    return (
        spread_join(postings, few, ["code"], "node")
        .join(placed, "node")
        .repartition("code")
        .sortWithinPartitions("code", "root", "node")
        .select("code", "node", "root", "low")
        .mapInArrow(compare, schema)
        .distinct()
    )


class _Held:
    """The texts of a block, with which others are compared in whole."""

    def __init__(self):
        self.rows, self.cell, self.above, self.vocabulary = [], None, {}, None

    def find(self, root: int) -> int:
        while root in self.above:
            root = self.above[root]
        return root

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows
        self.vocabulary = None

    def links(self, others: list[tuple], once: bool = False) -> Iterator[tuple[int, int]]:
        """Links to ``others`` that join classes not yet joined in this cell.

        ``once``: the others are these rows themselves, so only larger roots are compared.
        """
        if not self.rows or not others:
            return
        if self.vocabulary is None:
            self.vocabulary = np.unique(np.concatenate([r[3] for r in self.rows]))
        others = sorted(others, key=lambda r: r[1])
        root = np.array([r[1] for r in others])
        total = np.array([float(r[4].sum(dtype=np.float64)) for r in others])
        flat = np.concatenate([r[3] for r in others])
        weight = np.concatenate([r[4] for r in others]).astype(np.float64)
        of = np.repeat(np.arange(len(others)), [len(r[3]) for r in others])
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == flat
        at, weight, of = at[known], weight[known], of[known]
        starts = np.searchsorted(of, np.arange(len(others) + 1))
        before = np.concatenate([r[2] for r in others])
        before_of = np.repeat(np.arange(len(others)), [len(r[2]) for r in others])
        mine = np.zeros(len(self.vocabulary))
        for node, own, earlier, codes, own_weight in self.rows:
            fresh = np.ones(len(others), bool)  # those not met under an earlier code
            if len(earlier):
                fresh[before_of[np.isin(before, earlier)]] = False
                if not fresh.any():
                    continue
            own_weight = own_weight.astype(np.float64)
            place = np.searchsorted(self.vocabulary, codes)
            mine[place] = own_weight
            # Others are in the order of their roots: all but those of the same root.
            low, high = np.searchsorted(root, [own, own + 1])
            for i, j in ((0, low), (high, len(others))):
                if i == j or not fresh[i:j].any() or once and not i:
                    continue
                part = slice(starts[i], starts[j])
                common = np.bincount(
                    of[part] - i, np.minimum(mine[at[part]], weight[part]), minlength=j - i
                )
                alike = common / (own_weight.sum() + total[i:j] - common) >= SIMILARITY
                alike &= fresh[i:j]
                for k in np.flatnonzero(alike) + i:
                    a, b = self.find(own), self.find(int(root[k]))
                    if a != b:
                        self.above[max(a, b)] = min(a, b)
                        yield node, others[k][0]
            mine[place] = 0


#: What names a cell, in which one block meets another or itself.
CELL = ("code", "heft", "first", "second")


def mixed_cells(placed: DataFrame) -> DataFrame:
    """The rows of cells in which texts of different roots meet.

    A cell of two blocks needs rows of both; an even ``heft`` with ``first`` = ``second`` is
    a block that meets itself.
    """
    alone = (F.col("heft") % 2 == 0) & (F.col("first") == F.col("second"))
    met = (
        placed.groupBy(*CELL)
        .agg(
            F.min("root").alias("least"),
            F.max("root").alias("most"),
            F.bool_or("later").alias("some"),
            F.bool_and("later").alias("only"),
        )
        .where((F.col("least") != F.col("most")) & (alone | (F.col("some") & ~F.col("only"))))
    )
    return placed.join(met, list(CELL), "left_semi")


def crowded_links(
    postings: DataFrame, shared: DataFrame, bodies: DataFrame, rare: np.ndarray
) -> DataFrame:
    """Links ``a``, ``b`` among the texts of codes that more than :data:`WINDOW` share.

    All pairs of different roots are compared by their whole weighted shingles, each under
    the first code that both share. Texts are dealt into classes of total weight, of which
    only neighbouring ones can hold similar texts, and these into blocks of bounded size;
    every two blocks meet in a cell of their own, so the pairs are spread over tasks and a task
    holds one block. Links that join what others of the cell have joined are left out.
    """
    crowded = shared.where(F.col("n") > WINDOW).select("code")
    joined = spread_join(postings, crowded, ["code"], "node")
    lists = joined.groupBy("node", "root").agg(F.sort_array(F.collect_list("code")).alias("codes"))

    def weigh(batch):
        out = {c: [] for c in ("node", "root", "codes", "heft", "size", "shingles", "counts")}
        for node, root, codes, text in zip(*(batch[c] for c in ("node", "root", "codes", "text"))):
            _, found, counts = shingles(next(pieces([text])))
            weight = weights(found, counts, rare)
            total = float(weight.sum(dtype=np.float64))
            out["heft"].append(math.floor(math.log(total) / -math.log(SIMILARITY - 1e-6)))
            out["size"].append(len(found))
            out["shingles"].append(found.astype(np.uint64).tobytes())
            # Nearly all are 1, so they take less room on the way than the weights.
            out["counts"].append(counts.astype(np.uint32).tobytes())
            for name, value in (("node", node), ("root", root), ("codes", codes)):
                out[name].append(value)
        return out

    kinds = (
        "node long, root long, codes array<long>, heft int, size long, shingles binary, counts binary"
    )
    weighed = written(map_columns(lists.join(bodies, "node"), weigh, kinds), "near-weighed")
    each = weighed.select("node", "root", "heft", "size", F.posexplode("codes").alias("nth", "code"))
    blocks = each.groupBy("code", "heft").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    # A text is in one of its code's blocks; the largest class of weight tells their number.
    blocks = blocks.groupBy("code").agg(F.ceil(F.max("size") / BLOCK).cast("int").alias("blocks"))
    dealt = spread_join(each, blocks, ["code"], "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )

    def cells(heft: str, first: str, second: str, held: bool, over: str) -> DataFrame:
        rows = dealt.withColumn("k", F.explode(F.expr(over)))
        return rows.select(
            "code",
            F.expr(heft).alias("heft"),
            F.expr(first).alias("first"),
            F.expr(second).alias("second"),
            F.lit(not held).alias("later"),
            "node",
            "root",
            "nth",
        )

    last = "blocks - 1"
    placed = (
        cells("2 * heft", "block", "k", True, f"sequence(block, {last})")
        .unionByName(cells("2 * heft", "k", "block", False, "CASE WHEN block > 0 THEN sequence(0, block - 1) END"))
        .unionByName(cells("2 * heft + 1", "block", "k", True, f"sequence(0, {last})"))
        .unionByName(cells("2 * heft - 1", "k", "block", False, f"sequence(0, {last})"))
    )
    schema = postings.sparkSession.createDataFrame([], "a long, b long").schema
    arrow = arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            found: list[tuple[int, int]] = []
            run: list[tuple] = []
            later = False

            def flush():
                if later:
                    found.extend(held.links(run))
                else:
                    inside = held.cell[1] % 2 == 0 and held.cell[2] == held.cell[3]
                    if inside:  # a block with itself, row by row as it comes
                        found.extend(held.links(run))
                        mine = _Held()
                        mine.above = held.above
                        mine.add(run)
                        found.extend(mine.links(run, once=True))
                    held.add(run)
                run.clear()

            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *cell, is_later, node, root, earlier, codes, counts in zip(*columns):
                if run and (cell != held.cell or is_later != later):
                    flush()
                if cell != held.cell:
                    held = _Held()
                    held.cell = cell
                later = is_later
                found_codes = np.frombuffer(codes, np.uint64)
                weight = weights(found_codes, np.frombuffer(counts, np.uint32), rare)
                run.append((node, root, np.array(earlier, np.int64), found_codes, weight))
            if run:
                flush()
            if found:
                yield record_batch({"a": [a for a, _ in found], "b": [b for _, b in found]}, arrow)

    kept = mixed_cells(written(placed, "near-placed"))
    whole = kept.join(weighed.select("node", "codes", "shingles", "counts"), "node")
    told = whole.select(
        *CELL, "later", "node", "root", F.expr("slice(codes, 1, nth)").alias("earlier"), "shingles", "counts"
    )
    ordered = told.repartition(*CELL).sortWithinPartitions(*CELL, "later", "root", "node")
    return ordered.mapInArrow(compare, schema)


def similar(one: str, other: str, rare: np.ndarray) -> float:
    """The weighted Jaccard similarity of two texts' shingles."""
    text, codes, counts = shingles([next(pieces([t]))[0] for t in (one, other)])
    weight = weights(codes, counts, rare).astype(np.float64)
    cut = int(np.searchsorted(text, 1))
    _, i, j = np.intersect1d(codes[:cut], codes[cut:], assume_unique=True, return_indices=True)
    a, b = weight[:cut][i], weight[cut:][j]
    low, total = np.minimum(a, b).sum(), weight.sum()
    return float(low / (total - low))


def verified(pairs: DataFrame, bodies: DataFrame, rare: np.ndarray) -> DataFrame:
    """The pairs ``a``, ``b`` whose texts are similar enough."""

    def run(batch):
        kept = [
            (a, b)
            for a, b, s, t in zip(batch["a"], batch["b"], batch["one"], batch["other"])
            if similar(s, t, rare) >= SIMILARITY
        ]
        return {"a": [p[0] for p in kept], "b": [p[1] for p in kept]}

    one = bodies.select(F.col("node").alias("a"), F.col("text").alias("one"))
    other = bodies.select(F.col("node").alias("b"), F.col("text").alias("other"))
    both = pairs.select("a", "b").join(one, "a").join(other, "b")
    return map_columns(both.select("a", "b", "one", "other"), run, "a long, b long")


def _bodies(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the wanted nodes."""
    keys = wanted.join(nodes.select("node", "key"), "node")
    plain = texts(docs).select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    found = spread_join(plain, keys, ["key"], "doc_id")
    return written(found.groupBy("node").agg(F.first("text").alias("text")), "near-bodies")


def _widened(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more ``links``; without any they stay as they are."""
    if links.isEmpty():
        return groups
    stars = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(links))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``class_id`` and ``copies`` of every row.

    ``class_id`` is the smallest id in the row's class of equal and similar texts,
    ``copies`` the number of rows with this very text. A null text is an empty one, and
    all empty texts are one class. A text of fewer than five words is similar to another
    only if their words are the same. Null ids name no class that has another id. Repeated
    rows share their class; other columns are ignored; no row gives no row.
    """
    cells, n = frequencies(docs)
    rare = rarity(cells, max(n, 1))
    rows = written(signed(docs, rare), "near-signed")
    one_each = rows.groupBy("key").agg(
        F.min("doc_id").alias("least"),
        F.count("*").alias("copies"),
        F.first("signature").alias("signature"),
    )
    nodes = written(one_each.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    seen = _seen(nodes)
    pairs = written(candidates(seen), "near-pairs")
    in_pairs = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bodies = _bodies(docs, in_pairs, nodes)
    # First each text's most promising partner, then what these links have not yet joined.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", -F.col("a"))).alias("a"))
    links = written(verified(best, bodies, rare), "near-links")
    joined = components(links)
    rest = (
        pairs.join(best, ["a", "b"], "left_anti")
        .join(joined.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(joined.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        .select("a", "b")
    )
    more = written(verified(rest, bodies, rare), "near-links")
    groups = _widened(joined, more)
    # What large buckets may have kept apart.
    members = written(divided(seen, groups), "near-divided")
    if not members.isEmpty():
        told = _bodies(docs, members.select("node"), nodes)
        postings = posted(members, told, cells, rare)
        shared = shared_codes(postings)
        most = shared.agg(F.max("n")).first()[0]
        if most:
            missed = rare_candidates(postings, shared, nodes).join(pairs, ["a", "b"], "left_anti")
            late = verified(missed, told, rare)
            if most > WINDOW:
                late = late.unionByName(crowded_links(postings, shared, told, rare))
            groups = _widened(groups, written(late, "near-links"))
    grouped = nodes.select("node", "key", "least").join(groups, "node")
    named = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    class_of = spread_join(grouped, named, ["root"], "key").select("key", "class_id")
    # Only texts that have copies or links need a look-up; any other is its own class.
    shared = (
        nodes.select("key", "least", "copies")
        .join(class_of, "key", "left")
        .where("class_id IS NOT NULL OR copies > 1")
        .select("key", F.coalesce("class_id", "least").alias("class_id"), "copies")
    )
    return spread_join(rows.select("doc_id", "key"), shared, ["key"], "doc_id", "left").select(
        "doc_id",
        "key",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one that gives the class its id.

    Columns stay. Of repeated rows one is kept.
    """
    near_id, near_key, near_text = unused(docs, "near_id", "near_key", "near_text")
    kept = (
        classes(docs)
        .where(F.col("doc_id").eqNullSafe(F.col("class_id")))
        .select(F.col("doc_id").alias(near_id), F.col("key").alias(near_key))
        .distinct()
    )
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(near_text, F.unhex(F.md5(body)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(near_id))
    return (
        keyed.join(kept, same & (F.col(near_text) == F.col(near_key)), "left_semi")
        .dropDuplicates(["doc_id", near_text])
        .drop(near_text)
    )
