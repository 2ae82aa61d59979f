"""Approximate nearest neighbours by NN-descent and greedy graph search.

A neighbour graph over the distinct vectors starts from blocks of vectors that fall on the
same sides of random planes. Each round joins every vector's neighbours, and those it is
a neighbour of, with one another: whoever is near my neighbour is likely near me. Only
pairs with a neighbour that is new since the last round are looked at, and only
improvements are kept. Queries then walk the graph from where they stand, always on from
the best vectors seen. Rounds run on vectors rounded to a byte a component; what the walk
found is measured again on the original vectors in double precision.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from usagelens.llm.tables import map_columns, sorted_side, spread_join
from usagelens.session import written

#: Neighbours of a vector in the graph; rounds at most; share of new edges that ends them.
DEGREE, ROUNDS, SETTLED = 40, 8, 0.015
#: Orders that start the graph, planes of each, vectors of a block, neighbours from each.
ORDERS, PLANES, BLOCK, SEEDS = 4, 14, 512, 12
#: Candidates that one meeting offers to a vector.
OFFERS = 8
#: Steps of a walk, vectors it goes on from in each step, and vectors measured at the end.
STEPS, BEAM, MEASURED = 4, 32, 80
_SALTS = 32


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part.

    Null vectors, zero ones, those that hold a null, NaN or infinite component and those
    of another than the most frequent length do not.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = rows.where("vec_id IS NOT NULL AND size(vector) > 0").where(
        ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    )
    sizes = sound.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    common = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return sound.where(F.size("vector") == (common["n"] if common else 0))


def _top(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key; the rows of one key are first thinned in parts."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS))
    thin = Window.partitionBy(key, "part").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    return (
        rows.withColumn("part", part)
        .withColumn("at", F.row_number().over(thin))
        .where(F.col("at") <= n)
        .drop("part")
        .withColumn("at", F.row_number().over(whole))
        .where(F.col("at") <= n)
        .drop("at")
    )


def encode(vectors: np.ndarray) -> list[bytes]:
    """Each vector as its scale (8 bytes) and a signed byte a component."""
    scale = np.abs(vectors).max(axis=1)
    codes = np.rint(vectors / scale[:, None] * 127).astype(np.int8)
    return [np.float64(s / 127).tobytes() + c.tobytes() for s, c in zip(scale, codes)]


def decode(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :8]).view(np.float64)
    return (raw[:, 8:].view(np.int8) * scale).astype(np.float64)


def _best(similar: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest entries of each row."""
    n = min(n, similar.shape[1])
    return np.argpartition(-similar, n - 1, axis=1)[:, :n]


def _first_edges(nodes: DataFrame, order: int) -> DataFrame:
    """The nearest of each vector among a block that one order puts next to it."""

    def sides(batch):
        vectors = decode(batch["code"])
        rng = np.random.default_rng(order)
        planes = rng.normal(size=(vectors.shape[1], PLANES))
        bits = (vectors @ planes > 0).astype(np.int64) @ (1 << np.arange(PLANES)[::-1])
        return {"node": batch["node"], "code": batch["code"], "side": bits}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows):
            ids = np.array([r[0] for r in rows])
            vectors = decode([r[1] for r in rows])
            similar = vectors @ vectors.T
            np.fill_diagonal(similar, -np.inf)
            best = _best(similar, min(SEEDS, len(ids) - 1))
            return pa.RecordBatch.from_pydict(
                {
                    "node": np.repeat(ids, best.shape[1]),
                    "nbr": ids[best].ravel(),
                    "sim": np.take_along_axis(similar, best, axis=1).ravel(),
                }
            )

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(held) >= 2 * BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if len(held) > 1:
            yield block(held)

    placed = map_columns(nodes.select("node", "code"), sides, "node long, code binary, side long")
    ordered = placed.repartitionByRange("side", "node").sortWithinPartitions("side", "node")
    return ordered.select("node", "code").mapInArrow(pairs, "node long, nbr long, sim double")


def _nearest(edges: DataFrame) -> DataFrame:
    """The :data:`DEGREE` nearest neighbours of each node; an edge seen before is not fresh."""
    once = (
        edges.repartition("node")
        .groupBy("node", "nbr")
        .agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    )
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    return once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= DEGREE).drop("at")


def _met(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Improving edges between vectors that have a neighbour in common."""
    forward = edges.select(F.col("node").alias("v"), F.col("nbr").alias("u"), "fresh")
    backward = edges.select(F.col("nbr").alias("v"), F.col("node").alias("u"), "fresh")
    order = [F.desc("fresh"), F.xxhash64("u", "v")]
    around = (
        forward.unionByName(_top(backward, "v", order, DEGREE))
        .groupBy("v", "u")
        .agg(F.max("fresh").alias("fresh"))
    )
    worst = edges.groupBy("node").agg(
        F.when(F.count("*") < DEGREE, float("-inf")).otherwise(F.min("sim")).alias("worst")
    )
    known = nodes.select("node", "code").join(sorted_side(worst), "node").withColumnRenamed("node", "u")
    meetings = (
        spread_join(around, known, ["u"], "v", grows=True)
        .groupBy("v")
        .agg(F.collect_list(F.struct("u", "code", "worst", "fresh")).alias("all"))
        .select("all")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, one, other, near = batch.column(0), [], [], []
            flat, cuts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = flat.field("u").to_numpy()
            fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
            worst = flat.field("worst").to_numpy()
            vectors = decode(flat.field("code").to_pylist()) if len(flat) else None
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                similar = vectors[a:b] @ vectors[a:b].T
                looked = fresh[a:b, None] | fresh[None, a:b]
                np.fill_diagonal(looked, False)
                similar[~looked] = -np.inf
                best = _best(similar, OFFERS)
                value = np.take_along_axis(similar, best, axis=1)
                row, column = np.nonzero(value > worst[a:b, None])
                one.append(ids[a:b][row])
                other.append(ids[a:b][best[row, column]])
                near.append(value[row, column])
            if one:
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": np.concatenate(one),
                        "nbr": np.concatenate(other),
                        "sim": np.concatenate(near),
                    }
                )

    return meetings.mapInArrow(meet, "node long, nbr long, sim double")


def graph(nodes: DataFrame) -> DataFrame:
    """``node``, ``nbr`` and ``sim``: the neighbour graph of the coded vectors."""
    edges = None
    for order in range(ORDERS):
        more = _first_edges(nodes, order)
        edges = more if edges is None else edges.unionByName(more)
    edges = written(_nearest(edges.withColumn("fresh", F.lit(True))), "graph")
    for _ in range(ROUNDS):
        found = _met(edges, nodes).withColumn("fresh", F.lit(True))
        old = edges.withColumn("fresh", F.lit(False))
        edges = written(_nearest(old.unionByName(found)), "graph")
        state = edges.agg(F.count("*").alias("n"), F.count_if("fresh").alias("new")).first()
        if state["new"] <= SETTLED * state["n"]:
            break
    return edges.select("node", "nbr", "sim")


def walked(starts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query``, ``node``: the vectors that a greedy search from each start found nearest."""
    codes = nodes.select("node", "code")
    asked = starts.select(F.col("node").alias("query")).join(
        sorted_side(codes.select(F.col("node").alias("query"), F.col("code").alias("ask"))), "query"
    )
    asked = written(asked, "walk")
    seen = edges.join(sorted_side(asked.select("query")), F.col("node") == F.col("query")).select(
        "query", F.col("nbr").alias("node"), "sim", F.lit(False).alias("left")
    )
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "node")

    def measure(batch):
        one, other = decode(batch["ask"]), decode(batch["code"])
        return {
            "query": batch["query"],
            "node": batch["node"],
            "sim": np.einsum("ij,ij->i", one, other),
        }

    links = edges.select(F.col("node").alias("from"), "nbr")
    for step in range(STEPS):
        ahead = (
            seen.where("NOT left")
            .withColumn("at", F.row_number().over(order))
            .where(F.col("at") <= BEAM * (2 if step == 0 else 1))
            .select("query", F.col("node").alias("from"))
        )
        ahead = written(ahead, "walk")
        reached = (
            spread_join(ahead, links, ["from"], "query", grows=True)
            .select("query", F.col("nbr").alias("node"))
            .distinct()
            .where("query <> node")
            .join(sorted_side(seen.select("query", "node")), ["query", "node"], "left_anti")
        )
        measured = spread_join(reached, codes, ["node"], "query", grows=True)
        pairs = measured.join(sorted_side(asked), "query")
        kinds = "query long, node long, sim double"
        found = map_columns(pairs.select("query", "node", "ask", "code"), measure, kinds)
        gone = ahead.withColumnRenamed("from", "node").withColumn("went", F.lit(True))
        marked = seen.join(sorted_side(gone), ["query", "node"], "left").select(
            "query", "node", "sim", (F.col("left") | F.coalesce("went", F.lit(False))).alias("left")
        )
        both = marked.unionByName(found.withColumn("left", F.lit(False)))
        kept = both.withColumn("at", F.row_number().over(order)).where(F.col("at") <= 4 * MEASURED)
        seen = written(kept.drop("at"), "walk")
    best = seen.withColumn("at", F.row_number().over(order)).where(F.col("at") <= MEASURED)
    return best.select("query", "node")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the usable rows whose ``vec_id`` is divisible by ``every``; candidates all
    usable rows but the query's own. The score is the inner product in double precision;
    nearest first, ties to the smaller id. Equal vectors are one node of the graph and
    come back as their rows; a query with fewer candidates gets them all where the table
    has no more than the graph's degree. Ids are taken as distinct; rows that repeat an id
    with the same vector count once. Other columns are ignored; no query gives no row.
    """
    rows = written(usable(vectors).distinct().withColumn("body", F.xxhash64("vector")), "vectors")
    one_each = rows.groupBy("body", "vector").agg(F.min("vec_id").alias("node"))

    def coded(batch):
        return {
            "node": batch["node"],
            "body": batch["body"],
            "code": encode(np.array(batch["vector"], np.float64)),
            "vector": batch["vector"],
        }

    kinds = "node long, body long, code binary, vector array<double>"
    nodes = written(map_columns(one_each.select("node", "body", "vector"), coded, kinds), "nodes")
    own = nodes.select("body", "node", F.col("vector").alias("same"))
    members = written(
        spread_join(rows, own, ["body"], "vec_id", grows=True)
        .where(F.col("vector") == F.col("same"))
        .select("vec_id", "node"),
        "members",
    )
    queries = members.where(F.col("vec_id") % every == 0)
    starts = queries.select("node").distinct()
    edges = graph(nodes)
    found = walked(starts, edges, nodes)
    found = found.unionByName(starts.select(F.col("node").alias("query"), "node")).distinct()
    exact = nodes.select("node", "vector")
    product = F.aggregate(
        F.zip_with("asked", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )
    scores = (
        spread_join(found, exact, ["node"], "query", grows=True)
        .join(
            sorted_side(exact.select(F.col("node").alias("query"), F.col("vector").alias("asked"))),
            "query",
        )
        .select("query", "node", product.alias("score"))
    )
    # Of equal vectors only the first rows can be among the nearest; one may be the query.
    few = _top(members, "node", [F.asc("vec_id")], k + 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        spread_join(scores, few, ["node"], "query", grows=True)
        .withColumn("at", F.row_number().over(best))
        .where(F.col("at") <= k + 1)
        .select("query", "vec_id", "score")
    )
    ids = queries.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        spread_join(ids, lists, ["query"], "query_id", grows=True)
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
