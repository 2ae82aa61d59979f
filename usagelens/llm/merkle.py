"""A Merkle manifest of a table: per-source trees of document digests under one root.

Leaves are ordered by id within their source and cut into aligned blocks of ``3**5``. A
block keeps each of its levels as one string of concatenated hex digests: three children
lie side by side, so a fixed-width substring of a level is exactly the text whose hash is
the parent, and the substrings that flank a digest within its run are the proof's
segments. The digests of the blocks are the leaves of the next tier of blocks, and so on
up to the source's subroot; subroots are leaves of a last tree in the same way.

Every step is a DataFrame or SQL function. Places come from range-sorted files and their
row numbers, so a source with a third of all rows is never in one task, and no task holds
more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.session import written

ARITY, HEIGHT, HEX = 3, 5, 64
BLOCK = ARITY**HEIGHT
RUN = ARITY * HEX

_STEPS = "array<struct<left:string,right:string>>"


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: each field as ``-`` if null, else its byte length, ``:``, its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return _hash(F.concat(*[F.coalesce(p, F.lit("-")) for p in parts]))


def leaves(docs: DataFrame) -> DataFrame:
    """Source key, id, leaf and, for documents that are tampered with, the altered leaf.

    The key sorts as sources do: null first, then by bytes. A document whose id's CRC-32 is
    even loses its line breaks in the altered form; a null id or text is not altered.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("tree"),
        "doc_id",
        leaf_digest(*rest, F.col("text")).alias("digest"),
        F.when(chosen & F.contains("text", F.lit("\n")), leaf_digest(*rest, cut)).alias("altered"),
    )


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Add ``place``, from 0 within the ``tree`` by ``order``, and ``total``, the tree's nodes.

    Rows are written in range partitions of their order, each sorted into files. A row's
    place is its number in its file less the number of its tree's first row there, plus the
    tree's rows in earlier files. Equal rows are told apart by an arbitrary number, so
    that even one repeated row is spread; the window holds one row per file of a tree.
    """
    keys = ["tree", *order, "tie"]
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    ordered = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys), "merkle-order")
    rows = ordered.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    files = rows.groupBy("file", "tree").agg(
        F.count("*").alias("n"),
        F.min("row").alias("first_row"),
        F.min(F.struct(*keys)).alias("least"),
    )
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        files.select(
            "file",
            "tree",
            (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_row")).alias("shift"),
            F.sum("n").over(whole).alias("total"),
        ),
        "merkle-starts",
    )
    return (
        rows.join(starts, ["file", "tree"])
        .withColumn("place", F.col("row") + F.col("shift"))
        .drop("file", "row", "shift", "tie")
    )


def _parents(level: Column) -> Column:
    """The level above: the hash of every run of three digests, concatenated."""
    last = F.ceil(F.length(level) / RUN).cast("int") - 1
    runs = F.sequence(F.lit(0), last)
    return F.array_join(F.transform(runs, lambda r: _hash(F.substring(level, r * RUN + 1, F.lit(RUN)))), "")


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Aligned blocks of placed nodes with their levels as strings.

    ``height`` is the number of levels above the nodes: all of them where the tree has
    further blocks, else as many as it takes until one node remains. ``top`` is the digest
    that stands for the block.
    """
    node = F.struct("place", "digest", *carried)
    rows = (
        nodes.groupBy("tree", "total", F.expr(f"place div {BLOCK}").alias("block"))
        .agg(F.sort_array(F.collect_list(node)).alias("nodes"))
        .withColumn("level0", F.array_join("nodes.digest", ""))
    )
    enough = F.coalesce(
        *[F.when(F.col("total") <= ARITY**h, F.lit(h)) for h in range(HEIGHT)], F.lit(HEIGHT)
    )
    rows = rows.withColumn("height", enough)
    for h in range(HEIGHT):
        above = F.when(F.col("height") > h, _parents(F.col(f"level{h}")))
        rows = rows.withColumn(f"level{h + 1}", above)
    levels = F.array(*[f"level{h}" for h in range(HEIGHT + 1)])
    return rows.select(
        "tree",
        "total",
        "block",
        "nodes",
        "height",
        levels.alias("levels"),
        F.get(levels, F.col("height")).alias("top"),
    )


def tiers(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """All tiers of blocks of placed nodes, lowest first; each is a written table."""
    out = [written(blocks(nodes, *carried), "merkle-blocks")]
    while not (more := out[-1].where(F.col("total") > BLOCK)).isEmpty():
        above = more.select(
            "tree",
            F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"),
            F.col("block").alias("place"),
            F.col("top").alias("digest"),
        )
        out.append(written(blocks(above), "merkle-blocks"))
    return out


def tops(levels: list[DataFrame]) -> DataFrame:
    """``tree`` and the digest that is left of it."""
    done = [t.where(F.col("total") <= BLOCK).select("tree", F.col("top").alias("digest")) for t in levels]
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out


def _steps(q: Column) -> Column:
    """The flanking substrings on every level of a block around the digest above its node ``q``."""

    def step(h: int) -> Column:
        level, node = F.get("levels", F.lit(h)), F.floor(q / ARITY**h).cast("int")
        run, at = F.floor(node / ARITY).cast("int") * RUN, node % ARITY * HEX
        return F.struct(
            F.substring(level, run + 1, at).alias("left"),
            F.substring(level, run + at + HEX + 1, F.lit(RUN - HEX) - at).alias("right"),
        )

    every = F.array(*[step(h) for h in range(HEIGHT)])
    return F.slice(every, F.lit(1), F.col("height"))


def paths(levels: list[DataFrame], beyond: DataFrame | None = None) -> DataFrame:
    """Every node of the lowest tier with the steps from it to the top of its tree and beyond.

    ``beyond`` gives further ``steps`` and columns by ``tree``. Steps go down from tier to
    tier, one row per block, so only the last step has a row per node.
    """
    none = F.array().cast(_STEPS)
    extra = [c for c in beyond.columns if c not in ("tree", "steps")] if beyond else []
    upper = None
    for tier in reversed(levels):
        last = tier.where(F.col("total") <= BLOCK)
        last = last.join(beyond, "tree") if beyond else last.withColumn("steps", none)
        rows = last
        if upper is not None:
            more = tier.where(F.col("total") > BLOCK).join(upper, ["tree", "block"])
            rows = more.unionByName(last)
        each = F.transform("nodes", lambda n, q: F.struct(n.alias("node"), F.concat(_steps(q), "steps").alias("steps")))
        opened = rows.select("tree", *extra, F.explode(each).alias("one"))
        found = opened.select("tree", *extra, "one.node.*", "one.steps")
        upper = found.withColumnRenamed("place", "block").drop("digest")
    return found


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the steps of its proof."""
    return F.aggregate(steps, start, lambda d, s: _hash(F.concat(s["left"], d, s["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document.

    Equal ids are ordered by leaf; repeated rows are leaves of their own, null ids come
    first, null sources are one source. An empty text differs from a null one. An empty
    table gives no rows; other columns are ignored.
    """
    trees = tiers(placed(leaves(docs), "doc_id", "digest"), "doc_id", "altered")
    sources = tops(trees).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    upper = tiers(placed(sources, "source"), "source")
    found = tops(upper).first()
    beyond = paths(upper).select(
        F.col("source").alias("tree"), F.col("digest").alias("subroot"), "steps"
    )
    beyond = written(beyond, "merkle-sources")
    root = F.lit(found["digest"] if found else None).cast("string")
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return (
        paths(trees, beyond)
        .withColumn("folded_root", folded(F.coalesce("altered", "digest"), F.col("steps")))
        .select(
            "doc_id",
            F.col("digest").alias("leaf"),
            "subroot",
            root.alias("root"),
            _hash(proof).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == root).alias("verified"),
        )
    )


def _tree_sql(name: str, source: str) -> str:
    """A recursive tree over (tree, place, total, digest)."""
    return f"""{name} AS (
    SELECT 0 AS lvl, tree, place, total, digest FROM {source}
    UNION ALL
    SELECT lvl + 1, tree, place // 3, (total + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
    FROM {name} WHERE total > 1 GROUP BY lvl, tree, total, place // 3
)"""


def sql() -> str:
    """The same manifest in SQL: trees by recursion level by level, proofs by joins with the runs."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    step = """
    SELECT d.row_id, {nr} + t.lvl AS step,
        coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place < d.at // CAST(3 ** t.lvl AS BIGINT)), '') AS lft,
        coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place > d.at // CAST(3 ** t.lvl AS BIGINT)), '') AS rgt
    FROM {rows} d JOIN {tree} t
        ON t.tree = d.tree AND t.total > 1 AND t.place // 3 = d.at // CAST(3 ** (t.lvl + 1) AS BIGINT)
    GROUP BY d.row_id, t.lvl"""
    low = step.format(nr=0, rows="(SELECT row_id, tree, place AS at FROM placed)", tree="tree")
    high = step.format(
        nr=1000,
        rows="(SELECT p.row_id, '' AS tree, s.place AS at FROM placed p JOIN subroots s ON s.source = p.tree)",
        tree="upper_tree",
    )
    return f"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce('+' || source, '') AS tree, text,
        {fields} AS head,
        xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
            string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END),
            4294967295) % 2 = 0 AS tampered
    FROM documents
),
hashed AS (
    SELECT row_id, doc_id, tree, sha256(head || {field('text')}) AS digest,
        CASE WHEN tampered THEN sha256(head || {field("replace(text, chr(10), '')")}) END AS altered
    FROM docs
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
        count(*) OVER (PARTITION BY tree) AS total
    FROM hashed
),
{_tree_sql("tree", "placed")},
subroots AS (
    SELECT '' AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS place,
        count(*) OVER () AS total
    FROM tree WHERE total = 1
),
{_tree_sql("upper_tree", "subroots")},
steps AS ({low}
    UNION ALL {high}
),
proofs AS (
    SELECT row_id, list({{'l': lft, 'r': rgt}} ORDER BY step) AS path,
        string_agg(lft || rgt, '' ORDER BY step) AS proof
    FROM steps GROUP BY row_id
),
fold AS (
    SELECT p.row_id, 1 AS i, coalesce(p.altered, p.digest) AS digest FROM placed p
    UNION ALL
    SELECT f.row_id, f.i + 1, sha256(q.path[f.i]['l'] || f.digest || q.path[f.i]['r'])
    FROM fold f JOIN proofs q ON q.row_id = f.row_id AND f.i <= len(q.path)
),
ends AS (SELECT row_id, arg_max(digest, i) AS folded_root FROM fold GROUP BY row_id)
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, u.digest AS root,
    sha256(coalesce(q.proof, '')) AS proof_sha256, e.folded_root,
    e.folded_root = u.digest AS verified
FROM placed p JOIN subroots s ON s.source = p.tree
JOIN ends e ON e.row_id = p.row_id LEFT JOIN proofs q ON q.row_id = p.row_id,
(SELECT digest FROM upper_tree WHERE total = 1) u
"""
