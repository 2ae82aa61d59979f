"""Mixing sources to target weights by a proportionate-fair schedule, in DataFrame and SQL functions.

Every source is cut into blocks of equal size. Block ``i`` (from 0) of a source of weight
``w`` among weights of sum ``t`` must run no earlier than slot ``floor(i*t/w)`` and before
slot ``ceil((i+1)*t/w)``; in each slot the earliest deadline among the released blocks
wins. While all sources last, every prefix of the mixture holds each source to within
less than one block of its weight. When a source runs out a new phase begins, in which
the windows of the others start anew.

In lowest terms the weights of a phase repeat after ``t`` slots: at every multiple of it each
source has run exactly its weight in blocks. So the state there needs no fold over what
came before, and stretches of whole periods list their slots independently of each other.
Only the period in which a source runs out is walked through to find the next phase.

No document is dropped or repeated. Only the list of sources with their counts meets in
one row; the schedule has one row per block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 64
#: Slots that are listed together, at least.
STRETCH = 1024
#: Documents of one source that share a ranking bucket, about.
_BUCKET = 1000
#: Tasks that list the slots, at least.
_FOLDS = 32

#: The greatest common divisor of the numbers of ``a``.
_GCD = """
aggregate(a, 0L, (g, x) -> aggregate(
  sequence(1, 96), struct(greatest(g, x) AS p, least(g, x) AS q),
  (e, n) -> if(e.q = 0L, e, struct(e.q AS p, e.p % e.q AS q)), e -> e.p))
"""


def _winner(used: str, phase: str, t: str) -> str:
    """The source that runs in slot ``t`` of a phase with ``base``, weights ``v``, ``total``, ``since``."""
    return f"""
array_min(filter(
  transform(filter(sequence(0, size(s) - 1), i -> {phase}.v[i] > 0L), i -> struct(
    (({used}[i] - {phase}.base[i] + 1L) * {phase}.total + {phase}.v[i] - 1L) div {phase}.v[i] AS deadline,
    i AS i, (({used}[i] - {phase}.base[i]) * {phase}.total) div {phase}.v[i] AS release)),
  y -> y.release <= {t} - {phase}.since)).i"""


#: The phase that begins at slot ``z.since`` with ``z.used`` blocks of each source; ``whole``
#: periods pass before the one in which a source runs out.
_PHASE = f"""
transform(array(transform(s, (x, i) -> if(z.used[i] < blocks[i], x.w, 0L))), a ->
transform(array({_GCD}), g -> transform(
  array(transform(a, x -> if(g > 0L, x div g, 0L))), v -> struct(
    z.since AS since, z.used AS base, v AS v, aggregate(v, 0L, (m, x) -> m + x) AS total,
    array_min(filter(transform(v, (x, i) -> if(x > 0L, (blocks[i] - z.used[i] - 1L) div x, NULL)),
      x -> x IS NOT NULL)) AS whole))[0])[0])[0]
"""

#: The slots of that last period up to the one in which a source runs out.
_LAST = f"""
aggregate(
  sequence(phase.since + phase.whole * phase.total, phase.since + (phase.whole + 1L) * phase.total - 1L),
  struct(zip_with(phase.base, phase.v, (b, x) -> b + phase.whole * x) AS used, -1L AS ended),
  (r, t) -> if(r.ended >= 0L, r, transform(array({_winner("r.used", "phase", "t")}), p -> struct(
    transform(r.used, (u, k) -> if(k = p, u + 1L, u)) AS used,
    if(r.used[p] + 1L = blocks[p], t + 1L, -1L) AS ended))[0]))
"""

_PHASES = f"""
aggregate(
  sequence(1, size(s)),
  struct(transform(s, x -> 0L) AS used, 0L AS since, cast(array() AS array<struct<
    since: bigint, base: array<bigint>, v: array<bigint>, total: bigint, ended: bigint>>) AS phases),
  (acc, n) -> if(forall(sequence(0, size(s) - 1), i -> acc.used[i] = blocks[i]), acc,
    transform(transform(array(struct(acc.used AS used, acc.since AS since)), z -> {_PHASE}),
      phase -> transform(array({_LAST}), last -> struct(
        last.used AS used, last.ended AS since,
        concat(acc.phases, array(struct(phase.since AS since, phase.base AS base, phase.v AS v,
          phase.total AS total, last.ended AS ended))) AS phases))[0])[0]),
  acc -> acc.phases)
"""

#: Who runs in each slot of a stretch, and which of the source's blocks.
_PICKS = f"""
aggregate(
  sequence(first, least(first + length, phase.ended) - 1L),
  struct(zip_with(phase.base, phase.v, (b, x) -> b + at * (length div phase.total) * x) AS used,
         cast(array() AS array<struct<i: int, j: bigint>>) AS picks),
  (r, t) -> transform(array({_winner("r.used", "phase", "t")}), p -> struct(
    transform(r.used, (u, k) -> if(k = p, u + 1L, u)) AS used,
    concat(r.picks, array(struct(p AS i, r.used[p] AS j))) AS picks))[0],
  r -> r.picks)
"""


def source_name() -> Column:
    """The mixture component of a row; rows without a source form one of their own."""
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def sources(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: the sources ``s`` by name with their documents ``n`` and whole weights ``w``.

    Weights default to the whole square root of a source's size. Given ones count to six
    decimal places; a source they do not name gets the smallest weight. Without documents
    there is no row.
    """
    named = docs.groupBy(source_name().alias("source")).agg(F.count("*").alias("n"))
    weight = F.floor(F.sqrt("n"))
    if weights is not None:
        given = [F.lit(round(w * 1_000_000)) for w in weights.values()]
        pairs = [x for pair in zip(map(F.lit, weights), given) for x in pair]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")
        weight = F.coalesce(table[F.col("source")], F.lit(0))
    weighed = named.withColumn("w", F.greatest(F.lit(1), weight).cast("long"))
    listed = F.sort_array(F.collect_list(F.struct("source", "n", "w"))).alias("s")
    return weighed.agg(listed).where("size(s) > 0")


def schedule(plan: DataFrame, size: int) -> DataFrame:
    """One row per block of ``size`` documents: ``mix_source``, ``mix_block``, ``mix_slot``.

    ``mix_start`` counts the documents in earlier slots: all blocks are full but the last
    ones of the sources that ran out in earlier phases.
    """
    tasks = max(_FOLDS, plan.sparkSession.sparkContext.defaultParallelism)
    missing = (
        f"aggregate(zip_with(s, zip_with(phase.base, blocks, (b, m) -> if(b = m, b, 0L)), "
        f"(x, m) -> if(m > 0L, m * {size}L - x.n, 0L)), 0L, (m, x) -> m + x)"
    )
    return (
        plan.selectExpr("s", f"transform(s, x -> (x.n + {size - 1}L) div {size}L) AS blocks")
        .selectExpr("s", "blocks", f"explode({_PHASES}) AS phase")
        .selectExpr("*", f"{missing} AS missing")
        .selectExpr("*", f"phase.total * (({STRETCH}L + phase.total - 1L) div phase.total) AS length")
        .selectExpr("*", "explode(sequence(0L, (phase.ended - phase.since - 1L) div length)) AS at")
        .selectExpr("*", "phase.since + at * length AS first")
        .repartition(tasks, "first")
        .selectExpr("s", "first", "missing", f"posexplode({_PICKS}) AS (slot, pick)")
        .selectExpr(
            "s[pick.i].source AS mix_source",
            "pick.j AS mix_block",
            "first + slot AS mix_slot",
            f"(first + slot) * {size}L - missing AS mix_start",
        )
    )


def ranked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mix_source`` and ``mix_rank``, the place in the source from 0.

    The order inside a source is that of a hash of the id. Ranks come from counts per
    hash prefix and an order inside each prefix, so a source of any size is spread out.
    """
    digits = max(0, math.ceil(math.log(max(docs.count(), 1) / _BUCKET, 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.select(
        "*",
        source_name().alias("mix_source"),
        key.alias("mix_key"),
        F.substring(key, 1, digits // 2).alias("mix_high"),
        F.substring(key, digits // 2 + 1, digits - digits // 2).alias("mix_low"),
    )
    parts = ["mix_source", "mix_high", "mix_low"]
    low = keyed.groupBy(*parts).agg(F.count("*").alias("n"))
    high = low.groupBy(*parts[:2]).agg(F.sum("n").alias("n"))
    by_low = Window.partitionBy(*parts[:2]).orderBy("mix_low")
    by_high = Window.partitionBy("mix_source").orderBy("mix_high")
    starts = (
        low.withColumn("low_start", F.sum("n").over(by_low) - F.col("n"))
        .drop("n")
        .join(
            high.withColumn("high_start", F.sum("n").over(by_high) - F.col("n")).drop("n"),
            parts[:2],
        )
        .select(*parts, (F.col("low_start") + F.col("high_start")).alias("mix_start"))
    )
    inside = Window.partitionBy(*parts).orderBy("mix_key", "doc_id")
    return (
        keyed.withColumn("mix_row", F.row_number().over(inside))
        .join(starts, parts)
        .withColumn("mix_rank", F.col("mix_start") + F.col("mix_row") - 1)
        .drop("mix_key", "mix_high", "mix_low", "mix_row", "mix_start")
    )


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK
) -> DataFrame:
    """``docs`` with ``mix_block`` (in the source), ``mix_slot`` (in the schedule), ``mix_position``.

    ``weights`` maps sources to positive figures; a source it does not name gets the
    smallest share. Positions number the rows of the mixture from 0 without gaps. Rows
    with equal ids are placed next to each other in their source, null sources are one
    component, texts are not read, and an empty table gives no rows. Columns whose names
    begin with ``mix_`` are replaced.
    """
    plain = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    size = int(block)
    rows = ranked(plain).withColumn("mix_block", F.expr(f"mix_rank div {size}"))
    return rows.join(schedule(sources(plain, weights), size), ["mix_source", "mix_block"]).select(
        *[F.col(c) for c in plain.columns],
        "mix_block",
        "mix_slot",
        F.expr(f"mix_start + mix_rank % {size}").alias("mix_position"),
    )


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, with their own columns only."""
    rows = mixed(docs, **options)
    return rows.repartitionByRange("mix_position").sortWithinPartitions("mix_position").drop(
        "mix_block", "mix_slot", "mix_position"
    )


def sql(block: int = BLOCK) -> str:
    """The positions of :func:`mixed` with default weights as one query over ``documents``, slot by slot."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '')
           ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rk
  FROM documents),
c AS (SELECT source, count(*) AS n FROM d GROUP BY source),
r AS (SELECT source, n, greatest(1, CAST(floor(sqrt(n)) AS BIGINT)) AS w,
             (n + {block - 1}) // {block} AS blocks, row_number() OVER (ORDER BY source) AS i FROM c),
lists AS (SELECT list(w ORDER BY i) AS w, list(blocks ORDER BY i) AS blocks, list(n ORDER BY i) AS n,
                 CAST(sum(w) AS BIGINT) AS total, CAST(sum(blocks) AS BIGINT) AS slots FROM r),
fold AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS pick, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS before,
         list_transform(w, lambda x: CAST(0 AS BIGINT)) AS used, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS base,
         CAST(0 AS BIGINT) AS since, total FROM lists
  UNION ALL
  SELECT slot, pick, used, after, CASE WHEN ended THEN after ELSE base END,
         CASE WHEN ended THEN slot + 1 ELSE since END, CASE WHEN ended THEN total - w[pick] ELSE total END
  FROM (
    SELECT *, list_transform(used, lambda u, i: CASE WHEN i = pick THEN u + 1 ELSE u END) AS after,
           used[pick] + 1 = blocks[pick] AS ended
    FROM (
      SELECT slot + 1 AS slot, used, base, since, fold.total, w, blocks,
        list_min(list_filter(list_transform(w, lambda v, i:
          CASE WHEN used[i] < blocks[i] AND ((used[i] - base[i]) * fold.total) // v <= slot + 1 - since
               THEN (((used[i] - base[i] + 1) * fold.total + v - 1) // v) * 1000000 + i END),
          lambda x: x IS NOT NULL)) % 1000000 AS pick
      FROM fold, lists WHERE slot + 1 < slots))),
p AS (SELECT slot, pick AS i, before[pick] AS j, before FROM fold WHERE slot >= 0)
SELECT d.doc_id, d.source, d.rk // {block} AS block, p.slot,
       CAST(list_sum(list_transform(p.before, lambda b, i: least(lists.n[i], {block} * b))) + d.rk % {block} AS BIGINT)
         AS position
FROM d JOIN r ON r.source = d.source
JOIN p ON p.i = r.i AND p.j = d.rk // {block}
CROSS JOIN lists
"""
