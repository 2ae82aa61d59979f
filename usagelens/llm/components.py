"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.llm.tables import spread_join
from usagelens.session import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every linked node.

    ``links`` has columns ``a`` and ``b``. Each round joins every node's neighbours to the
    least of them, first for the larger neighbours and then for the smaller ones, until
    every component is a star around its root. Rounds grow with the logarithm of the
    longest path. Only counts reach the driver.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = written(edges.distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            spread_join(both, _least(both), ["u"], "v")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = written(large, "links")
        joined = spread_join(large, _least(large), ["u"], "v")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = written(small, "links")
        state = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("code"),
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
