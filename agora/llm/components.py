"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.llm.common import stored


def _smallest(links: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours; links are (u, v) both ways."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Large-star and small-star rounds (Kiveris and others, 2014): each round links every node
    to the smallest node around it, until all links lead straight to the smallest node of
    their component. The rounds are logarithmic in the longest path. A node's neighbours
    are never gathered: their minimum is aggregated and joined back.
    """
    edges = stored(
        spark,
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "links",
    )
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node are linked to the smallest around it.
        large = (
            both.join(_smallest(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # Small star: neighbours below a node, and the node, are linked to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = stored(spark, small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
