"""Connected components of links, by joins and groupings alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import written


def _star(links: DataFrame, to_larger: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones and itself) hang on the least of them and the node instead."""
    if to_larger:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if to_larger:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        moved = joined.filter(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp): for each node of links (a, b: long) the least node of its component.

    Large-star and small-star steps take turns until every node hangs on the least of its component
    (in some log2(nodes) turns); the links of a turn are written to the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    nodes = written(links.select(low.alias("a"), high.alias("b")).distinct())
    now, seen = nodes.filter("a <> b"), None
    while True:
        now = written(_star(_star(now, True), False))
        state = now.agg(F.count(F.lit(1)), F.sum(_digest())).first()
        if state == seen:
            break
        seen = state
    all_nodes = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return all_nodes.join(now.select(F.col("b").alias("node"), F.col("a").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _digest() -> Column:
    """Of a link: an unchanged sum means unchanged links."""
    return F.xxhash64("a", "b").cast("decimal(20)")
