"""Connected components of a graph of any size, by alternating stars.

Each round lets every node point its larger neighbours (large star) and then
its smaller ones (small star) at the smallest node it knows, until the links
are stars around the smallest node of each component.  Links and labels stay
in tables; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b, once through a large or a small star.

    The smallest neighbours are a table of their own: both sides of the join
    are then plain exchanges, of which Spark splits a node with very many links.
    """
    if large:
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        out = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
        others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = others.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of its component, for every node of
    ``links`` (a bigint, b bigint, in any order, repeats allowed)."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(ordered, "links"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == seen:
            break
        seen = state
        middle = written(_star(now, True), "links")
        after = written(_star(middle, False).distinct(), "links")
        for done in (now, middle):
            dropped(done.sparkSession, done)
        now = after
    else:
        raise RuntimeError(f"the components aren't stable after {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
