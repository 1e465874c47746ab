"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that links (``a``, ``b``) reach, for every node of a link.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers one step further
    and merges the links of nodes that met; paths shrink by half or more in a round. Every table is written to the
    shared folder; nothing but the number of open links comes to the driver. Hot nodes are summed within the tasks
    before the shuffle, and the joins are inner joins that adaptive execution can split.
    """
    links = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    at = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
        near = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        step = materialise(near)
        onward = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        # A pointer leads to a smaller node, which is a node of a link and so has a pointer of its own.
        jump = materialise(step.join(onward, "up").select("node", "top"))
        if at is None:
            at = jump.select("node", F.col("top").alias("root"))
        else:
            moved = jump.select(F.col("node").alias("root"), "top")
            at = materialise(at.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        first = links.join(jump.select(F.col("node").alias("a"), F.col("top").alias("c")), "a").select("b", "c")
        both_ends = first.join(jump.select(F.col("node").alias("b"), F.col("top").alias("d")), "b")
        links = materialise(
            both_ends.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        )
    return at if at is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
