"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfreq.llm.scratch import checkpointed


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node of the links u, v.

    Both steps only ever take minima per node, which are combined before the shuffle, and join
    them back to the links, where a node with very many links can be split. The number of rounds
    grows with the logarithm of the number of nodes. No row leaves the executors but a count and a
    checksum per round.
    """
    links = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .filter("u <> v").distinct())
    mark = _mark(links)
    while mark[0]:
        # u is the larger end of every link; a larger neighbour goes to the smallest neighbour or the node itself.
        upward = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = links.unionByName(upward.select("u", F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m"))
        large = upward.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                               F.col("m").alias("v")).distinct())
        links = checkpointed(small)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
