"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Each step is joins and aggregates on the nodes; a node with very many links is split by the adaptive
skew join, since its links only meet one row with its smallest neighbour. The number of rounds grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.workspace import checkpointed


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_smallest(both), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    sent = down.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return sent.unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has a link; the root is the smallest node that can be reached."""
    links = checkpointed(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))

    def mark(frame: DataFrame):
        return frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()

    before = None
    while True:
        links = checkpointed(_small_star(_large_star(links)))
        now = mark(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
