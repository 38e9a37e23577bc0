"""Connected components of a link table by alternating large-star and small-star rounds.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.) Every round is joins and
map-side combined minima over the links alone; only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return (both.where("b > a").join(least, "a").where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    side = (down.join(least, "a").where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b")))
    return side.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a long, b long)`` that is not itself a root.

    The root is the smallest node of its component. Self links, repeated links, nulls on either
    side and empty tables are fine; links with a null are no links.
    """
    links = written(links.where("a <> b"), "links")  # read twice in a round
    state = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).head()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
