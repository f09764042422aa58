"""Connected components of links between numbered rows, in rounds of star operations.

Each round joins every node's larger neighbours to its smallest neighbour and then every
node's smaller neighbours to their smallest, until all links point to the root of their
component (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Rounds
are written, so no plan grows and both sides of a join are tables whose hot nodes adaptive
execution can split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def to_smallest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs, written, and for each ``u`` the smallest of itself and its ``v``."""
    pairs = cut(pairs, "pairs")
    return pairs, cut(
        pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
        "smallest")


def stars(links: DataFrame) -> DataFrame:
    """``links`` (a, b) as stars: one row (a, b) per node but the root b, the smallest."""
    current = cut(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(current)
    while before[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        pairs, least = to_smallest(both)
        large = pairs.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs, least = to_smallest(large)
        # From a node's smaller neighbours to the smallest, and from the node itself.
        small = pairs.join(least, "u").select(
            F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        current = cut(small.where("a <> b").distinct(), "links")
        now = state(current)
        if now == before:
            break
        before = now
    return current
