"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize


def _centre(edges: DataFrame, of: str) -> DataFrame:
    """edges(u, v) with the least neighbour of each u, or u itself if that is less (large star) or not (small star)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if of == "large":
        least = least.select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of one orderable type to (node, root): root is the least node reachable; only nodes with a link to another.

    Each round is written to the shared folder. A node with very many links is the centre of a star after the first
    round: its least neighbour is found with partial aggregation, and the join that follows is one that Spark splits. Rounds go on
    until one changes nothing, about the logarithm of the longest path squared at most. Null nodes have no links.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _centre(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = _centre(down, "small")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        last, edges = edges, materialize(small.where("u <> v").distinct(), "links")
        discard(last)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
