"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.runtime import durable


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of each node to the least of them (and of the node itself).

    large-star: all larger neighbours; small-star: the node and its smaller
    neighbours. Minima come from an aggregate and a join back, so a node with
    very many neighbours is not held by one task.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # Edges point from the larger node to the smaller one.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = (edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a != b").distinct()


def components(links: DataFrame, id_type: str) -> DataFrame:
    """`row_id` and `component`, the least id it is joined with, of every linked node.

    Stops when a round changes nothing; the number of rounds grows with the
    logarithm of the longest path.
    """
    edges = durable(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct())
    # Order-free fingerprint of the edges: equal before and after means no change.
    mark = F.struct(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h"))
    before = edges.agg(mark.alias("m")).first()["m"]
    while before["n"]:
        edges = durable(_star(_star(edges, True), False))
        after = edges.agg(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    # Every edge now ends in the least id of its component.
    out = edges.select(F.col("a").alias("row_id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("row_id"), F.col("b").alias("component")).distinct()
    return durable(out.unionByName(roots))
