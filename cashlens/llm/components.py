"""Connected components by alternating large-star and small-star steps, each a minimum per node and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.common import written


def components(links: DataFrame, folder: str, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that links reach.

    A node with many links is no group in one task: minima combine on the mappers, and the join that hands a
    minimum back to the node's links may be split by Spark. Rounds grow with the logarithm of the longest path.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = written(edges, folder, f"{name}_0")
    before = None
    for turn in range(1, max_rounds + 1):
        # large star: every larger neighbour of a node is tied to the smallest of its neighbours and itself
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: every smaller neighbour and the node itself are tied to the smallest neighbour
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        tied = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e"))
        edges = written(tied.select("e.*").where("v <> u").distinct(), folder, f"{name}_{turn}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
