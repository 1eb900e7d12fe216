"""Connected components of links between string ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswatch.session import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the least id that links lead to. Ids without a link do not appear; null ids link nothing.

    Large-star and small-star rounds in turn: every node is tied to the least of its neighbours until nothing changes, which takes
    about the logarithm of the longest path. A round is two aggregations and joins, so a node with very many links is spread.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        sides = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(edges.select(F.col("low").alias("node"), F.col("high").alias("other")))
        tied = sides.join(sides.groupBy("node").agg(F.min("other").alias("_least")).withColumn("least", F.least("node", "_least")).drop("_least"), "node")
        large = tied.where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low")).where("high <> low").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high")
        edges = stored(
            small.where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(small.select("high", F.col("least").alias("low"))).distinct(), "edges"
        )
    pairs = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return pairs.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
