"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm.tables import stored


def _attach(edges: DataFrame, centre: str, other: str) -> DataFrame:
    """Smallest node around each centre, itself included, beside each of its edges."""
    least = edges.groupBy(centre).agg(F.least(F.col(centre), F.min(other)).alias("least"))
    return edges.join(least, centre)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, component): the smallest node reachable.

    Every step is a join and an aggregation with partial sums, so a node with a third of all links is no hot spot.
    Each step's links are stored in the shared folder. Only nodes that have a link appear.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _attach(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        small = _attach(large, "a", "b")
        edges = stored(
            small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(small.select("a", F.col("least").alias("b"))).distinct(),
            "edges",
        )
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
