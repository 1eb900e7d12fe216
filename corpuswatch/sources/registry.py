"""Source registry join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswatch.operators.identity import first_per_key
from corpuswatch.session import broadcast_if_small


def with_source_info(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_region`` and ``source_priority`` by source name; unknown sources keep nulls.

    One row per source name is joined, so the article side keeps its row count. The registry is broadcast
    when its row count says it is small.
    """
    info = first_per_key(sources, ["name"], F.col("priority"), F.col("region")).select(
        F.col("name").alias("source"), F.col("region").alias("source_region"), F.col("priority").alias("source_priority")
    )
    return articles.join(broadcast_if_small(info), "source", "left")
