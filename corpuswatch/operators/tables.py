"""Table writes: article upsert, analytic facts, trend snapshots, live rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.functions.text import or_empty, word_count
from corpuswatch.operators.identity import first_per_key

REPLACED = ["processed_at", "categories", "category_scores", "sentiment_label", "sentiment_score", "entities"]


def upsert_articles(base: DataFrame, updates: DataFrame, ts: str = "processed_at", tie: str = "url") -> DataFrame:
    """New hashes are added; for known ones only the labels and ``processed_at`` change.

    Several updates of one hash in a batch act in time order: a new article keeps the text of the first and
    the labels of the last. Both come from one rank each, cut before the shuffle.
    """
    replaced = [c for c in REPLACED if c in updates.columns]
    first = first_per_key(updates, ["content_hash"], F.col(ts), F.col(tie))
    last = first_per_key(updates, ["content_hash"], F.col(ts).desc(), F.col(tie).desc()).select(
        "content_hash", *[F.col(c).alias(f"_{c}") for c in replaced]
    )
    fresh = first.join(last, "content_hash").select(
        *[F.col(f"_{c}" if c in replaced else c).alias(c) for c in base.columns]
    )
    b, u = base.alias("b"), fresh.alias("u")
    known, updated = F.col("b.content_hash").isNotNull(), F.col("u.content_hash").isNotNull()

    def pick(c: str) -> Column:
        if c in replaced:
            return F.when(updated, F.col(f"u.{c}")).otherwise(F.col(f"b.{c}"))
        return F.when(known, F.col(f"b.{c}")).otherwise(F.col(f"u.{c}"))

    return b.join(u, F.col("b.content_hash") == F.col("u.content_hash"), "full_outer").select(
        *[pick(c).alias(c) for c in base.columns]
    )


def to_fact_rows(enriched: DataFrame) -> DataFrame:
    """Analytic fact rows with the month they are stored under. Queries filter by crawl time, so that is the month's."""
    return enriched.select(
        or_empty(F.col("content_hash")).alias("content_hash"),
        or_empty(F.col("url")).alias("url"),
        F.left(or_empty(F.col("title")), F.lit(500)).alias("title"),
        or_empty(F.col("source")).alias("source"),
        or_empty(F.col("source_type")).alias("source_type"),
        F.coalesce("language", F.lit("en")).alias("language"),
        or_empty(F.col("region")).alias("region"),
        F.coalesce("published_at", "crawled_at").alias("published_at"),
        "crawled_at",
        "categories",
        F.coalesce("sentiment.label", F.lit("neutral")).alias("sentiment_label"),
        F.coalesce("sentiment.score", F.lit(0.5)).alias("sentiment_score"),
        F.coalesce(F.size("entities"), F.lit(0)).alias("entity_count"),
        word_count(F.col("content")).alias("word_count"),
        F.date_format("crawled_at", "yyyyMM").alias("month"),
    )


def write_facts(facts: DataFrame, path: str, mode: str = "append") -> None:
    """Append facts by month; files are sorted so that row-group statistics help the usual filters."""
    (
        # By range: a day of terabytes is written by many tasks, and files stay sorted.
        facts.repartitionByRange("month", "crawled_at", "source")
        .sortWithinPartitions("month", "crawled_at", "source", "sentiment_label")
        .write.mode(mode)
        .partitionBy("month")
        .parquet(path)
    )


def write_trend_snapshot(trends: DataFrame, path: str, mode: str = "append") -> None:
    """Append a trend list under the day it was computed."""
    (
        trends.select(
            F.col("computed_at").alias("snapshot_at"), "kind", "name", "current_count", "prev_count", "velocity", "is_spike",
            F.date_format("computed_at", "yyyyMMdd").alias("day"),
        )
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def live_feed_rows(df: DataFrame) -> DataFrame:
    """What the live feed shows of an article: eight fields, the first five entities, and the key."""
    return df.select(
        "content_hash", or_empty(F.col("title")).alias("title"), or_empty(F.col("url")).alias("url"),
        or_empty(F.col("source")).alias("source"), "categories", "sentiment", "region", "published_at",
        F.slice("entities", 1, 5).alias("entities"),
    )
