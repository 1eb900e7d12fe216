"""Driver tables in the shape the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswatch.operators.identity import with_content_hash
from corpuswatch.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files: one file, or a folder of them.

    The path is a pattern that only this name fits, because a file stream takes plain paths for folders.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def articles_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(spread(table(spark, sf_dir, "documents")))


def articles_of(documents: DataFrame) -> DataFrame:
    """Documents as raw articles: the first line is the title."""
    at = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return with_content_hash(
        documents.select(
            "doc_id",
            F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"),
            "source",
            F.lit("web").alias("source_type"),
            F.lit(None).cast("string").alias("author"),
            F.col("lang").alias("language"),
            F.upper("lang").alias("region"),
            at.alias("published_at"),
            at.alias("crawled_at"),
        )
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def mentions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mentions per event: its type as a category and its user as an entity."""
    return mentions_of(table(spark, sf_dir, "events"))


def mentions_of(events: DataFrame) -> DataFrame:
    pairs = F.array(
        F.struct(F.lit("cat").alias("kind"), F.col("event_type").alias("name")),
        F.struct(F.lit("ent").alias("kind"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("name")),
    )
    return events.select(F.col("event_id").cast("string").alias("content_hash"), "ts", F.inline(pairs))


def incidents_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classified unusual events."""
    return incidents_of(table(spark, sf_dir, "events"))


def incidents_of(events: DataFrame) -> DataFrame:
    five = F.col("user_id") % 5
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").cast("string").alias("article_hash"),
        F.concat(F.lit("event://"), F.col("event_id").cast("string")).alias("url"),
        F.concat_ws(" ", F.col("event_type"), F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("feed"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.col("ts").alias("published_at"),
        F.col("event_type").alias("subcategory"),
        F.initcap("event_type").alias("subcategory_label"),
        (F.lit(0.5) + (F.col("event_id") % 50) / F.lit(100.0)).alias("credibility_score"),
        # value / 20 to three decimals, half up, in whole numbers: no binary noise on the half-way cases.
        (F.least(F.floor((F.round(F.col("value") * 100) + 1) / 2), F.lit(1000)) / F.lit(1000.0)).alias("anomaly_score"),
        F.lit(0.5).alias("source_reliability"),
        F.array("event_type").alias("matched_signals"),
        F.when(five != 0, F.concat(F.lit("R"), five.cast("string"))).alias("region"),
        F.array(F.struct(user.alias("name"), F.lit("person").alias("type"))).alias("entities"),
        F.col("props").alias("content_snippet"),
    )


def baskets_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: the order as the article, the part as an entity key, the line as list position."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("article"),
        F.col("l_partkey").cast("string").alias("entity_key"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_suppkey").cast("string").alias("source"),
    )


def sources_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_name").alias("name"),
            F.col("r_name").alias("region"),
            (F.col("s_suppkey") % 3 + 1).alias("priority"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("title")
    )
