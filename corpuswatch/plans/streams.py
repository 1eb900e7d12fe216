"""Registered streaming queries: the driver tables read as file streams and run to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpuswatch.operators.enrich import enrich
from corpuswatch.operators.tables import to_fact_rows
from corpuswatch.plans import fixtures as X
from corpuswatch.plans.queries import query, stamp
from corpuswatch.session import scratch_path
from corpuswatch.sources import adapters as A
from corpuswatch.streaming import ingest as I
from corpuswatch.streaming import jobs as S


def finish(writer: DataStreamWriter) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def collected(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream into a table below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    finish(
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/out")
    )
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return A.stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def article_stream(spark: SparkSession, sf: str) -> DataFrame:
    return A.articles_of(A.stream_table(spark, sf, "documents"))


@query
def stream_volume(spark, sf):
    return collected(S.stream_volume(event_stream(spark, sf), "ts"), "volume").select(stamp("minute").alias("minute"), "count")


@query
def stream_dedup_exact(spark, sf):
    return collected(S.stream_dedup_exact(article_stream(spark, sf)), "exact").select("content_hash")


@query
def stream_dedup_near(spark, sf):
    path = scratch_path(spark, "near")
    finish(S.stream_dedup_near(article_stream(spark, sf), f"{path}/tables", f"{path}/state"))
    return spark.read.parquet(f"{path}/tables/kept").select("url")


#: Choices of the layered dedup under which nothing is forgotten within the table's span.
NEVER = {f"{name}_ttl_seconds": None for name in ("exact", "simhash", "minhash")}


def in_two_parts(spark: SparkSession, sf: str, path: str, job: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Run a job over the articles as they arrive in two parts by time, started anew for the second."""
    docs = A.articles_from_documents(spark, sf)
    at = F.unix_micros("crawled_at").cast("double")
    bounds = docs.select(at.alias("at")).approxQuantile("at", [0.5], 0.01)
    part = sum((F.coalesce((at > b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
    for i in range(len(bounds) + 1):
        docs.where(part == i).write.mode("append").parquet(f"{path}/in")
        finish(job(spark.readStream.schema(docs.schema).parquet(f"{path}/in")))


@query
def stream_dedup_layers(spark, sf):
    """All layers over articles that arrive in two parts, the stream restarted for the second."""
    path = scratch_path(spark, "layers")
    in_two_parts(spark, sf, path, lambda arriving: S.stream_dedup_layers(arriving, f"{path}/tables", f"{path}/state", **NEVER))
    return spark.read.parquet(f"{path}/tables/kept").select("url")


def fixture_enrichment(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    return lambda df: enrich(df, X.gazetteer(spark), X.LEXICON, X.POSITIVE, X.NEGATIVE)


def sink_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sink, key, value) of all that the sinks of an ingest job hold below ``path``."""
    text, props = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")), F.col("props")

    def rows(sink: str, df: DataFrame, key: list, value) -> DataFrame:
        return df.select(F.lit(sink).alias("sink"), F.concat_ws("|", *key).alias("key"), F.coalesce(value, F.lit("")).alias("value"))

    lake = spark.read.schema("url string, hash16 string").json(f"{path}/lake")
    facts = spark.read.parquet(f"{path}/facts")
    parts = [
        rows("lake", lake, ["url"], F.col("hash16")),
        rows("articles", I.current_articles(spark, path), ["url"], F.array_join("categories", ",")),
        rows("facts", facts, ["url"], F.concat_ws("|", "sentiment_label", text("word_count"), text("entity_count"))),
        rows("nodes", I.current_nodes(spark, path), ["label", "id"], F.coalesce(props["mention_count"], props["article_count"])),
        rows("edges", I.current_edges(spark, path), ["type", "src", "dst"], F.coalesce(props["sentiment"], F.when(F.col("type") == "RELATES_TO", text("weight")))),
        rows("vectors", I.current_vectors(spark, path), ["id"], F.col("sentiment")),
        rows("mentions", I.mention_counts(spark, path).where("kind <> 'kw'"), ["kind", "name", stamp("slot")], text("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def stream_ingest(spark, sf):
    """Raw articles in two parts, the job restarted for the second: dedup by all layers, enrichment, every sink."""
    path = scratch_path(spark, "ingest")
    process = fixture_enrichment(spark)
    in_two_parts(spark, sf, path, lambda arriving: I.stream_ingest(arriving, f"{path}/t", f"{path}/state", process, **NEVER))
    return sink_rows(spark, f"{path}/t")


@query
def stream_trends(spark, sf):
    path = scratch_path(spark, "trends")
    finish(S.stream_trends(A.mentions_of(event_stream(spark, sf)), f"{path}/counts", f"{path}/state"))
    return S.trend_table(spark, f"{path}/counts").withColumn("slot", stamp("slot"))


@query
def stream_frequency(spark, sf):
    counts = collected(S.stream_frequency(A.incidents_of(event_stream(spark, sf))), "frequency")
    return counts.withColumn("window_start", stamp("window_start"))


@query
def stream_top_trends(spark, sf):
    path = scratch_path(spark, "top")
    finish(S.refresh_top_trends(A.mentions_of(event_stream(spark, sf)), f"{path}/t", f"{path}/state", every=None))
    return S.newest_snapshot(spark, f"{path}/t/top").select("kind", "name", "velocity")


@query
def stream_live_feed(spark, sf):
    path = scratch_path(spark, "live")
    articles = X.label(article_stream(spark, sf)).withColumn("entities", F.array(F.lit("x")))
    finish(S.stream_live_feed(articles, f"{path}/feed", f"{path}/state"))
    return S.newest_snapshot(spark, f"{path}/feed").select("content_hash", "url", stamp("published_at").alias("published_at"))


@query
def stream_link_events(spark, sf):
    path = scratch_path(spark, "link")
    finish(S.stream_link_events(A.incidents_of(event_stream(spark, sf)), f"{path}/t", f"{path}/state"))
    return spark.read.parquet(f"{path}/t/verdicts").select("event_cluster_id", "verdict", "classification", "confidence")


@query
def stream_fan_out(spark, sf):
    """Articles labelled once per micro-batch and written to a fact table and a raw table."""
    path = scratch_path(spark, "fan")
    sinks = {
        "facts": lambda df, i: S.write_batch(to_fact_rows(df), f"{path}/facts", i),
        "raw": lambda df, i: S.write_batch(df.select("url", "content_hash"), f"{path}/raw", i),
    }
    empty = F.expr("cast(array() as array<struct<name:string,type:string>>)")
    label = lambda df: X.label(df).withColumn("entities", empty)
    finish(S.run_pipeline(article_stream(spark, sf), label, sinks, f"{path}/failed", f"{path}/state"))
    facts = spark.read.parquet(f"{path}/facts").select("url", "sentiment_label", "word_count")
    return facts.join(spark.read.parquet(f"{path}/raw").select("url", "content_hash"), "url")
