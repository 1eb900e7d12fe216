"""One job from raw articles to every sink: dedup, enrichment, then lake, articles, facts, graph, vectors and mention counts.

A micro-batch is deduplicated and enriched once and written below ``enriched``. Every sink then takes the batches it has not applied,
oldest first, and marks each in a ledger when it is done. A sink that fails keeps its place and catches up with the next batch or by
``deliver``; the others go on. Sinks write one folder per batch and overwrite it, so a batch that is run again leaves one copy. Enriched
batches that every sink has applied are removed, but for the newest of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpuswatch.operators import graph as H
from corpuswatch.operators.tables import to_fact_rows, upsert_articles, write_facts
from corpuswatch.operators.trends import WINDOW_SECONDS, mentions
from corpuswatch.operators.vectors import upsert_vectors, vector_rows
from corpuswatch.sources.lake import write_lake
from corpuswatch.streaming.jobs import Sink, layered_dedup_batch
from corpuswatch.streaming.snapshots import drop_snapshots, snapshot_ids, write_batch, write_snapshot

# Properties of graph nodes that count articles: those of several batches are added.
COUNTERS = ("mention_count", "article_count")


def _graph_sink(path: str) -> Sink:
    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.select(
            *[c for c in df.columns if c not in ("content", "embedding", "sentiment_label", "sentiment_score")],
            F.col("sentiment.label").alias("sentiment_label"), F.col("sentiment.score").alias("sentiment_score"),
        )
        write_batch(H.build_nodes(rows), f"{path}/nodes", batch_id)
        write_batch(H.build_edges(rows), f"{path}/edges", batch_id)
        write_batch(H.relates_to(rows), f"{path}/related", batch_id)

    return write


def _mention_counts(df: DataFrame) -> DataFrame:
    slot = F.window("ts", f"{WINDOW_SECONDS} seconds")["start"]
    return mentions(df).groupBy("kind", "name", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def sinks_under(path: str) -> dict[str, Sink]:
    """The sinks of enriched articles, each with its tables below ``path``."""
    return {
        "lake": lambda df, i: write_lake(df, f"{path}/lake/batch={i}", "overwrite"),
        "articles": lambda df, i: write_batch(df.drop("embedding"), f"{path}/articles", i),
        "facts": lambda df, i: write_facts(to_fact_rows(df), f"{path}/facts/batch={i}", "overwrite"),
        "graph": _graph_sink(path),
        "vectors": lambda df, i: write_batch(vector_rows(df), f"{path}/vectors", i),
        "mentions": lambda df, i: write_batch(_mention_counts(df), f"{path}/mentions", i),
    }


# -- the ledger -------------------------------------------------------------------------------------------


def applied(spark: SparkSession, path: str, sink: str) -> int:
    """Newest batch that the sink has applied, and with it all before; -1 for none."""
    return max(snapshot_ids(spark, f"{path}/ledger/{sink}"), default=-1)


def deliver(spark: SparkSession, path: str, sinks: dict[str, Sink]) -> dict[str, str]:
    """Hand every sink what it has not applied, oldest first; returns the error of each sink that failed. What failed comes again next time."""
    ready = snapshot_ids(spark, f"{path}/enriched")
    errors = {}
    for name, sink in sinks.items():
        last = applied(spark, path, name)
        try:
            for batch_id in (i for i in ready if i > last):
                sink(spark.read.parquet(f"{path}/enriched/batch={batch_id}"), batch_id)
                mark = spark.range(1).select(F.lit(name).alias("sink"), F.current_timestamp().alias("applied_at"))
                write_snapshot(mark, f"{path}/ledger/{name}", batch_id)
        except Exception as error:
            errors[name] = str(error)[:500]
    drop_snapshots(spark, f"{path}/enriched", min(applied(spark, path, name) for name in sinks))
    return errors


def ingest_batch(path: str, process: Callable[[DataFrame], DataFrame], sinks: dict[str, Sink], **dedup) -> Sink:
    """Micro-batch step: dedup against what is remembered (``dedup``: choices of ``layered_dedup_batch``), ``process``, deliver.

    Errors of sinks are noted below ``failures``, one row (sink, error) each.
    """
    judge = layered_dedup_batch(f"{path}/dedup", **dedup)

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        # A batch that comes again after its dedup is not judged again: its sinks only catch up.
        if batch_id not in snapshot_ids(spark, f"{path}/enriched"):
            judge(df, batch_id)
            write_batch(process(spark.read.parquet(f"{path}/dedup/kept/batch={batch_id}")), f"{path}/enriched", batch_id)
            # The kept rows of a batch serve its enrichment only; what later batches need is in the memories.
            drop_snapshots(spark, f"{path}/dedup/kept", batch_id)
        errors = deliver(spark, path, sinks)
        if errors:
            write_batch(spark.createDataFrame(list(errors.items()), "sink string, error string"), f"{path}/failures", batch_id)

    return run


def stream_ingest(
    stream: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], sinks: dict[str, Sink] | None = None, **dedup
) -> DataStreamWriter:
    """Raw articles to all sinks below ``path``; ``process`` is the enrichment (``operators.enrich.enrich`` with its lexicons)."""
    step = ingest_batch(path, process, sinks_under(path) if sinks is None else sinks, **dedup)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


# -- what the sinks hold, over all batches ----------------------------------------------------------------


def current_articles(spark: SparkSession, path: str) -> DataFrame:
    """One row per hash: the text of its first batch, the labels of its last."""
    rows = spark.read.parquet(f"{path}/articles").drop("batch")
    return upsert_articles(rows.limit(0), rows)


def current_vectors(spark: SparkSession, path: str) -> DataFrame:
    return upsert_vectors(None, spark.read.parquet(f"{path}/vectors").drop("batch"))


def current_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all batches: the first write of a property wins, counters are added."""
    p = F.col("props")
    counts = [F.sum(p[c].cast("bigint")).alias(c) for c in COUNTERS]
    seen = F.max(p["last_seen"]).alias("last_seen")
    merged = spark.read.parquet(f"{path}/nodes").groupBy("id", "label").agg(F.min_by("props", "batch").alias("props"), *counts, seen)
    changed = F.map_filter(
        F.create_map(*[x for c in (*COUNTERS, "last_seen") for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()
    )
    kept = F.map_filter("props", lambda k, _: ~k.isin(*COUNTERS, "last_seen"))
    return merged.select("id", "label", F.map_concat(kept, changed).alias("props"))


def current_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of all batches, each once; RELATES_TO edges with the sum of their weights."""
    edges = spark.read.parquet(f"{path}/edges")
    once = edges.groupBy("src", "dst", "type", F.col("props")["sentiment"].alias("_mood")).agg(F.min("weight").alias("weight"), F.min_by("props", "batch").alias("props"))
    related = spark.read.parquet(f"{path}/related").groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))
    return once.drop("_mood").select("src", "dst", "type", "weight", "props").unionByName(related, allowMissingColumns=True)


def mention_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kind, name, slot, n) over all batches."""
    return spark.read.parquet(f"{path}/mentions").groupBy("kind", "name", "slot").agg(F.sum("n").alias("n"))
