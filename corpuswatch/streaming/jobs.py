"""Structured Streaming jobs. They reuse the batch operators, so stream and batch agree on on-time data.

State that later batches need is kept in tables under a shared folder. Every micro-batch writes its own
``batch=<id>`` folder and overwrites it when the batch is run again, so a retry after a lost executor or
driver leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpuswatch.functions.fingerprints import jaccard
from corpuswatch.operators import clusters as C
from corpuswatch.operators import dedup as D
from corpuswatch.operators.dedup import MINHASH_SIMILARITY, dedup_exact, with_word_sets
from corpuswatch.operators.fingerprint_tiles import last_known
from corpuswatch.operators.identity import join_rows
from corpuswatch.operators.tables import live_feed_rows
from corpuswatch.operators.insights import rule_insights
from corpuswatch.operators.trends import compute_trends, top_trends
from corpuswatch.operators.verdicts import rule_verdicts
from corpuswatch.session import cut_lineage, discard, stored
from corpuswatch.streaming.memory import Memory
from corpuswatch.streaming.snapshots import newest_snapshot, read_snapshot, snapshot_ids, write_batch, write_snapshot  # noqa: F401

Sink = Callable[[DataFrame, int], None]


def fan_out(sinks: dict[str, Sink], failed_path: str) -> Sink:
    """Write a batch to every sink; a sink that fails is noted with its rows and does not stop the others."""

    def run(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(df, batch_id)
                except Exception as error:
                    noted = df.withColumn("_error", F.lit(str(error)[:500]))
                    noted.write.mode("overwrite").parquet(f"{failed_path}/sink={name}/batch={batch_id}")
        finally:
            df.unpersist()

    return run


def run_pipeline(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], sinks: dict[str, Sink], failed_path: str, checkpoint: str
) -> DataStreamWriter:
    """Consume, process and fan out each micro-batch. ``process`` and the sinks see ordinary DataFrames."""
    write = fan_out(sinks, failed_path)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: write(process(df), batch_id)
    )


def replay_failed(spark: SparkSession, failed_path: str, name: str, sink: Sink) -> int:
    """Hand the noted batches of one sink to it again, oldest first; returns how many batches there were."""
    failed = spark.read.parquet(f"{failed_path}/sink={name}")
    ids = [r["batch"] for r in failed.select("batch").distinct().orderBy("batch").toLocalIterator()]
    for batch_id in ids:
        sink(failed.where(F.col("batch") == batch_id).drop("_error", "batch"), batch_id)
    return len(ids)


# -- dedup ------------------------------------------------------------------------------------------------


def stream_dedup_exact(stream: DataFrame, ts: str = "crawled_at", memory: str = "7 days", key: str = "content_hash") -> DataFrame:
    """First sighting of every hash within the memory; older state is dropped with the watermark."""
    return stream.withWatermark(ts, memory).dropDuplicatesWithinWatermark([key])


def near_dedup_batch(path: str, verify: bool = True, ts: str = "crawled_at", tie: str = "url", chars: int | None = None) -> Sink:
    """Micro-batch step of near-duplicate removal against all articles kept so far.

    Tables under ``path``: ``kept`` (articles), ``bands`` (band key and word-set id of kept articles) and
    ``sets`` (word hashes per id). Rows that match history go first; the rest of the batch is judged among
    itself with the batch operator. Word sets are made where the rows are read and stored once; the rows are judged by slim ones, and
    their texts meet a shuffle only when the kept ones are written. Rows alike in hash, time and ``tie`` are one row.
    """
    key = ["content_hash", ts, tie]

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        words = stored(with_word_sets(df, key, chars), "words")
        slim = dedup_exact(words.select(*key, "_set", "_bands"), ts=ts, tie=tie)
        if batch_id > 0:
            # Only batches before this one: a retry must not meet its own rows.
            before = F.col("batch") < batch_id
            slim = slim.join(spark.read.parquet(f"{path}/kept").where(before).select("content_hash"), "content_hash", "left_anti")
        fresh = [stored(slim, "fresh")]
        if batch_id > 0:
            mine = fresh[0].dropDuplicates(["_set"]).select(F.col("_set").alias("id"), F.explode("_bands").alias("band_key"))
            met = mine.join(spark.read.parquet(f"{path}/bands").where(before).select("band_key", "set_id"), "band_key")
            met = met.select("id", "set_id").distinct()
            if verify:
                met = cut_lineage(met)
                asked = words.join(met.select(F.col("id").alias("_set")).distinct(), "_set", "left_semi").dropDuplicates(["_set"])
                sets = spark.read.parquet(f"{path}/sets").where(before).select("set_id", "words")
                sets = sets.join(met.select("set_id").distinct(), "set_id", "left_semi")
                met = met.join(asked.select(F.col("_set").alias("id"), "_words"), "id").join(sets, "set_id").where(jaccard(F.col("_words"), F.col("words")) >= MINHASH_SIMILARITY)
            fresh.append(stored(fresh[0].join(met.select(F.col("id").alias("_set")), "_set", "left_anti"), "fresh"))
        kept = stored(D._minhash_layer(fresh[-1], MINHASH_SIMILARITY, verify, 1000, "greedy", ts, tie, words), "kept")
        write_batch(kept.select(F.explode("_bands").alias("band_key"), F.col("_set").alias("set_id")), f"{path}/bands", batch_id)
        chosen = words.join(kept.select("_set"), "_set", "left_semi").dropDuplicates(["_set"])
        write_batch(chosen.select(F.col("_set").alias("set_id"), F.col("_words").alias("words")), f"{path}/sets", batch_id)
        discard(words)
        # One column names a row (null meets null inside it), so one shuffle serves the join and the choice among rows alike in all of the key.
        rows = df.withColumn("_row", F.struct(*key)).join(kept.select(F.struct(*key).alias("_row")), "_row", "left_semi")
        write_batch(rows.dropDuplicates(["_row"]).drop("_row"), f"{path}/kept", batch_id)
        discard(*fresh, kept)

    return run


def stream_dedup_near(stream: DataFrame, path: str, checkpoint: str, verify: bool = True) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(near_dedup_batch(path, verify))


def _unmet(rows: DataFrame, known: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows whose ``key`` is not known (columns ``key``, ``until``) at their time. A key has one row: what is known longest decides."""
    longest = known.groupBy(key).agg(F.max(F.coalesce("until", F.lit("9999-12-31").cast("timestamp"))).alias("_until"))
    met = rows.join(longest, key, "left")
    return met.where(F.col("_until").isNull() | (F.col(ts) >= F.col("_until"))).drop("_until").select(*rows.columns)


def layered_dedup_batch(
    path: str, mode: str = "intended", ts: str = "crawled_at", tie: str = "url", exact_ttl_seconds: int | None = D.EXACT_TTL_SECONDS,
    simhash_ttl_seconds: int | None = D.SIMHASH_TTL_SECONDS, minhash_ttl_seconds: int | None = D.EXACT_TTL_SECONDS, compact_every: int = 16,
    hot_limit: int = 1000,
) -> Sink:
    """Micro-batch step of ``dedup_articles``: exact hashes, then SimHash, then MinHash, each against its own memory and within the batch.

    Kept articles go to ``path/kept``. A layer remembers the rows that passed it, for its time to live (``None``: for ever), so the state
    covers that span. Over batches in time order, with memories longer than the stream, the kept rows are those of ``dedup_articles``.
    Rows alike in hash, time and ``tie`` are one row. A row without a hash or time stays out where the exact layer has a time to live,
    as in ``dedup_exact``.
    """
    spans = {"exact": exact_ttl_seconds, "simhash": simhash_ttl_seconds, "minhash": minhash_ttl_seconds}
    memory = {name: Memory(f"{path}/{name}", span, ts, compact_every) for name, span in spans.items()}
    key = ["content_hash", ts, tie]
    simhash_chars, minhash_chars = (D.REFERENCE_SIMHASH_CHARS, D.REFERENCE_MINHASH_CHARS) if mode == "reference" else (None, None)

    def known_fingerprints(rows: DataFrame, known: DataFrame) -> DataFrame:
        """Fingerprints of the batch that a remembered one is close to, with its time."""
        # The newest time decides, so each fingerprint is known with one; what never expires comes after all others.
        forever = (1 << 63) - 1
        latest = F.max(F.coalesce(F.unix_micros(F.col("until").cast("timestamp")), F.lit(forever)))
        known = known.groupBy("simhash").agg(latest.alias("value"))
        if mode == "reference":
            met = known.withColumnRenamed("simhash", "id")
        else:
            known = cut_lineage(known.select(F.col("simhash").alias("id"), "value"))
            met = last_known(cut_lineage(rows.select(F.col("simhash").alias("id")).distinct()), known, D.SIMHASH_DISTANCE)
        return met.select(F.col("id").alias("simhash"), F.when(F.col("value") < forever, F.timestamp_micros("value")).alias("until"))

    def known_sets(rows: DataFrame, known: DataFrame) -> DataFrame:
        """Word sets of the batch that share a band with a remembered one and, as intended, reach the similarity."""
        mine = cut_lineage(rows.groupBy("_set").agg(F.first("_words").alias("_words"), F.first("_bands").alias("_bands")))
        bands = mine.select("_set", F.explode("_bands").alias("band_key"))
        met = bands.join(known.select(F.explode("bands").alias("band_key"), "set_id", "until"), "band_key")
        met = met.groupBy("_set", "set_id").agg(F.max("until").alias("until"))
        if mode != "reference":
            sets = known.select("set_id", "words").dropDuplicates(["set_id"])
            met = met.join(mine.select("_set", "_words"), "_set").join(sets, "set_id").where(jaccard(F.col("_words"), F.col("words")) >= MINHASH_SIMILARITY)
        return met.select("_set", "until")

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates(key)
        narrow = cut_lineage(with_word_sets(D.with_simhash(rows, simhash_chars), [*key, "simhash"], minhash_chars))
        if (known := memory["exact"].read(spark, batch_id)) is not None:
            narrow = _unmet(narrow, known, "content_hash", ts)
        exact = cut_lineage(dedup_exact(narrow, ts=ts, tie=tie, ttl_seconds=exact_ttl_seconds))
        memory["exact"].write(exact.select("content_hash", ts), batch_id)
        fresh = exact
        if (known := memory["simhash"].read(spark, batch_id)) is not None:
            fresh = cut_lineage(_unmet(fresh, known_fingerprints(fresh, known), "simhash", ts))
        near = cut_lineage(D._simhash_layer(fresh, D.SIMHASH_DISTANCE, mode, None, hot_limit, "greedy", simhash_ttl_seconds, ts, tie))
        memory["simhash"].write(near.select("simhash", ts), batch_id)
        fresh = near
        if (known := memory["minhash"].read(spark, batch_id)) is not None:
            fresh = cut_lineage(_unmet(fresh, known_sets(fresh, known), "_set", ts))
        kept = cut_lineage(D._minhash_layer(fresh, MINHASH_SIMILARITY, mode == "intended", hot_limit, "greedy", ts, tie))
        memory["minhash"].write(kept.select(F.col("_set").alias("set_id"), F.col("_words").alias("words"), F.col("_bands").alias("bands"), ts), batch_id)
        write_batch(join_rows(rows, kept.select(*key), key, "left_semi"), f"{path}/kept", batch_id)

    return run


def stream_dedup_layers(stream: DataFrame, path: str, checkpoint: str, **choices) -> DataStreamWriter:
    """All three layers over a stream of articles; ``choices`` as of ``layered_dedup_batch``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(layered_dedup_batch(path, **choices))


# -- windows ----------------------------------------------------------------------------------------------


def stream_trends(mentions: DataFrame, path: str, checkpoint: str, window: str = "30 minutes", memory: str = "2 hours") -> DataStreamWriter:
    """Counts per window and mention, written as they change; ``trend_table`` reads them."""
    counts = (
        mentions.withWatermark("ts", memory)
        .groupBy(F.window("ts", window).alias("w"), "kind", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("slot"), "kind", "name", "n")
    )
    return (
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: write_batch(df, path, batch_id))
    )


def trend_table(spark: SparkSession, path: str, seconds: int = 1800, threshold: float = 2.5) -> DataFrame:
    """Trend ratio per window from the written counts; a window's count only grows, so the largest is the last."""
    counts = spark.read.parquet(path).groupBy("kind", "name", "slot").agg(F.max("n").alias("current_count"))
    w = Window.partitionBy("kind", "name").orderBy("slot")
    follows = F.unix_seconds(F.lag("slot").over(w)) == F.unix_seconds("slot") - seconds
    prev = F.when(follows, F.lag("current_count").over(w)).otherwise(F.lit(0))
    ratio = F.col("current_count") / F.greatest("prev_count", F.lit(1))
    return counts.withColumn("prev_count", prev).withColumn("velocity", F.round(ratio, 3)).withColumn("is_spike", ratio >= threshold)


def stream_frequency(events: DataFrame, window: str = "24 hours", slide: str = "1 hour", memory: str | None = None) -> DataFrame:
    """Events per key in sliding windows: repeats of an event go first, then the windows count.

    Repeats are known for ``memory``. Counts are exact if that is no shorter than the window, which is its default.
    """
    return (
        events.withWatermark("published_at", memory or window)
        .dropDuplicatesWithinWatermark(["article_hash"])
        .groupBy(F.window("published_at", window, slide).alias("w"), "subcategory", F.coalesce("region", F.lit("global")).alias("region"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(F.col("w.start").alias("window_start"), "subcategory", "region", "event_count")
    )


def stream_volume(articles: DataFrame, ts: str = "crawled_at", memory: str = "1 minute") -> DataFrame:
    """Articles per minute, final once the watermark has passed."""
    return (
        articles.withWatermark(ts, memory)
        .groupBy(F.window(ts, "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("minute"), "count")
    )


# -- small tables kept fresh ------------------------------------------------------------------------------


def refresh_top_trends(mentions: DataFrame, path: str, checkpoint: str, every: str | None = "2 minutes") -> DataStreamWriter:
    """Keep the top-trend list (``top``) and the insights from it (``insights``) fresh; ``newest_snapshot`` reads them.

    Mentions of the last two windows are carried over, the lists are rewritten, and old snapshots go.
    """

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        before = read_snapshot(spark, f"{path}/mentions", batch_id)
        both = df.select("kind", "name", "ts") if before is None else before.unionByName(df.select("kind", "name", "ts"))
        bound = both.select((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("b")).scalar()
        write_snapshot(both.where(F.col("ts") >= bound), f"{path}/mentions", batch_id)
        trends = compute_trends(spark.read.parquet(f"{path}/mentions/batch={batch_id}"))
        write_snapshot(top_trends(trends), f"{path}/top", batch_id)
        write_snapshot(rule_insights(trends), f"{path}/insights", batch_id)

    writer = mentions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer if every is None else writer.trigger(processingTime=every)


def stream_live_feed(articles: DataFrame, path: str, checkpoint: str, n: int = 200) -> DataStreamWriter:
    """The newest ``n`` live rows after every batch; ``newest_snapshot`` reads them."""

    def run(df: DataFrame, batch_id: int) -> None:
        before = read_snapshot(df.sparkSession, path, batch_id)
        rows = live_feed_rows(df)
        both = rows if before is None else before.unionByName(rows)
        write_snapshot(both.orderBy(F.col("published_at").desc(), "content_hash", "url").limit(n), path, batch_id)

    return articles.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def stream_link_events(events: DataFrame, path: str, checkpoint: str, mode: str = "intended", **thresholds: float) -> DataStreamWriter:
    """Pattern pass over pending events: full batches are linked and judged, a short rest waits for more."""

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        waiting = read_snapshot(spark, f"{path}/pending", batch_id)
        pending = df if waiting is None else waiting.unionByName(df)
        write_batch(C.assign_batches(pending), f"{path}/batched", batch_id)
        batched = spark.read.parquet(f"{path}/batched/batch={batch_id}")
        write_snapshot(batched.where("pending").select(*df.columns), f"{path}/pending", batch_id)
        ready = batched.where("not pending").drop("pending")
        write_batch(C.link_events(C.with_event_embedding(ready), **thresholds), f"{path}/clusters", batch_id)
        clusters = spark.read.parquet(f"{path}/clusters/batch={batch_id}")
        clock = F.current_timestamp()
        write_batch(rule_verdicts(clusters, ready, clock, mode).drop("mean_credibility"), f"{path}/verdicts", batch_id)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
