"""Streams over several micro-batches agree with the batch operators."""

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuswatch.operators import aggregates as G
from corpuswatch.operators import dedup as D
from corpuswatch.operators import trends as R
from corpuswatch.operators.tables import to_fact_rows
from corpuswatch.plans import fixtures as X
from corpuswatch.plans import streams as P
from corpuswatch.session import stored
from corpuswatch.sources import adapters as A
from corpuswatch.streaming import ingest as I
from corpuswatch.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def in_files(df, path, order, n):
    """Write rows as ``n`` files in order and read them back one file per micro-batch."""
    rows = df.orderBy(order).toPandas()
    step = -(-len(rows) // n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(rows.iloc[i * step : (i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@pytest.fixture(scope="module")
def docs(spark):
    return A.articles_from_documents(spark, SF)


@pytest.mark.parametrize("n", [1, 4])
def test_near_dedup_equals_batch(spark, docs, tmp_path, n):
    stream = in_files(docs, tmp_path / "in", "crawled_at", n)
    finish(S.stream_dedup_near(stream, str(tmp_path / "t"), str(tmp_path / "c")))
    got = {r["url"] for r in spark.read.parquet(str(tmp_path / "t" / "kept")).collect()}
    want = {r["url"] for r in D.dedup_minhash(D.dedup_exact(docs)).collect()}
    assert got == want


def test_near_dedup_retry_changes_nothing(spark, docs, tmp_path):
    step = S.near_dedup_batch(str(tmp_path / "t"))
    cut = dt.datetime(2024, 1, 1, 1, 40)
    first, second = docs.where(F.col("crawled_at") < cut), docs.where(F.col("crawled_at") >= cut)
    step(first, 0)
    step(second, 1)
    once = spark.read.parquet(str(tmp_path / "t" / "kept")).count()
    step(second, 1)
    assert spark.read.parquet(str(tmp_path / "t" / "kept")).count() == once


def test_near_dedup_of_rows_alike_and_without_a_time(spark, docs, tmp_path):
    """Rows alike in hash, time and url come out once, null times are times, and a batch leaves neither shuffles nor tables behind."""
    timeless = docs.withColumn("crawled_at", F.when(F.hash("url") % 3 != 0, F.col("crawled_at")))
    rows = timeless.unionByName(timeless.limit(20)).cache()
    want = sorted(r["url"] for r in D.dedup_minhash(D.dedup_exact(rows)).collect())
    root, before = Path(stored(spark.range(1), "probe").inputFiles()[0].removeprefix("file://")).parent.parent, shuffled(spark)
    tables = set(root.iterdir())
    S.near_dedup_batch(str(tmp_path / "t"))(rows, 0)
    for _ in range(50):
        left = sum(size for f, size in shuffled(spark).items() if f not in before)
        if left < 50_000:
            break
        time.sleep(0.1)
    assert left < 50_000, "more than a few counts"
    assert not {"words", "fresh", "kept"} & {p.name.partition("-")[0] for p in set(root.iterdir()) - tables}
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "t" / "kept")).collect()) == want
    ids = [{r[0] for r in spark.read.parquet(str(tmp_path / "t" / name)).select("set_id").collect()} for name in ("bands", "sets")]
    assert ids[0] == ids[1] and len(ids[0]) == len(want)


def shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data") if f.exists()}


def test_layered_dedup_retry_changes_nothing(spark, docs, tmp_path):
    step = S.layered_dedup_batch(str(tmp_path / "t"), exact_ttl_seconds=None)
    cut = dt.datetime(2024, 1, 1, 1, 40)
    first, second = docs.where(F.col("crawled_at") < cut), docs.where(F.col("crawled_at") >= cut)
    step(first, 0)
    step(second, 1)
    once = sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "t" / "kept")).collect())
    step(second, 1)
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "t" / "kept")).collect()) == once
    assert once == sorted(r["url"] for r in D.dedup_articles(docs).where("dropped_by is null").collect())


def test_layered_dedup_forgets(spark, tmp_path):
    """One article every fourth day: it comes back when a week has passed since it was last kept. Old folders and expired rows go."""
    path, day = str(tmp_path / "t"), dt.datetime(2024, 1, 1)
    step = S.layered_dedup_batch(path, compact_every=2)
    for i in range(4):
        rows = [("a", "one two three four five six", "h"), ("b", f"{i} other words {i * 7} {i * 11} {i * 13} {i * 17}", f"g{i}")]
        rows = [(f"{u}{i}", u, text, key, day + dt.timedelta(days=4 * i)) for u, text, key in rows]
        step(spark.createDataFrame(rows, "url string, title string, content string, content_hash string, crawled_at timestamp"), i)
    kept = {r["url"] for r in spark.read.parquet(f"{path}/kept").collect()}
    assert {u for u in kept if u < "b"} == {"a0", "a2"}
    for name, days in (("exact", 7), ("simhash", 3)):
        assert S.snapshot_ids(spark, f"{path}/{name}") == [1, 2, 3]
        oldest = spark.read.parquet(f"{path}/{name}/batch=3").agg(F.min("crawled_at")).first()[0]
        assert oldest > day + dt.timedelta(days=12 - days)


def test_exact_dedup(spark, docs, tmp_path):
    stream = in_files(docs.select("content_hash", "crawled_at"), tmp_path / "in", "crawled_at", 3)
    finish(S.stream_dedup_exact(stream).writeStream.format("memory").queryName("exact_seen"))
    assert spark.table("exact_seen").count() == docs.select("content_hash").distinct().count()


def events(spark):
    return A.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("n", [1, 5])
def test_trends_equal_batch(spark, tmp_path, n):
    mentions = A.mentions_of(events(spark))
    stream = in_files(mentions, tmp_path / "in", "ts", n)
    finish(S.stream_trends(stream, str(tmp_path / "t"), str(tmp_path / "c")))
    columns = ["kind", "name", "slot", "current_count", "prev_count", "velocity", "is_spike"]
    got = {tuple(r) for r in S.trend_table(spark, str(tmp_path / "t")).select(columns).collect()}
    assert got == {tuple(r) for r in R.trend_series(mentions).select(columns).collect()}


def test_top_trends_refresh(spark, tmp_path):
    mentions = A.mentions_of(events(spark))
    stream = in_files(mentions, tmp_path / "in", "ts", 3)
    finish(S.refresh_top_trends(stream, str(tmp_path / "t"), str(tmp_path / "c"), every=None))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "top" / "batch=2")).select("kind", "name", "velocity").collect()]
    want = [tuple(r) for r in R.top_trends(R.compute_trends(mentions)).select("kind", "name", "velocity").collect()]
    assert sorted(got) == sorted(want)


def test_volume_counts_closed_minutes(spark, tmp_path):
    stream = in_files(events(spark), tmp_path / "in", "ts", 4)
    finish(S.stream_volume(stream, "ts").writeStream.format("memory").queryName("volume"))
    want = {(r["minute"], r["count"]) for r in G.volume_per_minute(events(spark).withColumnRenamed("ts", "crawled_at"), 60 * 24 * 365).collect()}
    got = {(r["minute"], r["count"]) for r in spark.table("volume").collect()}
    assert got <= want and len(got) >= len(want) - 3


def test_frequency_ignores_repeats(spark, tmp_path):
    ev = A.incidents_of(events(spark))
    doubled = ev.unionByName(ev).select("article_hash", "published_at", "subcategory", "region")
    stream = in_files(doubled, tmp_path / "in", "published_at", 4)
    finish(S.stream_frequency(stream).writeStream.format("memory").queryName("freq"))
    key, hour = ("error", "R1"), dt.datetime(2024, 1, 10)
    got = {r["window_start"]: r["event_count"] for r in spark.table("freq").collect() if (r["subcategory"], r["region"]) == key}
    inside = (F.col("published_at") >= F.lit(hour)) & (F.col("published_at") < F.lit(hour + dt.timedelta(days=1)))
    assert got.get(hour, 0) == ev.where(inside & (F.col("subcategory") == key[0]) & (F.col("region") == key[1])).count()


def test_live_feed_keeps_the_newest(spark, docs, tmp_path):
    full = X.label(docs).withColumn("entities", F.array(F.lit("x")))
    stream = in_files(full, tmp_path / "in", "crawled_at", 3)
    finish(S.stream_live_feed(stream, str(tmp_path / "f"), str(tmp_path / "c"), n=20))
    got = {r["url"] for r in spark.read.parquet(str(tmp_path / "f" / "batch=2")).collect()}
    assert got == {r["url"] for r in docs.orderBy(F.col("published_at").desc()).limit(20).collect()}


def test_link_events_handles_each_event_once(spark, tmp_path):
    ev = A.incidents_of(events(spark))
    stream = in_files(ev, tmp_path / "in", "published_at", 3)
    finish(S.stream_link_events(stream, str(tmp_path / "t"), str(tmp_path / "c")))
    batched = spark.read.parquet(str(tmp_path / "t" / "batched"))
    linked = batched.where("not pending")
    left = spark.read.parquet(str(tmp_path / "t" / "pending" / "batch=2"))
    assert linked.select("article_hash").distinct().count() == linked.count()
    assert linked.count() + left.count() == ev.count() and left.count() < 50
    assert linked.groupBy("batch", "batch_id").count().agg(F.max("count")).first()[0] <= 200
    assert spark.read.parquet(str(tmp_path / "t" / "verdicts")).count() > 0


def test_failing_sink_is_isolated_and_replayed(spark, docs, tmp_path):
    down = {"on": True}

    def flaky(df, batch_id):
        if down["on"]:
            raise RuntimeError("store is down")
        S.write_batch(df.select("url"), str(tmp_path / "flaky"), batch_id)

    sinks = {
        "flaky": flaky,
        "facts": lambda df, i: S.write_batch(to_fact_rows(df), str(tmp_path / "facts"), i),
    }
    empty = F.expr("cast(array() as array<struct<name:string,type:string>>)")
    stream = in_files(docs, tmp_path / "in", "crawled_at", 2)
    writer = S.run_pipeline(stream, lambda df: X.label(df).withColumn("entities", empty), sinks, str(tmp_path / "failed"), str(tmp_path / "c"))
    finish(writer)
    assert spark.read.parquet(str(tmp_path / "facts")).count() == docs.count()
    down["on"] = False
    assert S.replay_failed(spark, str(tmp_path / "failed"), "flaky", flaky) == 2
    assert spark.read.parquet(str(tmp_path / "flaky")).count() == docs.count()


def test_ingest_over_batches_with_a_failing_sink_equals_one_batch(spark, docs, tmp_path):
    """Two batches with one sink down, then a retry: what all sinks hold is what one batch of everything gives."""
    process, path, whole = P.fixture_enrichment(spark), str(tmp_path / "t"), str(tmp_path / "w")
    down = {"on": True}
    good = I.sinks_under(path)

    def flaky(df, batch_id):
        if down["on"]:
            raise RuntimeError("store is down")
        good["facts"](df, batch_id)

    sinks = good | {"facts": flaky}
    step = I.ingest_batch(path, process, sinks, **P.NEVER)
    cut = F.col("crawled_at") < dt.datetime(2024, 1, 1, 1, 40)
    step(docs.where(cut), 0)
    assert [tuple(r) for r in spark.read.parquet(f"{path}/failures").select("sink", "error").collect()] == [("facts", "store is down")]
    assert I.applied(spark, path, "facts") == -1 and I.applied(spark, path, "graph") == 0
    down["on"] = False
    step(docs.where(~cut), 1)
    assert {I.applied(spark, path, name) for name in sinks} == {1}
    assert S.snapshot_ids(spark, f"{path}/enriched") == [1]
    once = sorted(map(tuple, P.sink_rows(spark, path).collect()))
    step(docs.where(~cut), 1)
    good["graph"](spark.read.parquet(f"{path}/enriched/batch=1"), 1)
    assert sorted(map(tuple, P.sink_rows(spark, path).collect())) == once
    I.ingest_batch(whole, process, I.sinks_under(whole), **P.NEVER)(docs, 0)
    assert sorted(map(tuple, P.sink_rows(spark, whole).collect())) == once


def test_ingest_of_an_empty_batch(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    I.ingest_batch(path, P.fixture_enrichment(spark), I.sinks_under(path), **P.NEVER)(docs.limit(0), 0)
    assert not S.snapshot_ids(spark, f"{path}/failures")
    assert I.current_articles(spark, path).count() == 0 and I.current_edges(spark, path).count() == 0


@pytest.mark.parametrize("n_files", [1, 3])
def test_streamed_table_is_a_file_or_a_folder_of_files(spark, tmp_path, n_files):
    """Every row arrives, whichever way the table is stored; other tables beside it stay out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if n_files == 1:
        docs.coalesce(1).write.parquet(str(tmp_path / "one"))
        next((tmp_path / "one").glob("part-*")).rename(tmp_path / "documents.parquet")
    else:
        docs.repartition(n_files).write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(3).write.parquet(str(tmp_path / "labels.parquet"))
    urls = P.collected(A.articles_of(A.stream_table(spark, str(tmp_path), "documents")).select("url"), "urls")
    assert urls.count() == docs.count()
