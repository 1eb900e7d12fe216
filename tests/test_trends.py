import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from corpuswatch.operators import aggregates as G
from corpuswatch.operators import trends as R

NOW = dt.datetime(2024, 1, 10, 12)


def ago(**kw):
    return NOW - dt.timedelta(**kw)


def mentions(spark, rows):
    return spark.createDataFrame([("cat", n, t) for n, t in rows], "kind string, name string, ts timestamp")


def test_borders_and_modes(spark):
    m = mentions(spark, [("a", NOW), ("a", ago(minutes=10)), ("a", ago(minutes=30)), ("b", ago(minutes=40)), ("a", ago(minutes=60)), ("c", NOW), ("c", NOW)])
    got = {r["name"]: (r["current_count"], r["prev_count"]) for r in R.compute_trends(m, NOW).collect()}
    assert got == {"a": (2, 1), "c": (2, 0)}  # half-open: -30 is previous, -60 is outside, every mention counts
    ref = {r["name"]: (r["current_count"], r["prev_count"]) for r in R.compute_trends(m, NOW, mode="reference").collect()}
    assert ref == {"a": (3, 2), "c": (1, 0)}  # closed: -30 in both, -60 inside, one per second


def test_spike_threshold_is_inclusive(spark):
    rows = [("x", ago(minutes=i)) for i in range(5)] + [("x", ago(minutes=45)), ("x", ago(minutes=46))]
    r = R.compute_trends(mentions(spark, rows), NOW).first()
    assert (r["velocity"], r["is_spike"]) == (2.5, True)
    assert R.active_spikes(R.compute_trends(mentions(spark, rows[1:]), NOW)).count() == 0


def test_series_treats_gaps_as_zero(spark):
    m = mentions(spark, [("a", dt.datetime(2024, 1, 1, 0, 5)), ("a", dt.datetime(2024, 1, 1, 0, 35)), ("a", dt.datetime(2024, 1, 1, 2, 5))])
    got = [(r["current_count"], r["prev_count"]) for r in R.trend_series(m).orderBy("slot").collect()]
    assert got == [(1, 0), (1, 1), (1, 0)]


@pytest.mark.parametrize("ratio,n,regional", [(3.0, 1, False), (4.0, 3, True), (20.0, 50, True), (8.0, 2, False)])
def test_confidence_formula(spark, ratio, n, regional):
    got = spark.range(1).select(R.signal_confidence(F.lit(ratio), F.lit(n), F.lit(regional)).alias("c")).first()["c"]
    want = min(min((ratio - 3) / 10, 0.5) + 0.3 + min(math.log(n + 1) / 5, 0.3) + (0.1 if regional else 0.0), 1.0)
    assert got == pytest.approx(want)


def test_signals(spark):
    rows = [(f"e{i}", "odd", "R1", ago(hours=i / 2)) for i in range(30)] + [("old", "odd", "R1", ago(hours=30)), ("e0", "odd", "R1", ago(hours=1))]
    rows += [("q", "calm", None, ago(hours=2))] + [(f"b{i}", "calm", None, ago(hours=30 + i)) for i in range(40)]
    ev = spark.createDataFrame(rows, "article_hash string, subcategory string, region string, published_at timestamp")
    got = R.frequency_signals(ev, NOW).collect()
    assert len(got) == 1
    s = got[0]
    assert (s["subcategory"], s["region"], s["event_count"], s["baseline_count"]) == ("odd", "R1", 30, 0.5)
    assert len(s["events"]) == 20 and s["events"][0] == "e29" and s["frequency_ratio"] == 60.0
    assert s["temporal_span_hours"] == 14.5


def events(spark, n):
    rows = [(f"e{i:03d}", "a" if i % 10 else "rare", i / n, NOW - dt.timedelta(minutes=i)) for i in range(n)]
    return spark.createDataFrame(rows, "article_hash string, subcategory string, anomaly_score double, published_at timestamp")


def test_feed_can_come_back_short(spark):
    assert G.mystery_feed(events(spark, 100), 10, "rare", mode="reference").count() == 3  # only the newest 30 are looked at
    assert G.mystery_feed(events(spark, 100), 10, "rare").count() == 10
    assert G.mystery_feed(events(spark, 100), 10, None, 0.25, mode="reference").count() == 5


def test_lists(spark):
    rows = [("h1", ["x"], None), ("h2", ["x", "y"], NOW), ("h3", [], NOW), ("h4", ["y"], ago(days=1))]
    df = spark.createDataFrame(rows, "content_hash string, categories array<string>, published_at timestamp")
    for c in ("url", "title", "source", "source_type", "region", "author"):
        df = df.withColumn(c, F.lit("v"))
    df = df.withColumn("sentiment_label", F.lit("neutral")).withColumn("sentiment_score", F.lit(0.5)).withColumn("crawled_at", F.col("published_at"))
    assert [r["content_hash"] for r in G.list_articles(df).collect()] == ["h1", "h2", "h3", "h4"]
    assert [r["content_hash"] for r in G.list_articles(df, category="y", limit=1, offset=1).collect()] == ["h4"]
    assert {(r["category"], r["count"]) for r in G.category_distribution(df, 48, NOW).collect()} == {("x", 1), ("y", 2)}
    stats = G.article_stats(df, NOW).first()
    assert (stats["total"], stats["last_hour"], stats["last_day"], stats["sources"]) == (4, 2, 2, 1)  # strict: 24 h ago is out


@pytest.mark.parametrize("cred,anom,bands", [
    (0.65, 0.8, ("verified", "critical", "high")), (0.649, 0.75, ("unverified", "high", "high")), (0.4, 0.65, ("unverified", "high", "medium")),
    (0.39, 0.55, ("low credibility", "elevated", "medium")), (0.1, 0.49, ("low credibility", "normal", "low")),
])
def test_bands(spark, cred, anom, bands):
    df = spark.createDataFrame([(cred, anom)], "credibility_score double, anomaly_score double")
    r = G.with_score_bands(df).first()
    assert (r["credibility_band"], r["anomaly_level"], r["anomaly_bar"]) == bands


def test_time_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = G.within(df, "ts", 24, as_of=NOW).select("event_type")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
