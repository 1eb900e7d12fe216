"""Lists, filters and grouped aggregates over articles, events and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.functions.parsing import age_label
from corpuswatch.functions.text import exact_mean, rounded
from corpuswatch.session import clock_bound

LIST_COLUMNS = [
    "content_hash", "url", "title", "source", "source_type", "published_at", "categories", "sentiment_label",
    "sentiment_score", "region", "author",
]


def within(df: DataFrame, ts: str, amount: int, unit: str = "HOURS", as_of=None, strict: bool = False) -> DataFrame:
    """Rows not older than ``amount`` units before the clock; ``strict`` leaves the border itself out."""
    bound = clock_bound(df, ts, as_of, f"INTERVAL {int(amount)} {unit}")
    return df.where(F.col(ts) > bound if strict else F.col(ts) >= bound)


def list_articles(
    df: DataFrame, category: str | None = None, sentiment: str | None = None, region: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of the newest articles. Undated articles come first; the hash breaks ties."""
    if category:
        df = df.where(F.array_contains("categories", category))
    if sentiment:
        df = df.where(F.col("sentiment_label") == sentiment)
    if region:
        df = df.where(F.col("region") == region)
    ordered = df.select(*LIST_COLUMNS).orderBy(F.desc_nulls_first("published_at"), "content_hash", "url")
    return ordered.offset(offset).limit(limit)


def filter_feed(df: DataFrame, category: str = "all", sentiment: str = "all", keep: int = 200, mode: str = "intended") -> DataFrame:
    """The newest ``keep`` articles that pass the two filters; ``mode="reference"`` filters the newest ``keep`` articles."""
    order = [F.col("published_at").desc(), F.col("content_hash"), F.col("url")]
    newest = df.orderBy(*order).limit(keep) if mode == "reference" else df
    if category != "all":
        newest = newest.where(F.array_contains("categories", category))
    if sentiment != "all":
        newest = newest.where(F.col("sentiment_label") == sentiment)
    return newest if mode == "reference" else newest.orderBy(*order).limit(keep)


def mystery_feed(
    df: DataFrame, limit: int = 50, subcategory: str | None = None, min_anomaly: float = 0.0, ts: str = "published_at", mode: str = "intended"
) -> DataFrame:
    """The newest ``limit`` events that pass the filters.

    ``mode="reference"`` filters only the newest ``3 * limit`` events, so that a rare subcategory can come back short.
    """
    order = [F.col(ts).desc(), F.col("article_hash")]
    recent = df.orderBy(*order).limit(limit * 3) if mode == "reference" else df
    if subcategory:
        recent = recent.where(F.col("subcategory") == subcategory)
    return recent.where(F.col("anomaly_score") >= min_anomaly).orderBy(*order).limit(limit)


def _band(c: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(c >= bound, name) if out is None else out.when(c >= bound, name)
    return out.otherwise(otherwise)


def with_score_bands(df: DataFrame) -> DataFrame:
    """Display bands of credibility, anomaly and, when present, confidence."""
    anomaly = F.col("anomaly_score")
    out = (
        df.withColumn(
            "credibility_band",
            _band(F.col("credibility_score"), (0.65, "verified"), (0.4, "unverified"), otherwise="low credibility"),
        )
        .withColumn("anomaly_level", _band(anomaly, (0.8, "critical"), (0.65, "high"), (0.5, "elevated"), otherwise="normal"))
        .withColumn("anomaly_bar", _band(anomaly, (0.75, "high"), (0.55, "medium"), otherwise="low"))
        .withColumn("anomaly_pct", F.floor(anomaly * 100 + 0.5))
    )
    if "confidence" in df.columns:
        pct = F.floor(F.col("confidence") * 100 + 0.5)
        out = out.withColumn("confidence_pct", pct).withColumn(
            "confidence_bar", _band(pct, (75, "high"), (55, "medium"), otherwise="low")
        )
    return out


def with_age(df: DataFrame, ts: str, as_of=None, seconds: bool = False) -> DataFrame:
    return df.withColumn("age", age_label(F.col(ts), clock_bound(df, ts, as_of), seconds))


def article_stats(df: DataFrame, as_of=None) -> DataFrame:
    """One row: all articles, those of the last hour and day, distinct sources."""
    hour = clock_bound(df, "crawled_at", as_of, "INTERVAL 1 HOUR")
    day = clock_bound(df, "crawled_at", as_of, "INTERVAL 1 DAY")
    return df.select("crawled_at", "source", hour.alias("_h"), day.alias("_d")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("crawled_at") > F.col("_h")).alias("last_hour"),
        F.count_if(F.col("crawled_at") > F.col("_d")).alias("last_day"),
        F.count_distinct("source").alias("sources"),
    )


def sentiment_breakdown(df: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    recent = within(df.select("crawled_at", "sentiment_label", "sentiment_score"), "crawled_at", hours, as_of=as_of)
    return (
        recent.groupBy(F.col("sentiment_label").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            rounded(exact_mean(F.col("sentiment_score")), 4).alias("avg_score"),
        )
        .orderBy(F.col("count").desc(), "label")
    )


def volume_per_minute(df: DataFrame, minutes: int = 60, as_of=None) -> DataFrame:
    recent = within(df.select("crawled_at"), "crawled_at", minutes, "MINUTES", as_of)
    return recent.groupBy(F.date_trunc("minute", "crawled_at").alias("minute")).agg(F.count(F.lit(1)).alias("count")).orderBy("minute")


def category_distribution(df: DataFrame, hours: int = 24, as_of=None, k: int = 20) -> DataFrame:
    recent = within(df.select("crawled_at", "categories"), "crawled_at", hours, as_of=as_of)
    return (
        recent.select(F.explode("categories").alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "category")
        .limit(k)
    )


def source_stats(df: DataFrame, hours: int = 24, as_of=None, k: int = 50) -> DataFrame:
    recent = within(df.select("crawled_at", "source"), "crawled_at", hours, as_of=as_of)
    return (
        recent.groupBy("source")
        .agg(F.count(F.lit(1)).alias("count"), F.max("crawled_at").alias("last_seen"))
        .orderBy(F.col("count").desc(), "source")
        .limit(k)
    )


def sentiment_share(df: DataFrame) -> DataFrame:
    """Rounded percentage of each sentiment label; the window runs over the few grouped rows."""
    counts = df.groupBy(F.col("sentiment_label").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("pct", F.floor(F.col("count") * 100 / total + 0.5))


def trending_topics(edges: DataFrame, limit: int = 10, mode: str = "intended") -> DataFrame:
    """Mentions per topic; ``reference`` mode counts from the second mention on."""
    n = F.count(F.lit(1)) - (1 if mode == "reference" else 0)
    return (
        edges.where(F.col("type") == "TAGGED_AS")
        .groupBy(F.col("dst").alias("name"))
        .agg(n.alias("count"))
        .orderBy(F.col("count").desc(), "name")
        .limit(limit)
    )


def source_rollup(df: DataFrame, mode: str = "intended", ts: str = "crawled_at") -> DataFrame:
    n = F.count(F.lit(1)) - (1 if mode == "reference" else 0)
    return df.groupBy("source").agg(n.alias("article_count"), F.max(ts).alias("last_seen"))


def cycle_counts(df: DataFrame, seconds: int = 120, ts: str = "crawled_at") -> DataFrame:
    """Articles per crawl cycle and the running total; a cycle is a slot of the crawl interval.

    The running total first adds up days, then cycles of a day, so no window holds more than a day of slots.
    """
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds)
    counts = df.groupBy(slot.alias("cycle")).agg(F.count(F.lit(1)).alias("crawled"))
    counts = counts.withColumn("_day", F.date_trunc("day", "cycle"))
    days = counts.groupBy("_day").agg(F.sum("crawled").alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("_day").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(days, "_day").select(
        "cycle", "crawled", (F.col("_before") + F.sum("crawled").over(upto)).alias("total_crawled")
    )


def rolling_cycle_mean(cycles: DataFrame, width: int = 5, keep: int = 60) -> DataFrame:
    """Whole-number mean of each cycle and the ones before it, over the newest ``keep`` cycles."""
    newest = cycles.select("cycle", "crawled").orderBy(F.col("cycle").desc()).limit(keep)
    w = Window.orderBy("cycle").rowsBetween(-(width - 1), 0)
    mean = F.floor(F.sum("crawled").over(w) / F.count(F.lit(1)).over(w))
    return newest.withColumn("rolling_mean", mean)


def verdict_tiers(verdicts: DataFrame) -> DataFrame:
    def n(v):
        return F.count_if(F.col("verdict") == v)

    return verdicts.agg(
        n("strong signal").alias("strong"),
        n("weak signal").alias("weak"),
        n("no strong connection").alias("none"),
        F.count_if(F.col("verdict") != "no strong connection").alias("with_connection"),
    )


def retain_newest(df: DataFrame, n: int, ts: str, tie: str, ttl_days: int | None = None, as_of=None) -> DataFrame:
    """The newest ``n`` rows, of those inside the time to live."""
    if ttl_days is not None:
        df = within(df, ts, ttl_days, "DAYS", as_of)
    return df.orderBy(F.col(ts).desc(), tie).limit(n)


def scoreboard(df: DataFrame, limit: int = 20, recent: int = 200, ts: str = "published_at") -> DataFrame:
    """Highest anomaly scores among the newest events; equal scores keep newest first."""
    newest = mystery_feed(df, recent, ts=ts)
    return newest.orderBy(F.col("anomaly_score").desc(), F.col(ts).desc(), "article_hash").limit(limit)


def recent_verdicts(df: DataFrame, limit: int = 20, ts: str = "analyzed_at", tie: str = "event_cluster_id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), tie).limit(limit)
