"""Mentions, trends and frequency anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.operators.enrich import title_keywords
from corpuswatch.session import clock_bound

# Trend window in seconds, spike bound, list size.
WINDOW_SECONDS, SPIKE, TOP_K = 1800, 2.5, 20
# Anomaly window, baseline, smallest baseline, ratio and confidence bounds, events listed.
ANOMALY_HOURS, BASELINE_HOURS, BASELINE_DAYS, BASELINE_FLOOR = 24, 168, 7, 0.5
RATIO, MIN_CONFIDENCE, LISTED = 3.0, 0.45, 20


def mentions(df: DataFrame, ts: str = "crawled_at") -> DataFrame:
    """One row per mention: categories, entities (``type:name``) and title keywords of each article."""
    ents = F.filter("entities", lambda e: F.length(e["name"]) > 2)

    def tag(kind: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    names = F.transform(ents, lambda e: F.concat(F.coalesce(e["type"], F.lit("unknown")), F.lit(":"), F.left(e["name"], F.lit(50))))
    everything = F.concat(tag("cat", F.col("categories")), tag("ent", names), tag("kw", title_keywords(F.col("title"))))
    return df.select("content_hash", F.col(ts).alias("ts"), F.inline(everything))


def _velocity(current: Column, previous: Column) -> Column:
    return current / F.greatest(previous, F.lit(1))


def compute_trends(
    m: DataFrame, as_of=None, window: int = WINDOW_SECONDS, threshold: float = SPIKE, mode: str = "intended"
) -> DataFrame:
    """Mentions in the current window against the one before, per (kind, name).

    ``intended``: windows ``(start, end]`` and every mention counts. ``reference``: closed windows, so a border
    mention is in both, and mentions of one second count once.
    """
    end = clock_bound(m, "ts", as_of)
    mid = clock_bound(m, "ts", as_of, f"INTERVAL {window} SECONDS")
    start = clock_bound(m, "ts", as_of, f"INTERVAL {2 * window} SECONDS")
    ts = F.col("ts")
    rows = m.select("kind", "name", "ts")
    if mode == "reference":
        second = F.date_trunc("second", ts)
        rows = rows.withColumn("ts", second).where((ts >= F.date_trunc("second", start)) & (ts <= end)).distinct()
        mid, end = F.date_trunc("second", mid), F.date_trunc("second", end)
        is_current, is_previous = (ts >= mid) & (ts <= end), ts <= mid
    else:
        rows = rows.where((ts > start) & (ts <= end))
        is_current, is_previous = ts > mid, ts <= mid
    flagged = rows.select("kind", "name", is_current.alias("_c"), is_previous.alias("_p"))
    counts = flagged.groupBy("kind", "name").agg(
        F.count_if("_c").alias("current_count"), F.count_if("_p").alias("prev_count")
    )
    velocity = _velocity(F.col("current_count"), F.col("prev_count"))
    return counts.where("current_count > 0").select(
        F.concat_ws(":", F.lit("trend"), "kind", "name").alias("key"),
        "name",
        "kind",
        "current_count",
        "prev_count",
        F.round(velocity, 3).alias("velocity"),
        (velocity >= threshold).alias("is_spike"),
        end.alias("computed_at"),
    )


def top_trends(trends: DataFrame, k: int = TOP_K) -> DataFrame:
    return trends.orderBy(F.col("velocity").desc(), "kind", "name").limit(k)


def active_spikes(trends: DataFrame) -> DataFrame:
    return trends.where("is_spike")


def trend_series(m: DataFrame, seconds: int = WINDOW_SECONDS, threshold: float = SPIKE) -> DataFrame:
    """The trend ratio for every slot with mentions; a slot after an empty one compares with zero."""
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    counts = m.groupBy("kind", "name", slot.alias("_slot")).agg(F.count(F.lit(1)).alias("current_count"))
    w = Window.partitionBy("kind", "name").orderBy("_slot")
    follows = F.lag("_slot").over(w) == F.col("_slot") - 1
    prev = F.when(follows, F.lag("current_count").over(w)).otherwise(F.lit(0))
    velocity = _velocity(F.col("current_count"), F.col("prev_count"))
    return (
        counts.withColumn("prev_count", prev)
        .withColumn("slot", F.timestamp_seconds(F.col("_slot") * seconds))
        .withColumn("velocity", F.round(velocity, 3))
        .withColumn("is_spike", velocity >= threshold)
        .drop("_slot")
    )


def signal_confidence(ratio: Column, count: Column, regional: Column) -> Column:
    """Spike height (capped), number of events (log scale) and a bonus for a named region."""
    height = F.least((ratio - RATIO) / 10, F.lit(0.5)) + 0.3
    size = F.least(F.log1p(count.cast("double")) / 5, F.lit(0.3))
    return F.least(height + size + F.when(regional, 0.1).otherwise(0.0), F.lit(1.0))


def frequency_signals(
    events: DataFrame, as_of=None, window_hours: int = ANOMALY_HOURS, baseline_hours: int = BASELINE_HOURS,
    baseline_days: float = BASELINE_DAYS, min_ratio: float = RATIO, min_confidence: float = MIN_CONFIDENCE,
    listed: int = LISTED, mode: str = "intended",
) -> DataFrame:
    """Keys (subcategory, region) with unusually many events in the last day against the week before.

    The first ``listed`` events are found by a rank that Spark also applies before the shuffle, so a hot key
    sends at most ``listed`` rows per task. ``reference`` mode closes both windows at their common border and
    takes the span from the first two events.
    """
    ts = F.col("published_at")
    end = clock_bound(events, "published_at", as_of)
    mid = clock_bound(events, "published_at", as_of, f"INTERVAL {window_hours} HOURS")
    start = clock_bound(events, "published_at", as_of, f"INTERVAL {baseline_hours} HOURS")
    closed = mode == "reference"
    rows = events.select("article_hash", "subcategory", F.coalesce("region", F.lit("global")).alias("region"), "published_at")
    # An event seen twice counts once, at its latest time, as re-adding a member of a set moves it.
    recent = rows.where((ts <= end) & (ts >= start if closed else ts > start))
    once = recent.groupBy("subcategory", "region", "article_hash").agg(F.max("published_at").alias("published_at"))
    flagged = once.withColumn("_cur", ts >= mid if closed else ts > mid).withColumn("_base", ts <= mid)
    key = ["subcategory", "region"]
    span = F.unix_micros(F.max(F.when(F.col("_cur"), ts)).cast("timestamp")) - F.unix_micros(
        F.min(F.when(F.col("_cur"), ts)).cast("timestamp")
    )
    counts = flagged.groupBy(*key).agg(
        F.count_if("_cur").alias("event_count"), F.count_if("_base").alias("_base_total"), span.alias("_span")
    )
    ranked = flagged.where("_cur").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*key).orderBy("published_at", "article_hash"))
    )
    lists = ranked.where(F.col("_rank") <= listed).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "article_hash"))), lambda x: x["article_hash"]).alias("events"),
        (
            F.unix_micros(F.max(F.when(F.col("_rank") <= 2, ts)).cast("timestamp"))
            - F.unix_micros(F.min("published_at").cast("timestamp"))
        ).alias("_span2"),
    )
    per_day = F.greatest(F.col("_base_total") / F.lit(baseline_days), F.lit(BASELINE_FLOOR))
    scored = (
        counts.withColumn("_per_day", per_day)
        .withColumn("_ratio", F.col("event_count") / F.col("_per_day"))
        .where((F.col("event_count") > 0) & (F.col("_ratio") >= min_ratio))
        .withColumn("_conf", signal_confidence(F.col("_ratio"), F.col("event_count"), F.col("region") != "global"))
        .where(F.col("_conf") >= min_confidence)
    )
    return scored.join(lists, key).select(
        F.concat_ws(":", "subcategory", "region", F.unix_seconds(end.cast("timestamp")).cast("string")).alias("signal_id"),
        F.lit("freq_spike").alias("signal_type"),
        "events",
        "subcategory",
        F.nullif(F.col("region"), F.lit("global")).alias("region"),
        "event_count",
        F.round("_per_day", 2).alias("baseline_count"),
        F.round("_ratio", 3).alias("frequency_ratio"),
        F.round(F.col("_span2" if closed else "_span") / F.lit(3.6e9), 4).alias("temporal_span_hours"),
        F.round("_conf", 3).alias("confidence"),
        end.alias("detected_at"),
    )
