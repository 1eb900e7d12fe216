"""Rule verdicts over clusters and the texts built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.functions.text import exact_mean, fixed_point, rounded
from corpuswatch.operators.clusters import cluster_events, event_time, shared_entities

# Verdict texts.
NO_EVENTS = "INSUFFICIENT EVIDENCE: no events in cluster."
NO_LINKS = "NO_STRONG_CONNECTION: pattern engine found no links above threshold."
LOW_CREDIBILITY = "Average source credibility below 0.35. Insufficient reliable evidence to establish pattern."
BELOW = "INSUFFICIENT EVIDENCE. Cluster confidence or event count below anomaly threshold. No connection established."
DATA_GAPS = "LLM analysis unavailable. Manual review recommended for high-anomaly clusters."
CAPPED = " [CAPPED: low source credibility limits max confidence to 0.4]"
NO_SHARED = "No shared entities detected across events."


def _two(c: Column) -> Column:
    return fixed_point(rounded(c, 2), 2)


def cluster_statistics(members: DataFrame) -> DataFrame:
    """Per cluster: event count, mean scores, subcategory of the first event, titles of the first five."""
    # Only five short titles per cluster are collected; the filter runs before the list is built.
    early = F.when(F.col("pos") < 5, F.struct("pos", F.left("title", F.lit(80)).alias("title")))
    return members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        exact_mean(F.col("anomaly_score")).alias("mean_anomaly"),
        exact_mean(F.col("credibility_score")).alias("mean_credibility"),
        F.min_by("subcategory", "pos").alias("subcategory"),
        F.transform(F.array_sort(F.collect_list(early)), lambda x: x["title"]).alias("connected_events"),
    )


def rule_verdicts(clusters: DataFrame, events: DataFrame, as_of: Column, mode: str = "intended") -> DataFrame:
    """Verdict per cluster from confidence, mean scores and event count.

    ``intended`` tests the strong rule before the weak one; ``reference`` tests weak first, which hides strong.
    """
    stats = cluster_statistics(cluster_events(clusters, events))
    real = clusters.where(F.col("cluster_id").isNotNull())
    joined = real.join(stats, "cluster_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    n, anomaly, cred, conf = (F.col(c) for c in ("n_events", "mean_anomaly", "mean_credibility", "confidence"))
    empty, low = n == 0, cred < 0.35
    is_weak = (conf >= 0.75) & (anomaly >= 0.65) & (n >= 4)
    is_strong = (conf >= 0.85) & (anomaly >= 0.75) & (n >= 6)
    count = n.cast("string")
    weak_text = F.concat(
        F.lit("Multiple events ("), count, F.lit(") with elevated anomaly score ("), _two(anomaly),
        F.lit(") and acceptable credibility ("), _two(cred),
        F.lit("). Pattern threshold met but confirmation requires additional independent sources."),
    )
    strong_text = F.concat(
        F.lit("Strong cluster: "), count, F.lit(" events, anomaly="), _two(anomaly), F.lit(", credibility="), _two(cred),
        F.lit(". Consistent signal across multiple sources."),
    )
    tiers = [("weak signal", is_weak), ("strong signal", is_strong)]
    if mode == "intended":
        tiers.reverse()
    tier = F.when(empty, "none").when(low, "low")
    for name, rule in tiers:
        tier = tier.when(rule, name)
    judged = joined.withColumn("_tier", tier.otherwise("none"))
    t = F.col("_tier")
    out = judged.select(
        F.col("cluster_id").alias("event_cluster_id"),
        F.when(~empty, F.concat(F.lit("Rule-based analysis of "), count, F.lit(" events in subcategory "), "subcategory", F.lit("."))).alias("summary"),
        "connected_events",
        t.isin("weak signal", "strong signal").alias("pattern_detected"),
        F.when(empty, 0.0).otherwise(rounded(F.col("confidence"), 3)).alias("confidence"),
        F.when(empty, NO_EVENTS).when(t == "low", LOW_CREDIBILITY).when(t == "weak signal", weak_text)
        .when(t == "strong signal", strong_text).otherwise(BELOW).alias("reasoning"),
        F.when(t == "weak signal", "emerging_pattern").when(t == "strong signal", "anomaly").otherwise("coincidence").alias("classification"),
        F.when(t.isin("weak signal", "strong signal"), t).otherwise("no strong connection").alias("verdict"),
        F.when(~empty, DATA_GAPS).alias("data_gaps"),
        F.when(~empty, F.concat(
            F.lit("Average source reliability: "), _two(cred), F.lit(". "),
            F.when(cred < 0.5, "Low credibility — treat with skepticism.").otherwise("Acceptable credibility."),
        )).alias("credibility_note"),
        F.lit(False).alias("llm_used"),
        as_of.alias("analyzed_at"),
        F.col("mean_credibility"),
    )
    return out


def cap_confidence(verdicts: DataFrame, mean_credibility: str = "mean_credibility") -> DataFrame:
    """Confidence of model verdicts is at most 0.4 when the sources are weak, and the note says so."""
    capped = (F.col(mean_credibility) < 0.35) & (F.col("confidence") > 0.4)
    note = F.concat(F.coalesce("credibility_note", F.lit("")), F.lit(CAPPED))
    return verdicts.withColumn("credibility_note", F.when(capped, note).otherwise(F.col("credibility_note"))).withColumn(
        "confidence", F.when(capped, 0.4).otherwise(F.col("confidence"))
    )


def default_verdicts(clusters: DataFrame, as_of: Column) -> DataFrame:
    """Verdict rows of the batches in which nothing was linked."""
    none = clusters.where(F.col("verdict") == "NO_STRONG_CONNECTION")
    return none.select(
        "batch_id",
        F.lit("no strong connection").alias("verdict"),
        F.lit("coincidence").alias("classification"),
        F.lit(False).alias("pattern_detected"),
        F.lit(0.0).alias("confidence"),
        F.lit(NO_LINKS).alias("reasoning"),
        F.lit(False).alias("llm_used"),
        as_of.alias("analyzed_at"),
    )


def cluster_context(clusters: DataFrame, events: DataFrame, shown: int = 10, signals: int = 5) -> DataFrame:
    """The text blocks that describe a cluster: numbered events, shared entities, regions, mean scores, time span, id, type and relationship."""
    members = cluster_events(clusters, events)
    line = F.concat(
        F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] Title: "), "title",
        F.lit("\n    Source: "), "source", F.lit(" (reliability: "), F.col("source_reliability").cast("string"),
        F.lit(")\n    Credibility: "), F.col("credibility_score").cast("string"), F.lit(" | Anomaly: "),
        F.col("anomaly_score").cast("string"), F.lit("\n    Subcategory: "), "subcategory_label",
        F.lit("\n    Matched signals: "), F.array_join(F.slice("matched_signals", 1, signals), ", "),
        F.lit("\n    Snippet: "), F.left("content_snippet", F.lit(200)), F.lit("\n"),
    )
    blocks = members.groupBy("cluster_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("pos") < shown, F.struct("pos", line.alias("line"))))), lambda x: x["line"]
            ), "\n",
        ).alias("events_block"),
        F.count(F.lit(1)).alias("n_events"),
        rounded(exact_mean(F.col("anomaly_score")), 3).alias("avg_anomaly_score"),
        rounded(exact_mean(F.col("credibility_score")), 3).alias("avg_credibility_score"),
        F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set("region")), ", "), F.lit("")), F.lit("unknown")).alias("regions_text"),
        F.min_by("subcategory_label", "pos").alias("subcategory"),
        ((F.unix_seconds(F.max(event_time())) - F.unix_seconds(F.min(event_time()))) / 3600).alias("_hours"),
    )
    kind = clusters.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.min("cluster_type").alias("cluster_type"), F.coalesce(F.min("relationship"), F.lit("unknown")).alias("relationship"), F.max("confidence").alias("_confidence"))
    blocks = blocks.join(kind, "cluster_id").withColumns({
        "header": F.concat(F.lit("Cluster ID: "), "cluster_id", F.lit("\nCluster type: "), "cluster_type", F.lit("\nRelationship: "), "relationship"),
        "temporal_block": F.concat(F.lit("Events span: "), F.round("_hours", 2).cast("string"), F.lit(" hours")),
        "graph_block": F.concat(F.lit("Relationship type detected: "), "relationship", F.lit(" (confidence: "), F.col("_confidence").cast("string"), F.lit(")")),
    }).drop("_hours", "_confidence", "cluster_type", "relationship")
    entity_line = F.concat(F.lit("  - "), "entity", F.lit(" (appears in "), F.col("event_count").cast("string"), F.lit(" events)"))
    entities = shared_entities(members).groupBy("cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entity_line.alias("line")))), lambda x: x["line"]), "\n").alias("entity_block")
    )
    return blocks.join(entities, "cluster_id", "left").withColumn("entity_block", F.coalesce("entity_block", F.lit(NO_SHARED)))
