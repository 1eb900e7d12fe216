"""Registered queries: one function (spark, sf_dir) -> DataFrame per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswatch.functions import fingerprints as FP
from corpuswatch.functions.parsing import parse_model_json, parse_ts
from corpuswatch.functions.text import normalize_text, strip_tags
from corpuswatch.functions.vector_math import l2_normalize
from corpuswatch.lexicons import CATEGORY_KEYWORDS
from corpuswatch.operators import aggregates as G
from corpuswatch.operators import clusters as C
from corpuswatch.operators import dedup as D
from corpuswatch.operators import enrich as E
from corpuswatch.operators import graph as H
from corpuswatch.operators import insights as I
from corpuswatch.operators import tables as TB
from corpuswatch.operators import trends as R
from corpuswatch.operators import vectors as V
from corpuswatch.operators import verdicts as J
from corpuswatch.plans import fixtures as X
from corpuswatch.session import cut_lineage, stored
from corpuswatch.sources import adapters as A
from corpuswatch.sources import pages as P
from corpuswatch.sources.payloads import ordered_union_distinct
from corpuswatch.sources.registry import with_source_info

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


# -- sources ----------------------------------------------------------------------------------------------


@query
def content_hash(spark, sf):
    return A.articles_from_documents(spark, sf).select("doc_id", "content_hash")


@query
def content_hash_reference(spark, sf):
    from corpuswatch.operators.identity import REFERENCE_HASH_CHARS, with_content_hash

    return with_content_hash(A.articles_from_documents(spark, sf), REFERENCE_HASH_CHARS).select("doc_id", "content_hash")


@query
def ranked_id_list(spark, sf):
    events = A.table(spark, sf, "events")

    def ranked(n: int, *order: Column) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(*order)) - 1
        return events.orderBy(*order).limit(n).select(F.col("event_id").alias("id"), rank.alias("pos"))

    top = ranked(100, F.col("value").desc(), F.col("event_id"))
    new = ranked(50, F.col("ts").desc(), F.col("event_id"))
    return ordered_union_distinct(top, new)


@query
def page_text_without_tags(spark, sf):
    text = strip_tags(F.col("html"))
    return A.pages(spark, sf).select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


@query
def page_articles(spark, sf):
    clock = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return P.articles_from_pages(A.pages(spark, sf), clock).select(
        "page_id", "title", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"), "source", "content_hash",
        stamp("published_at").alias("published_at"),
    )


@query
def page_links(spark, sf):
    return P.page_links(A.pages(spark, sf)).select("page_id", "pos", "link")


@query
def page_links_rendered(spark, sf):
    return P.page_links(A.pages(spark, sf), min_path_len=12).select("page_id", "pos", "link")


@query
def page_links_reference(spark, sf):
    """The first 30 links of each page, as the analysed system takes them."""
    return P.page_links(A.pages(spark, sf), cap=30).select("page_id", "pos", "link")


@query
def source_info(spark, sf):
    lines = A.table(spark, sf, "lineitem").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("source"), "l_quantity"
    )
    info = with_source_info(lines, A.sources_from_supplier(spark, sf))
    return info.groupBy("source_region", "source_priority").agg(
        F.count(F.lit(1)).alias("articles"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )


# -- tables -----------------------------------------------------------------------------------------------


@query
def upserted_articles(spark, sf):
    all_docs = X.labelled_documents(spark, sf).withColumn("processed_at", F.col("crawled_at") + F.expr("INTERVAL 1 DAY"))
    quality = A.table(spark, sf, "labels").select("doc_id")
    stored = D.dedup_exact(all_docs.join(quality, "doc_id", "left_semi"))
    stored = stored.withColumn("processed_at", F.col("crawled_at")).withColumn("categories", F.array(F.lit("old")))
    return TB.upsert_articles(stored, all_docs).select(
        "content_hash", "url", joined("categories").alias("categories"), "sentiment_label", stamp("processed_at").alias("processed_at")
    )


@query
def fact_rows(spark, sf):
    return TB.to_fact_rows(X.tagged_documents(spark, sf)).select(
        "content_hash", "url", F.md5("title").alias("title_md5"), "region", joined("categories").alias("categories"), "sentiment_label",
        "sentiment_score", "entity_count", "word_count", "month",
    )


@query
def upserted_vectors(spark, sf):
    old = A.vectors(spark, sf).withColumn("updated_at", F.lit(1))
    flipped = F.transform("embedding", lambda x: (x * -2).cast("float")).alias("embedding")
    new = A.vectors(spark, sf).where("title = '1'").select("id", flipped, "title", F.lit(2).alias("updated_at"))
    stored = old.withColumn("embedding", l2_normalize(F.col("embedding")))
    return V.upsert_vectors(stored, new).select(
        "id", "updated_at", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"),
        F.round(F.get("embedding", F.lit(63)).cast("double"), 4).alias("last"),
    )


# -- lists and filters ------------------------------------------------------------------------------------


def _list_columns(df: DataFrame) -> DataFrame:
    return df.select("content_hash", "url", "source", stamp("published_at").alias("published_at"), joined("categories").alias("categories"), "sentiment_label", "sentiment_score", "region")


@query
def article_list(spark, sf):
    return _list_columns(G.list_articles(X.labelled_documents(spark, sf), limit=50, offset=10))


@query
def article_list_filtered(spark, sf):
    return _list_columns(G.list_articles(X.labelled_documents(spark, sf), "alpha", "positive", "EN", limit=200))


@query
def feed_filtered(spark, sf):
    return _list_columns(G.filter_feed(X.labelled_documents(spark, sf), "gamma", "negative"))


@query
def feed_filtered_reference(spark, sf):
    return _list_columns(G.filter_feed(X.labelled_documents(spark, sf), "gamma", "negative", mode="reference"))


def _event_feed(spark, sf, mode: str):
    return G.mystery_feed(A.incidents_from_events(spark, sf), 50, "purchase", 0.3, mode=mode).select(
        "article_hash", "subcategory", "anomaly_score", stamp("published_at").alias("published_at")
    )


@query
def unusual_event_feed(spark, sf):
    return _event_feed(spark, sf, "intended")


@query
def unusual_event_feed_reference(spark, sf):
    return _event_feed(spark, sf, "reference")


@query
def recent_events(spark, sf):
    recent = G.within(A.table(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", 36)
    return recent.select("event_id", "event_type")


@query
def score_bands(spark, sf):
    return G.with_score_bands(A.incidents_from_events(spark, sf).withColumn("confidence", F.col("credibility_score"))).select(
        "article_hash", "credibility_band", "anomaly_level", "anomaly_bar", "anomaly_pct", "confidence_pct", "confidence_bar"
    )


@query
def age_labels(spark, sf):
    events = A.table(spark, sf, "events").select("event_id", "ts")
    return G.with_age(events, "ts", seconds=True).select("event_id", "age")


# -- dedup ------------------------------------------------------------------------------------------------


@query
def normalized_text(spark, sf):
    text = normalize_text(F.col("content"))
    return A.articles_from_documents(spark, sf).select("doc_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


@query
def dedup_exact(spark, sf):
    return D.dedup_exact(A.articles_from_documents(spark, sf)).select("content_hash", "url")


@query
def dedup_exact_with_memory(spark, sf):
    """Events of one user and type: a repeat inside six hours of the kept one goes."""
    rows = A.table(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("k"), "ts", "event_id"
    )
    return D.dedup_exact(rows, "k", "ts", "event_id", ttl_seconds=6 * 3600).select("k", "event_id")


@query
def unseen_articles(spark, sf):
    docs = A.articles_from_documents(spark, sf)
    seen = docs.join(A.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return D.drop_seen(docs, seen).select("doc_id", "content_hash")


@query
def simhash_fingerprints(spark, sf):
    return D.with_simhash(A.articles_from_documents(spark, sf)).select("doc_id", "simhash")


@query
def simhash_fingerprints_reference(spark, sf):
    return D.with_simhash(A.articles_from_documents(spark, sf), D.REFERENCE_SIMHASH_CHARS).select("doc_id", "simhash")


@query
def simhash_fingerprints_whole_text(spark, sf):
    return D.with_simhash(A.articles_from_documents(spark, sf), chars=None).select("doc_id", "simhash")


@query
def fingerprint_distance(spark, sf):
    docs = D.with_simhash(A.articles_from_documents(spark, sf))
    return docs.select("doc_id", FP.hamming(F.col("simhash"), FP.simhash64(F.col("content"))).alias("distance"))


@query
def dedup_simhash(spark, sf):
    return D.dedup_simhash(A.articles_from_documents(spark, sf)).select("url", "simhash")


@query
def dedup_simhash_whole_text(spark, sf):
    return D.dedup_simhash(A.articles_from_documents(spark, sf), chars=None).select("url", "simhash")


@query
def dedup_simhash_equal(spark, sf):
    return D.dedup_simhash(A.articles_from_documents(spark, sf), mode="reference").select("url", "simhash")


@query
def minhash_signatures(spark, sf):
    signature = F.array_join(F.transform("minhash", lambda x: x.cast("string")), ",")
    return D.with_minhash(A.articles_from_documents(spark, sf)).select("doc_id", F.md5(signature).alias("signature_md5"))


@query
def minhash_signatures_reference(spark, sf):
    signature = F.array_join(F.transform("minhash", lambda x: x.cast("string")), ",")
    docs = D.with_minhash(A.articles_from_documents(spark, sf), D.REFERENCE_MINHASH_CHARS)
    return docs.select("doc_id", F.md5(signature).alias("signature_md5"))


@query
def lsh_buckets(spark, sf):
    """Buckets of every band with more than one article: first article and size."""
    bands = D.lsh_candidates(D.with_minhash(A.articles_from_documents(spark, sf)), "doc_id")
    grouped = bands.groupBy("band", "band_key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n > 1").select("band", "first_doc", "n")


@query
def lsh_verified(spark, sf):
    """Every bucket member against the first of its bucket, with the exact Jaccard similarity of the words."""
    docs = A.articles_from_documents(spark, sf)
    # Bands and pairs are written once; only the documents of a pair are split into words again.
    bands = stored(D.lsh_candidates(D.with_minhash(docs), "doc_id"), "bands")
    leaders = bands.groupBy("band", "band_key").agg(F.min("doc_id").alias("a"))
    pairs = stored(bands.join(leaders, ["band", "band_key"]).where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    met = docs.join(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "doc_id", "left_semi")
    sets = met.select("doc_id", F.array_distinct(D.words(D.dedup_text(None))).alias("w"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("w").alias("words_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("w").alias("words_b"))
    return D.verify_jaccard(pairs.join(left, "a").join(right, "b")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def dedup_minhash(spark, sf):
    return D.dedup_minhash(A.articles_from_documents(spark, sf)).select("url")


@query
def dedup_minhash_whole_text(spark, sf):
    return D.dedup_minhash(A.articles_from_documents(spark, sf), chars=None).select("url")


@query
def dedup_minhash_unverified(spark, sf):
    return D.dedup_minhash(A.articles_from_documents(spark, sf), verify=False).select("url")


@query
def dedup_layers(spark, sf):
    return D.dedup_articles(A.articles_from_documents(spark, sf)).select("url", "dropped_by")


@query
def dedup_layers_reference(spark, sf):
    return D.dedup_articles(A.articles_from_documents(spark, sf), mode="reference").select("url", "dropped_by")


# -- enrichment -------------------------------------------------------------------------------------------


@query
def keyword_category_hits(spark, sf):
    docs = E.with_category_hits(A.articles_from_documents(spark, sf), X.LEXICON).select("doc_id", F.inline("category_hits"))
    return docs.select("doc_id", F.col("label").alias("category"), F.round("score", 4).alias("score"))


@query
def keyword_category_hits_reference(spark, sf):
    docs = E.with_category_hits(A.articles_from_documents(spark, sf), X.LEXICON, E.REFERENCE_LABEL_CHARS).select("doc_id", F.inline("category_hits"))
    return docs.select("doc_id", F.col("label").alias("category"), F.round("score", 4).alias("score"))


@query
def keyword_category_hits_default_whole_text(spark, sf):
    """Default English lexicon over whole texts."""
    docs = E.with_category_hits(A.articles_from_documents(spark, sf), CATEGORY_KEYWORDS, chars=None)
    docs = docs.select("doc_id", F.inline("category_hits"))
    return docs.select("doc_id", F.col("label").alias("category"), F.round("score", 4).alias("score"))


@query
def top_categories(spark, sf):
    docs = X.labelled_documents(spark, sf)
    return docs.select("doc_id", joined("categories").alias("categories"), F.round(F.element_at("category_scores", F.col("categories")[0]), 4).alias("best"))


@query
def keyword_sentiment(spark, sf):
    return X.rated_documents(spark, sf).select("doc_id", "sentiment.*")


@query
def keyword_sentiment_reference(spark, sf):
    docs = E.keyword_sentiment(A.articles_from_documents(spark, sf), X.POSITIVE, X.NEGATIVE, E.REFERENCE_LABEL_CHARS)
    return docs.select("doc_id", "sentiment.*")


@query
def keyword_sentiment_whole_text(spark, sf):
    docs = E.keyword_sentiment(A.articles_from_documents(spark, sf), X.POSITIVE, X.NEGATIVE, chars=None)
    return docs.select("doc_id", "sentiment.*")


@query
def tagged_entities(spark, sf):
    tags = E.tag_entities(A.articles_from_documents(spark, sf), X.gazetteer(spark), "doc_id")
    return tags.select("doc_id", "name", "label", F.col("start").cast("bigint").alias("start"))


@query
def entities_from_tags(spark, sf):
    lines = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    labels = F.array(*[F.lit(x) for x in ("PERSON", "ORG", "GPE", "CARDINAL", "MONEY", "PERCENT")])
    tags = lines.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.col("p_brand").alias("name"),
        F.element_at(labels, (F.col("p_size") % 6 + 1).cast("int")).alias("label"), F.col("l_linenumber").alias("start"),
        (F.col("l_linenumber") + 1).alias("end"),
    )
    found = E.entities_from_tags(tags, "k")
    text = F.array_join(F.transform("entities", lambda e: F.concat_ws("/", e["type"], e["name"], e["start"].cast("string"))), ";")
    return found.select("k", text.alias("entities"))


@query
def title_keywords(spark, sf):
    return A.articles_from_documents(spark, sf).select("doc_id", joined(E.title_keywords(F.col("title"))).alias("keywords"))


@query
def text_counts(spark, sf):
    docs = X.tagged_documents(spark, sf)
    return E.with_counts(docs).select("doc_id", "word_count", "entity_count")


@query
def source_reliability(spark, sf):
    docs = A.articles_from_documents(spark, sf)
    return docs.select("doc_id", E.source_reliability(F.col("source")).alias("by_source"), E.source_reliability(F.col("title")).alias("by_title"))


@query
def content_credibility(spark, sf):
    score = E.content_credibility(F.lower("content"), X.BOOSTS, X.PENALTIES)
    return A.articles_from_documents(spark, sf).select("doc_id", F.round(score, 4).alias("credibility"))


@query
def unusual_events(spark, sf):
    events = E.classify_events(A.articles_from_documents(spark, sf), X.EVENT_SIGNALS, boosts=X.BOOSTS, penalties=X.PENALTIES)
    return events.select(
        "article_hash", "url", "subcategory", "subcategory_label", F.round("credibility_score", 3).alias("credibility_score"),
        F.round("anomaly_score", 3).alias("anomaly_score"), "source_reliability", joined("matched_signals").alias("signals"),
    )


@query
def parsed_timestamps(spark, sf):
    ts = F.col("ts").cast("timestamp")
    shown = (
        F.when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"))
        .when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_type") == "error", F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z"))
        .when(F.col("event_type") == "signup", F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))
        .otherwise(F.lit("some day"))
    )
    clock = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return A.table(spark, sf, "events").select("event_id", stamp(parse_ts(shown, clock)).alias("parsed"))


@query
def model_json(spark, sf):
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        F.col("event_type") == "click", F.concat(F.lit("```\n"), "props", F.lit("\n```"))
    ).when(F.col("event_type") == "error", F.lit("I cannot answer")).otherwise(F.col("props"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    return A.table(spark, sf, "events").select("event_id", parse_model_json(raw, schema)["k"].alias("k"))


@query
def enriched_articles(spark, sf):
    full = E.enrich(A.articles_from_documents(spark, sf), X.gazetteer(spark), X.LEXICON, X.POSITIVE, X.NEGATIVE, dim=64)
    return full.select(
        "url", joined("categories").alias("categories"), "sentiment.label", "word_count", "entity_count",
        F.size("embedding").alias("dim"),
    )


@query
def article_embeddings(spark, sf):
    docs = E.with_embedding(A.articles_from_documents(spark, sf), dim=64)
    return docs.select("doc_id", F.round(V.row_dot("embedding", "embedding"), 3).alias("norm"), F.size("embedding").alias("dim"))


# -- aggregates -------------------------------------------------------------------------------------------


@query
def article_stats(spark, sf):
    return G.article_stats(A.articles_from_documents(spark, sf))


@query
def sentiment_breakdown(spark, sf):
    return G.sentiment_breakdown(X.rated_documents(spark, sf), 6, as_of=X.newest_crawl(spark, sf))


@query
def volume_per_minute(spark, sf):
    events = A.table(spark, sf, "events").withColumnRenamed("ts", "crawled_at")
    return G.volume_per_minute(events, 24 * 60).select(stamp("minute").alias("minute"), "count")


@query
def category_distribution(spark, sf):
    return G.category_distribution(X.categorised_documents(spark, sf), 24 * 365, as_of=X.newest_crawl(spark, sf))


@query
def source_stats(spark, sf):
    return G.source_stats(A.articles_from_documents(spark, sf), 6).select("source", "count", stamp("last_seen").alias("last_seen"))


@query
def sentiment_share(spark, sf):
    return G.sentiment_share(X.rated_documents(spark, sf))


@query
def trending_topics(spark, sf):
    return G.trending_topics(H.build_edges(X.stored_tagged_documents(spark, sf)))


@query
def source_rollup(spark, sf):
    return G.source_rollup(A.articles_from_documents(spark, sf)).select("source", "article_count", stamp("last_seen").alias("last_seen"))


@query
def cycle_counts(spark, sf):
    return G.cycle_counts(A.table(spark, sf, "events"), 120, "ts").select(stamp("cycle").alias("cycle"), "crawled", "total_crawled")


@query
def rolling_cycle_mean(spark, sf):
    cycles = G.cycle_counts(A.table(spark, sf, "events"), 3600, "ts")
    return G.rolling_cycle_mean(cycles).select(stamp("cycle").alias("cycle"), "crawled", "rolling_mean")


@query
def verdict_tiers(spark, sf):
    return G.verdict_tiers(_verdicts(spark, sf))


@query
def active_spikes(spark, sf):
    return R.active_spikes(R.compute_trends(A.mentions_from_events(spark, sf))).select("kind", "name", "velocity")


@query
def newest_events(spark, sf):
    return G.retain_newest(A.incidents_from_events(spark, sf), 500, "published_at", "article_hash", 7).select("article_hash")


@query
def scoreboard(spark, sf):
    return G.scoreboard(A.incidents_from_events(spark, sf)).select("article_hash", "anomaly_score")


@query
def recent_verdicts(spark, sf):
    latest = G.recent_verdicts(_verdicts(spark, sf), 100, "last_event_at")
    return latest.select("event_cluster_id", "verdict", stamp("last_event_at").alias("last_event_at"))


# -- trends -----------------------------------------------------------------------------------------------


@query
def mentions(spark, sf):
    rows = R.mentions(X.tagged_documents(spark, sf).withColumn("content_hash", F.col("url")))
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), stamp(F.max("ts")).alias("last"))


@query
def trends(spark, sf):
    return R.compute_trends(A.mentions_from_events(spark, sf)).drop("computed_at")


@query
def trends_reference(spark, sf):
    return R.compute_trends(A.mentions_from_events(spark, sf), mode="reference").drop("computed_at")


@query
def top_trends(spark, sf):
    return R.top_trends(R.compute_trends(A.mentions_from_events(spark, sf))).select("kind", "name", "velocity")


@query
def trend_series(spark, sf):
    return R.trend_series(A.mentions_from_events(spark, sf)).withColumn("slot", stamp("slot"))


@query
def frequency_signals(spark, sf):
    found = R.frequency_signals(A.incidents_from_events(spark, sf), min_ratio=1.0)
    return found.select(
        "signal_id", "subcategory", "region", joined("events").alias("events"), "event_count", "baseline_count", "frequency_ratio",
        "temporal_span_hours", "confidence",
    )


# -- clusters ---------------------------------------------------------------------------------------------


def _batched(spark, sf) -> DataFrame:
    """Batched events, written once: every detector reads them."""
    return cut_lineage(C.assign_batches(A.incidents_from_events(spark, sf)))


def _clusters(events: DataFrame) -> DataFrame:
    """Six-hour windows and regions of every batch."""
    return C.with_cluster_columns(C.union_clusters(C.temporal_clusters(events, hours=6), C.spatial_clusters(events)))


def _verdicts(spark, sf) -> DataFrame:
    """Rule verdicts dated by the last event of the cluster."""
    events = _batched(spark, sf)
    clusters = _clusters(events)
    last = C.cluster_events(clusters, events).groupBy(F.col("cluster_id").alias("event_cluster_id")).agg(F.max("published_at").alias("last_event_at"))
    return J.rule_verdicts(clusters, events, F.lit(None).cast("timestamp")).join(last, "event_cluster_id")


@query
def event_batches(spark, sf):
    return _batched(spark, sf).select("article_hash", "batch_id", "pending")


@query
def entity_clusters(spark, sf):
    found = C.with_cluster_columns(C.link_by_entity(_batched(spark, sf), 0.70))
    return found.select("batch_id", "entity", joined("events").alias("events"), "size", "confidence", "avg_anomaly", "avg_credibility")


@query
def semantic_clusters(spark, sf):
    rank = F.row_number().over(Window.partitionBy("title").orderBy("id"))
    events = A.vectors(spark, sf).select(
        F.concat_ws("-", "title", F.col("id").cast("string")).alias("article_hash"), F.col("title").cast("bigint").alias("group"), "id",
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("title"), "embedding",
        F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("published_at"),
        F.lit(0.9).alias("anomaly_score"), (F.lit(0.5) + F.col("id") % 50 / 100.0).alias("credibility_score"),
    )
    batched = C.assign_batches(events.drop("group", "id"))
    found = C.with_cluster_columns(C.link_by_semantics(batched, min_sim=0.36, min_confidence=0.05))
    return found.select("batch_id", joined("events").alias("events"), F.round("similarity", 4).alias("similarity"), "confidence", "avg_credibility")


@query
def temporal_clusters(spark, sf):
    found = C.with_cluster_columns(C.temporal_clusters(_batched(spark, sf), hours=6))
    return found.select(
        "cluster_id", "batch_id", "size", "confidence", "avg_anomaly", "avg_credibility", joined("regions").alias("regions"),
        F.md5(joined("events")).alias("events_md5"),
    )


@query
def spatial_clusters(spark, sf):
    found = C.with_cluster_columns(C.spatial_clusters(_batched(spark, sf)))
    return found.select("cluster_id", "batch_id", "region", "size", "confidence", "avg_anomaly")


@query
def cluster_union(spark, sf):
    return _clusters(_batched(spark, sf)).groupBy("cluster_type", "kind_rank").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("events"), F.round(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double"), 3).alias("confidence")
    )


@query
def cluster_event_rows(spark, sf):
    events = _batched(spark, sf)
    rows = C.cluster_events(_clusters(events), events)
    return rows.select("cluster_id", "pos", "article_hash", "anomaly_score")


@query
def shared_entities(spark, sf):
    events = _batched(spark, sf)
    return C.shared_entities(C.cluster_events(_clusters(events), events))


@query
def merged_clusters(spark, sf):
    merged = C.with_cluster_columns(C.merge_clusters(_clusters_raw(spark, sf)))
    return merged.select("batch_id", "cluster_type", "relationship", "size", "confidence", "cluster_id")


def _clusters_raw(spark, sf) -> DataFrame:
    events = _batched(spark, sf)
    return C.union_clusters(C.link_by_entity(events), C.temporal_clusters(events), C.spatial_clusters(events))


@query
def clusters_across_batches(spark, sf):
    """Clusters of names and regions in batches of 200 events that start every 100, merged over all batches."""
    events = cut_lineage(C.assign_sliding_batches(A.incidents_from_events(spark, sf)))
    found = cut_lineage(C.with_cluster_columns(C.union_clusters(C.link_by_entity(events), C.spatial_clusters(events))).drop("members"))
    return C.merge_across_batches(found)[1]


@query
def close_document_pairs(spark, sf):
    """Documents of any source whose word vectors are nearly parallel."""
    docs = E.with_embedding(A.articles_from_documents(spark, sf), dim=384).select(F.col("doc_id").alias("id"), "embedding")
    return V.close_pairs(docs.where(F.array_max("embedding") > 0), 0.97).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query
def linked_events(spark, sf):
    """All detectors, the one of similar texts included."""
    return C.link_events(C.with_event_embedding(_batched(spark, sf))).select("batch_id", "cluster_id", "cluster_type", "relationship", "size", "confidence", "verdict")


@query
def rule_verdicts(spark, sf):
    events = _batched(spark, sf)
    return J.rule_verdicts(_clusters(events), events, F.lit(None).cast("timestamp")).select(
        "event_cluster_id", "summary", joined("connected_events").alias("connected_events"), "pattern_detected", "confidence",
        "reasoning", "classification", "verdict", "credibility_note",
    )


@query
def rule_verdicts_reference(spark, sf):
    events = _batched(spark, sf)
    verdicts = J.rule_verdicts(_clusters(events), events, F.lit(None).cast("timestamp"), mode="reference")
    return verdicts.groupBy("verdict", "classification").agg(F.count(F.lit(1)).alias("n"))


@query
def capped_confidence(spark, sf):
    rows = A.incidents_from_events(spark, sf).select(
        "article_hash", F.col("anomaly_score").alias("confidence"), (F.col("credibility_score") - 0.4).alias("mean_credibility"),
        F.lit(None).cast("string").alias("credibility_note"),
    )
    return J.cap_confidence(rows).select("article_hash", F.round("confidence", 4).alias("confidence"), "credibility_note")


@query
def default_verdicts(spark, sf):
    none = C.link_events(_batched(spark, sf), min_confidence=1.1, semantics=False)
    return J.default_verdicts(none, F.lit(None).cast("timestamp")).select("batch_id", "verdict", "classification", "confidence", "reasoning")


@query
def cluster_context(spark, sf):
    events = _batched(spark, sf)
    context = J.cluster_context(_clusters(events), events)
    return context.select(
        "cluster_id", F.md5("events_block").alias("events_md5"), "entity_block", "n_events", "avg_anomaly_score", "avg_credibility_score",
        "regions_text", "subcategory", "header", "temporal_block", "graph_block",
    )


@query
def cluster_graph_nodes(spark, sf):
    return C.cluster_nodes(_clusters(_batched(spark, sf))).select("cluster_id", "cluster_type", "relationship_type", "confidence")


@query
def cluster_graph_events(spark, sf):
    events = _batched(spark, sf)
    return C.event_nodes(_clusters(events), events).select(
        "article_hash", "title", "url", "subcategory", "anomaly_score", "credibility_score", "source_reliability", stamp("published_at").alias("published_at"))


@query
def cluster_graph_membership(spark, sf):
    events = _batched(spark, sf)
    return C.cluster_membership(_clusters(events), events)


@query
def cluster_graph_links(spark, sf):
    return C.cluster_links(_clusters(_batched(spark, sf)))


# -- graph ------------------------------------------------------------------------------------------------


def _basket_edges(spark, sf) -> DataFrame:
    lists = stored(H.basket_lists(A.baskets_from_lineitem(spark, sf)), "baskets")
    return H.co_occurrence(H.entity_pairs(lists), "RELATES_TO", H.n_pairs(lists))


@query
def entity_pairs(spark, sf):
    return H.mention_pairs(A.baskets_from_lineitem(spark, sf))


@query
def entity_pairs_reference(spark, sf):
    """Pairs of the first five entities of each article."""
    return H.mention_pairs(A.baskets_from_lineitem(spark, sf), cap=5)


@query
def category_pairs(spark, sf):
    pairs = H.category_pairs(X.labelled_documents(spark, sf))
    return H.co_occurrence(pairs, "TRENDING_WITH").select("src", "dst", "weight")


@query
def graph_nodes(spark, sf):
    nodes = H.build_nodes(X.stored_tagged_documents(spark, sf))
    p = F.col("props")
    return nodes.select(
        "id", "label", p["mention_count"].alias("mention_count"), p["article_count"].alias("article_count"), p["name"].alias("name"),
        p["type"].alias("type"), p["url"].alias("url"), p["sentiment_label"].alias("sentiment_label"),
    )


@query
def graph_edges(spark, sf):
    edges = H.build_edges(X.stored_tagged_documents(spark, sf))
    return edges.select("src", "dst", "type", F.col("props")["sentiment"].alias("sentiment"))


@query
def co_occurrence(spark, sf):
    return _basket_edges(spark, sf).select("src", "dst", "weight")


@query
def entity_connections(spark, sf):
    """What is bought with the part that orders name most often: parts are entities of a name (its brand) and a type."""
    props = F.create_map(F.lit("name"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    nodes = A.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("Entity").alias("label"), props.alias("props"))
    return H.entity_connections(nodes, _basket_edges(spark, sf), "Brand#13")


@query
def related_entities(spark, sf):
    """RELATES_TO edges from the tags of the documents."""
    return H.relates_to(X.stored_tagged_documents(spark, sf)).select("src", "dst", "weight")


@query
def latest_subgraph_links(spark, sf):
    docs = X.stored_tagged_documents(spark, sf)
    return H.latest_subgraph(H.build_nodes(docs), H.build_edges(docs))[1]


@query
def latest_subgraph_nodes(spark, sf):
    docs = X.stored_tagged_documents(spark, sf)
    return H.latest_subgraph(H.build_nodes(docs), H.build_edges(docs))[0].select("id", "label")


@query
def two_hop_neighbours(spark, sf):
    """Customers, orders and parts as a graph: everything within two hops of part 7."""
    edges = A.table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")
    )
    return H.k_hop(edges, "p7", 2)


@query
def closed_links(spark, sf):
    docs = X.stored_tagged_documents(spark, sf)
    nodes, edges = H.build_nodes(docs), H.build_edges(docs)
    return H.closed_links(edges, nodes.where(F.col("label").isin("Article", "Topic"))).select("src", "dst", "type")


@query
def subgraph_by_label(spark, sf):
    docs = X.stored_tagged_documents(spark, sf)
    _, links = H.filter_labels(H.build_nodes(docs), H.build_edges(docs), ["Article", "Entity"])
    return links.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# -- vectors ----------------------------------------------------------------------------------------------


@query
def nearest_neighbours(spark, sf):
    """Every vector against the whole table."""
    v = A.vectors(spark, sf)
    return V.knn(v, v, 10).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query
def nearest_neighbours_by_cell(spark, sf):
    """As many probes as find 95 % of the exact neighbours of a sample."""
    v = A.vectors(spark, sf)
    model = V.train_cells(v, 20)
    celled = V.with_cell(v, model)
    return V.knn_by_cell(v, celled, model, 10, V.probes_for(v, celled, model)).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query
def nearest_neighbours_by_label_cell(spark, sf):
    """Cells around the mean vector of each label; a query looks into its two nearest ones."""
    v = A.vectors(spark, sf)
    centers = V.label_centers(A.table(spark, sf, "embeddings"))
    celled = v.withColumn("cell", F.get(V.cell_of(F.col("embedding"), centers), 0))
    return V.knn_by_cell(v, celled, centers, 10, 2).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query
def retrieval(spark, sf):
    v = A.vectors(spark, sf).withColumn("url", F.concat(F.lit("vec://"), F.col("id").cast("string")))
    v = v.withColumn("categories", F.array("title")).withColumn("sentiment", F.lit("neutral"))
    return V.retrieve(v, v, 5).select("query_id", "context", "context_count", "answer")


# -- insights ---------------------------------------------------------------------------------------------

# Event types read as categories that the insight rules know.
RENAMED = {"click": "technology", "view": "war_conflict", "error": "crime_law", "signup": "finance", "purchase": "energy"}


def _named_trends(spark, sf) -> DataFrame:
    """Trends of hourly windows with event types under category names; a low spike bound keeps the rules busy."""
    names = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    m = A.mentions_from_events(spark, sf).withColumn("name", F.coalesce(F.try_element_at(names, F.col("name")), F.col("name")))
    return R.compute_trends(m.where("kind = 'cat'"), window=4 * 3600, threshold=0.5)


@query
def rule_insights(spark, sf):
    return I.rule_insights(_named_trends(spark, sf))


@query
def insight_context(spark, sf):
    docs = X.labelled_documents(spark, sf)
    entities = A.mentions_from_events(spark, sf).where("kind = 'ent'").groupBy("name").agg(F.count(F.lit(1)).alias("count")).withColumn("type", F.lit("user"))
    return I.insight_context(_named_trends(spark, sf), G.sentiment_breakdown(docs, 24), entities, G.category_distribution(docs, 24))
