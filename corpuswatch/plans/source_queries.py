"""Registered queries on payloads, topics and sinks: payloads are made from the given tables, sinks are written and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpuswatch.functions.text import or_empty
from corpuswatch.operators import enrich as E
from corpuswatch.operators import tables as TB
from corpuswatch.operators import trends as R
from corpuswatch.plans.queries import query, stamp
from corpuswatch.session import scratch_path
from corpuswatch.sources import adapters as A
from corpuswatch.sources import lake as LK
from corpuswatch.sources import payloads as PL

NOW = "2024-05-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _documents(spark, sf):
    return A.table(spark, sf, "documents")


def _shown(articles):
    return articles.select("url", "title", F.md5("content").alias("content_md5"), "source", "author", stamp("published_at").alias("published_at"))


def _story_payloads(spark, sf):
    text = F.col("text")
    item = F.struct(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "comment").otherwise("story").alias("type"), F.substring_index(text, "\n", 1).alias("title"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://s/"), F.col("doc_id"))).alias("url"), text.alias("text"), (F.col("doc_id") * 60).alias("time"),
        F.col("lang").alias("by"),
    )
    return _documents(spark, sf).select(F.to_json(item).alias("payload"), _now().alias("ingested_at"))


@query
def story_items(spark, sf):
    """Every document as a story item; each third has no link, each fifth is a comment."""
    return _shown(PL.articles_from_story_items(_story_payloads(spark, sf), "https://page/"))


@query
def story_items_reference(spark, sf):
    """Contents of 5,000 characters, as in the analysed system."""
    return _shown(PL.articles_from_story_items(_story_payloads(spark, sf), "https://page/", PL.REFERENCE_CONTENT_CHARS))


@query
def article_lists(spark, sf):
    """Every document as a list of two articles, the second without a title for each second document."""
    def article(mark, title):
        return F.struct(
            title.alias("title"), F.concat(F.lit(f"https://{mark}/"), F.col("doc_id")).alias("url"),
            F.date_format(F.timestamp_seconds(F.col("doc_id") * 3600), "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("source").alias("domain"),
        )

    title = F.trim(F.substring_index("text", "\n", 1))
    pair = F.array(article("a", title), article("b", F.when(F.col("doc_id") % 2 == 0, title).otherwise("")))
    payloads = _documents(spark, sf).select(F.to_json(F.struct(pair.alias("articles"))).alias("payload"), F.col("lang").alias("topic"), _now().alias("ingested_at"))
    return _shown(PL.articles_from_artlist(payloads))


def _timeline_payloads(spark, sf):
    link = F.concat_ws("/", F.lit("https://t"), "conv_id", "turn")
    post = F.struct(
        F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("content"), F.lit("2024-02-03T04:05:06.000Z").alias("created_at"), link.alias("url"),
        F.when(F.col("role") == "user", F.struct(F.lit("Card").alias("title"), F.concat(link, F.lit("/card")).alias("url"))).alias("card"),
        F.struct(F.col("role").alias("acct")).alias("account"),
    )
    turns = A.table(spark, sf, "conversations")
    return turns.select(F.to_json(post).alias("payload"), F.lit("host").alias("host"), F.lit("US").alias("region"), _now().alias("ingested_at"))


@query
def timeline_posts(spark, sf):
    """Every conversation turn as a post in markup; user turns carry a card."""
    return _shown(PL.articles_from_timeline(_timeline_payloads(spark, sf)))


@query
def timeline_posts_reference(spark, sf):
    """Contents of 5,000 characters, as in the analysed system."""
    return _shown(PL.articles_from_timeline(_timeline_payloads(spark, sf), PL.REFERENCE_TITLE_CHARS, PL.REFERENCE_CONTENT_CHARS))


def _search_payloads(spark, sf):
    post = F.struct(
        F.concat(F.lit("at://did:"), F.col("conv_id"), F.lit("/post/"), F.col("turn")).alias("uri"), F.struct(F.col("text").alias("text")).alias("record"),
        F.lit("2024-01-02T03:04:05Z").alias("indexedAt"), F.struct(F.col("role").alias("handle")).alias("author"),
    )
    return A.table(spark, sf, "conversations").select(F.to_json(F.struct(F.array(post).alias("posts"))).alias("payload"), F.lit("q").alias("label"), _now().alias("ingested_at"))


@query
def search_posts(spark, sf):
    """Every conversation turn as a search result."""
    return _shown(PL.articles_from_search_posts(_search_payloads(spark, sf), "https://web/"))


@query
def search_posts_reference(spark, sf):
    """Contents of 5,000 characters, as in the analysed system."""
    return _shown(PL.articles_from_search_posts(_search_payloads(spark, sf), "https://web/", PL.REFERENCE_TITLE_CHARS, PL.REFERENCE_CONTENT_CHARS))


def _escaped(c):
    for found, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(found), F.lit(written))
    return c


@query
def feed_articles(spark, sf):
    """Every document as a feed of one entry: RSS with media elements beside its own, or Atom with an enclosure link."""
    title = _escaped(F.trim(F.substring_index("text", "\n", 1)))
    link, text = F.concat(F.lit("https://f/"), F.col("doc_id").cast("string")), F.translate("text", "<>", "  ")
    rss = F.concat(
        F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><media:title>photo</media:title><description>"), _escaped(text),
        F.lit("</description><media:description>caption</media:description><dc:creator>"), F.col("lang"), F.lit("</dc:creator><pubDate>Tue, 05 Mar 2024 10:00:00 +0100</pubDate></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed><entry><title>"), title, F.lit('</title><link rel="enclosure" href="https://x/"/><link rel="alternate" href="'), link, F.lit('"/><content>'), _escaped(text),
        F.lit("</content><updated>2024-03-05T09:00:00Z</updated><author><name>"), F.col("lang"), F.lit("</name></author></entry></feed>"),
    )
    payload = F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom)
    feeds = _documents(spark, sf).select(payload.alias("payload"), F.col("source").alias("name"), F.lit("https://feed").alias("url"), F.lit("GB").alias("region"), _now().alias("ingested_at"))
    return PL.articles_from_feeds(feeds).select("url", F.md5("title").alias("title_md5"), F.length("content").alias("n_chars"), "source", "author", stamp("published_at").alias("published_at"))


@query
def topic_round_trip(spark, sf):
    """Articles to keyed topic rows and back; rows cut in half are quarantined."""
    rows = LK.to_topic_rows(A.articles_from_documents(spark, sf))
    spoiled = F.col("key").substr(1, 1) == "0"
    good, bad = LK.parse_topic_values(rows.withColumn("value", F.when(spoiled, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value"))))
    return good.select("url", "content_hash", F.md5("content").alias("content_md5"), F.lit(False).alias("quarantined")).unionByName(
        bad.groupBy().agg(F.count("*").cast("string").alias("url")).select("url", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("content_md5"), F.lit(True).alias("quarantined"))
    )


def _lake(spark, sf) -> str:
    path = scratch_path(spark, "lake")
    LK.write_lake(A.articles_from_documents(spark, sf), path)
    return path


@query
def lake_round_trip(spark, sf):
    """What the lake holds by date and source after all articles were written."""
    # The only field that is asked for; date and source come from the folders.
    lake = spark.read.schema("hash16 string").json(_lake(spark, sf))
    return lake.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt"), "source_key").agg(F.count("*").alias("n"), F.min("hash16").alias("first_hash16"))


@query
def lake_article(spark, sf):
    """One article looked up in the lake: that of the first document."""
    path = _lake(spark, sf)
    first = A.articles_from_documents(spark, sf).orderBy("doc_id").select("content_hash", "source", F.date_format("published_at", "yyyy-MM-dd").alias("dt")).first()
    return LK.read_lake(spark, path, first["dt"], first["source"], first["content_hash"]).select("url", "content_hash", F.md5("content").alias("content_md5"))


@query
def trend_snapshots(spark, sf):
    """The trend list written under its day and read back."""
    path = scratch_path(spark, "trends")
    TB.write_trend_snapshot(R.compute_trends(A.mentions_from_events(spark, sf)), path)
    return spark.read.parquet(path).select("kind", "name", "current_count", "prev_count", "is_spike", F.col("day").cast("string").alias("day"))


def _length_labels(texts: pd.Series) -> pd.DataFrame:
    """A stand-in model: labels by the length of the text; it fails on texts with a bar."""
    if texts.str.contains("|", regex=False).any():
        raise ValueError("cannot read tables")
    share = texts.str.len() % 10 / 10
    return pd.DataFrame({"labels": [["long", "short"] if n > 0.4 else ["short", "long"] for n in share], "scores": [[max(n, round(1 - n, 4)), min(n, round(1 - n, 4))] for n in share]})


def _length_mood(texts: pd.Series) -> pd.DataFrame:
    if texts.str.contains("|", regex=False).any():
        raise ValueError("cannot read tables")
    share = texts.str.len() % 10 / 10
    return pd.DataFrame({"label": ["LABEL_2" if n > 0.4 else "LABEL_0" for n in share], "score": 0.5 + share / 2})


def _model_categories(spark, sf):
    docs = E.model_categories(A.articles_from_documents(spark, sf), _length_labels)
    return docs.withColumn("categories", F.array_join("categories", ","))


def _model_sentiment(spark, sf):
    docs = E.model_sentiment(A.articles_from_documents(spark, sf), _length_mood)
    return docs.select("doc_id", "content", F.col("sentiment.label").alias("label"), F.col("sentiment.score").alias("score"))


@query
def model_categories(spark, sf):
    """Categories of a model, keyword rules for the texts it fails on."""
    return _model_categories(spark, sf).select("doc_id", "categories")


@query
def model_sentiment(spark, sf):
    """Sentiment of a model, keyword rules for the texts it fails on."""
    return _model_sentiment(spark, sf).drop("content")
