"""API and feed payloads to raw articles.

Each function takes a DataFrame with one payload per row in column ``payload`` (JSON or XML text) plus the
columns named in its docstring, and returns the raw-article columns. Parsing is by schema inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.functions.parsing import try_ts
from corpuswatch.functions.text import head, or_empty, strip, strip_tags, truthy
from corpuswatch.operators.identity import with_content_hash
from corpuswatch.schemas import ARTICLE_LIST, RAW_ARTICLE, SEARCH_POSTS, STORY_ITEM, TIMELINE_POST

ISO_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss"]
RFC_FORMATS = [
    "dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss z",
]

#: Characters of title and content that the analysed system keeps of stories and posts; the default keeps whole texts.
REFERENCE_TITLE_CHARS, REFERENCE_CONTENT_CHARS = 300, 5000


def _as_articles(df: DataFrame) -> DataFrame:
    """Complete the raw-article columns, in schema order, with the content hash."""
    with_hash = with_content_hash(df)
    return with_hash.select(
        *[
            (F.col(f.name) if f.name in with_hash.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RAW_ARTICLE.fields
        ]
    )


def _text(c: Column) -> Column:
    return or_empty(c.cast("string"))


def ordered_union_distinct(first: DataFrame, second: DataFrame, take_first: int = 100, take_second: int = 50):
    """Ids of two ranked lists (columns ``pos``, ``id``): the head of each, first sighting kept, in order."""
    lists = (
        first.where(F.col("pos") < take_first)
        .select("id", F.struct(F.lit(0).alias("list"), "pos").alias("at"))
        .unionByName(
            second.where(F.col("pos") < take_second).select("id", F.struct(F.lit(1).alias("list"), "pos").alias("at"))
        )
    )
    return lists.groupBy("id").agg(F.min("at").alias("at")).select("id", "at.list", "at.pos").orderBy("list", "pos")


def articles_from_story_items(df: DataFrame, item_page: str, content_chars: int | None = None) -> DataFrame:
    """Story items; ``item_page`` is the page address that an id is appended to when the story has no link.

    Whole texts by default, and the content hash is that of what is kept; ``content_chars=REFERENCE_CONTENT_CHARS`` as in the analysed system.
    """
    item = df.select(F.from_json("payload", STORY_ITEM).alias("i"), "ingested_at").select("i.*", "ingested_at")
    return _as_articles(
        item.where((F.col("type") == "story") & (strip(_text(F.col("title"))) != "")).select(
            F.coalesce(truthy(F.col("url")), F.concat(F.lit(item_page), F.col("id").cast("string"))).alias("url"),
            strip(F.col("title")).alias("title"),
            head(_text(F.col("text")), content_chars).alias("content"),
            F.lit("hackernews").alias("source"),
            F.lit("api").alias("source_type"),
            F.timestamp_seconds(F.coalesce("time", F.lit(0))).alias("published_at"),
            F.col("by").alias("author"),
            F.lit("en").alias("language"),
            F.lit("US").alias("region"),
            F.col("ingested_at").alias("crawled_at"),
            F.create_map(
                F.lit("score"), F.coalesce("score", F.lit(0)).cast("string"),
                F.lit("comments"), F.coalesce("descendants", F.lit(0)).cast("string"),
                F.lit("hn_id"), F.col("id").cast("string"),
            ).alias("metadata"),
        )
    )


def articles_from_artlist(df: DataFrame) -> DataFrame:
    """Article lists; also reads ``topic`` (label of the search) and ``ingested_at`` (fallback date)."""
    rows = df.select(
        F.explode(F.from_json("payload", ARTICLE_LIST)["articles"]).alias("a"), "topic", "ingested_at"
    ).select("a.*", "topic", "ingested_at")
    title, seen = strip(_text(F.col("title"))), _text(F.col("seendate"))
    return _as_articles(
        rows.where((title != "") & (strip(_text(F.col("url"))) != "")).select(
            strip(F.col("url")).alias("url"),
            title.alias("title"),
            F.concat(seen, F.lit(" "), title).alias("content"),
            F.concat(F.lit("gdelt/"), F.coalesce("domain", F.lit("unknown"))).alias("source"),
            F.lit("api").alias("source_type"),
            F.coalesce(F.try_to_timestamp(seen, F.lit("yyyyMMdd'T'HHmmss'Z'")), "ingested_at").alias("published_at"),
            F.coalesce("language", F.lit("English")).alias("language"),
            F.col("sourcecountry").alias("region"),
            F.col("ingested_at").alias("crawled_at"),
            F.create_map(
                F.lit("domain"), F.col("domain"), F.lit("socialimage"), F.col("socialimage"),
                F.lit("gdelt_topic"), F.col("topic"), F.lit("tone"), F.col("tone"),
            ).alias("metadata"),
        )
    )


def articles_from_timeline(
    df: DataFrame, title_chars: int | None = None, content_chars: int | None = None
) -> DataFrame:
    """Public timeline posts; also reads ``host``, ``region`` and ``ingested_at``. Short posts are dropped; whole texts unless lengths are given.

    A post without a card's title is named by its first 120 characters, whatever ``title_chars`` is.
    """
    rows = df.select(F.from_json("payload", TIMELINE_POST).alias("p"), "host", "region", "ingested_at")
    text = strip_tags(_text(F.col("p.content")))
    url = F.coalesce(truthy(F.col("p.card.url")), truthy(F.col("p.url")))
    return _as_articles(
        rows.where((F.length(text) >= 40) & url.isNotNull()).select(
            url.alias("url"),
            head(F.coalesce(truthy(F.col("p.card.title")), head(text, 120)), title_chars).alias("title"),
            head(text, content_chars).alias("content"),
            F.concat(F.lit("mastodon/"), F.col("host")).alias("source"),
            F.lit("social").alias("source_type"),
            F.coalesce(try_ts(F.col("p.created_at"), *ISO_FORMATS), "ingested_at").alias("published_at"),
            F.col("p.account.acct").alias("author"),
            F.lit("en").alias("language"),
            "region",
            F.col("ingested_at").alias("crawled_at"),
            F.create_map(
                F.lit("instance"), F.col("host"),
                F.lit("favourites"), F.coalesce("p.favourites_count", F.lit(0)).cast("string"),
                F.lit("reblogs"), F.coalesce("p.reblogs_count", F.lit(0)).cast("string"),
                F.lit("card_description"), _text(F.col("p.card.description")),
            ).alias("metadata"),
        )
    )


def articles_from_search_posts(
    df: DataFrame, profile_page: str, title_chars: int | None = None, content_chars: int | None = None
) -> DataFrame:
    """Search results; also reads ``label`` and ``ingested_at``. ``profile_page`` prefixes rewritten post URIs; whole texts unless lengths are given.

    A post without an embedded title is named by its first 120 characters, whatever ``title_chars`` is.
    """
    rows = df.select(F.explode(F.from_json("payload", SEARCH_POSTS)["posts"]).alias("p"), "label", "ingested_at")
    text = strip(_text(F.col("p.record.text")))
    ext = F.col("p.embed.external")
    uri = _text(F.col("p.uri"))
    parts = F.split(F.replace(uri, F.lit("at://"), F.lit("")), "/")
    rewritten = F.concat(
        F.lit(profile_page), F.try_element_at(parts, F.lit(1)), F.lit("/post/"), F.try_element_at(parts, F.lit(3))
    )
    plain = F.coalesce(truthy(ext["uri"]), uri)
    post_url = F.when(uri.startswith("at://") & (F.size(parts) >= 3), rewritten).otherwise(plain)
    content = F.concat_ws("\n", F.filter(F.array(text, ext["description"]), lambda x: x.isNotNull() & (x != "")))
    return _as_articles(
        rows.where((F.length(text) >= 30) & (post_url != "")).select(
            F.coalesce(truthy(ext["uri"]), post_url).alias("url"),
            head(F.coalesce(truthy(ext["title"]), head(text, 120)), title_chars).alias("title"),
            head(content, content_chars).alias("content"),
            F.concat(F.lit("bluesky/"), F.col("label")).alias("source"),
            F.lit("social").alias("source_type"),
            F.coalesce(try_ts(F.col("p.indexedAt"), *ISO_FORMATS), "ingested_at").alias("published_at"),
            F.col("p.author.handle").alias("author"),
            F.lit("en").alias("language"),
            F.col("ingested_at").alias("crawled_at"),
            F.create_map(
                F.lit("like_count"), F.coalesce("p.likeCount", F.lit(0)).cast("string"),
                F.lit("repost_count"), F.coalesce("p.repostCount", F.lit(0)).cast("string"),
                F.lit("reply_count"), F.coalesce("p.replyCount", F.lit(0)).cast("string"),
                F.lit("post_url"), post_url,
                F.lit("query"), F.col("label"),
            ).alias("metadata"),
        )
    )


RSS_SCHEMA = (
    "channel struct<item:array<struct<title:string,link:string,content_encoded:string,summary:string,description:string,"
    "pubDate:string,published:string,updated:string,author:string,dc_creator:string,dc_date:string>>>"
)
ATOM_SCHEMA = (
    "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,content:string,summary:string,"
    "published:string,updated:string,author:array<struct<name:string>>,dc_creator:string>>"
)


def feed_entries(df: DataFrame) -> DataFrame:
    """RSS and Atom documents to one row per entry with the position in the feed.

    A qualified name stays apart from the plain one: ``content:encoded`` reads as ``content_encoded``, and a photo's
    ``media:title`` never takes the place of the entry's ``title``. Only a feed that is itself written with the prefix ``atom:`` loses it.
    """
    atom_root = F.col("payload").rlike(r"<atom:feed\b")
    plain = F.when(atom_root, F.regexp_replace("payload", r"<(/?)atom:", "<$1")).otherwise(F.col("payload"))
    xml = F.regexp_replace(plain, r"<(/?)([A-Za-z][\w.-]*):", "<$1$2_")
    rss = F.from_xml(xml, RSS_SCHEMA)["channel"]["item"]
    atom = F.from_xml(xml, ATOM_SCHEMA)["entry"]
    entry = "struct<title:string,link:string,content:string,summary:string,published:string,updated:string,author:string>"

    def rss_entry(e):
        return F.struct(
            e["title"].alias("title"), e["link"].alias("link"), e["content_encoded"].alias("content"),
            F.coalesce(e["summary"], e["description"]).alias("summary"),
            F.coalesce(e["pubDate"], e["published"], e["dc_date"]).alias("published"), e["updated"].alias("updated"),
            F.coalesce(e["author"], e["dc_creator"]).alias("author"),
        )

    def atom_entry(e):
        # The entry's own page, not an enclosure, edit or self link.
        page = F.filter(e["link"], lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(
            e["title"].alias("title"), F.try_element_at(page, F.lit(1))["_href"].alias("link"), e["content"].alias("content"),
            e["summary"].alias("summary"), e["published"].alias("published"), e["updated"].alias("updated"),
            F.coalesce(F.try_element_at(e["author"], F.lit(1))["name"], e["dc_creator"]).alias("author"),
        )

    entries = F.coalesce(
        F.transform(rss, rss_entry).cast(f"array<{entry}>"), F.transform(atom, atom_entry).cast(f"array<{entry}>")
    )
    rest = [c for c in df.columns if c != "payload"]
    return df.select(*rest, F.posexplode(entries).alias("pos", "e")).select(*rest, "pos", "e.*")


def articles_from_feeds(
    df: DataFrame,
    source_type: str = "rss",
    max_entries: int | None = None,
    title_chars: int | None = None,
    content_chars: int | None = None,
    summary_first: bool = False,
) -> DataFrame:
    """Feed documents to articles; also reads ``name``, ``url``, ``region`` and ``ingested_at``.

    Text precedence is content, then summary or description (``summary_first`` turns that round); date
    precedence is published, then updated, then the ingest time. ``max_entries`` is the per-feed entry cap
    that some feeds are read with.
    """
    rows = feed_entries(df.withColumnRenamed("url", "feed_url"))
    if max_entries is not None:
        rows = rows.where(F.col("pos") < max_entries)
    title, link = strip(_text(F.col("title"))), strip(_text(F.col("link")))
    order = ["summary", "content"] if summary_first else ["content", "summary"]
    body = F.coalesce(*[truthy(F.col(c)) for c in order], F.lit(""))
    formats = RFC_FORMATS + ISO_FORMATS
    return _as_articles(
        rows.where((title != "") & (link != "")).select(
            link.alias("url"),
            head(title, title_chars).alias("title"),
            head(strip_tags(body), content_chars).alias("content"),
            F.col("name").alias("source"),
            F.lit(source_type).alias("source_type"),
            F.coalesce(
                try_ts(F.col("published"), *formats), try_ts(F.col("updated"), *formats), F.col("ingested_at")
            ).alias("published_at"),
            "author",
            F.lit("en").alias("language"),
            "region",
            F.col("ingested_at").alias("crawled_at"),
            F.create_map(F.lit("feed_url"), F.col("feed_url")).alias("metadata"),
        )
    )
