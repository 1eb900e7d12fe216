"""Record layouts used by sources, operators and sinks."""

from pyspark.sql import types as T

STRING, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
TIMESTAMP, BOOLEAN, STRINGS = T.TimestampType(), T.BooleanType(), T.ArrayType(T.StringType())


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SENTIMENT = record(label=STRING, score=DOUBLE, positive=DOUBLE, negative=DOUBLE, neutral=DOUBLE)
ENTITY = record(name=STRING, label=STRING, start=INT, end=INT, type=STRING)

RAW_ARTICLE = record(
    content_hash=STRING, url=STRING, title=STRING, content=STRING, source=STRING, source_type=STRING, author=STRING,
    language=STRING, region=STRING, published_at=TIMESTAMP, crawled_at=TIMESTAMP, raw_html=STRING,
    metadata=T.MapType(STRING, STRING),
)
ENRICHED_ARTICLE = T.StructType(
    RAW_ARTICLE.fields
    + record(
        categories=STRINGS, category_scores=T.MapType(STRING, DOUBLE), sentiment=SENTIMENT, entities=T.ArrayType(ENTITY),
        embedding=T.ArrayType(T.FloatType()), word_count=INT, entity_count=INT, processed_at=TIMESTAMP,
    ).fields
)

VERDICT = record(
    event_cluster_id=STRING, summary=STRING, connected_events=STRINGS, pattern_detected=BOOLEAN, confidence=DOUBLE,
    reasoning=STRING, classification=STRING, verdict=STRING, data_gaps=STRING, credibility_note=STRING,
)
INSIGHT_ITEM = record(title=STRING, description=STRING, confidence=STRING, category=STRING)
INSIGHTS = record(
    market_opportunities=T.ArrayType(INSIGHT_ITEM), emerging_risks=T.ArrayType(INSIGHT_ITEM), viral_topics=T.ArrayType(INSIGHT_ITEM)
)

STORY_ITEM = record(
    id=LONG, type=STRING, title=STRING, url=STRING, text=STRING, time=LONG, by=STRING, score=LONG, descendants=LONG
)
ARTICLE_LIST = record(
    articles=T.ArrayType(
        record(
            title=STRING, url=STRING, seendate=STRING, domain=STRING, sourcecountry=STRING, language=STRING,
            socialimage=STRING, tone=STRING,
        )
    )
)
TIMELINE_POST = record(
    content=STRING, created_at=STRING, url=STRING, card=record(title=STRING, url=STRING, description=STRING),
    account=record(acct=STRING), favourites_count=LONG, reblogs_count=LONG,
)
SEARCH_POSTS = record(
    posts=T.ArrayType(
        record(
            uri=STRING, record=record(text=STRING),
            embed=record(external=record(uri=STRING, title=STRING, description=STRING)),
            indexedAt=STRING, author=record(handle=STRING), likeCount=LONG, repostCount=LONG, replyCount=LONG,
        )
    )
)
