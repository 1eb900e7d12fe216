import datetime as dt
import json

from pyspark.sql import functions as F

from corpuswatch.functions.parsing import age_label, parse_model_json, parse_ts
from corpuswatch.functions.text import python_title, strip_tags
from corpuswatch.schemas import RAW_ARTICLE, VERDICT
from corpuswatch.sources import lake, pages, payloads
from corpuswatch.sources.registry import with_source_info

NOW = dt.datetime(2024, 5, 1, 12)


def payload(spark, rows, columns):
    return spark.createDataFrame([(json.dumps(p) if not isinstance(p, str) else p, *rest) for p, *rest in rows], columns)


def test_story_items(spark):
    rows = [
        ({"id": 1, "type": "story", "title": " Hello ", "url": "https://a.b/c", "time": 1700000000, "by": "me", "score": 5, "descendants": 2}, NOW),
        ({"id": 2, "type": "story", "title": "No link", "text": "x" * 6000, "time": 0}, NOW),
        ({"id": 3, "type": "comment", "title": "skip"}, NOW),
        ({"id": 4, "type": "story", "title": "  "}, NOW),
    ]
    df = payload(spark, rows, "payload string, ingested_at timestamp")
    got = {r["metadata"]["hn_id"]: r for r in payloads.articles_from_story_items(df, "https://page/item?id=").collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["title"] == "Hello" and got["1"]["published_at"] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got["2"]["url"] == "https://page/item?id=2" and len(got["2"]["content"]) == 6000
    assert got["2"]["metadata"]["score"] == "0" and len(got["2"]["content_hash"]) == 64


def test_artlist(spark):
    rows = [({"articles": [
        {"title": " A ", "url": "https://x/1", "seendate": "20240301T101500Z", "domain": "x", "sourcecountry": "FR", "language": "French"},
        {"title": "B", "url": "https://x/2", "seendate": "junk"},
        {"title": "", "url": "https://x/3"},
    ]}, "tech", NOW), ({}, "none", NOW)]
    got = payloads.articles_from_artlist(payload(spark, rows, "payload string, topic string, ingested_at timestamp")).orderBy("url").collect()
    assert [r["title"] for r in got] == ["A", "B"]
    assert got[0]["published_at"] == dt.datetime(2024, 3, 1, 10, 15) and got[1]["published_at"] == NOW
    assert got[0]["content"] == "20240301T101500Z A" and got[1]["source"] == "gdelt/unknown" and got[1]["language"] == "English"


def test_timeline(spark):
    text = "<p>" + "long enough text for the filter " * 2 + "</p>"
    rows = [
        ({"content": text, "created_at": "2024-02-03T04:05:06.000Z", "url": "https://p/1", "card": {"title": "Card", "url": "https://c/1"}, "account": {"acct": "me"}}, "h", None, NOW),
        ({"content": text, "created_at": "bad", "url": "https://p/2", "card": None}, "h", "US", NOW),
        ({"content": "<p>short</p>", "url": "https://p/3"}, "h", None, NOW),
        ({"content": text}, "h", None, NOW),
    ]
    df = payload(spark, rows, "payload string, host string, region string, ingested_at timestamp")
    got = payloads.articles_from_timeline(df).orderBy("url").collect()
    assert [r["url"] for r in got] == ["https://c/1", "https://p/2"]
    assert got[0]["title"] == "Card" and got[0]["published_at"] == dt.datetime(2024, 2, 3, 4, 5, 6)
    assert got[1]["published_at"] == NOW and got[1]["metadata"]["favourites"] == "0" and not got[1]["content"].startswith("<")


def test_search_posts(spark):
    text = "a post text that is long enough to stay"
    posts = [
        {"uri": "at://did:1/app.post/abc", "record": {"text": text}, "indexedAt": "2024-01-02T03:04:05Z", "author": {"handle": "h"}},
        {"uri": "at://x/y", "record": {"text": text}, "embed": {"external": {"uri": "https://e/1", "title": "T", "description": "D"}}},
        {"uri": "at://x/y", "record": {"text": "short"}},
    ]
    df = payload(spark, [({"posts": posts}, "world", NOW)], "payload string, label string, ingested_at timestamp")
    got = payloads.articles_from_search_posts(df, "https://web/profile/").orderBy("url").collect()
    assert [r["url"] for r in got] == ["https://e/1", "https://web/profile/did:1/post/abc"]
    assert got[0]["content"] == text + "\nD" and got[0]["title"] == "T" and got[0]["metadata"]["post_url"] == "https://e/1"
    assert got[1]["content"] == text and got[1]["author"] == "h"


RSS = """<?xml version="1.0"?><rss xmlns:content="http://c"><channel><title>F</title>
<item><title>One</title><link>https://f/1</link><description>desc</description><content:encoded>&lt;p&gt;full&lt;/p&gt;</content:encoded>
<pubDate>Tue, 05 Mar 2024 10:00:00 +0100</pubDate></item>
<item><title>Two</title><link>https://f/2</link><description>only desc</description><pubDate>nonsense</pubDate></item>
<item><title></title><link>https://f/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>At</title><link href="https://a/1"/><summary>sum</summary>
<updated>2024-03-05T09:00:00Z</updated><author><name>Ann</name></author></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame(
        [(RSS, "Feed", "https://feed", "GB", NOW), (ATOM, "Atom", "https://atom", None, NOW)],
        "payload string, name string, url string, region string, ingested_at timestamp",
    )
    got = {r["url"]: r for r in payloads.articles_from_feeds(df).collect()}
    assert set(got) == {"https://f/1", "https://f/2", "https://a/1"}
    assert got["https://f/1"]["content"] == "full" and got["https://f/1"]["published_at"] == dt.datetime(2024, 3, 5, 9)
    assert got["https://f/2"]["content"] == "only desc" and got["https://f/2"]["published_at"] == NOW
    assert got["https://a/1"]["published_at"] == dt.datetime(2024, 3, 5, 9) and got["https://a/1"]["author"] == "Ann"
    capped = payloads.articles_from_feeds(df, "reddit", max_entries=1, summary_first=True, title_chars=2)
    assert {r["title"] for r in capped.collect()} == {"On", "At"}


def test_pages_branches(spark):
    body = "<p>" + "text " * 40 + "</p>"
    rows = [
        (1, "https://s/1", f"<html><meta property='article:published_time' content='2024-01-02T03:04:05Z'><h1>T <b>x</b></h1><article>{body}<script>var a='<p>';</script></article>"),
        (2, "https://s/2", f"<article>{body}</article>"),
        (3, "https://s/3", "<h1>t</h1><article>too short</article>"),
        (4, "https://s/4", f"<h1>a &amp; b &#233; &lt;i&gt;</h1><div class='story body'>{body}</div>"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    clock = F.lit(NOW).cast("timestamp")
    got = {r["page_id"]: r for r in pages.articles_from_pages(df, clock).collect()}
    assert set(got) == {1} and got[1]["title"] == "Tx" and "var a" not in got[1]["content"]
    assert got[1]["published_at"] == dt.datetime(2024, 1, 2, 3, 4, 5) and got[1]["source"] == "s"
    by_class = {r["page_id"]: r for r in pages.articles_from_pages(df, clock, "div", "story").collect()}
    assert by_class[4]["title"] == "a & b é <i>" and by_class[4]["published_at"] == NOW


def test_links(spark):
    html = "".join(f"<a href='{h}'>x</a>" for h in (
        "/root/a", "b/c", "../up", "https://s/abs", "https://other/x", "//s/proto", "#frag", "?q=1", "/root/a", "mailto:x@y"))
    df = spark.createDataFrame([(1, "https://s/dir/page", html)], "page_id int, url string, html string")
    got = [r["link"] for r in pages.page_links(df, cap=None).orderBy("pos").collect()]
    assert got == ["https://s/root/a", "https://s/dir/b/c", "https://s/up", "https://s/abs", "https://s/proto", "https://s/dir/page#frag", "https://s/dir/page?q=1"]
    assert [r["link"] for r in pages.page_links(df, min_path_len=6, cap=1).collect()] == ["https://s/root/a"]


def test_registry_keeps_article_rows(spark):
    arts = spark.createDataFrame([("a",), ("a",), ("z",)], "source string")
    info = spark.createDataFrame([("a", "GB", 2), ("a", "US", 1)], "name string, region string, priority int")
    got = with_source_info(arts, info).collect()
    assert len(got) == 3 and {r["source_region"] for r in got} == {"US", None}


def test_lake_round_trip(spark, tmp_path):
    rows = [("h" * 64, "t", "a/b", dt.datetime(2024, 1, 2)), ("k" * 64, "u", None, dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "content_hash string, title string, source string, published_at timestamp")
    df = df.withColumn("crawled_at", F.col("published_at")).withColumn("embedding", F.array(F.lit(1.0)))
    lake.write_lake(df, str(tmp_path / "lake"))
    assert (tmp_path / "lake" / "dt=2024-01-02" / "source_key=a_b").is_dir()
    found = lake.read_lake(spark, str(tmp_path / "lake"), "2024-01-02", "a/b", "h" * 64)
    assert [r["title"] for r in found.collect()] == ["t"]
    assert all("dt=2024-01-02/source_key=a_b" in f for f in found.inputFiles())
    assert lake.read_lake(spark, str(tmp_path / "lake"), "2024-01-05", "a/b", "h" * 64).count() == 0
    odd = df.withColumn("source", F.lit("x: [50%]"))
    lake.write_lake(odd, str(tmp_path / "odd"))
    assert lake.read_lake(spark, str(tmp_path / "odd"), "2024-01-02", "x: [50%]", "h" * 64).count() == 1
    assert lake.read_lake(spark, str(tmp_path / "lake"), "2024-01-03", "unknown", "k" * 64).count() == 1


def test_topic_rows_and_quarantine(spark):
    df = spark.createDataFrame([("h1", "t1"), (None, "t2")], "content_hash string, title string")
    rows = lake.to_topic_rows(df).collect()
    assert [r["key"] for r in rows] == ["h1", ""] and json.loads(rows[0]["value"])["title"] == "t1"
    assert lake.to_topic_rows(df, None).first()["key"] is None
    raw = spark.createDataFrame([('{"title": "ok"}',), ("{broken",), ("[1,2",)], "value string")
    good, bad = lake.parse_topic_values(raw, RAW_ARTICLE)
    assert [r["title"] for r in good.collect()] == ["ok"] and bad.count() == 2


def test_small_functions(spark):
    df = spark.createDataFrame([("war_conflict x1y",)], "t string")
    assert df.select(python_title(F.replace("t", F.lit("_"), F.lit(" "))).alias("x")).first()["x"] == "War Conflict X1Y"
    assert df.select(strip_tags(F.lit(" <p>a</p> ")).alias("x")).first()["x"] == "a"
    clock = F.lit(NOW).cast("timestamp")
    ages = [(30, "30s ago"), (59, "59s ago"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86399, "23h ago"), (86400, "1d ago")]
    for seconds, want in ages:
        ts = F.lit(NOW - dt.timedelta(seconds=seconds)).cast("timestamp")
        assert spark.range(1).select(age_label(ts, clock, True).alias("x")).first()["x"] == want
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "Tue, 02 Jan 2024 03:04:05 +0000", "20240102T030405Z", "never", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in frame.select(parse_ts(F.col("t"), clock).alias("x")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 4 + [NOW, NOW]


def test_model_json(spark):
    texts = ['{"verdict": "weak signal"}', '```json\n{"verdict": "x"}\n```', "```\n{\"verdict\": \"y\"}```", "sorry", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["v"] for r in frame.select(parse_model_json(F.col("t"), VERDICT).alias("v")).collect()]
    assert [g and g["verdict"] for g in got] == ["weak signal", "x", "y", None, None]


def test_feeds_keep_qualified_names_apart(spark):
    rss = """<rss xmlns:media="m" xmlns:dc="d" xmlns:atom="a"><channel><atom:link href="https://feed/self" rel="self"/><item><title>Own</title><link>https://f/1</link>
    <description>own text</description><media:title>photo</media:title><media:description>caption</media:description><atom:link href="https://f/self"/>
    <dc:creator>Ann</dc:creator><dc:date>2024-03-05T09:00:00Z</dc:date></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="enclosure" href="https://a/file.mp3"/><link rel="alternate" href="https://a/page"/>
    <content>body</content><published>2024-03-05T09:00:00Z</published><author><name>Bob</name></author><author><name>Eve</name></author></entry></feed>"""
    prefixed = """<atom:feed xmlns:atom="http://www.w3.org/2005/Atom"><atom:entry><atom:title>P</atom:title><atom:link href="https://p/1"/></atom:entry></atom:feed>"""
    df = spark.createDataFrame([(x, "F", "https://feed", None, NOW) for x in (rss, atom, prefixed)], "payload string, name string, url string, region string, ingested_at timestamp")
    got = {r["url"]: r for r in payloads.articles_from_feeds(df).collect()}
    assert set(got) == {"https://f/1", "https://a/page", "https://p/1"}
    one = got["https://f/1"]
    assert (one["title"], one["content"], one["author"], one["published_at"]) == ("Own", "own text", "Ann", dt.datetime(2024, 3, 5, 9))
    assert (got["https://a/page"]["content"], got["https://a/page"]["author"]) == ("body", "Bob")


def test_nested_elements_and_class_selectors(spark):
    body = "<p>" + "text " * 40 + "</p>"
    rows = [
        (1, "https://s/1", f"<h1>t</h1><div class='x story'><div>{body}<div>in</div></div><div>tail</div></div><div>after</div>"),
        (2, "https://s/2", f"<h1>t</h1><section class='story-list'>no</section><main class='story'><div>{body}</div></main>"),
        (3, "https://s/3", f"<h1>t</h1><div class='story'><div>{body}"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    clock = F.lit(NOW).cast("timestamp")
    got = {r["page_id"]: r["content"] for r in pages.articles_from_pages(df, clock, content_tag=None, content_class="story").collect()}
    assert set(got) == {1, 2} and got[1].endswith("in tail") and "after" not in got[1] and "no" not in got[2].split()
    assert set(r["page_id"] for r in pages.articles_from_pages(df, clock, content_tag="div", content_class="story").collect()) == {1}


def test_character_references(spark):
    df = spark.createDataFrame([("&#x2019;&#8217; &#128512; &#xD83D;&#xDE00; &#55357;&#56832;&#33; &#xD83D; &#1114112; &amp;#33; &#x41;&#x41;",)], "t string")
    assert df.select(pages.unescape_entities(F.col("t"))).first()[0] == "\u2019\u2019 \U0001f600 \U0001f600 \U0001f600! \ufffd \ufffd &#33; AA"


def test_model_json_takes_one_object_only(spark):
    df = spark.createDataFrame([('{"verdict": "x"} trailing',), ('  {"verdict": "x"} ',)], "t string")
    got = [r[0] for r in df.select(parse_model_json(F.col("t"), VERDICT)).collect()]
    assert got[0] is None and got[1] is not None


def test_whole_stories_and_posts(spark):
    """Texts that differ only after the start that the analysed system keeps stay apart, and no title is cut."""
    long = "y" * 6000
    items = [({"id": i, "type": "story", "title": "Same", "text": long + end}, NOW) for i, end in enumerate("ab")]
    df = payload(spark, items, "payload string, ingested_at timestamp")
    got = payloads.articles_from_story_items(df, "https://page/", content_chars=None).collect()
    assert {r["content"] for r in got} == {long + "a", long + "b"} and len({r["content_hash"] for r in got}) == 2

    card = {"title": "t" * 400, "url": "https://u/card"}
    posts = [({"content": f"<p>{long}{end}</p>", "url": f"https://u/{end}", "card": card}, "h", "US", NOW) for end in "ab"]
    df = payload(spark, posts, "payload string, host string, region string, ingested_at timestamp")
    got = payloads.articles_from_timeline(df, title_chars=None, content_chars=None).collect()
    assert {r["content"] for r in got} == {long + "a", long + "b"} and {r["title"] for r in got} == {"t" * 400}
    assert len({r["content_hash"] for r in got}) == 2

    found = {"posts": [{"uri": f"at://did/post/{end}", "record": {"text": long + end}, "embed": {"external": {"uri": f"https://e/{end}", "title": "t" * 400}}} for end in "ab"]}
    df = payload(spark, [(found, "q", NOW)], "payload string, label string, ingested_at timestamp")
    got = payloads.articles_from_search_posts(df, "https://p/", title_chars=None, content_chars=None).collect()
    assert {r["content"] for r in got} == {long + "a", long + "b"} and {r["title"] for r in got} == {"t" * 400}
    assert len({r["content_hash"] for r in got}) == 2


def test_lake_lookup_opens_one_file(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = [(f"{i:03d}{'x' * 30}", "a", dt.datetime(2024, 1, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "content_hash string, source string, published_at timestamp").withColumn("crawled_at", F.col("published_at"))
    for part in range(3):
        lake.write_lake(df.where(F.substring("content_hash", 1, 1) == str(part)), path)
    assert spark.read.parquet(f"{path}/{lake.INDEX}").count() == len(list(tmp_path.glob("lake/dt=*/*/*.json"))) == 3
    files = lake.lake_files(spark, path, "2024-01-02", "a", rows[150][0])
    assert len(files) == 1 and lake.read_lake(spark, path, "2024-01-02", "a", rows[150][0]).count() == 1
    assert lake.lake_files(spark, path, "2024-01-02", "a", "9" * 33) == [] and lake.read_lake(spark, path, "2024-01-02", "a", "9" * 33).count() == 0
    assert lake.index_lake(spark, path) == 0


def test_a_lake_is_listed_in_one_job(spark, tmp_path):
    """The index of a lake takes as many jobs for 24 files as for 4, and the round trip infers no schema."""
    from corpuswatch.plans import source_queries as Q

    def jobs(n):
        path = str(tmp_path / f"lake{n}")
        rows = spark.range(4 * n).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("source"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("2024-01-01").cast("timestamp").alias("crawled_at"))
        rows = rows.withColumn("hash16", F.left("content_hash", F.lit(16))).withColumn("dt", F.lit("2024-01-01")).withColumn("source_key", F.col("source"))
        rows.coalesce(1).write.partitionBy("dt", "source_key").json(path)
        spark.sparkContext.setJobGroup(f"index{n}", "")
        try:
            assert lake.index_lake(spark, path) == n == lake.index_lake(spark, path) + n
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert spark.read.parquet(f"{path}/_index").agg(F.sum("rows")).first()[0] == 4 * n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"index{n}"))

    assert jobs(4) == jobs(24)
    found = Q.lake_round_trip(spark, "/root/testdata/sf0.001")
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
