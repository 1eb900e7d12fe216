import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuswatch import lexicons as L
from corpuswatch.operators import enrich as E


def docs(spark, rows):
    data = [(f"u{i}", f"h{i}", t, c, s) for i, (t, c, s) in enumerate(rows)]
    return spark.createDataFrame(data, "url string, content_hash string, title string, content string, source string").withColumn(
        "region", F.lit(None).cast("string")
    ).withColumn("published_at", F.lit("2024-01-01").cast("timestamp")).withColumn("crawled_at", F.col("published_at"))


def test_categories_ties_and_fallback(spark):
    rows = [("gdp stock bond earnings", "", "s"), ("nothing here", "", "s"), ("oil court senate merger", "", "s"), ("", "", "s")]
    got = [(r["categories"], r["category_scores"]) for r in E.keyword_categories(docs(spark, rows)).orderBy("url").collect()]
    assert got[0][0] == ["finance"] and got[0][1] == {"finance": 1.0}
    assert got[1] == (["general"], {"general": 0.5}) == got[3]
    assert got[2][0] == ["politics", "business", "crime_law"]  # four with one hit each: lexicon order


def test_word_match_is_stricter(spark):
    rows = [("said the chair", "", "s")]  # 'ai' inside other words
    assert E.keyword_categories(docs(spark, rows)).first()["categories"] == ["technology"]
    assert E.keyword_categories(docs(spark, rows), match="word").first()["categories"] == ["general"]


@pytest.mark.parametrize("text,label,score", [
    ("growth rise", "positive", 1.0), ("crash", "negative", 0.0), ("plain", "neutral", 0.5), ("growth crash", "neutral", 0.5),
    ("growth rise crash", "positive", 0.6667), ("crash drop growth", "negative", 0.3333),
])
def test_sentiment_formula(spark, text, label, score):
    s = E.keyword_sentiment(docs(spark, [(text, "", "s")])).first()["sentiment"]
    assert (s["label"], s["score"]) == (label, score)
    rest = {"positive": 0.2, "negative": 0.2, "neutral": 0.6}
    assert all(s[c] == (score if c == label else v) for c, v in rest.items())


def test_model_hooks_and_failure(spark):
    def categories(texts):
        return pd.DataFrame({"labels": [["a", "b", "c", "d"]] * len(texts), "scores": [[0.91119, 0.5, 0.2, 0.9]] * len(texts)})

    got = E.model_categories(docs(spark, [("t", "c", "s")]), categories).first()
    assert got["categories"] == ["a", "b"] and got["category_scores"]["a"] == 0.9112

    def mood(texts):
        return pd.DataFrame({"label": ["LABEL_2"] * len(texts), "score": [0.9] * len(texts)})

    s = E.model_sentiment(docs(spark, [("t", "c", "s")]), mood).first()["sentiment"]
    assert (s["label"], s["score"]) == ("positive", 0.9)
    assert s["negative"] == pytest.approx(0.03) and s["neutral"] == pytest.approx(0.04)

    def broken(texts):
        raise RuntimeError("no model")

    assert E.model_categories(docs(spark, [("oil", "", "s")]), broken).first()["categories"] == ["energy"]
    assert E.model_sentiment(docs(spark, [("growth", "", "s")]), broken).first()["sentiment"]["label"] == "positive"
    assert E.with_embedding(docs(spark, [("t", "c", "s")]), broken, dim=4).first()["embedding"] == [0.0] * 4


def test_entity_rules(spark):
    tags = spark.createDataFrame(
        [("h", 0, "Bob", "PERSON", 0, 3), ("h", 1, "X", "ORG", 4, 5), ("h", 2, "Rome", "GPE", 6, 10), ("h", 3, "Bob", "PERSON", 11, 14),
         ("h", 4, "five", "CARDINAL", 15, 19), ("h", 5, "Ann", "PERSON", 20, 23)],
        "content_hash string, pos int, name string, label string, start int, end int",
    )
    ents = E.entities_from_tags(tags).first()["entities"]
    assert [(e["type"], e["name"], e["start"]) for e in ents] == [("person", "Bob", 0), ("person", "Ann", 20), ("country_city", "Rome", 6)]


def test_tagging_places(spark):
    gaz = spark.createDataFrame([("new york", "GPE"), ("Bob", "PERSON")], "name string, label string")
    text = "Bobby met Bob in New York; 12.5% of $1,000 on 2024-01-02."
    got = {(r["name"], r["label"]): r["start"] for r in E.tag_entities(docs(spark, [("Hi", text, "s")]), gaz).collect()}
    whole = "Hi. " + text
    assert got == {
        ("Bob", "PERSON"): whole.index("Bob in"), ("New York", "GPE"): whole.index("New York"), ("12.5%", "PERCENT"): whole.index("12.5%"),
        ("$1,000", "MONEY"): whole.index("$1,000"), ("2024-01-02", "DATE"): whole.index("2024-01-02"),
    }


def test_keywords_and_counts(spark):
    df = docs(spark, [("About  the GREAT (big) Things of Words today again", "a b\n c ", "s"), ("", "", "s")])
    got = df.orderBy("url").select(E.title_keywords(F.col("title")).alias("k"), E.word_count(F.col("content")).alias("n")).collect()
    assert got[0]["k"] == ["about", "great", "(big)", "things", "words"] and got[0]["n"] == 3
    assert got[1]["k"] == [] and got[1]["n"] == 0


def test_reliability_and_events(spark):
    rows = [
        ("UFO and orb sighting", "confirmed by radar confirmed", "Reuters World"), ("UFO", "", "The Sun"), ("calm", "day", "x"),
        ("coordinated attack", "", "x"), ("coordinated attack", "cluster of cases", "x"), ("ghost ufo", "", "x"),
    ]
    df = docs(spark, rows)
    rel = [r[0] for r in df.orderBy("url").select(E.source_reliability(F.col("source"))).collect()]
    assert rel == [0.9, 0.1, 0.5, 0.5, 0.5, 0.5]
    got = {r["url"]: r for r in E.classify_events(df).collect()}
    assert set(got) == {"u0", "u4", "u5"}
    assert got["u0"]["subcategory"] == "ufo_alien" and got["u0"]["matched_signals"] == ["ufo", "orb sighting"]
    assert got["u0"]["credibility_score"] == round(0.9 * 0.6 + (0.5 + 2 * 0.08) * 0.4, 3)
    assert got["u0"]["anomaly_score"] == round(0.55 + 0.1 + 0.09, 3)
    assert got["u4"]["subcategory"] == "emerging_pattern_signal" and got["u5"]["subcategory"] == "ufo_alien"


def test_lexicon_order():
    assert list(L.CATEGORY_KEYWORDS)[:2] == ["finance", "technology"] and len(L.CATEGORY_KEYWORDS) == 11


def test_plans_stay_in_the_jvm(spark):
    plan = E.keyword_sentiment(E.keyword_categories(docs(spark, [("a", "b", "s")])))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "Exchange" not in plan.split("Physical Plan")[1]


def test_names_of_any_length_are_found_in_the_row_and_by_join(spark, monkeypatch):
    """A four-word name, a nested shorter one and another case; both ways give the same tags."""
    gaz = spark.createDataFrame([("Bank of New Lisbon", "ORG"), ("new lisbon", "GPE"), ("Lisbon", "GPE"), (None, "ORG")], "name string, label string")
    text = "The Bank-of  new LISBON paid 5%. Bank of New Lisbon, again Lisbon."
    df = spark.createDataFrame([("h1", "t", text), ("h2", None, None), ("h3", "Lisbon", "")], "content_hash string, title string, content string")
    in_row = sorted(map(tuple, E.tag_entities(df, gaz).collect()))
    assert ("h1", "Bank of New Lisbon") in {(r[0], r[2]) for r in in_row}
    assert {r[2] for r in in_row if r[0] == "h1"} == {"Bank of new LISBON", "Bank of New Lisbon", "new LISBON", "New Lisbon", "LISBON", "Lisbon", "5%"}
    entities = {r["content_hash"]: r["entities"] for r in E.with_entities(df, gaz, "content_hash").collect()}
    monkeypatch.setattr(E, "GAZETTEER_ROWS", 0)
    assert sorted(map(tuple, E.tag_entities(df, gaz).collect())) == in_row
    assert {r["content_hash"]: r["entities"] for r in E.with_entities(df, gaz, "content_hash").collect()} == entities


def test_one_bad_text_spoils_no_other(spark):
    def rate(texts):
        if texts.str.contains("bad").any():
            raise ValueError("bad text")
        return pd.DataFrame({"label": ["POSITIVE"] * len(texts), "score": [0.9] * len(texts)})

    rows = [(i, "bad" if i % 7 == 3 else f"plain {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = E.score_texts(df, F.col("text"), rate, "label string, score double").select("id", "model.label").collect()
    assert {r["id"] for r in got if r["label"] is None} == {i for i, t in rows if t == "bad"}


def test_model_queries_show_the_fallback(spark):
    """Every document is in the result, and those the stand-in model fails on carry the labels of the keyword rules."""
    from corpuswatch.plans import source_queries as S

    sf = "/root/testdata/sf0.001"
    articles = S.A.articles_from_documents(spark, sf)
    failing = {r["doc_id"] for r in articles.where("contains(content, '|')").select("doc_id").collect()}
    rules = {r["doc_id"]: ",".join(r["categories"]) for r in E.keyword_categories(articles).collect()}
    moods = {r["doc_id"]: r["sentiment"]["label"] for r in E.keyword_sentiment(articles).collect()}
    categories = {r["doc_id"]: r["categories"] for r in S.model_categories(spark, sf).collect()}
    labels = {r["doc_id"]: r["label"] for r in S.model_sentiment(spark, sf).collect()}
    assert failing and set(categories) == set(labels) == set(rules)
    assert {d: categories[d] for d in failing} == {d: rules[d] for d in failing}
    assert {d: labels[d] for d in failing} == {d: moods[d] for d in failing}
    assert all(set(categories[d].split(",")) <= {"long", "short"} for d in set(rules) - failing)


def test_names_of_texts_are_found_in_arrow_buffers(spark, monkeypatch):
    """No word list becomes a pandas column of Python strings; empty texts, names over the edge of a text and labels of one name included."""
    def refuse(*args, **kwargs):
        raise AssertionError("words as Python strings")

    monkeypatch.setattr(E.F, "pandas_udf", refuse)
    texts = ["New York and new york", "", None, "ends with New", "York starts", "York NEW YORK City, York", "nothing"]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "content_hash int, title string, content string").coalesce(1)
    names = spark.createDataFrame([("new york", "GPE"), ("York", "GPE"), ("york", "ORG"), ("New York City", "LOC")], "name string, label string")
    got = sorted((r.content_hash, r.name, r.label) for r in E.tag_entities(df, names).collect())
    york = [("York", "GPE"), ("York", "ORG")]
    want = {
        0: [("New York", "GPE"), ("new york", "GPE"), ("york", "GPE"), ("york", "ORG"), *york], 4: york,
        5: [("NEW YORK", "GPE"), ("NEW YORK City", "LOC"), ("YORK", "GPE"), ("YORK", "ORG"), *york],
    }
    assert got == sorted((i, n, label) for i, tags in want.items() for n, label in tags)


def test_models_get_bounded_slices_of_a_batch(spark):
    def rate(texts):
        return pd.DataFrame({"label": [str(n) for n in texts.str.len()], "score": float(texts.str.len().sum())})

    df = spark.range(0, 45, 1, 1).select("id", F.when(F.col("id") % 9 == 4, None).otherwise(F.repeat(F.lit("ä"), F.lit(50_000) + F.col("id").cast("int"))).alias("text"))
    df = df.unionByName(spark.range(45, 46).select("id", F.repeat(F.lit("b"), F.lit(3_000_000)).alias("text"))).coalesce(1)
    got = E.score_texts(df.where("text is not null"), F.col("text"), rate, "label string, score double").select("id", "model.*").collect()
    assert {r.id: r.label for r in got} == {i: str(50_000 + i) for i in range(45) if i % 9 != 4} | {45: "3000000"}
    assert all(r.score <= E.MODEL_BYTES / 2 for r in got if r.id < 45)
    odd = E.score_texts(spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "id long, text string").coalesce(1), F.col("text"), lambda t: pd.DataFrame({"n": t.fillna("none").str.len()}), "n long")
    assert {r.id: r.model.n for r in odd.collect()} == {1: 4, 2: 0, 3: 3}
