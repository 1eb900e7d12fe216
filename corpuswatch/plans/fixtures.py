"""Word lists that occur in the driver's invented prose, and the inputs built with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswatch.operators.enrich import keyword_categories, keyword_sentiment, with_entities
from corpuswatch.session import cut_lineage
from corpuswatch.sources import adapters as A

# Fixture lexicon.
LEXICON = {
    "alpha": ["thble", "thtion"],
    "beta": ["attion", "eriner", "erble"],
    "gamma": ["ertion", "thanedble", "oning"],
    "delta": ["ering", "ontion"],
}
POSITIVE, NEGATIVE = ["thing", "erble"], ["oning", "ontion"]
BOOSTS, PENALTIES = ["ation", "enter", "thing"], ["oning", "erble"]
GAZETTEER = [
    ("thble", "PERSON"), ("attion", "ORG"), ("ertion", "GPE"), ("ering", "LOC"), ("oning", "PRODUCT"), ("ontion", "EVENT"),
    ("thing", "NORP"),
]
EVENT_SIGNALS = [
    ("odd_lights", "Odd lights", 0.55, 1, ["thble", "thtion", "eriner"]),
    ("odd_sounds", "Odd sounds", 0.40, 1, ["attion", "erble", "oning"]),
    ("odd_pattern", "Odd pattern", 0.45, 2, ["ertion", "thanedble", "ontion", "ering"]),
]


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "name string, label string")


def label(articles: DataFrame) -> DataFrame:
    labelled = keyword_sentiment(keyword_categories(articles, LEXICON), POSITIVE, NEGATIVE)
    return labelled.withColumn("sentiment_label", F.col("sentiment.label")).withColumn("sentiment_score", F.col("sentiment.score"))


def newest_crawl(spark: SparkSession, sf_dir: str):
    """The clock of the labelled documents, read from the narrow articles: labels are not computed for it."""
    return A.articles_from_documents(spark, sf_dir).select(F.max("crawled_at")).scalar()


def categorised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with categories only: an unused sentiment would be computed all the same."""
    return keyword_categories(A.articles_from_documents(spark, sf_dir), LEXICON)


def rated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with sentiment only."""
    rated = keyword_sentiment(A.articles_from_documents(spark, sf_dir), POSITIVE, NEGATIVE)
    return rated.withColumn("sentiment_label", F.col("sentiment.label")).withColumn("sentiment_score", F.col("sentiment.score"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(A.articles_from_documents(spark, sf_dir))


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_entities(labelled_documents(spark, sf_dir), gazetteer(spark))


def stored_tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged documents without their text, written once: graph building reads them several times."""
    return cut_lineage(tagged_documents(spark, sf_dir).drop("content", "sentiment", "category_scores"))
