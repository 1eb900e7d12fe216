"""Rule insights from trends and the context text for a chat model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch import lexicons as L
from corpuswatch.functions.text import fixed_point, python_title


def _one(c: Column) -> Column:
    return fixed_point(F.round(c, 1), 1)


def ranked_spikes(trends: DataFrame, k: int = 20) -> DataFrame:
    """Spikes among the top ``k`` trends, numbered in list order. The window sees at most ``k`` rows."""
    top = trends.orderBy(F.col("velocity").desc(), "kind", "name").limit(k)
    w = Window.orderBy(F.col("velocity").desc(), "kind", "name")
    return top.where("is_spike").withColumn("place", F.row_number().over(w))


def rule_insights(trends: DataFrame) -> DataFrame:
    """Rows (section, place, title, description, confidence, category)."""
    spikes = ranked_spikes(trends)
    name, velocity = F.col("name"), F.col("velocity")
    cat = (F.col("kind") == "cat") & (F.col("place") <= 3)

    def rows(section: str, keep: Column, title: Column, description: Column, confidence: Column, category: Column) -> DataFrame:
        return spikes.where(keep).select(
            F.lit(section).alias("section"), "place", title.alias("title"), description.alias("description"),
            confidence.alias("confidence"), category.alias("category"),
        )

    chance = rows(
        "market_opportunities", cat & name.isin(L.OPPORTUNITY_CATEGORIES),
        F.concat(F.lit("Surge in "), python_title(name), F.lit(" News Coverage")),
        F.concat(python_title(name), F.lit(" sector showing "), _one(velocity), F.lit("x velocity spike")),
        F.when(velocity > 3, "high").otherwise("medium"), name,
    )
    risk = rows(
        "emerging_risks", cat & name.isin(L.RISK_CATEGORIES),
        F.concat(F.lit("Elevated "), python_title(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" Activity")),
        F.concat(F.lit("News volume "), _one(velocity), F.lit("x above baseline")),
        F.lit("high"), name,
    )
    viral = rows(
        "viral_topics", F.col("place") <= 5,
        F.replace(name, F.lit(":"), F.lit(" → ")),
        F.concat(F.lit("Velocity: "), _one(velocity), F.lit("x | Count: "), F.col("current_count").cast("string")),
        F.lit("high"), F.col("kind"),
    )
    return chance.unionByName(risk).unionByName(viral)


def _lines(df: DataFrame, line: Column, *order: Column, k: int | None = None) -> Column:
    """Text block of a small ordered report as one value; the report is cut to ``k`` rows before it is joined."""
    rows = df if k is None else df.orderBy(*order).limit(k)
    placed = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).select("_n", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n")
    return placed.agg(text.alias("text")).scalar()


def insight_context(trends: DataFrame, sentiments: DataFrame, entities: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with the four text blocks: top 10 trends, sentiments, top 10 entities, top 10 categories."""
    spark = trends.sparkSession
    flag = F.when(F.col("is_spike"), "True").otherwise("False")
    trend = F.concat(F.lit("- "), "name", F.lit(" (velocity: "), _one(F.col("velocity")), F.lit("x, spike: "), flag, F.lit(")"))
    mood = F.concat(
        F.lit("- "), "label", F.lit(": "), F.col("count").cast("string"), F.lit(" articles ("),
        fixed_point(F.round("avg_score", 2), 2), F.lit(" avg score)"),
    )
    entity = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")"))
    cat = F.concat(F.lit("- "), "category", F.lit(": "), F.col("count").cast("string"), F.lit(" articles"))
    by_count = F.col("count").desc()
    return spark.range(1).select(
        _lines(trends, trend, F.col("velocity").desc(), F.col("kind"), F.col("name"), k=10).alias("trend_block"),
        _lines(sentiments, mood, by_count, F.col("label")).alias("sentiment_block"),
        _lines(entities, entity, by_count, F.col("name"), k=10).alias("entity_block"),
        _lines(categories, cat, by_count, F.col("category"), k=10).alias("category_block"),
    )
