"""Labels, sentiment, entities, embeddings and credibility of articles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuswatch import lexicons as L
from corpuswatch.functions.text import (
    computed_once, contains_term, head, matched_terms, or_empty, strip, term_hits, tokens, word_count, words,
)

ScoringFn = Callable[[pd.Series], pd.DataFrame]


# Characters of the content that the analysed system labels and tags; here whole texts are the default.
REFERENCE_LABEL_CHARS, REFERENCE_TAG_CHARS = 512, 2000


def label_text(chars: int | None = None) -> Column:
    """The text that labels are read from: title, full stop, content (``chars``: only its start)."""
    return F.concat(or_empty(F.col("title")), F.lit(". "), head(or_empty(F.col("content")), chars))


# -- categories -------------------------------------------------------------------------------------------


def category_hits(lowered: Column, lexicon: dict[str, list[str]], match: str = "substring") -> Column:
    """Array of (score, rank, label) per category, null without a hit; rank is minus the lexicon position.

    Only plain expressions, so that the substring tests run as generated code.
    """
    entries = []
    for i, (label, terms) in enumerate(lexicon.items()):
        n = term_hits(lowered, terms, match)
        score = F.least(n / F.lit(3.0), F.lit(1.0))
        entries.append(F.when(n > 0, F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(label).alias("label"))))
    return F.array(*entries)


def with_category_hits(df: DataFrame, lexicon: dict[str, list[str]], chars: int | None = None, match: str = "substring"):
    """Add ``category_hits``: the categories of an article that have a hit."""
    lowered = computed_once(df, _low=F.lower(label_text(chars)))
    hits = computed_once(lowered, _all=category_hits(F.col("_low"), lexicon, match))
    return hits.withColumn("category_hits", F.filter("_all", lambda e: e.isNotNull())).drop("_low", "_all")


def top_categories(hits: Column, k: int = 3) -> Column:
    """Best ``k`` hits, ties in lexicon order; without any hit the fallback category."""
    label, score = L.FALLBACK_CATEGORY
    fallback = F.array(F.struct(F.lit(score).alias("score"), F.lit(0).alias("rank"), F.lit(label).alias("label")))
    best = F.slice(F.sort_array(hits, asc=False), 1, k)
    return F.when(F.size(hits) == 0, fallback).otherwise(best)


def keyword_categories(
    df: DataFrame, lexicon: dict[str, list[str]] | None = None, k: int = 3, chars: int | None = None,
    match: str = "substring",
) -> DataFrame:
    """Add ``categories`` and ``category_scores`` from keyword hits."""
    hits = with_category_hits(df, lexicon or L.CATEGORY_KEYWORDS, chars, match)
    return (
        hits.withColumn("_top", top_categories(F.col("category_hits"), k))
        .withColumn("categories", F.col("_top.label"))
        .withColumn("category_scores", F.map_from_arrays("_top.label", "_top.score"))
        .drop("_top", "category_hits")
    )


#: Bytes of text that a model is given at a time.
MODEL_BYTES = 2_000_000


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of texts up to ``MODEL_BYTES`` (a longer text stands alone): only one of them is ever copied into Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MODEL_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def score_texts(df: DataFrame, text: Column, score_fn: ScoringFn, schema: str) -> DataFrame:
    """Run a user model over a text column in Arrow batches; its frame becomes the struct column ``model``.

    ``score_fn`` is called with slices of a batch of texts (``text_slices``). Where it fails the slice is halved until the texts it fails on stand
    alone; those yield null rows, so that the keyword rules can take over.
    """
    struct = T.StructType.fromDDL(schema)

    def rated(texts: pd.Series) -> pd.DataFrame:
        try:
            return score_fn(texts.reset_index(drop=True)).reset_index(drop=True)
        except Exception:
            if len(texts) <= 1:
                return pd.DataFrame({n: [None] * len(texts) for n in struct.names})
            half = len(texts) // 2
            return pd.concat([rated(texts[:half]), rated(texts[half:])], ignore_index=True)

    kinds = [to_arrow_type(f.dataType) for f in struct.fields]

    @F.arrow_udf(struct)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for part in text_slices(texts):
            frame = rated(part.to_pandas())
            parts.append(pa.StructArray.from_arrays([pa.array(frame[n], type=t, from_pandas=True) for n, t in zip(struct.names, kinds)], struct.names))
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct(list(zip(struct.names, kinds))))

    return df.withColumn("model", run(text))


def model_categories(df: DataFrame, score_fn: ScoringFn, k: int = 3, floor: float = 0.3, chars: int | None = None):
    """Categories from a model that returns ``labels`` and ``scores`` arrays, best first; keyword rules on failure."""
    hits = with_category_hits(df, L.CATEGORY_KEYWORDS, chars)
    scored = score_texts(hits, label_text(chars), score_fn, "labels array<string>, scores array<double>")
    pairs = F.slice(F.arrays_zip("model.labels", "model.scores"), 1, k)
    kept = F.transform(
        F.filter(pairs, lambda p: p["scores"] > floor),
        lambda p: F.struct(F.round(p["scores"], 4).alias("score"), F.lit(0).alias("rank"), p["labels"].alias("label")),
    )
    fallback = top_categories(F.col("category_hits"), k)
    return (
        scored.withColumn("_top", F.when(F.col("model.labels").isNull(), fallback).otherwise(kept))
        .withColumn("categories", F.col("_top.label"))
        .withColumn("category_scores", F.map_from_arrays("_top.label", "_top.score"))
        .drop("_top", "model", "category_hits")
    )


# -- sentiment --------------------------------------------------------------------------------------------


def sentiment_label_score(lowered: Column, positive=None, negative=None, match: str = "substring") -> Column:
    """Struct (label, score) from positive and negative word hits in lower-cased text."""
    p = term_hits(lowered, positive or L.POSITIVE_WORDS, match)
    n = term_hits(lowered, negative or L.NEGATIVE_WORDS, match)
    balance = (p - n) / F.greatest(p + n, F.lit(1))
    label = F.when(balance > 0.1, "positive").when(balance < -0.1, "negative").otherwise("neutral")
    score = (
        F.when(balance > 0.1, F.round(0.5 + balance * 0.5, 4))
        .when(balance < -0.1, F.round(0.5 - F.abs(balance) * 0.5, 4))
        .otherwise(F.lit(0.5))
    )
    return F.struct(label.alias("label"), score.alias("score"))


def sentiment_struct(label: Column, score: Column, rest: dict[str, Column | float]) -> Column:
    """Full sentiment record: the winning class carries the score, the others their ``rest`` value."""
    shares = [
        F.when(label == c, score).otherwise(rest[c] if isinstance(rest[c], Column) else F.lit(rest[c])).alias(c)
        for c in ("positive", "negative", "neutral")
    ]
    return F.struct(label.alias("label"), score.alias("score"), *shares)


KEYWORD_REST = {"positive": 0.2, "negative": 0.2, "neutral": 0.6}


def keyword_sentiment(df: DataFrame, positive=None, negative=None, chars: int | None = None, match: str = "substring"):
    """Add the ``sentiment`` struct from keyword hits."""
    lowered = computed_once(df, _low=F.lower(label_text(chars)))
    rated = computed_once(lowered, _s=sentiment_label_score(F.col("_low"), positive, negative, match))
    sentiment = sentiment_struct(F.col("_s.label"), F.col("_s.score"), KEYWORD_REST)
    return rated.withColumn("sentiment", sentiment).drop("_s", "_low")


def model_sentiment(df: DataFrame, score_fn: ScoringFn, chars: int | None = None) -> DataFrame:
    """Sentiment from a model that returns ``label`` and ``score``; keyword rules on failure."""
    scored = score_texts(df, head(label_text(chars), chars), score_fn, "label string, score double")
    names = F.create_map(*[F.lit(x) for pair in L.SENTIMENT_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(names, F.col("model.label")), F.lit("neutral"))
    score = F.round("model.score", 4)
    left = F.round(1 - score, 4)
    from_model = sentiment_struct(label, score, {"positive": left * 0.3, "negative": left * 0.3, "neutral": left * 0.4})
    rule = sentiment_label_score(F.lower(label_text(chars)))
    from_rule = sentiment_struct(rule["label"], rule["score"], KEYWORD_REST)
    chosen = F.when(F.col("model.label").isNull(), from_rule).otherwise(from_model)
    return scored.withColumn("sentiment", chosen).drop("model")


# -- entities ---------------------------------------------------------------------------------------------


def entities_from_tags(tags: DataFrame, key: str = "content_hash") -> DataFrame:
    """Tagger rows (key, pos, name, label, start, end) to one ``entities`` array per article.

    Labels map to types, unmapped labels and one-letter names go, a name counts once per type, and types
    follow their first sighting in the article. Every step is partitioned by the article key.
    """
    types = F.create_map(*[F.lit(x) for pair in L.ENTITY_TYPES.items() for x in pair])
    typed = (
        tags.withColumn("type", F.try_element_at(types, F.col("label")))
        .withColumn("name", strip(F.col("name")))
        .where(F.col("type").isNotNull() & (F.length("name") >= 2))
    )
    once = Window.partitionBy(key, "type", "name").orderBy("pos", "label")
    by_type = Window.partitionBy(key, "type")
    first = (
        typed.withColumn("_n", F.row_number().over(once))
        .where("_n = 1")
        .withColumn("_type_at", F.min("pos").over(by_type))
    )
    item = F.struct("_type_at", "pos", F.struct("name", "label", "start", "end", "type").alias("e"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("entities"))


# Patterns for values that need no name list.
VALUE_PATTERNS = {
    "PERCENT": r"\d+(?:\.\d+)?\s?%",
    "MONEY": r"[$€£]\s?\d[\d,]*(?:\.\d+)?",
    "DATE": r"\d{4}-\d{2}-\d{2}",
}


#: Names (and their characters in all) up to which a gazetteer is sent to every task; a larger one is joined by shuffle.
GAZETTEER_ROWS, GAZETTEER_CHARS = 100_000, 8_000_000
TAGS = "array<struct<name:string,label:string>>"


def _spelled_words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")


def _names(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.select(F.lower("name").alias("_name"), "label").distinct()


def _small(gazetteer: DataFrame) -> bool:
    seen = gazetteer.limit(GAZETTEER_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    return seen[0] <= GAZETTEER_ROWS and seen[1] <= GAZETTEER_CHARS


def _found_in_row(names: DataFrame) -> Callable[[Column, Column], Column]:
    """A function of the words of a text, as spelled and lower-cased, that gives the distinct names in it, of any length."""
    starts: dict[str, list[tuple[list[str], str]]] = {}
    for name, label in names.where("_name is not null").collect():
        parts = name.split(" ")
        starts.setdefault(parts[0], []).append((parts, label))
    shared = names.sparkSession.sparkContext.broadcast(starts)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("label", T.StringType())])))
    def found(spelled: pa.Array, lowered: pa.Array) -> pa.Array:
        # Words stay in their Arrow buffers; only those that start a name become Python strings.
        index, offsets, words_ = shared.value, lowered.offsets.to_numpy(), lowered.values
        starting = pc.index_in(words_, value_set=pa.array(list(index), type=words_.type)).is_valid().to_numpy(zero_copy_only=False)
        places = np.flatnonzero(starting)
        places = places[(places >= offsets[0]) & (places < offsets[-1])]
        rows = np.searchsorted(offsets, places, side="right") - 1
        shift = spelled.offsets.to_numpy()[rows] - offsets[rows]
        firsts, as_is = words_.take(pa.array(places)).to_pylist(), spelled.values.take(pa.array(places + shift)).to_pylist()
        tags = [{} for _ in range(len(lowered))]
        for place, row, move, word, name in zip(places.tolist(), rows.tolist(), shift.tolist(), firsts, as_is):
            for parts, label in index[word]:
                n = len(parts)
                if n == 1:
                    tags[row][name, label] = None
                elif place + n <= offsets[row + 1] and words_.slice(place, n).to_pylist() == parts:
                    tags[row][" ".join(spelled.values.slice(place + move, n).to_pylist()), label] = None
        out = [[{"name": n, "label": lab} for n, lab in row] for row in tags]
        return pa.array(out, type=pa.list_(pa.struct([("name", pa.string()), ("label", pa.string())])))

    return found


def _tags(text: Column, names: Column) -> tuple[Column, Column]:
    """The padded text (to be column ``_pad``), and tags (pos, name, label, start, end) of a text: the names found, and money, percent and date values, each at its first place."""
    # Every other character becomes one blank, so places in the padded text are places in the text plus one.
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]", " "), F.lit(" "))

    def values(label: str, pattern: str) -> Column:
        distinct = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.transform(distinct, lambda v: F.struct(v.alias("name"), F.lit(label).alias("label")))

    def placed(tag: Column) -> Column:
        plain = F.regexp_replace(tag["name"], r"[^\p{L}\p{N}]", " ")
        lead = F.length(plain) - F.length(F.ltrim(plain))
        alone = F.instr(F.col("_pad"), F.concat(F.lit(" "), F.trim(plain), F.lit(" ")))
        at = F.when(alone > 0, alone - 1 - lead).otherwise(F.instr(text, tag["name"]) - 1)
        return F.struct(at.alias("pos"), tag["name"].alias("name"), tag["label"].alias("label"), at.alias("start"), (at + F.length(tag["name"])).alias("end"))

    everything = F.concat(F.coalesce(names, F.expr(f"cast(array() as {TAGS})")), *[values(label, p) for label, p in VALUE_PATTERNS.items()])
    return padded, F.transform(everything, placed)


def _tagged_rows(df: DataFrame, gazetteer: DataFrame, chars: int | None) -> DataFrame:
    """``df`` with ``_tags``, without a shuffle; for a gazetteer that fits its bounds."""
    found = _found_in_row(_names(gazetteer))
    split = df.withColumn("_text", label_text(chars)).withColumn("_w", _spelled_words(F.col("_text")))
    named = split.withColumn("_names", found(F.col("_w"), F.transform("_w", F.lower)))
    padded, tags = _tags(F.col("_text"), F.col("_names"))
    return named.withColumn("_pad", padded).withColumn("_tags", tags).drop("_text", "_w", "_names", "_pad")


def _one_row_per_tag(tagged: DataFrame, key: str) -> DataFrame:
    """``_tags`` unfolded. A plain ``inline`` lets the optimizer ask for the size of the array below it, which computes it twice."""
    return tagged.select(key, F.inline_outer("_tags")).where(F.col("name").isNotNull())


def tag_entities(df: DataFrame, gazetteer: DataFrame, key: str = "content_hash", chars: int | None = None):
    """Dictionary and pattern tagging: rows (key, pos, name, label, start, end), ``pos`` orders the tags.

    Names of any number of words are found by lower-cased words of title and content. A gazetteer within its bounds is
    looked up in the row, without a shuffle. For a larger one the distinct word n-grams, as long as its longest name, meet it in
    an equi-join; only n-grams leave the row, and the few names found go back to their text.
    """
    if _small(gazetteer):
        return _one_row_per_tag(_tagged_rows(df, gazetteer, chars), key)
    base = df.select(key, label_text(chars).alias("_text"))
    names = _names(gazetteer)
    longest = names.agg(F.max(F.size(F.split("_name", " ")))).first()[0] or 1
    split = computed_once(base.select(key, "_text"), _w=_spelled_words(F.col("_text"))).drop("_text")

    def grams(n: int) -> Column:
        if n == 1:
            return F.col("_w")
        starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))

    found = F.array_distinct(F.concat(*[grams(n) for n in range(1, longest + 1)]))
    named = (
        split.select(key, F.explode(found).alias("name"))
        .join(names.hint("merge"), F.lower("name") == F.col("_name"))
        .groupBy(key)
        .agg(F.collect_list(F.struct("name", "label")).alias("_names"))
    )
    padded, tags = _tags(F.col("_text"), F.col("_names"))
    return _one_row_per_tag(computed_once(base.join(named, key, "left"), _pad=padded).select(key, tags.alias("_tags")), key)


def entities_in_row(tags: Column) -> Column:
    """The ``entities`` array of a row's tags, by the rules of ``entities_from_tags``, without a shuffle."""
    types = F.create_map(*[F.lit(x) for pair in L.ENTITY_TYPES.items() for x in pair])
    typed = F.transform(tags, lambda t: F.struct(
        t["pos"].alias("pos"), t["label"].alias("label"), strip(t["name"]).alias("name"), t["start"].alias("start"), t["end"].alias("end"),
        F.try_element_at(types, t["label"]).alias("type"),
    ))
    return F.filter(typed, lambda t: t["type"].isNotNull() & (F.length(t["name"]) >= 2))


def _with_entities_in_row(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    staged = _tagged_rows(df, gazetteer, None).withColumn("_typed", F.array_sort(entities_in_row(F.col("_tags"))))
    # A name counts once per type, at its first place; types follow their first place.
    key = lambda t: F.concat_ws("\x00", t["type"], t["name"])
    staged = staged.withColumns({"_keys": F.transform("_typed", key), "_types": F.transform("_typed", lambda t: t["type"])})
    once = F.filter("_typed", lambda t, i: F.array_position("_keys", key(t)) == i + 1)
    ranked = F.transform(once, lambda t: F.struct(
        F.get("_typed", (F.array_position("_types", t["type"]) - 1).cast("int"))["pos"].alias("_type_at"), t["pos"].alias("pos"),
        F.struct(t["name"].alias("name"), t["label"].alias("label"), t["start"].alias("start"), t["end"].alias("end"), t["type"].alias("type")).alias("e"),
    ))
    return staged.withColumn("entities", F.transform(F.array_sort(ranked), lambda x: x["e"])).drop("_tags", "_typed", "_keys", "_types")


# -- embeddings, counts, keywords -------------------------------------------------------------------------


def with_embedding(df: DataFrame, encode_fn: ScoringFn | None = None, dim: int = 384, chars: int | None = None):
    """Add ``embedding``: a user encoder in Arrow batches (zero vector on failure), or a hashed bag of words."""
    if encode_fn is None:
        tokened = df.withColumn("_words", words(label_text(chars)))
        hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(tokened)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(hashed)
        return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")
    scored = score_texts(df, label_text(chars), encode_fn, "embedding array<float>")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return scored.withColumn("embedding", F.coalesce("model.embedding", zero)).drop("model")


def title_keywords(title: Column, k: int = 5, min_len: int = 4) -> Column:
    """First ``k`` title words longer than ``min_len`` that are no stop words, lower-cased."""
    kept = F.filter(tokens(title), lambda w: (F.length(w) > min_len) & ~F.lower(w).isin(L.TITLE_STOPWORDS))
    return F.slice(F.transform(kept, F.lower), 1, k)


def with_counts(df: DataFrame) -> DataFrame:
    return df.withColumn("word_count", word_count(F.col("content"))).withColumn(
        "entity_count", F.coalesce(F.size("entities"), F.lit(0))
    )


# -- credibility and unusual events -----------------------------------------------------------------------


def source_reliability(source: Column, match: str = "substring") -> Column:
    name = F.lower(or_empty(source))
    distrusted = name.rlike("|".join(re.escape(s) for s in L.DISTRUSTED_SOURCES))
    trusted = reduce(lambda x, y: x | y, [contains_term(name, s, match) for s in L.TRUSTED_SOURCES])
    return F.when(distrusted, F.lit(0.1)).when(trusted, F.lit(0.9)).otherwise(F.lit(0.5))


def content_credibility(lowered: Column, boosts=None, penalties=None) -> Column:
    """Credibility of lower-cased text."""
    raw = (
        F.lit(0.5)
        + term_hits(lowered, boosts or L.CREDIBILITY_BOOSTS) * 0.08
        - term_hits(lowered, penalties or L.CREDIBILITY_PENALTIES) * 0.1
    )
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw))


def classify_events(df: DataFrame, lexicon=None, min_reliability: float = 0.3, boosts=None, penalties=None) -> DataFrame:
    """Unusual events: articles of acceptable sources with enough hits in one subcategory.

    Whole title and content are searched. The subcategory with most hits wins, the earlier one on ties.
    """
    lexicon = lexicon or L.UNUSUAL_EVENT_SIGNALS
    text = F.lower(F.concat_ws(" ", or_empty(F.col("title")), or_empty(F.col("content"))))
    staged = df.withColumn("_rel", source_reliability(F.col("source"))).where(F.col("_rel") >= min_reliability)
    candidates = []
    for i, (name, label, base, need, terms) in enumerate(lexicon):
        n = term_hits(F.col("_text"), terms)
        match = F.struct(n.alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(base).alias("base"))
        candidates.append(F.when(n >= need, match))
    best = candidates[0] if len(candidates) == 1 else F.greatest(*candidates)
    matched = F.coalesce(
        *[F.when(F.col("_best.name") == name, matched_terms(F.col("_text"), terms)) for name, _, _, _, terms in lexicon]
    )
    credibility = F.col("_rel") * 0.6 + content_credibility(F.col("_text"), boosts, penalties) * 0.4
    boost = F.least(F.col("_best.hits") * 0.05, F.lit(0.3))
    anomaly = F.least(F.col("_best.base") + boost + F.col("_rel") * 0.1, F.lit(1.0))
    scored = computed_once(computed_once(staged, _text=text), _best=best).where(F.col("_best").isNotNull())
    entities = F.col("entities") if "entities" in df.columns else F.lit(None).cast(T.ArrayType(T.StringType()))
    return scored.select(
        F.col("content_hash").alias("article_hash"),
        "url",
        "title",
        "source",
        "published_at",
        F.col("_best.name").alias("subcategory"),
        F.col("_best.label").alias("subcategory_label"),
        F.round(credibility, 3).alias("credibility_score"),
        F.round(anomaly, 3).alias("anomaly_score"),
        F.col("_rel").alias("source_reliability"),
        matched.alias("matched_signals"),
        "region",
        entities.alias("entities"),
        F.left("content", F.lit(600)).alias("content_snippet"),
    )


def with_entities(df: DataFrame, gazetteer: DataFrame | None, key: str = "url") -> DataFrame:
    """Add ``entities`` from the gazetteer and the value patterns; an empty array where nothing is found."""
    empty = F.expr("cast(array() as array<struct<name:string,label:string,start:int,`end`:int,type:string>>)")
    if gazetteer is None:
        return df.withColumn("entities", empty)
    if _small(gazetteer):
        return _with_entities_in_row(df, gazetteer)
    found = entities_from_tags(tag_entities(df, gazetteer, key), key)
    return df.join(found, key, "left").withColumn("entities", F.coalesce("entities", empty))


def enrich(
    df: DataFrame, gazetteer: DataFrame | None = None, lexicon=None, positive=None, negative=None, as_of: Column | None = None,
    encode_fn: ScoringFn | None = None, dim: int = 384, key: str = "url",
) -> DataFrame:
    """Categories, sentiment, entities, embedding and counts in one pass; only a large gazetteer needs a shuffle.

    ``key`` names the rows uniquely: two articles with one content hash may still differ further down.
    """
    labelled = keyword_sentiment(keyword_categories(df, lexicon), positive, negative)
    labelled = with_entities(labelled, gazetteer, key)
    embedded = with_counts(with_embedding(labelled, encode_fn, dim))
    return embedded.withColumn("processed_at", F.col("crawled_at") if as_of is None else as_of)
