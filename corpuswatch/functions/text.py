"""Text expressions. All are built-in Spark expressions and stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# White space of any kind; spelled out, because the Unicode switch of the regex engine is slow.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Drop leading and trailing white space of any kind (``trim`` only knows the blank)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(c: Column) -> Column:
    """Lower case, every run of other characters than letters, digits and ``_`` to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def words(c: Column) -> Column:
    """Words of the normalised text; an empty text has none."""
    text = normalize_text(c)
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, " "))


def tokens(c: Column) -> Column:
    """White-space tokens of the text as written."""
    text = strip(c)
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, f"{SPACE}+"))


def word_count(c: Column) -> Column:
    return F.size(tokens(or_empty(c)))


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"<[^>]+>", " "))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer copies a computed column into every later filter and projection that reads it; it does not
    do so across a generator. Worth it for costly expressions that are read more than once.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def head(c: Column, n: int | None) -> Column:
    """First ``n`` characters; ``None`` keeps the whole text."""
    return c if n is None else F.left(c, F.lit(n))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def truthy(c: Column) -> Column:
    """Null for the empty string, so that ``coalesce`` skips it."""
    return F.nullif(c, F.lit(""))


def contains_term(lowered: Column, term: str, match: str = "substring") -> Column:
    """Does the lower-cased text hold the term, as a substring or as a whole word?"""
    if match == "word":
        return lowered.rlike(r"(?U)\b" + re.escape(term.strip()) + r"\b")
    return lowered.contains(term)


def term_hits(lowered: Column, terms: list[str], match: str = "substring") -> Column:
    """How many of the terms occur at least once."""
    return reduce(add, [contains_term(lowered, t, match).cast("int") for t in terms], F.lit(0))


def matched_terms(lowered: Column, terms: list[str]) -> Column:
    """The terms that occur, in lexicon order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(lowered, t))


def python_title(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, so that ``x1y`` becomes ``X1Y``."""
    runs = F.regexp_extract_all(c, F.lit(r"([a-zA-Z]+|[^a-zA-Z]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), ""
    )


def rounded(c: Column, digits: int) -> Column:
    """Half up on the decimal value: nine decimals first, so that binary noise does not decide half-way cases."""
    return F.round(F.round(c, 9), digits)


def fixed_point(c: Column, digits: int) -> Column:
    """A number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def exact_mean(c: Column) -> Column:
    """Mean that does not depend on the order of addition (scores carry few decimals), to nine decimals."""
    return F.round(F.sum(c.cast("decimal(18,6)")).cast("double") / F.count(c), 9)
