"""Timestamps, model output and small formatting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Timestamp layouts met in article payloads.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyyMMdd'T'HHmmss'Z'",
    "EEE, dd MMM yyyy HH:mm:ss Z",
    "EEE, d MMM yyyy HH:mm:ss Z",
    "EEE, d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss",
    "MMMM d, yyyy",
    "yyyy-MM-dd",
]


def try_ts(c: Column, *formats: str) -> Column:
    """First layout that parses; null when none does."""
    # Spark's parser refuses the week-day letter, which carries no information anyway.
    body = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}, ", "")
    attempts = [F.try_to_timestamp(body, F.lit(f.removeprefix("EEE, "))) for f in formats]
    return F.coalesce(F.expr("cast(null as timestamp)"), *attempts)


def parse_ts(c: Column, as_of: Column, formats: list[str] | None = None) -> Column:
    """Timestamp from free text; text that no layout understands becomes the clock value."""
    return F.coalesce(try_ts(c, *(formats or TIMESTAMP_FORMATS)), as_of)


def parse_model_json(c: Column, schema) -> Column:
    """Struct from a model answer that may sit in a fenced code block; null when it is not JSON."""
    raw = F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    fenced = F.regexp_replace(F.try_element_at(F.split(raw, "```"), F.lit(2)), r"^json", "")
    body = F.when(raw.startswith("```"), fenced).otherwise(raw)
    # As the only element of an array: text that follows the object spoils the array.
    listed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(schema), {"mode": "PERMISSIVE"})
    parsed = F.when(F.size(listed) == 1, F.get(listed, 0))
    # An answer that is not a JSON object parses to a struct of nulls; report it as null.
    any_field = F.coalesce(*[parsed[n].cast("string") for n in schema.fieldNames()])
    return F.when(any_field.isNotNull(), parsed)


def age_label(ts: Column, as_of: Column, seconds: bool = False) -> Column:
    """``12m ago`` / ``3h ago`` / ``2d ago``; with ``seconds`` ages under a minute read ``42s ago``."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    unit = 1_000_000

    def label(size: int, suffix: str) -> Column:
        return F.concat(F.floor(age / F.lit(size * unit)).cast("string"), F.lit(suffix))

    out = F.when(age < 60 * unit, label(1, "s ago")) if seconds else F.when(F.lit(False), F.lit(""))
    return (
        out.when(age < 3600 * unit, label(60, "m ago"))
        .when(age < 86400 * unit, label(3600, "h ago"))
        .otherwise(label(86400, "d ago"))
    )
