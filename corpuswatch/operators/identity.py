"""Article identity and row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.functions.text import head, or_empty
from corpuswatch.session import dealt, parts_for, stored


#: Fixed value: characters of the content that the analysed system hashes.
REFERENCE_HASH_CHARS = 500


def with_content_hash(df: DataFrame, chars: int | None = None) -> DataFrame:
    """sha256 of the title followed by the content (``chars``: only its start; ``REFERENCE_HASH_CHARS`` as in the analysed system)."""
    return df.withColumn(
        "content_hash", F.sha2(F.concat(or_empty(F.col("title")), head(or_empty(F.col("content")), chars)), 256)
    )


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row per key. The rank filter is also applied before the shuffle, so copies do not travel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def join_rows(df: DataFrame, rows: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on key columns that may be null: null meets null, so no row is lost for want of a date."""
    other = rows
    for k in keys:
        other = other.withColumnRenamed(k, f"_by_{k}")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys])
    return df.join(other, on, how).drop(*[f"_by_{k}" for k in keys])


def with_time_rank(df: DataFrame, ts: str, tie: str, keys: list[str] | None = None, out: str = "time_rank") -> DataFrame:
    """Position (from 1) of each row by time (null first), then ``tie``, within its key.

    Rows are dealt into ranges of (key, time, tie) of equal size and written once; the counts of the ranges before give every range
    its offset, and only the rows of one range are ranked together. So neither a key nor one timestamp that holds a third of
    all rows meets in one task; only rows alike in all three do, and their order among themselves is left open.
    """
    keys = keys or []
    n = df.count()
    # Four ranges for each task that ranks them, so that those which meet in one differ little in all.
    ranged = stored(df.repartitionByRange(parts_for(df.sparkSession, 4 * n), *keys, ts, tie).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(ts, tie))
    ranked = join_rows(dealt(ranged, n, *keys, "_range").withColumn("_place", within), offsets, [*keys, "_range"], "inner")
    return ranked.select(*df.columns, (F.col("_offset") + F.col("_place")).alias(out))
