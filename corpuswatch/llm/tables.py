"""Intermediate tables in the shared folder, and distributed ranks and running sums in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.session import discard, stored  # noqa: F401  written once below spark.checkpoint.dir, safe from lost executors


def running(df: DataFrame, order: list[Column], weight: Column, within: list[str] | None = None) -> DataFrame:
    """``df`` in global order with ``n_before`` (rows) and ``sum_before`` (weight), both exclusive.

    A range sort deals the rows out; its partitions are summed, and only one total per partition (and per value of
    ``within``, whose columns must lead the order) meets in a window. No task sees more than its range. The sorted rows are stored, so
    the second pass meets the same partitions. With ``within`` both counts start again at each of its values.
    """
    names = within or []
    sorted_rows = stored(
        df.withColumn("_weight", weight.cast("bigint")).orderBy(*[F.col(c) for c in names], *order).withColumn("_at", F.monotonically_increasing_id()),
        "sorted",
    )
    part = F.shiftright("_at", 33)
    keys = [*names, "_part"]
    totals = sorted_rows.groupBy(*names, part.alias("_part")).agg(F.count("*").alias("_n"), F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0")
    )
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    here = sorted_rows.withColumn("_part", part).withColumns({
        "_n1": F.count("*").over(inside), "_sum1": F.coalesce(F.sum("_weight").over(inside), F.lit(0)),
    })
    condition = here["_part"] == offsets["_part"]
    for c in names:
        condition = condition & here[c].eqNullSafe(offsets[c])
    return here.join(offsets, condition).select(
        *[here[c] for c in df.columns], (F.col("_n0") + F.col("_n1")).alias("n_before"), (F.col("_sum0") + F.col("_sum1")).alias("sum_before")
    )
