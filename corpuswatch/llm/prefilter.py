"""A fixed-size bitmap of hashed longs: a cheap filter before an exact join, of the same size for any input.

When the bitmap fills up more rows pass; the exact join behind it decides, so results never depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 24


@dataclass
class Prefilter:
    words: object  # broadcast bytes, BITS / 8 of them

    @staticmethod
    def of(df: DataFrame, value: Column) -> Prefilter:
        at = F.pmod(value, F.lit(BITS))
        packed = (
            df.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
        )
        table = np.zeros(BITS // 64, dtype="<i8")
        for batch in packed.toArrow().to_batches():
            table[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
        return Prefilter(df.sparkSession.sparkContext.broadcast(table.tobytes()))

    def table(self) -> np.ndarray:
        return np.frombuffer(self.words.value, dtype=np.uint8)

    @staticmethod
    def holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = values.astype(np.uint64) & np.uint64(BITS - 1)
        return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def may_hold(self, value: Column) -> Column:
        """False only where a long is none of those that the bitmap was made of; the other columns of the row stay where they are."""

        @F.arrow_udf(T.BooleanType())
        def held(values: pa.Array) -> pa.Array:
            return pa.array(self.holds(self.table(), values.to_numpy(zero_copy_only=False)))

        return held(value)
