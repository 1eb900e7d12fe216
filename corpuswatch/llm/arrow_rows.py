"""Row-wise kernels that add columns to a table of any columns, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm import words as W


def with_measures(df: DataFrame, added: dict[str, str], kernel: Callable[[], Callable[[pa.RecordBatch], list]], named: list[str] = ()) -> DataFrame:
    """``df`` plus the columns ``added`` (name: type) that ``kernel()`` makes of each slice of rows.

    ``kernel`` is called once per task and returns the function that gets the slices (with a column ``text`` and those ``named``) and
    gives one array for each new column. Columns of ``df`` named like new ones are replaced; others pass as they are, whatever their names.
    """
    keep = [c for c in df.columns if c not in added]
    source = df.select(*keep)
    types = dict(source.dtypes)
    schema = ", ".join([f"c{i} {types[c]}" for i, c in enumerate(keep)] + [f"`{c}` {t}" for c, t in added.items()])
    inner = [c if c == "text" or c in named else f"c{i}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = kernel()
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(batch.columns, inner)
            for part in W.chunks(plain, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, *measure(part)], [*[f"c{i}" for i in range(len(keep))], *added])

    return source.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"`{c}`") for c in added])


def veiled(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all but the ``needed`` columns under neutral names, and the way back to its own columns from what is made of it."""
    names = [c if c in needed else f"_column{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)])
