"""Sharding by a k-d tree over metadata, in DataFrame expressions only.

The tree splits every node at the weighted median of its widest dimension until leaves reach the target bytes. Medians are exact
and distributed: one range sort per level orders all nodes at once, and running sums of bytes find each node's cut.
Rows of equal text are one unit, so that copies stay together; only a group of copies of more than a quarter of a
shard is cut into small pieces by a hash of doc_id, which keeps the leaves near equal whatever the groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm.tables import running, stored

#: A group of equal texts of more than this share of a shard's bytes is cut, into pieces of the second share.
GROUP_SHARE, PIECE_SHARE = 1 / 4, 1 / 64
#: Split groups that a broadcast may hold (their number is at most shards / GROUP_SHARE).
MAX_BROADCAST_ROWS = 100_000
DIMENSIONS = ("lang_code", "source_code", "log_size", "doc_age")


def size() -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")


def _code(c: str) -> Column:
    """Place of a category on a line from 0 to 1."""
    return F.coalesce(F.crc32(F.col(c).cast("string")), F.lit(0)) / F.lit(2.0**32)


def _rows(documents: DataFrame) -> DataFrame:
    columns = {c: F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("text_key"), *[v.alias(c) for c, v in columns.items()],
    )


def _with_unit(rows: DataFrame, split: DataFrame, small: bool) -> DataFrame:
    """``rows`` (doc_id, text_key) with the unit that each belongs to."""
    joined = rows.join(F.broadcast(split) if small else split, "text_key", "left")
    piece = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.coalesce("pieces", F.lit(1)))
    return joined.withColumn("unit", F.xxhash64("text_key", piece)).drop("pieces")


def _tree(units: DataFrame, leaves: int) -> DataFrame:
    """Units with the number of their leaf."""
    spread = units.agg(*[(F.max(c) - F.min(c)).alias(c) for c in DIMENSIONS]).first()
    scale = {c: 1 / spread[c] if spread[c] else 0.0 for c in DIMENSIONS}
    nodes = units.withColumn("leaf", F.lit(0)).withColumn("leaves", F.lit(leaves))
    for _ in range(math.ceil(math.log2(leaves)) if leaves > 1 else 0):
        extent = nodes.groupBy("leaf").agg(F.sum("weight").alias("total"), *[((F.max(c) - F.min(c)) * scale[c]).alias(f"w_{c}") for c in DIMENSIONS])
        widest = F.greatest(*[F.col(f"w_{c}") for c in DIMENSIONS])
        value = F.col(DIMENSIONS[-1]) * scale[DIMENSIONS[-1]]
        for c in DIMENSIONS[-2::-1]:
            value = F.when(F.col(f"w_{c}") == widest, F.col(c) * scale[c]).otherwise(value)
        placed = nodes.join(extent, "leaf").withColumn("value", value).select(*nodes.columns, "total", "value")
        half = F.ceil(F.col("leaves") / 2).cast("int")
        left = (F.col("sum_before") + F.col("weight") / 2) * F.col("leaves") <= F.col("total") * half
        cut = running(placed, [F.col("value"), F.col("unit")], F.col("weight"), within=["leaf"]).withColumn("left", left | (F.col("leaves") == 1))
        nodes = cut.select(
            *units.columns, F.when(F.col("left"), F.col("leaf")).otherwise(F.col("leaf") + half).alias("leaf"),
            F.when(F.col("leaves") == 1, 1).when(F.col("left"), half).otherwise(F.col("leaves") - half).cast("int").alias("leaves"),
        )
    return nodes.select("unit", F.col("leaf").alias("shard"))


def _planned(documents: DataFrame, shards: int | None, target_bytes: int | None) -> tuple[DataFrame, DataFrame, bool]:
    """Stored rows with their shards; split groups; whether those are few enough for a broadcast."""
    rows = stored(_rows(documents), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = shards or max(1, math.ceil(total / target_bytes))
    piece = max(1, int(total / leaves * PIECE_SHARE))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") > total / leaves * GROUP_SHARE) & (F.col("rows") > 1))
    split = stored(groups.select("text_key", F.ceil(F.col("bytes") / piece).cast("bigint").alias("pieces")), "split")
    small = leaves / GROUP_SHARE <= MAX_BROADCAST_ROWS
    rows = _with_unit(rows, split, small)
    units = stored(
        rows.groupBy("unit").agg(
            F.sum("size").alias("weight"), F.min(_code("lang")).alias("lang_code"), F.min(_code("source")).alias("source_code"),
            F.min(F.log("size")).alias("log_size"), F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("doc_age"),
        ),
        "units",
    )
    tree = stored(_tree(units, leaves), "leaves")
    return rows.join(tree, "unit"), split, small


def shard_rows(documents: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each row of ``documents`` (doc_id, text; lang and source if there).

    ``shards`` leaves, or as many as ``target_bytes`` need. Sizes (UTF-8 bytes plus 1) of the leaves are near equal: each cut is off
    by half a unit at most, and a unit is one row or equal texts of a quarter of a shard at most. Slots number the rows of a shard from 0 without gaps, equal texts side by side. Null and empty texts
    have size 1; null metadata is a category of its own; repeated rows and null doc_ids are rows like others. An empty
    table gives no rows; fewer units than shards leave some shards empty. Other columns are ignored.
    """
    placed = _planned(documents, shards, target_bytes)[0].select("doc_id", "size", "text_crc32", "text_key", "shard")
    order = [F.col("text_key"), F.col("doc_id")]
    return running(placed, order, F.lit(1), within=["shard"]).select("doc_id", "size", "text_crc32", "shard", F.col("n_before").alias("slot"))


def sharded_documents(documents: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``documents`` with all its columns and ``shard`` (a column of that name is replaced)."""
    kept = [c for c in documents.columns if c != "shard"]
    placed, split, small = _planned(documents, shards, target_bytes)
    units = placed.select("unit", "shard").distinct()
    internal = {"text_key": "_text_key", "unit": "_unit", "pieces": "_pieces"}
    piece = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.coalesce("_pieces", F.lit(1)))
    named = split.withColumnsRenamed(internal)
    keyed = documents.select(*kept, F.xxhash64("text").alias("_text_key")).join(F.broadcast(named) if small else named, "_text_key", "left")
    keyed = keyed.withColumn("_unit", F.xxhash64("_text_key", piece))
    return keyed.join(units.withColumnsRenamed(internal), "_unit").select(*kept, "shard")
