"""Mixing sources to target weights by weighted fair queueing, in DataFrame expressions only.

Each source's documents are shuffled by a hash and queue up, pass after pass. A copy's virtual finish time is the number of its source's words up to
its end, divided by the source's target. All copies are range-sorted by that time and taken while their
running sum stays within the budget, so every source is cut off at the same virtual time, next to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.llm.arrow_rows import veiled
from corpuswatch.llm.tables import running, stored

WORD = r"[^\x20\x09-\x0D]+"
#: A source's queue is summed in 4096 slices of the key; no task sorts more than one slice of one source.
SLICE_BITS = 48


def size() -> Column:
    """Words of the whole text; null: 0."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(seed: int) -> Column:
    """60 bits of a digest of the row, as a long: the place in the shuffle."""
    parts = [F.col("doc_id").cast("bigint").cast("string"), F.col("source").cast("string"), F.md5("text")]
    row = F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) for each source of ``sized`` (doc_id, source, size).

    Sources in order of code points, null last, weigh ``weights``, repeating. They share 100 % of all sizes by weight; a target
    stops at ``most`` times its source's size and the excess is shared again by weight until no target is above its limit.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(totals, [F.col("source").asc_nulls_last()], F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("n_before", F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    budget = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most
    held, level = F.lit(False), None
    while True:
        # One level for all sources below their limits; those that it lifts above stop there, and the level rises.
        free, total_weight, n_held = ranked.agg(
            F.lit(budget) - F.coalesce(F.sum(F.when(held, limit)), F.lit(0)), F.sum(F.when(~held, F.col("weight"))), F.count(F.when(held, 1))
        ).first()
        if level is not None and n_held == level[2] or not total_weight:
            break
        level = (free, total_weight, n_held)
        held = held | (limit * F.lit(float(total_weight)) < F.col("weight") * F.lit(float(free)))
    if level is None:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
    return ranked.select("source", "source_size", F.when(held, limit.cast("double")).otherwise(share).alias("target"))


def plan(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """Rows (doc_id, key, size, source_size, target, copies, taken), one for each row of ``documents`` (doc_id, source, text).

    ``taken`` is ``copies * size``: whole documents are taken, never parts, at most ``most`` times each, and in all no more words than
    ``documents`` has. Rows without words (null, empty or blank texts) are taken 0 times. A null source is a source of its own;
    null doc_ids and repeated rows are documents of their own, which of several equal rows gets a copy more makes
    no difference to the mix. Reruns agree: ``key`` is a hash of the row and ``seed``, ties go by key and doc_id. An empty table
    gives no rows. Other columns are ignored.
    """
    sized = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size().alias("size"), shuffle_key(seed).alias("key")
    )
    sized = stored(sized, "sizes")
    targets = stored(source_targets(sized, weights, most), "targets")
    slices = sized.withColumn("slice", F.shiftright("key", SLICE_BITS))
    sums = slices.groupBy("source", "slice").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"], "slice", "start", "source_size", "target")
    queue = slices.join(starts, slices["source"].eqNullSafe(starts["source"]) & (slices["slice"] == starts["slice"])).select(
        slices["*"], "start", "source_size", "target"
    )
    order = Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn("end", F.col("start") + F.sum("size").over(order)).withColumn("row", F.monotonically_increasing_id())
    queue = stored(queue.select("row", "doc_id", "key", "size", "end", "source_size", "target"), "queue")

    turns = F.explode(F.expr("sequence(0, cast(ceil(target / source_size) AS int) - 1)"))
    copies = queue.where("size > 0 and target > 0").withColumn("turn", turns).select(
        "row", "doc_id", "key", "size", "turn", ((F.col("turn") * F.col("source_size") + F.col("end")) / F.col("target")).alias("finish")
    )
    budget = sized.agg(F.sum("size")).first()[0] or 0
    lined_up = running(copies, [F.col(c) for c in ("finish", "key", "doc_id", "turn", "row")], F.col("size"))
    taken = lined_up.where(F.col("sum_before") + F.col("size") <= budget).groupBy("row").agg(F.count("*").alias("copies"))
    copies = F.coalesce("copies", F.lit(0))
    return queue.join(taken, "row", "left").select(
        "doc_id", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The mix as documents: each row of ``documents`` as often as it is taken, with its own columns.

    Equal rows share a key; the copies that the plan gives them are dealt out among them.
    """
    per_key = plan(documents, weights, most, seed).where("copies > 0").groupBy("key").agg(F.sum("copies").alias("_copies"))
    plain, restored = veiled(documents, ("doc_id", "source", "text"))
    keyed = plain.withColumn("_key", shuffle_key(seed))
    equal = Window.partitionBy("_key")
    shared = keyed.join(per_key.withColumnRenamed("key", "_key"), "_key")
    dealt = shared.withColumn("_rows", F.count("*").over(equal)).withColumn("_nth", F.row_number().over(equal.orderBy("_key")))
    times = F.expr("cast(_copies div _rows AS int) + if(_nth <= _copies % _rows, 1, 0)")
    return restored(dealt.withColumn("_turn", F.explode(F.array_repeat(F.lit(0), times))))
