"""Fingerprints within a few bits of each other, met in tiles: arrays of a bounded number of fingerprints.

Fingerprints of long texts of one vocabulary crowd together, so keys of some bits make buckets whose pairs cannot be listed. Here no pair
leaves a task: two tiles meet, numpy compares them bit by bit, and one value per fingerprint comes out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.session import scratch_path, stored

#: Fingerprints that one round of ``first_fingerprints`` settles; a tile holds a quarter.
ROUND = 32_768
#: Bits compared at a time within a task.
BLOCK_CELLS = 2_000_000
LONGS = pa.list_(pa.int64())
NEVER_MET = np.iinfo(np.int64).min


def tiles(df: DataFrame, columns: list[str], order: list[Column], size: int) -> DataFrame:
    """Rows (tile, n, an array per column): long columns of ``df`` in order, at most ``size`` rows a tile, tile numbers in order."""
    parts = max(1, math.ceil(df.count() / (2 * size)))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("_part"), *columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part, held = 0, None, [np.zeros(0, dtype=np.int64) for _ in columns]

        def row(upto: int) -> pa.RecordBatch:
            values = [pa.array([h[:upto]], LONGS) for h in held]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([len(held[0][:upto])], pa.int64()), *values], ["tile", "n", *columns])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, columns)]
            while len(held[0]) >= size:
                yield row(size)
                seq, held = seq + 1, [h[size:] for h in held]
        if len(held[0]):
            yield row(size)

    return stored(dealt.mapInArrow(pack, f"tile bigint, n bigint, {', '.join(f'{c} array<bigint>' for c in columns)}"), "tiles")


def last_met(mine: np.ndarray, known: np.ndarray, value: np.ndarray | None, distance: int) -> np.ndarray:
    """Per fingerprint of ``mine`` the greatest ``value`` (none given: 1) of a known one within the distance, else ``NEVER_MET``.

    Two fingerprints within the distance agree in at least one of ``distance + 1`` blocks of bits, so only those are compared.
    """
    best = np.full(len(mine), NEVER_MET, dtype=np.int64)
    mine, known = mine.view(np.uint64), known.view(np.uint64)
    edges = [round(i * 64 / (distance + 1)) for i in range(distance + 2)]
    for low, high in zip(edges, edges[1:]):
        shift, mask = np.uint64(low), np.uint64((1 << (high - low)) - 1)
        rows = np.arange(len(mine)) if value is not None else np.flatnonzero(best == NEVER_MET)
        a, b = (mine[rows] >> shift) & mask, (known >> shift) & mask
        by_a, by_b = rows[np.argsort(a, kind="stable")], np.argsort(b, kind="stable")
        a, b = np.sort(a), b[by_b]
        names, start = np.unique(a, return_index=True)
        ends = np.append(start[1:], len(a))
        first, last = np.searchsorted(b, names, "left"), np.searchsorted(b, names, "right")
        for i in np.flatnonzero(last > first):
            js = by_b[first[i] : last[i]]
            step = max(1, BLOCK_CELLS // len(js))
            for at in range(start[i], ends[i], step):
                ids = by_a[at : min(at + step, ends[i])]
                near = np.bitwise_count(mine[ids][:, None] ^ known[js][None, :]) <= distance
                found = near.any(axis=1).astype(np.int64) if value is None else np.where(near, value[js][None, :], NEVER_MET).max(axis=1)
                best[ids] = np.maximum(best[ids], np.where(found, found, NEVER_MET) if value is None else found)
    return best


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _gone(distance: int):
    """Over rows (known, id): the ids of a round that a kept fingerprint is close to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = _longs(batch.column("known").flatten())
                for tile in {t.tobytes(): t for t in (_longs(x.values) for x in batch.column("id"))}.values():
                    met = tile[last_met(tile, known, None, distance) != NEVER_MET]
                    if len(met):
                        yield pa.RecordBatch.from_arrays([pa.array([met], LONGS)], ["id"])

    return run


def _first(distance: int):
    """Over rows (kind, tile, id), those that are gone before the others in order: what keep-first keeps of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, line = set(), []
        for batch in batches:
            for kind, ids in zip(batch.column("kind").to_pylist(), batch.column("id")):
                if kind:
                    line.append(_longs(ids.values))
                else:
                    gone.update(_longs(ids.values).tolist())
        if not line:
            return
        values = np.concatenate(line)
        values = values[~np.isin(values, np.fromiter(gone, dtype=np.int64, count=len(gone)))]
        bits, kept = values.view(np.uint64), np.ones(len(values), dtype=bool)
        for i in range(len(values)):
            if kept[i]:
                kept[i + 1 :] &= np.bitwise_count(bits[i + 1 :] ^ bits[i]) > distance
        if len(values):
            yield pa.RecordBatch.from_arrays([pa.array([values[kept]], LONGS)], ["id"])

    return run


def first_fingerprints(items: DataFrame, distance: int, size: int = ROUND) -> DataFrame:
    """Ids of the fingerprints (id, ord) that keep-first keeps: no earlier kept one is within ``distance`` bits. Null ids are left out.

    The line is cut by order into rounds of ``size``. A round first meets all that was kept before, spread over the tasks; what is left is settled
    in one task, which holds one round. Each fingerprint is written once and each kept one once more, whatever the crowding.
    """
    spark = items.sparkSession
    line = tiles(items.where("id is not null").select("id", "ord"), ["id"], [F.col("ord"), F.col("id")], max(1, size // 4))
    rounds, room = [], 0
    for tile, n in line.select("tile", "n").orderBy("tile").collect():  # a small row per tile
        if n > room:
            rounds.append([tile, tile])
            room = size
        rounds[-1][1], room = tile, room - n
    path = scratch_path(spark, "kept")
    for i, (start, end) in enumerate(rounds):
        here = line.where(F.col("tile").between(start, end))
        lined = here.select(F.lit(1).alias("kind"), "tile", "id")
        if i:
            before = spark.read.schema("id array<bigint>").parquet(*[f"{path}/{j}" for j in range(i)]).select(F.col("id").alias("known"))
            gone = before.crossJoin(F.broadcast(here.select("id"))).mapInArrow(_gone(distance), "id array<bigint>")
            lined = gone.select(F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("tile"), "id").unionByName(lined)
        lined.repartition(1).sortWithinPartitions("kind", "tile").mapInArrow(_first(distance), "id array<bigint>").write.parquet(f"{path}/{i}")
    if not rounds:
        return items.select(F.col("id").cast("long").alias("id")).limit(0)
    kept = spark.read.schema("id array<bigint>").parquet(*[f"{path}/{j}" for j in range(len(rounds))])
    return kept.select(F.explode("id").alias("id"))


def last_known(mine: DataFrame, known: DataFrame, distance: int, size: int = ROUND) -> DataFrame:
    """Rows (id, value): fingerprints of ``mine`` (id) that a known one (id, value: long) is close to, with the greatest such value."""
    a = tiles(mine.where("id is not null").select("id"), ["id"], [F.col("id")], size).select("id")
    b = tiles(known.where("id is not null").select("id", "value"), ["id", "value"], [F.col("id")], size)
    b = b.select(F.col("id").alias("known"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, theirs, value in zip(batch.column("id"), batch.column("known"), batch.column("value")):
                ids = _longs(ids.values)
                best = last_met(ids, _longs(theirs.values), _longs(value.values), distance)
                met = best != NEVER_MET
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(best[met])], ["id", "value"])

    pairs = a.crossJoin(b).repartition(4 * mine.sparkSession.sparkContext.defaultParallelism)
    return pairs.mapInArrow(run, "id bigint, value bigint").groupBy("id").agg(F.max("value").alias("value"))
