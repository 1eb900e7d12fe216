"""Rows that later micro-batches must remember: one folder per batch, expiry by event time, and compaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswatch.streaming.snapshots import drop_snapshots, snapshot_ids, write_batch


@dataclass(frozen=True)
class Memory:
    """A table below ``path`` of rows with a time ``ts``, each known for ``seconds`` (``None``: for ever).

    A batch reads what earlier batches left and writes its own folder, so running it again changes nothing. Every ``compact_every``-th
    batch also takes over the earlier rows that have not expired, and the next batch removes the folders before it: there are never more
    than that number of folders and one, and they hold little beyond the time span.
    """

    path: str
    seconds: int | None
    ts: str = "crawled_at"
    compact_every: int = 16

    def _folders(self, spark: SparkSession, batch_id: int) -> list[int]:
        """Batches before this one whose folders hold all that is remembered: from the last compaction on."""
        ids = [i for i in snapshot_ids(spark, self.path) if i < batch_id]
        whole = [i for i in ids if (i + 1) % self.compact_every == 0]
        return [i for i in ids if not whole or i >= whole[-1]]

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Rows of the batches before this one, also those that have expired since; ``until`` is when each does (null: never)."""
        ids = self._folders(spark, batch_id)
        if not ids:
            return None
        rows = spark.read.parquet(*[f"{self.path}/batch={i}" for i in ids])
        return rows.withColumn("until", self.until())

    def until(self):
        return F.lit(None).cast("timestamp") if self.seconds is None else F.col(self.ts) + F.make_interval(secs=F.lit(self.seconds))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        ids = self._folders(spark, batch_id)
        both = rows
        if ids and (batch_id + 1) % self.compact_every == 0:
            both = self.read(spark, batch_id).drop("until").unionByName(rows)
            if self.seconds is not None:
                # The newest time seen is the clock; a late row would meet what its time still knows only until here.
                clock = both.select(F.max(self.ts)).scalar()
                both = both.where((self.until() > clock) | F.col(self.ts).isNull())
        write_batch(both, self.path, batch_id)
        if ids:
            drop_snapshots(spark, self.path, ids[0])
