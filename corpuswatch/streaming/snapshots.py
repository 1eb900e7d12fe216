"""Tables of one folder per micro-batch below a shared path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuswatch.session import released


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    with released(df.sparkSession):
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_snapshot(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The table as the batch before left it; none before the first batch."""
    return None if batch_id == 0 else spark.read.parquet(f"{path}/batch={batch_id - 1}")


def snapshot_ids(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that left a whole snapshot, oldest first. Listed by Spark's file system, so any store will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(folder)]
    whole = [n for n in names if n.startswith("batch=") and store.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in whole)


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that every batch writes anew, as the last whole batch left it; none before the first."""
    ids = snapshot_ids(spark, path)
    return spark.read.parquet(f"{path}/batch={ids[-1]}") if ids else None


def write_snapshot(df: DataFrame, path: str, batch_id: int, keep: int = 2) -> None:
    """Write the snapshot of a batch, then let those before the last ``keep`` go. A batch reads the one before it, so two must stay."""
    write_batch(df, path, batch_id)
    drop_snapshots(df.sparkSession, path, batch_id - max(keep, 2) + 1)


def drop_snapshots(spark: SparkSession, path: str, first: int) -> None:
    """Remove the snapshots of batches before ``first``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [i for i in snapshot_ids(spark, path) if i < first]:
        store.delete(hadoop.Path(f"{path}/batch={old}"), True)
