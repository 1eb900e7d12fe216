"""Session helpers shared by operators that must cut lineage or read a clock."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a folder of
    its own; on a cluster a missing setting is an error, because executors cannot share local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="corpuswatch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return it with a fresh, short plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    with released(df.sparkSession):
        # A query looks at the switch when it is made, so this one is made here.
        return df.select("*").checkpoint(eager=True)


#: Spark's switch for shuffle files that go when the query that wrote them ends, not when the driver next collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind: for those whose result is stored, so that nothing reads them again."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: short lineage, columns pruned on reading, no shuffle files left."""
    path = scratch_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more, neither a result nor a table that is not stored itself."""
    for table in tables:
        jvm, files = table.sparkSession._jvm, table.inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared checkpoint folder."""
    tag = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{tag}"


def clock_bound(df: DataFrame, ts: str, as_of=None, back: str = "INTERVAL 0 SECONDS") -> Column:
    """``as_of - back`` as one value; without ``as_of`` the newest timestamp of ``df`` is the clock.

    The subtraction happens inside the scalar subquery, so the scan receives a plain comparison with one
    value and can use it for row-group pruning.
    """
    if as_of is not None:
        return F.lit(as_of).cast(df.schema[ts].dataType) - F.expr(back)
    return df.select((F.max(ts) - F.expr(back)).alias("bound")).scalar()


#: Rows that a task sorts or hashes in memory after a shuffle, on average.
TASK_ROWS = 400_000


def parts_for(spark: SparkSession, n_rows: int) -> int:
    """Partitions that keep a task near ``TASK_ROWS`` rows however large the table is; no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(n_rows / TASK_ROWS))


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` before they are grouped or ranked; the settings of a session give a number that does not follow the rows."""
    return df.repartition(parts_for(df.sparkSession, n_rows), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has fewer splits than there are cores (few, small files).

    For text-heavy work only; a large table has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a lookup table after counting it; a larger one is joined by shuffle.

    The explicit choice also keeps Spark from broadcasting the other side, whose size it may underrate
    (it does not know how many rows an explode makes).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")
