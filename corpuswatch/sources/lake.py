"""Raw article lake (JSON files by date and source) and topic rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswatch.schemas import ENRICHED_ARTICLE, RAW_ARTICLE


def write_lake(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lake partitioned by publication date and source; the embedding column is left out.

    A row keeps its 16-character hash prefix as ``hash16``, the key that single articles are looked up by.
    """
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    (
        df.drop("embedding")
        .withColumn("dt", F.date_format(F.coalesce("published_at", "crawled_at"), "yyyy-MM-dd"))
        .withColumn("source_key", F.replace(source, F.lit("/"), F.lit("_")))
        .withColumn("hash16", F.left(F.coalesce("content_hash", F.lit("nohash")), F.lit(16)))
        # By range, so that a folder gets few files and a large folder is still written by many tasks.
        .repartitionByRange("dt", "source_key", "hash16")
        .write.mode(mode)
        .partitionBy("dt", "source_key")
        .json(path)
    )
    index_lake(df.sparkSession, path)


#: Folder of the lake's index; readers of the lake skip names that start with an underscore.
INDEX = "_index"
INDEX_SCHEMA = "file string, low string, high string, rows bigint, dt string, source_key string"


def _index_rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(INDEX_SCHEMA).parquet(f"{path.rstrip('/')}/{INDEX}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def index_lake(spark: SparkSession, path: str) -> int:
    """Note the least and greatest hash of every lake file that the index does not know yet; returns how many there were.

    Files are written by ranges of hashes, so those of one folder hardly overlap. Run again after a write that broke off before its
    index, or over a lake of older files; a file that is in no index is never read by a lookup, so ``read_lake`` falls back to the
    folder where the index does not know it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.col("path").alias("file"))
    known, lake = _index_rows(spark, path), spark.read.schema("hash16 string").option("pathGlobFilter", "*.json")
    # One job lists the files; a lake without an index is read as the folder that it is.
    if known is None:
        n, read = files.count(), lake.json(path)
    else:
        paths = [r["file"] for r in files.join(known.select("file"), "file", "left_anti").collect()]
        n, read = len(paths), lake.json(paths) if paths else None
    if n:
        # Only the key is parsed; the folder's date and source come from the path.
        # The file's own column spells its path as in a URI.
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        noted = read.select("hash16", plain.alias("file")).groupBy("file").agg(F.min("hash16").alias("low"), F.max("hash16").alias("high"), F.count(F.lit(1)).alias("rows"))
        folder = [F.regexp_extract("file", f"/{name}=([^/]*)/", 1).alias(name) for name in ("dt", "source_key")]
        noted.select("*", *folder).repartitionByRange("dt", "source_key", "low").sortWithinPartitions("dt", "source_key", "low").write.mode("append").parquet(
            f"{path.rstrip('/')}/{INDEX}")
    return n


# Characters that partition folders spell as %XX.
ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\{[]^\x7f"}


def _folder_name(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


def lake_files(spark: SparkSession, path: str, dt: str, source: str, content_hash: str) -> list[str] | None:
    """Files of one date and source whose hashes may include this one; None where the index does not know the folder."""
    known = _index_rows(spark, path)
    if known is None:
        return None
    here = known.where((F.col("dt") == dt) & (F.col("source_key") == _folder_name(source.replace("/", "_"))))
    near = F.lit(content_hash[:16]).between(F.col("low"), F.col("high"))
    rows = here.select("file", near.alias("near")).collect()
    return [r["file"] for r in rows if r["near"]] if rows else None


def read_lake(spark: SparkSession, path: str, dt: str, source: str, content_hash: str) -> DataFrame:
    """Articles of one date, source and hash prefix. The index names the files to open; without it the folder is read."""
    fields = [f for f in ENRICHED_ARTICLE.fields if f.name != "embedding"]
    schema = T.StructType([*fields, T.StructField("hash16", T.StringType())])
    files = lake_files(spark, path, dt, source, content_hash)
    folder = f"{path.rstrip('/')}/dt={dt}/source_key={_folder_name(source.replace('/', '_'))}"
    try:
        if files != []:
            return spark.read.schema(schema).json(files or folder).where(F.col("hash16") == content_hash[:16]).drop("hash16")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], T.StructType(fields))


def to_topic_rows(df: DataFrame, key: str | None = "content_hash") -> DataFrame:
    """Rows for a keyed JSON topic: ``key`` and ``value``; trend topics carry no key."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    key_col = (F.lit(None).cast("string") if key is None else F.coalesce(F.col(key), F.lit(""))).alias("key")
    return df.select(key_col, value)


def write_topic(rows: DataFrame, servers: str, topic: str) -> None:
    """Batch write to a Kafka topic, acknowledged by all replicas and idempotent. Needs the Kafka package."""
    (
        rows.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("topic", topic)
        .save()
    )


def parse_topic_values(df: DataFrame, schema: T.StructType = RAW_ARTICLE) -> tuple[DataFrame, DataFrame]:
    """JSON ``value`` rows to (articles, quarantine); text that is not a record of the schema is quarantined."""
    wide = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("_r", F.from_json(F.col("value").cast("string"), wide, options))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    good = parsed.where(~bad).select("_r.*").drop("_corrupt")
    return good, parsed.where(bad).select(F.col("value").cast("string").alias("value"))


def read_articles_stream(
    spark: SparkSession, path: str | None = None, servers: str | None = None, topic: str | None = None,
    per_trigger: int = 100,
) -> DataFrame:
    """Stream of JSON ``value`` rows: a Kafka topic from its earliest offset, or a folder of JSON-lines files."""
    if servers is not None:
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", per_trigger)
            .load()
            .select(F.col("value").cast("string").alias("value"))
        )
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
