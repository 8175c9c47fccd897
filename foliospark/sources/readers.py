"""Sources: uploads, page images, responses, outputs and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.schemas import RESPONSE


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan of fewer splits than cores (one small file); a scan of many splits
    is left alone, so no large table is shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def uploads(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below ``path``: path, file_name, length, modified, content. Leave ``content`` out of
    the query and the bytes are never read. Spark's file sources skip files of zero bytes: an
    expected upload that does not show up is missing or empty."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length",
        F.col("modificationTime").alias("modified"), "content")


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded page images: origin, width, height, channels and pixel bytes (blue, green, red,
    alpha order); the pixel fields are null where a file cannot be decoded."""
    i = F.col("image")
    ok = i["height"] > 0
    return spark.read.format("image").option("recursiveFileLookup", "true").load(path).select(
        i["origin"].alias("origin"), F.when(ok, i["width"]).alias("width"),
        F.when(ok, i["height"]).alias("height"), F.when(ok, i["nChannels"]).alias("channels"),
        F.when(ok, i["data"]).alias("data"))


def responses(spark: SparkSession, path: str, fmt: str = "parquet",
              schema: T.StructType = RESPONSE) -> DataFrame:
    """Raw model responses with a fixed schema (parquet or JSON)."""
    return spark.read.format(fmt).schema(schema).load(path)


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """Written Markdown files: path and modification time, contents not read. A document exported
    as a folder of its file name counts as that file."""
    folder = F.regexp_replace("path", r"file_name=([^/]*\.md)/[^/]*\z", "$1")
    return (uploads(spark, path, "*.{md,txt}").select(folder.alias("path"), "modified")
            .filter(F.col("path").endswith(".md")).groupBy("path").agg(F.max("modified").alias("modified")))


def event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 files_per_trigger: int | None = None) -> DataFrame:
    """Event log as a stream of files."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_event_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Event log from a topic keyed by task id (needs the Kafka package on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.col("key").cast("string").alias("stream_key"),
                      F.col("value").cast("string").alias("value"))
