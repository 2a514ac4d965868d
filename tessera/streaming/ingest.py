"""Arriving image files as a stream: header facts, duplicates dropped within a watermark, counts by format.

An addition: the batch engine needs none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixel_math as pm

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_images(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as they appear, with the format their first bytes show."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(path)
    return files.withColumn("format", pm.sniff("content"))


def distinct_images(arriving: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for equal contents that arrive within the delay; state is bounded by the watermark."""
    marked = arriving.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", delay)
    return marked.dropDuplicatesWithinWatermark(["digest"])


def counts_by_format(arriving: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Files and bytes of each format in windows of arrival time."""
    timed = arriving.withWatermark("modificationTime", delay)
    return timed.groupBy(F.window("modificationTime", window), "format").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
