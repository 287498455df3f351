"""Streams: changed files as they land, and the memory store as a running table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lang import detect_language


def file_stream(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream of files(path, content, size_bytes, mtime, language).

    Read with an ``availableNow`` trigger and a checkpoint it is the incremental refresh:
    what an earlier run has seen is not read again.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), detect_language(F.col("path")).alias("language"))


def memory_stream(writes: DataFrame) -> DataFrame:
    """The last value of each (namespace, key) of a stream of writes, for update mode."""
    return writes.groupBy("namespace", "key").agg(F.max_by("value", "seq").alias("value"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """All that is there now, through a stream into a table in memory; for tests and small stores."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
