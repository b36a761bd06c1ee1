"""Conversion of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.api import convert

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_file_stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def convert_stream(files: DataFrame, watermark: str | None = None, **options) -> DataFrame:
    """Converted documents; with ``watermark``, of files with the same bytes within that time only the first."""
    if watermark:
        files = files.withColumn("content_sha256", F.sha2("content", 256)).withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["content_sha256"])
    return convert(files, **options)


def start(converted: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], available_now: bool = False) -> StreamingQuery:
    """Run ``sink`` on each batch; a batch that failed is run again with the same number, so sinks must overwrite."""
    writer = converted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
