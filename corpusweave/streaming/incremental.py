"""Incremental scans: file rows as they arrive, each content once, with counts by time of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text as T


def arriving(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the rows of Parquet files that appear in a folder, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks are for instants; in a stream times without a zone are taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")) if stream.isStreaming else stream


def first_seen(stream: DataFrame, time: str = "ingested_at", late: str = "7 days", digest: str = "file_hash") -> DataFrame:
    """Each content once; what comes later than `late` behind the newest is dropped with the state it would need."""
    return _timed(stream, time).withColumn(digest, F.lower(digest)).where(F.col(digest).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([digest])


def normalized(stream: DataFrame, content: str = "file_content") -> DataFrame:
    return stream.withColumn("text", T.normalize(F.col(content)))


def arrivals(stream: DataFrame, time: str = "ingested_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, files, empty) by window of arrival."""
    return _timed(stream, time).withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("files"), F.count_if("file_is_empty").alias("empty")).select(F.col("w.start").alias("start"), "files", "empty")
