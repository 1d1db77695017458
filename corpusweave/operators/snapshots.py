"""The two copies of the snapshot: what is missing on either side and what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.operators.compare import differences, latest

FIELDS = ("file_hash", "licenses", "file_content_is_text")


def canonical_path(path: Column) -> Column:
    """'/' for a backslash, and no './' in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def current(snapshot: DataFrame) -> DataFrame:
    """The latest state of each (repo_id, file_path) under its canonical path."""
    return latest(snapshot.withColumn("file_path", canonical_path(F.col("file_path"))), ["repo_id", "file_path"], "recorded_at", FIELDS)


def snapshot_differences(primary: DataFrame, mirror: DataFrame) -> DataFrame:
    """(repo_id, file_path, difference). Hashes compare without regard to case, licenses as sets (null is the empty set)."""
    fields = {
        "file_hash": F.lower("file_hash"),
        "licenses": F.array_sort(F.array_distinct(F.coalesce("licenses", F.array().cast("array<string>")))),
        "file_content_is_text": F.col("file_content_is_text"),
    }
    return differences(current(primary), current(mirror), ["repo_id", "file_path"], fields, "primary", "mirror")
