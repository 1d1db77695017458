"""Reports, snapshots, and what a run prints and logs."""

from __future__ import annotations

import contextlib
import logging
import sys
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import compress_b64, hyperlink, relative, same_multiset

_NONE = "array()"


def csv_rows(files: DataFrame) -> DataFrame:
    """The report's columns; lists and maps are JSON texts, Match % is empty without a fuzzy winner."""
    return files.select(
        hyperlink(F.col("file_path")).alias("File Name"), F.to_json(F.coalesce("license_names", F.array().cast("array<string>"))).alias("Licenses"), F.col("match_percent").alias("Match %"),
        F.col("has_full_license").alias("Full License"), F.col("file_is_empty").alias("Is Empty"), F.to_json("keyword_matches").alias("Keywords"), F.col("file_hash").alias("Hash"),
    )


def write_csv(files: DataFrame, path: str, one_file: bool = False) -> None:
    """The report as CSV with a header; one_file only for results known to be small."""
    rows = csv_rows(files)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def fuzzy_report(matches: DataFrame, root: str = "") -> DataFrame:
    """Winners, the greatest percent first (null as 0), then by path: (path, license_name, percent as text, versions, mismatch, substring)."""
    none = F.array().cast("array<string>")
    percent = F.coalesce("match_percent", F.lit(0.0))
    expected, found = F.coalesce("expected_versions", none), F.coalesce("found_versions", none)
    return matches.orderBy(percent.desc(), "path").select(
        (relative(F.col("path"), root) if root else F.col("path")).alias("path"), "license_name", F.format_number(percent, 2).alias("percent"), F.array_join(expected, ", ").alias("expected"),
        F.array_join(found, ", ").alias("found"), (~same_multiset(expected, found)).alias("version_mismatch"), "matched_substring",
    )


def empty_files(files: DataFrame) -> DataFrame:
    return files.where("file_is_empty").select("file_path")


def full_licence_files(files: DataFrame) -> DataFrame:
    return files.where("has_full_license").select("file_path", "license_names")


def totals(files: DataFrame) -> DataFrame:
    """One row of counters."""
    return files.agg(F.count("*").alias("files"), F.count_if("is_released").alias("released"), F.count_if("file_is_empty").alias("empty"), F.count_if("has_full_license").alias("with_full_license"))


def snapshot_rows(files: DataFrame, root: str = "") -> DataFrame:
    path: Column = relative(F.col("file_path"), root) if root else F.col("file_path")
    return files.select(
        path.alias("file_path"), "file_hash", F.coalesce("license_names", F.array().cast("array<string>")).alias("licenses"), compress_b64(F.encode(F.coalesce("file_content", F.lit("")), "UTF-8")).alias("file_content_b64"), "file_content_is_text"
    )


def write_snapshot(files: DataFrame, path: str, root: str = "", kind: str = "parquet") -> None:
    """The snapshot that the next run compares with, as Parquet or JSON lines."""
    snapshot_rows(files, root).write.mode("overwrite").format(kind).save(path)


class Timer:
    """Seconds of the stages of a run."""

    def __init__(self):
        self.took: dict[str, float] = {}

    @contextlib.contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.took[name] = time.perf_counter() - began


class Tee:
    """A stream that writes to several."""

    def __init__(self, *streams):
        self.streams = streams

    def write(self, text: str) -> int:
        for s in self.streams:
            s.write(text)
        return len(text)

    def flush(self) -> None:
        for s in self.streams:
            s.flush()


@contextlib.contextmanager
def tee_stdout(path: str):
    with open(path, "w", encoding="utf-8") as f, contextlib.redirect_stdout(Tee(sys.stdout, f)):
        yield


def logger(name: str, folder: str = "logs") -> logging.Logger:
    """INFO to <folder>/<name>.log, begun anew, DEBUG to the console."""
    out = logging.getLogger(f"corpusweave.{name}")
    if not out.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        out.setLevel(logging.DEBUG)
        for handler, level in ((logging.FileHandler(Path(folder) / f"{name}.log", mode="w"), logging.INFO), (logging.StreamHandler(), logging.DEBUG)):
            handler.setLevel(level)
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            out.addHandler(handler)
    return out
