"""The whole assessment as one plan: scan, three searches, resolution, diff, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators import files as table_ops
from corpusweave.operators import search
from corpusweave.runtime import written
from corpusweave.sources import scan, terms


@dataclass
class Assessment:
    files: DataFrame  # a row a released file, with all results
    fuzzy: DataFrame  # a row a winning or losing fuzzy match
    changed: DataFrame | None = None
    removed: DataFrame | None = None


def assess_table(files: DataFrame, full_texts: DataFrame, headers: DataFrame, keyword_terms: DataFrame, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """(files with their results, fuzzy matches) of files (key unique, text, ...), full_texts and headers (seq, name, text).

    license_names holds the exact names in pattern order, then the fuzzy winners. The texts are used by all searches, so a
    caller whose `files` is costly should hand in a written table.
    """
    texts = files.select(F.col(key).alias("path"), "text")
    exact = search.full_matches(texts, full_texts)
    fuzzy = written(search.fuzzy(texts, headers), "fuzzy")
    best = search.resolve(fuzzy).select("path", "selected", F.col("license_name").alias("fuzzy_license_match"), "match_percent")
    words = search.keyword_map(texts, keyword_terms)
    none = F.array().cast("array<string>")
    out = files.join(exact.withColumnsRenamed({"path": key, "license_names": "exact"}), key, "left")
    out = out.join(best.withColumnRenamed("path", key), key, "left").join(words.withColumnRenamed("path", key), key, "left")
    out = out.withColumn("license_names", F.concat(F.coalesce("exact", none), F.coalesce("selected", none))).drop("exact", "selected")
    return out, fuzzy


def assess(spark: SparkSession, config: scan.Config) -> Assessment:
    """Scan a source tree (archives expanded), search it, and compare it with the snapshot of an earlier run."""
    tree = scan.file_rows(scan.read_tree(spark, config.source), config.hash_algorithm, config.ignored)
    files = written(tree.where("is_released"), "files")
    out, fuzzy = assess_table(files, scan.read_patterns(spark, config.full_texts), scan.read_patterns(spark, config.headers), terms.frame(spark))
    result = Assessment(out, fuzzy)
    if config.previous:
        old = scan.read_snapshot(spark, config.previous)
        result.changed, result.removed = table_ops.new_or_changed(old, out), table_ops.removed(old, out)
    return result
