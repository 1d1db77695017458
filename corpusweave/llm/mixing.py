"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact budget cuts.

Each document gets a random key by hash. Documents are range-partitioned by (source, key), so that a source of any size
is spread over many tasks; each task sums token counts along its own stretch, the sums of whole stretches
(a row per partition and source) are added up in order, and together they give the exact prefix sum of each
document in its source. A source's budget is cut at that sum: `full` whole epochs and, of one more epoch, the
documents whose prefix sum is within what is left.

The total size is the largest at which every source that has tokens can deliver its share with at most
max_repeats uses of a document; shares of sources without tokens are spread over the others in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.tokenizing import count_column
from corpusweave.runtime import spread, written


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix sums by source along one sorted partition."""
    pid, source, so_far = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        names, tokens = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
        sums = np.empty(len(names), np.int64)
        i = 0
        while i < len(names):
            j = i
            while j < len(names) and names[j] == names[i]:
                j += 1
            if names[i] != source:
                source, so_far = names[i], 0
            sums[i:j] = np.cumsum(tokens[i:j]) + so_far
            so_far = int(sums[j - 1])
            i = j
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(np.full(len(names), pid, np.int32)), pa.array(sums)],
            names=["doc_id", "source", "n_tokens", "pid", "prefix"],
        )


def plan(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents with how often each is used, a row per target source with its budget).

    documents (doc_id, source, text): null and unlisted sources are left out, so are null and empty texts (no
    tokens). Sources compare without regard to letter case. A repeated doc_id counts as a document of its own.
    targets (source, target_share, max_repeats): null shares and repeats count as 0.
    total: tokens wanted; by default, and at most, what the tightest source allows.
    """
    goals = targets.groupBy(F.lower("source").alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("long").alias("max_repeats")
    ).where("source is not null")
    docs = documents.select("doc_id", F.lower("source").alias("source"), "text").where("text is not null and text <> '' and source is not null")
    docs = docs.join(goals.select("source"), "source", "left_semi").select("doc_id", "source", "text")
    counted = written(count_column(spread(docs), "text"), "mix-counts")
    tokens = counted.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("documents"))
    every = Window.partitionBy()  # one row per target
    budgets = (
        goals.join(tokens, "source", "left")
        .withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumn("documents", F.coalesce("documents", F.lit(0)))
        .withColumn("live", F.when((F.col("target_share") > 0) & (F.col("source_tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0))
        .withColumn("weight", F.when(F.sum("live").over(every) > 0, F.col("live") / F.sum("live").over(every)).otherwise(0.0))
        .withColumn("most", F.min(F.when(F.col("weight") > 0, F.floor(F.col("source_tokens") * F.col("max_repeats") / F.col("weight")))).over(every))
        .withColumn("total", F.coalesce(F.least("most", F.lit(total)) if total is not None else F.col("most"), F.lit(0)))
        .withColumn("budget", F.least(F.floor(F.col("weight") * F.col("total")), F.col("source_tokens") * F.col("max_repeats")))
        .withColumn("full", F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("source_tokens"))
        .drop("live", "most")
    )
    budgets = written(budgets.coalesce(1), "mix-budgets")
    ordered = counted.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    schema = T.StructType([counted.schema["doc_id"], counted.schema["source"], T.StructField("n_tokens", T.LongType()), T.StructField("pid", T.IntegerType()), T.StructField("prefix", T.LongType())])
    local = written(ordered.select("doc_id", "source", "n_tokens").mapInArrow(_prefix, schema), "mix-prefix")
    stretches = local.groupBy("source", "pid").agg(F.sum("n_tokens").alias("stretch"))
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select("source", "pid", F.coalesce(F.sum("stretch").over(before), F.lit(0)).alias("offset"))
    used = (
        local.join(offsets, ["source", "pid"])
        .join(budgets.select("source", "full", "rest"), "source")
        .withColumn("uses", (F.col("full") + F.when(F.col("prefix") + F.col("offset") <= F.col("rest"), 1).otherwise(0)).cast("int"))
        .where("uses > 0")
        .select("doc_id", "source", "n_tokens", "uses")
    )
    return used, budgets


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """A row for each use of a document in the mix: (doc_id, source, repeat_no from 1, n_tokens)."""
    used, _ = plan(documents, targets, total, seed)
    return used.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("repeat_no"), "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """A row per target source: what it was to make up of the mix, and what it does."""
    used, budgets = plan(documents, targets, total, seed)
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("uses"), F.max("uses").alias("most_repeats"))
    every = Window.partitionBy()
    return budgets.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "source_tokens", "budget",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.coalesce("tokens", F.lit(0)) / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)).alias("actual_share"),
    )
