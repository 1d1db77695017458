"""Connected components of a graph of any size, by alternating large and small stars over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusweave.runtime import free, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star: every node gets linked to the least node it knows of."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return small.where("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and checksum, observed while they are written."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum"))
    table = written(marked, "edges")
    return table, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its least node.

    edges (a, b) of any order; repeated edges and loops do no harm, rows with a null are left out. No edges give no rows.
    known: the components of further edges, from an earlier call. The number of rounds grows with the logarithm of the longest
    path; nothing is collected but counts.
    """
    if known is not None:
        edges = edges.select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    nodes = edges.where("a is not null and b is not null and a = b").select("a").distinct()
    edges, now = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while now != mark and now[0]:
        mark, old = now, edges
        edges, now = _written(_stars(old))
        free(old)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    alone = nodes.select(F.col("a").alias("node")).join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
