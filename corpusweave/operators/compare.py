"""Differences between two copies of a keyed dataset, by shared key ordinals and compressed presence bitmaps.

Every key of either side gets an ordinal (bucket, position): the bucket by hash, the position by rank among the distinct
keys of the bucket. A side's presence in a bucket is a bitmap over the positions, kept as (word, 64 bits) rows, of
which empty words are absent. AND-NOT of the two bitmaps yields the rows missing on either side; their intersection
drives the comparison, ordinal by ordinal, of the compared columns, which both sides hold in the same (bucket, position)
order. There are 64 buckets for each shuffle partition, which the session sizes to its input; a task sorts one bucket's keys at a time, with spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one word of a bitmap.
WORD = 64


def latest(df: DataFrame, keys: Sequence[str], by: str, fields: Sequence[str]) -> DataFrame:
    """One row for each key: the row with the greatest `by` (a partial aggregate, no sort and no window).

    Of rows that tie in `by` the greatest in the order of the fields counts, so that the choice is always the same;
    nulls come first in that order.
    """
    row = F.struct(F.col(by).alias("_by"), *[F.struct(F.col(f).isNotNull().alias("there"), F.col(f).alias("value")).alias(f"_{i}") for i, f in enumerate(fields)])
    got = df.groupBy(*keys).agg(F.max(row).alias("_r"))
    return got.select(*keys, *[F.col(f"_r._{i}.value").alias(f) for i, f in enumerate(fields)])


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: dict[str, Column], left_name: str = "left", right_name: str = "right", buckets: int | None = None) -> DataFrame:
    """(keys..., difference): 'missing_in_<name>', or a row for each field whose values differ.

    Both sides hold one row for each key (see latest). fields maps the name of a field to what is compared of it, over the
    columns of either side; null equals null and differs from every value. Keys may be null: null is a key like any
    other. Two empty sides give no rows. Other columns, whatever their names, are ignored.
    """
    spark = left.sparkSession
    buckets = buckets or 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(fields)

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"), F.lit(is_left).alias("_left"), F.struct(*keys).alias("_key"),
            F.struct(*[fields[n].alias(f"f{i}") for i, n in enumerate(names)]).alias("_value"),
        )

    ordinals = side(left, True).unionByName(side(right, False)).withColumn("_pos", F.dense_rank().over(Window.partitionBy("_bucket").orderBy("_key")) - 1)
    bit = (F.col("_pos") % WORD).cast("int")
    words = ordinals.select("_bucket", (F.col("_pos") / WORD).cast("int").alias("_word"), "_left", bit.alias("_bit"), "_key", "_value").withColumn("_set", F.expr("shiftleft(1L, _bit)"))
    row = F.struct("_bit", "_key", "_value")
    columns = words.groupBy("_bucket", "_word").agg(
        F.expr("coalesce(bit_or(_set) FILTER (WHERE _left), 0L)").alias("l"), F.expr("coalesce(bit_or(_set) FILTER (WHERE NOT _left), 0L)").alias("r"),
        F.array_sort(F.collect_list(F.when(F.col("_left"), row))).alias("in_l"), F.array_sort(F.collect_list(F.when(~F.col("_left"), row))).alias("in_r"),
    )

    def chosen(rows: str, bits: str) -> Column:
        return F.filter(F.expr(rows), lambda x: F.expr(bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), x["_bit"])) != 0)

    def missing(rows: str, bits: str, name: str) -> Column:
        return F.transform(chosen(rows, bits), lambda x: F.struct(x["_key"].alias("key"), F.lit(f"missing_in_{name}").alias("difference")))

    def unequal(a: Column, b: Column) -> Column:
        found = F.array(*[F.when(~a["_value"][f"f{i}"].eqNullSafe(b["_value"][f"f{i}"]), F.lit(n)) for i, n in enumerate(names)])
        return F.transform(F.array_compact(found), lambda n: F.struct(a["_key"].alias("key"), n.alias("difference")))

    both = F.flatten(F.zip_with(chosen("in_l", "l & r"), chosen("in_r", "l & r"), unequal))
    rows = columns.select(F.explode(F.concat(missing("in_l", "l & ~r", right_name), missing("in_r", "r & ~l", left_name), both)).alias("_d"))
    return rows.select(*[F.col(f"_d.key.{k}").alias(k) for k in keys], F.col("_d.difference").alias("difference"))
