"""Tokens with their places, and word n-grams, by array functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in an anchor, and in a block of a text whose places are summed up.
ANCHOR, BLOCK = 4, 512


def tokens(text: Column) -> Column:
    """Words of a normalised (single-spaced) text; the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def with_spans(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., pos, word, norm, start_char, end_char): a row for each token; ends excluded, characters are code points.

    Words are bound to a column and cut into blocks of BLOCK; places are sums over a block and over the blocks before, so
    the work grows with the text, not with its square.
    """
    words = df.where(f"{text} is not null and {text} <> ''").select(*keep, F.split(text, " ").alias("_w"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_w") / BLOCK).cast("int") - 1), lambda k: F.slice("_w", k * BLOCK + 1, F.lit(BLOCK)))
    words = words.select(*keep, blocks.alias("_b"))
    sums = F.aggregate("_b", F.array(F.lit(0)), lambda done, b: F.concat(done, F.array(F.element_at(done, -1) + F.length(F.array_join(b, " ")) + 1)))
    rows = words.select(*keep, "_b", sums.alias("_s")).select(*keep, "_s", F.posexplode("_b").alias("_k", "_w"))
    inner = F.aggregate("_w", F.array(F.lit(0)), lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + F.length(w) + 1)))
    rows = rows.select(*keep, "_k", "_w", F.element_at("_s", F.col("_k") + 1).alias("_o"), inner.alias("_i")).select(*keep, "_k", "_o", "_i", F.posexplode("_w").alias("_p", "word"))
    start = F.col("_o") + F.element_at("_i", F.col("_p") + 1)
    return rows.select(*keep, (F.col("_k") * BLOCK + F.col("_p")).alias("pos"), "word", F.lower("word").alias("norm"), start.alias("start_char"), (start + F.length("word")).alias("end_char"))


def anchors(words: Column, n: int = ANCHOR) -> Column:
    """Every run of n words, joined by blanks, in order; none if there are fewer. `words` must be a bound column."""
    runs = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(words, k + 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return runs


def anchor_rows(df: DataFrame, words: str, keep: list[str], n: int = ANCHOR) -> DataFrame:
    """(keep..., pos, gram)."""
    return df.where(F.size(words) >= n).select(*keep, F.posexplode(anchors(F.col(words), n)).alias("pos", "gram"))


def anchor_index(df: DataFrame, words: str, keep: list[str], n: int = ANCHOR) -> DataFrame:
    """(keep..., gram, positions): the inverted index of each row, made in its own batch; rows with fewer words than n have none."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("gram", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, grams, places = [], [], []
            for k, w in enumerate(b.column(len(keep)).to_pylist()):
                index: dict[str, list[int]] = {}
                for i, gram in enumerate(map(" ".join, zip(*(w[j:] for j in range(n))))):
                    index.setdefault(gram, []).append(i)
                at += [k] * len(index)
                grams += index
                places += index.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in b.columns[: len(keep)]], pa.array(grams, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=schema.names)

    whole = df.where(F.size(words) >= n).select(*keep, F.transform(words, lambda w: F.coalesce(w, F.lit(""))).alias("_w"))
    return whole.mapInArrow(run, schema)
