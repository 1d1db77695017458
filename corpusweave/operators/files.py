"""File tables: released files, duplicates, upserts, snapshot diffs by hash, folder digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import text as T

IGNORED = ("src/test",)


def is_ignored(path: Column, ignored: Sequence[str] = IGNORED) -> Column:
    """Is any of the entries part of the path? Backslashes count as slashes on both sides."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for entry in ignored:
        hit = hit | F.contains(slashes, F.lit(entry.replace("\\\\", "/").replace("\\", "/")))
    return hit


def release_status(files: DataFrame, path: str = "file_path", ignored: Sequence[str] = IGNORED) -> DataFrame:
    return files.withColumn("is_released", ~is_ignored(F.col(path), ignored))


def scan_counts(files: DataFrame, path: str = "file_path", ignored: Sequence[str] = IGNORED) -> DataFrame:
    """One row (total_files, released_files), also of an empty table."""
    return files.agg(F.count("*").alias("total_files"), F.count_if(~is_ignored(F.col(path), ignored)).alias("released_files"))


def upsert(files: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """The last row of each key; of rows that tie in `order` the greatest `tie`. A partial aggregate, no sort."""
    rest = [c for c in files.columns if c not in keys]
    last = files.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*files.columns)


def remove(files: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key is not among `keys`; rows with a null key stay."""
    return files.join(keys.select(*on).distinct(), list(on), "left_anti")


def lookup(files: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key is among `keys`; null keys find nothing."""
    return files.join(keys.select(*on).distinct(), list(on), "left_semi")


def hashed(files: DataFrame, content: str = "content", column: str = "file_hash", algorithm: str = "sha256") -> DataFrame:
    """Hashes for the rows that have none (null or empty); others keep theirs, and their content isn't looked at."""
    missing = F.coalesce(F.col(column), F.lit("")) == ""
    return files.withColumn(column, F.when(missing, T.digest(F.when(missing, F.col(content)), algorithm)).otherwise(F.col(column)))


def new_or_changed(old: DataFrame, new: DataFrame, column: str = "file_hash") -> DataFrame:
    """Rows of `new` whose hash `old` lacks; rows without a hash (null or empty) always, once each."""
    known = old.where(F.col(column) != "").select(F.lower(column).alias("_hash_to_compare")).distinct()
    return new.withColumn("_hash_to_compare", F.lower(F.nullif(F.col(column), F.lit("")))).join(known, "_hash_to_compare", "left_anti").drop("_hash_to_compare")


def removed(old: DataFrame, new: DataFrame, column: str = "file_hash") -> DataFrame:
    """Rows of `old` whose hash `new` lacks."""
    return new_or_changed(new, old, column)


def duplicates(files: DataFrame, content: str = "file_content", key: str = "file_id") -> DataFrame:
    """(digest, copies, first_id) of contents that occur more than once; null content is left out."""
    return files.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def exclude(files: DataFrame, path: str, folders: Sequence[str]) -> DataFrame:
    """Without the subtrees of the given folders (relative paths)."""
    for folder in folders:
        prefix = folder.strip("/") + "/"
        files = files.where(~F.col(path).startswith(prefix))
    return files


def folder_digests(files: DataFrame, folder: str, path: str, content: str, by_level: bool = False, name: bool = True) -> DataFrame:
    """(folder, digest): SHA-256 over the files of each folder in order: path, a zero byte, content.

    Files are sorted by whole path, or by_level as a walk gives them: a folder's own files before its subfolders. Without
    `name` only contents count. Rows stream through one hash a folder in sorted order, so a folder's size is no matter of memory:
    its files are sorted by the shuffle, and the hash is carried from batch to batch.
    """
    parts = F.split(path, "/")
    order = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p)), "\x01") if by_level else F.col(path)
    rows = files.where(F.col(folder).isNotNull() & F.col(path).isNotNull()).select(
        F.col(folder).alias("folder"), order.alias("order"), F.col(path).alias("path"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")
    )
    kind = rows.schema["folder"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for frame in frames:
            done = []
            for f, p, c in zip(frame.folder, frame.path, frame.content):
                if f != now:
                    if h:
                        done.append((now, h.hexdigest()))
                    now, h = f, hashlib.sha256()
                if name:
                    h.update(p.encode() + b"\0")
                h.update(bytes(c))
            yield pd.DataFrame(done, columns=["folder", "digest"])
        yield pd.DataFrame([(now, h.hexdigest())] if h else [], columns=["folder", "digest"])

    ordered = rows.repartition("folder").sortWithinPartitions("folder", "order", F.sha2("content", 256)).select("folder", "path", "content")
    return ordered.mapInPandas(run, f"folder {kind}, digest string")


def folder_fingerprints(files: DataFrame, folder: str, path: str, content: str) -> DataFrame:
    """(folder, files, fingerprint): SHA-256 over the sums of what each file's SHA-256 (of path, a zero byte, content's digest) holds.

    It tells the same folders apart as an ordered digest, whatever the order of files, but no content is shuffled and partial sums meet,
    so a folder that holds a third of all files is no hot task. Null content counts as empty.
    """
    one = F.sha2(F.concat(F.col(path), F.lit("\0"), F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256)), 256)
    rows = files.where(F.col(folder).isNotNull() & F.col(path).isNotNull()).select(F.col(folder).alias("folder"), one.alias("one"))
    sums = [F.sum(F.conv(F.substring("one", 1 + 15 * k, 15), 16, 10).cast("decimal(28,0)")).cast("string").alias(f"s{k}") for k in range(4)]  # 60 bits each
    by = rows.groupBy("folder").agg(F.count("*").alias("files"), *sums)
    return by.select("folder", "files", F.sha2(F.concat_ws("|", F.col("files").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))
