"""Long spans of tokens that occur word for word in more than one record.

1. Content-defined chunking. A gear hash rolls over the tokens (each token shifts the last ones eight bits out, so it covers
   eight); a chunk begins where the hash is the least of some `w` consecutive ones. The rule looks at nothing but the tokens
   around, so an insertion moves only the chunks it touches, and `w` is small enough that every run of the asked length
   holds, whatever stands around it, a whole chunk that is the same in every record with that run.
2. Chunks are deduplicated by digest: those found in one record only are dropped, and with them all text that can't be
   shared.
3. What is left is decided exactly: of each record's windows of the asked length that hold a shared chunk, the 128-bit hash
   is looked up among all records'; a window found in two different records is shared, and overlapping or touching
   shared windows make one span.

Records with equal token lists are one record for 1 to 3 and shared as a whole. Digests are aggregated (least and greatest
record of each) before and while they are shuffled, so a chunk that a third of the records hold is no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.runtime import spread, written

#: Tokens that the gear hash covers: 64 bits, eight a token.
GEAR = 8
#: Odd multipliers of the polynomial hashes (fixed values, primes).
BASES = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)


def chunk_starts(tokens: np.ndarray, ends: np.ndarray, w: int) -> np.ndarray:
    """Which positions of the concatenated records (token hashes; ends of each) begin a chunk."""
    n = len(tokens)
    h = np.zeros(n, np.uint64)
    gear = tokens * np.uint64(BASES[0]) ^ tokens >> np.uint64(29)
    for j in range(GEAR):
        h[: n - j] += gear[j:] << np.uint64(8 * (GEAR - 1 - j))
    h ^= h >> np.uint64(31)
    h *= np.uint64(BASES[1])
    for j in range(1, GEAR):  # no hash reaches into the next record
        h[np.maximum(ends - j, 0)] = np.iinfo(np.uint64).max

    def sliding(f, x: np.ndarray, fill: int) -> np.ndarray:
        out, span = x, 1
        while span < w:
            step = min(span, w - span)
            out = f(out, np.concatenate([out[step:], np.full(min(step, n), fill, np.uint64)]))
            span += step
        return out

    least = sliding(np.minimum, h, np.iinfo(np.uint64).max)  # of the windows beginning at each position
    # a position begins a chunk if some window that holds it has it as its least
    best = sliding(np.maximum, least[::-1], 0)[::-1]
    return best == h


class Hasher:
    """Polynomial hashes modulo 2**64 of any stretch of an array, by prefix sums."""

    def __init__(self, tokens: np.ndarray, base: int):
        n = len(tokens)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * np.cumprod(power, dtype=np.uint64)[:n], dtype=np.uint64, out=self.sums[1:])
        power[:] = np.uint64(pow(base, -1, 2**64))
        power[0] = 1
        self.back = np.cumprod(power, dtype=np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = offsets - offsets[0]
    return values, offsets[:-1], offsets[1:]


def _chunks(length: int):
    w = max(1, (length - GEAR + 2) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, starts, ends = _flat(b.column(3))
            at = np.flatnonzero(chunk_starts(values, ends, w))
            row = np.searchsorted(ends, at, side="right")
            # a chunk reaches over the hash that begins the next one
            keep = (row[:-1] == row[1:]) & (at[1:] + GEAR <= ends[row[1:]])
            first, last, row = at[:-1][keep], at[1:][keep] + GEAR, row[:-1][keep]
            digest = Hasher(values, BASES[0])(first, last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest.view(np.int64)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array((first - starts[row]).astype(np.int32)), pa.array((last - starts[row]).astype(np.int32))],
                names=["digest", "kind", "id", "record", "first", "last"],
            )

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, starts, ends = _flat(b.column(3))
            firsts, lo, hi = _flat(b.column(4))
            lasts, _, _ = _flat(b.column(5))
            first, last = firsts.view(np.int64), lasts.view(np.int64)
            row = np.repeat(np.arange(b.num_rows), hi - lo)
            # windows from `last - length` to `first` hold the chunk; marked by +1 and -1 and summed up
            left = np.maximum(last - length, 0) + starts[row]
            right = np.minimum(first, ends[row] - starts[row] - length) + starts[row]
            good = right >= left
            marks = np.zeros(len(values) + 2, np.int32)
            np.add.at(marks, left[good], 1)
            np.add.at(marks, right[good] + 1, -1)
            at = np.flatnonzero(np.cumsum(marks) > 0)
            row = pa.array(np.searchsorted(ends, at, side="right"))
            h1, h2 = (Hasher(values, base)(at, at + length).view(np.int64) for base in BASES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), b.column(0).take(row), b.column(1).take(row), b.column(2).take(row), pa.array((at - starts[row.to_numpy()]).astype(np.int32))],
                names=["h1", "h2", "kind", "id", "record", "pos"],
            )

    return run


def shared_spans(records: DataFrame, length: int = 80) -> DataFrame:
    """(kind, id, n_tokens, start_tok, end_tok): a row for each longest stretch of shared positions of a record.

    records (kind int, id, tokens array<string>), (kind, id) unique. A position is shared if it lies in a run of `length`
    tokens that another record has too. Null and shorter lists have none; a null token equals only a null token. Positions
    are from 0, end_tok excluded. Repeated rows count once.
    """
    if length < 2 * GEAR:
        raise ValueError(f"length must be at least {2 * GEAR}")
    hashed: Column = F.transform("tokens", lambda t: F.xxhash64(F.coalesce(t, F.lit("\0null"))))
    lists = spread(records.where(F.size("tokens") >= length).select("kind", "id", "tokens")).select("kind", "id", hashed.alias("hashes"))
    lists = lists.select("kind", "id", F.xxhash64("hashes").alias("record"), "hashes", F.xxhash64(F.lit(1), "hashes").alias("check"))
    kind, key = records.schema["kind"].dataType.simpleString(), records.schema["id"].dataType.simpleString()
    same = written(lists.select("kind", "id", "record", "check", F.size("hashes").alias("n_tokens")).distinct(), "span-records")
    classes = same.groupBy("record", "check").agg(F.count("*").alias("copies"), F.min(F.struct("kind", "id")).alias("one"))
    same = same.join(classes, ["record", "check"])
    whole = same.where("copies > 1").select("kind", "id", "n_tokens", F.lit(0).alias("start_tok"), F.col("n_tokens").alias("end_tok"))
    ones = same.where("one.kind = kind and one.id = id").select("kind", "id", "copies", "n_tokens")

    chunks = written(lists.select("kind", "id", "record", "hashes").mapInArrow(_chunks(length), f"digest long, kind {kind}, id {key}, record long, first int, last int"), "span-chunks")
    shared = chunks.groupBy("digest").agg(F.min("record").alias("least"), F.max("record").alias("most")).where("least <> most").select("digest")
    at = chunks.join(shared, "digest").groupBy("kind", "id").agg(F.collect_list(F.struct("first", "last")).alias("at"))
    to_long = lambda f: F.transform(F.col("at"), lambda x: x[f].cast("long"))
    candidates = at.join(ones.select("kind", "id"), ["kind", "id"]).select("kind", "id", to_long("first").alias("firsts"), to_long("last").alias("lasts"))
    windows = written(
        lists.join(candidates, ["kind", "id"]).select("kind", "id", "record", "hashes", "firsts", "lasts")
        .mapInArrow(_windows(length), f"h1 long, h2 long, kind {kind}, id {key}, record long, pos int"),
        "span-windows",
    )
    found = windows.groupBy("h1", "h2").agg(F.min("record").alias("least"), F.max("record").alias("most")).where("least <> most").select("h1", "h2")
    starts = windows.join(found, ["h1", "h2"]).groupBy("kind", "id").agg(F.array_sort(F.collect_list("pos")).alias("starts"))
    # a stretch begins where the window before ended earlier, and ends with the last window before the next beginning
    n = F.size("starts")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.col("starts")[i] > F.col("starts")[F.greatest(i - 1, F.lit(0))] + length))
    spans = starts.select("kind", "id", "starts", begins.alias("b")).select(
        "kind", "id",
        F.explode(F.transform("b", lambda i, k: F.struct(
            F.col("starts")[i].alias("start_tok"),
            (F.when(k + 1 < F.size("b"), F.element_at("starts", F.get("b", k + 1))).otherwise(F.element_at("starts", -1)) + length).alias("end_tok")))).alias("s"),
    )
    partial = spans.join(ones.where("copies = 1").select("kind", "id", "n_tokens"), ["kind", "id"]).select("kind", "id", "n_tokens", "s.start_tok", "s.end_tok")
    return whole.unionByName(partial)


def shares(records: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, id, n_tokens, shared_tokens, shared_percent) of every record; 0 percent where there are no tokens."""
    got = spans.groupBy("kind", "id").agg(F.sum(F.col("end_tok") - F.col("start_tok")).alias("shared_tokens"))
    n = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0))
    return records.select("kind", "id", n.alias("n_tokens")).join(got, ["kind", "id"], "left").select(
        "kind", "id", "n_tokens", F.coalesce("shared_tokens", F.lit(0)).alias("shared_tokens"),
        F.when(F.col("n_tokens") > 0, F.coalesce("shared_tokens", F.lit(0)) * 100.0 / F.col("n_tokens")).otherwise(0.0).alias("shared_percent"),
    )
