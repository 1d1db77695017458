"""Encoding with a public byte-level BPE tokenizer.

Short pre-tokens go through the library. A pre-token longer than LEAF bytes (text without any break) is
encoded by tree concatenation: its halves are encoded on their own, and windows of tokens around the join are
encoded again, each twice as wide as the last, until the window begins and ends with the very tokens that the
sides have there. A BPE sequence is the encoding of its bytes exactly if each pair of neighbours is, so agreement at
both ends of a window proves the whole.

Null and empty texts have no tokens. A special token's name in a text is ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("CORPUSWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Bytes of a pre-token from which on it is halved.
LEAF = 2048
#: Pre-token pattern of the public byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of one text from which on it is looked at for long pre-tokens.
LONG = LEAF // 4


@functools.lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tiktoken encoding; one per Python worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """Exact encoding of the bytes of two encodings of one pre-token's halves."""
    if not left or not right:
        return left + right
    k = 2
    while True:
        a, b = left[-k:], right[:k]
        again = enc._encode_single_piece(enc.decode_bytes(a + b))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]):
            return left[: len(left) - len(a)] + again + right[len(b) :]
        k *= 2


def tree(enc, piece: bytes, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """Encode one pre-token by tree concatenation; the leaves run in the pool's threads (the library frees the lock)."""
    n = max(1, -(-len(piece) // leaf))
    size = -(-len(piece) // n)
    parts = [piece[i : i + size] for i in range(0, len(piece), size)] or [b""]
    level = list((pool.map if pool else map)(enc._encode_single_piece, parts))
    while len(level) > 1:
        pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        joined = list((pool.map if pool else map)(lambda p: join(enc, *p), pairs))
        level = joined + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def encode(enc, text: str | None, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """Token ids of one text of any length."""
    if not text:
        return []
    if len(text) < LONG:
        return enc.encode_ordinary(text)
    out: list[int] = []
    done = 0
    for m in _pattern().finditer(text):
        if m.end() - m.start() >= leaf // 4 and len(raw := m.group().encode()) > leaf:
            out += enc.encode_ordinary(text[done : m.start()]) if done < m.start() else []
            out += tree(enc, raw, leaf, pool)
            done = m.end()
    return out + (enc.encode_ordinary(text[done:]) if done < len(text) else [])


def _runs(text: str) -> bool:
    """Can a text of this kind hold a pre-token of LEAF bytes? Any piece without a blank that is long enough, or blanks alone."""
    return len(text) >= LONG and (max(map(len, text.split())) if not text.isspace() else len(text)) >= LONG


def encode_all(enc, texts: list[str | None], pool: ThreadPoolExecutor | None = None) -> list[list[int]]:
    """Encode a batch; only texts that may hold a long pre-token are scanned for one."""
    return [[] if not t else encode(enc, t, pool=pool) if len(t) >= LONG and (_runs(t) or " " * LONG in t or "\n" * LONG in t) else enc.encode_ordinary(t) for t in texts]


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row; the whole text, one pass, no shuffle."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        with ThreadPoolExecutor(2) as pool:
            for b in batches:
                ids = encode_all(enc, b.column(1).to_pylist(), pool)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_column(df: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The rows of df without the text, with n_tokens beside them."""
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            n = [len(x) for x in encode_all(enc, b.column(len(rest)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    return df.select(*rest, text).mapInArrow(run, schema)
