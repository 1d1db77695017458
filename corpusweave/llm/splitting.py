"""Cutting oversized texts at natural boundaries by bounded-quantifier regular expressions over their tokens.

A text over the limit becomes a string of units, one character a token, that names the strongest boundary after the
token: H before a heading, P paragraph, L line, S sentence, W word, C any other whole character, x none (inside a
character), E the end. One regular expression takes the pieces from that string: its alternatives, by strength,
consume up to the limit and end at their boundary; the last falls back to characters. Overlap is a lookback by a
second expression over the units before a piece. Both, and the offsets, are SQL array functions. Text and units also come as arrays of
chunks of a fixed length, and a piece is put together from the few chunks it lies in: what a piece costs doesn't
depend on how far into the text it is, and the work grows with the text, not with its square.

H to W are boundaries of pre-tokens, and C cuts inside one keep the tokens on either side as they are; so the tokens
of a piece, encoded on its own, are its units, and no piece has to be encoded again.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.tokenizing import TOKENIZERS, encode_all, encoding
from corpusweave.runtime import spread

#: Characters and units in a chunk, and pieces whose places are summed up together.
CHUNK, BLOCK = 4096, 256

# Blanks and line ends at a cut go with what follows: there they are the pre-tokens that they are in the whole text, while
# behind a cut's last word they would be read as one. So a boundary lies where a run of blanks begins, and its strength is what the
# run holds: no line end, one, several, or several and a heading behind it.
_HEADING = re.compile(r"^(?=#{1,6} \S|[^\n]{1,80}\n(?:={3,}|-{3,})$)", re.M)
# Bits of a character's class: white space, the end of a sentence before white space, and the end anywhere.
_BLANK, _STOP, _FULL_STOP = 1, 2, 4
_CLASS = np.zeros(0x10000, np.uint8)
_CLASS[[c for c in range(0x3001) if chr(c).isspace()]] = _BLANK
_CLASS[[ord(c) for c in ".!?…"]] = _STOP
_CLASS[[ord(c) for c in "。！？"]] = _STOP | _FULL_STOP


@functools.lru_cache(maxsize=4)
def _lengths(name: str, folder: str) -> np.ndarray:
    """Bytes of each token."""
    enc = encoding(name, folder)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def _marks(text: str) -> list[tuple[str, np.ndarray]]:
    """(kind, where in characters) of the boundaries of a text, the weakest kind first."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    of = _CLASS[np.minimum(c, 0xFFFF)]
    blank = of == _BLANK
    starts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.append(ends[ends > (starts[0] if len(starts) else 0)], len(c))[: len(starts)]
    feeds = np.concatenate([[0], np.cumsum(c == 10)])
    lines = feeds[ends] - feeds[starts]
    stops = np.flatnonzero((of[:-1] & _FULL_STOP > 0) & (of[1:] == 0)) + 1
    stops = stops[[text[i].isalnum() for i in stops]] if len(stops) else stops
    heads = np.fromiter((m.start() for m in _HEADING.finditer(text)), np.int64) if "#" in text or "\n===" in text or "\n---" in text else np.empty(0, np.int64)
    sentence = np.concatenate([starts[of[starts - 1] & _STOP > 0], stops])
    return [("W", starts), ("S", sentence), ("L", starts[lines >= 1]), ("P", starts[lines >= 2]), ("H", starts[(lines >= 1) & np.isin(ends, heads)])]


def units(text: str, ids: list[int], lengths: np.ndarray) -> tuple[str, np.ndarray]:
    """(a character a token, the end of each token in characters)."""
    raw = np.frombuffer(text.encode() + b" ", np.uint8)
    ends = np.cumsum(lengths[ids])
    kinds = np.full(len(ids), ord("C"), np.uint8)
    kinds[raw[ends] == ord("'")] = ord("x")  # a contraction would be read anew there
    if not text.isascii():
        starts = (raw & 0xC0) != 0x80
        whole = starts[ends]
        ends = np.cumsum(starts)[ends] - 1
        kinds[~whole] = ord("x")
    else:
        whole = np.ones(len(ids), bool)
    at = np.full(len(text) + 1, 0, np.uint8)
    for kind, where in _marks(text):
        at[where] = ord(kind)
    strong = at[ends]
    kinds = np.where((strong > 0) & whole, strong, kinds)
    kinds[-1] = ord("E")
    return kinds.astype(np.uint8).tobytes().decode("latin-1"), ends


def pieces_pattern(body: int) -> str:
    """Alternatives by strength; all but the weakest ask for a quarter of the limit, so that pieces don't get tiny."""
    least = body // 4
    strong = "|".join(f".{{{least - 1},{body - 1}}}[{kinds}]" for kinds in ("H", "HP", "HPL", "HPLS"))
    return f".{{0,{body - 1}}}E|{strong}|.{{0,{body - 1}}}[HPLSW]|.{{0,{body - 1}}}[^x]|.{{1,{body}}}"


def _chunks(text: str) -> list[str]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def _cut(chunks: str, start: Column, end: Column) -> Column:
    """The characters [start, end) of a text that comes in chunks; end is above start, or both are 0."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor(F.greatest(end - 1, F.lit(0)) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, end - start)


def _sums(numbers: Column, start: Column) -> Column:
    """start, and the sums up to each of the numbers."""
    return F.aggregate(numbers, F.array(start), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))


def split(df: DataFrame, limit: int = 512, overlap: int = 32, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """A row for each piece of each text of more than `limit` tokens.

    Columns: key, piece_no (from 0), start_char, end_char (of the text, end excluded), overlap_tokens (units repeated
    from the piece before), n_tokens, boundary (the unit the piece ends with) and piece. Together the pieces without their
    overlaps are the text. Null, empty and shorter texts give no rows. `limit` must be at least 2 * overlap + 16.
    """
    if limit < 2 * overlap + 16 or overlap < 0:
        raise ValueError("limit must be at least 2 * overlap + 16, overlap at least 0")
    kind = df.schema[key].dataType
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(key, kind), T.StructField("units", T.StringType()), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("texts", strings), T.StructField("unit_chunks", strings)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(name, folder), _lengths(name, folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            at, strings, ends, chunks, unit_chunks = [], [], [], [], []
            # a token has at least one byte: a text of at most `limit` bytes isn't longer than `limit` tokens
            long = [i for i, t in enumerate(texts) if t and (len(t) > limit or len(t) * 4 > limit and len(t.encode()) > limit)]
            for i, ids in zip(long, encode_all(enc, [texts[i] for i in long])):
                if len(ids) > limit:
                    u, e = units(texts[i], ids, lengths)
                    at.append(i), strings.append(u), ends.append(e.astype(np.int32)), chunks.append(_chunks(texts[i])), unit_chunks.append(_chunks(u))
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(strings, pa.string()), pa.array(ends, pa.list_(pa.int32())), pa.array(chunks, lists), pa.array(unit_chunks, lists)], names=[key, "units", "ends", "texts", "unit_chunks"]
            )

    long = spread(df.select(key, text)).where(f"{text} is not null").mapInArrow(run, schema)
    body = limit - overlap
    parts = F.regexp_extract_all("units", F.lit(f"(?s){pieces_pattern(body)}"), F.lit(0))
    long = long.select(key, "ends", "texts", "unit_chunks", parts.alias("parts"))
    sizes = F.transform("parts", F.length)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("sizes") / BLOCK).cast("int") - 1), lambda k: F.slice("sizes", k * BLOCK + 1, F.lit(BLOCK)))
    long = long.withColumn("sizes", sizes).withColumn("blocks", blocks)
    long = long.withColumn("before", _sums(F.transform("blocks", lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x)), F.lit(0)))
    inner = F.zip_with("blocks", F.slice("before", 1, F.size("blocks")), lambda b, o: F.slice(_sums(b, o), 2, F.size(b)))
    long = long.select(key, "ends", "texts", "unit_chunks", "parts", F.concat(F.array(F.lit(0)), F.flatten(inner)).alias("cuts"))

    def row(k):
        first, last = F.element_at("cuts", k + 1), F.element_at("cuts", k + 2)
        # behind the earliest word or stronger boundary among the units that may be repeated, else the earliest character
        from_u = F.greatest(first - overlap - 1, F.lit(0))
        tail = _cut("unit_chunks", from_u, first)
        kinds = F.when(tail.rlike("[HPLSW]"), "[HPLSW](.*)$").otherwise("[^x](.*)$")
        back = F.when((k == 0) | ~tail.rlike("[^x]"), 0).otherwise(F.length(F.call_function("regexp_extract", tail, kinds, F.lit(1))))
        start_u = first - back
        start = F.when(start_u > 0, F.element_at("ends", F.greatest(start_u, F.lit(1)))).otherwise(0)
        end = F.element_at("ends", last)
        return F.struct(
            k.alias("piece_no"), start.alias("start_char"), end.alias("end_char"), back.alias("overlap_tokens"), (last - start_u).alias("n_tokens"),
            F.right(F.element_at("parts", k + 1), F.lit(1)).alias("boundary"), _cut("texts", start, end).alias("piece"),
        )

    return long.select(key, F.inline(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), row)))
