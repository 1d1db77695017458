"""One consistent form for text that looks the same: widths, combining accents, invisible characters, blanks, look-alike letters.

Most text is stable: by the normalization quick-check property of its characters it can't change. A scan isolates the unstable
segments (characters that fail the quick check or that have a fold, each with the combining marks behind it and the base
character before it, its boundary context), folds and composes those alone, and splices them into the unchanged rest.

Two forms: `canonical` keeps words of other scripts and maps look-alike letters only inside words that otherwise are Latin;
`skeleton`, for comparing, maps every look-alike letter. Letter case, line breaks, the number of blanks, and every visible
difference (superscripts, fractions, other letters) stay.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.runtime import spread, written

# Letters of other scripts that are drawn like Latin ones, in pairs.
LETTERS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ɡ": "g", "ɑ": "a", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
}
# More of them for comparing alone, where a word of its own script can't be spoiled: Greek, dotless i, Cherokee, small capitals.
MORE = {
    "α": "a", "ι": "i", "ρ": "p", "υ": "u", "ı": "i", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
# Characters that are not seen (zero-width, joiners, soft hyphen, direction marks, byte order mark).
UNSEEN = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# Hyphens drawn like the ordinary one.
HYPHENS = "‐‑﹣－"
#: Kinds of compatibility decomposition that don't show: width, no-break, typeface. Ligatures of Latin letters are added.
KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>")


@functools.lru_cache(maxsize=1)
def folds() -> dict[str, str]:
    """What becomes of a character by itself, apart from look-alike letters; from the character database.

    Variation selectors and the fillers of Hangul are not seen either.
    """
    out = dict.fromkeys(UNSEEN + "".join(map(chr, [*range(0xFE00, 0xFE10), 0x115F, 0x1160, 0x3164, 0xFFA0])), "") | dict.fromkeys(HYPHENS, "-")
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        if c in out:
            continue
        kind = unicodedata.decomposition(c).split(" ", 1)[0]
        if kind in KINDS or "ﬀ" <= c <= "ﬆ":
            out[c] = unicodedata.normalize("NFKC", c)
        elif unicodedata.category(c) == "Zs":
            out[c] = " "
    return out


@functools.lru_cache(maxsize=4)
def _unstable(letters: str) -> regex.Pattern:
    """Segments that may change: characters that fail the quick check or have a fold, and marks whose order may not be the canonical one."""
    own = "".join(folds()) + letters
    u = rf"[\p{{NFC_Quick_Check=No}}\p{{NFC_Quick_Check=Maybe}}{regex.escape(own, special_only=True)}]"
    return regex.compile(rf"(?:\P{{M}}?\p{{M}}*)(?:{u}\p{{M}}*)+|\P{{M}}?\p{{M}}{{2,}}")


_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_OTHER = regex.compile("[" + "".join(LETTERS) + "]")


def _word(m: regex.Match) -> str:
    w = m.group()
    if not _OTHER.search(w):
        return w
    rest = _OTHER.sub("", w)
    if not regex.search(r"\p{Latin}", rest) or regex.search(r"[\p{Greek}\p{Cyrillic}\p{Armenian}]", rest):
        return w
    return "".join(LETTERS.get(c, c) for c in w)


def _spliced(line: str, letters: bool, more: bool = False) -> str:
    f = all_folds(more) if letters else folds()
    return _unstable("".join(LETTERS | (MORE if more else {})) if letters else "").sub(lambda m: unicodedata.normalize("NFC", "".join([f.get(c, c) for c in m.group()])), line)


def _by_line(text: str | None, form) -> str | None:
    """Only lines with characters beyond ASCII are scanned: nothing composes over a line feed."""
    if not text or text.isascii():
        return text
    return "\n".join([x if x.isascii() else form(x) for x in text.split("\n")])


def _canonical(line: str) -> str:
    line = _spliced(line, False)
    return _WORD.sub(_word, line) if _OTHER.search(line) else line


def canonical(text: str | None) -> str | None:
    """The consistent form; null stays null, ASCII stays as it is."""
    return _by_line(text, _canonical)


@functools.lru_cache(maxsize=2)
def all_folds(more: bool = False) -> dict[str, str]:
    """Folds and look-alike letters."""
    return folds() | LETTERS | (MORE if more else {})


def skeleton(text: str | None, more: bool = True) -> str | None:
    """The form for comparing: equal for texts that look the same."""
    return _by_line(text, lambda line: _spliced(line, True, more))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, looks, own): digests of the form for comparing and of the string, of rows of which another looks the same and is another string."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            looks = [_digest(skeleton(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(looks, pa.binary()), pa.array([_digest(t) for t in texts], pa.binary())], names=["id", "looks", "own"])

    rows = written(spread(df.select(key, text).where(f"{key} is not null and {text} <> ''")).mapInArrow(run, f"id {kind}, looks binary, own binary").distinct(), "looks")
    several = rows.groupBy("looks").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("looks")
    return rows.join(several, "looks").select("id", "looks", "own")


def same_looking(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look the same and yet differ. Null and empty texts are left out, repeated rows count once.

    Only digests are shuffled. Different strings are paired first, and then each side of a pair is expanded to its rows: so copies of one
    string never meet, and what is examined is in proportion to the result.
    """
    rows = _looks(df, key, text)
    strings = rows.select("looks", "own").distinct()
    pairs = strings.withColumnRenamed("own", "a").join(strings.withColumnRenamed("own", "b"), "looks").where("a < b").select("a", "b")
    one = pairs.join(rows.select(F.col("own").alias("a"), F.col("id").alias("x")), "a")
    both = one.join(rows.select(F.col("own").alias("b"), F.col("id").alias("y")), "b").where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def look_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class_id, string_id): a row for each row whose text looks like another string; the least ids with its looks and with its string."""
    rows = _looks(df, key, text)
    strings = rows.groupBy("looks", "own").agg(F.min("id").alias("string_id"))
    classes = strings.groupBy("looks").agg(F.min("string_id").alias("class_id"))
    return rows.join(strings, ["looks", "own"]).join(classes, "looks").select("id", "class_id", "string_id")


def with_canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns (strings) in their consistent form."""
    rest = [c for c in df.columns if c not in columns]
    schema = df.select(*rest, *columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [pa.array([canonical(t) for t in c.to_pylist()], pa.string()) for c in b.columns[len(rest) :]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *new], names=[*rest, *columns])

    return spread(df.select(*rest, *columns)).mapInArrow(run, schema)
