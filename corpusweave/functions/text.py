"""Scalar text functions as Column expressions; Python only for what no built-in expression has, on the rows that need it."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Runs of control characters but tab, line feed and carriage return; runs of literal \xNN.
CONTROL = r"[\x00-\x08\x0B-\x0C\x0E-\x1F]+"
HEX_ESCAPE = r"(?:\\x[0-9A-Fa-f]{2})+"
#: ASCII punctuation, but dots between two digits; one expression, as removing the others first would join "1.-2" to "1.2".
PUNCTUATION = r"""[!"#$%&'()*+,\-/:;<=>?@\[\\\]^_`{|}~]|(?<![0-9])\.|\.(?![0-9])"""
#: What counts as white space: the Unicode kinds and the four separators.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
NUMBER = r"\d+(?:\.\d+)?"
VERSION = r"(?i)(?:\bversion\s+|\bv\.?\s*|\blicense\s+)(\d+(?:\.\d+)?)"


def clean_control(text: Column) -> Column:
    """Runs of control characters and of literal \\xNN become one blank each; null stays null."""
    return F.regexp_replace(F.regexp_replace(text, CONTROL, " "), HEX_ESCAPE, " ")


def strip_punctuation(text: Column) -> Column:
    """ASCII punctuation removed, dots between digits kept; a backslash-escaped `&.` counts as a dot."""
    return F.regexp_replace(F.regexp_replace(text, r"\\&\.", "."), PUNCTUATION, "")


_SIGNS = re.compile(r"[!-\-/:-@\[-`{-~]+|\.")


def _strip(s: str) -> str:
    """Punctuation for text beyond ASCII, where digits of any script keep a dot."""
    s = s.replace("\\&.", ".")

    def one(m: re.Match) -> str:
        a, b = m.span()
        return "." if m.group() == "." and 0 < a and b < len(s) and s[a - 1].isdigit() and s[b].isdigit() else ""

    return _SIGNS.sub(one, s)


def _fold(s: str) -> str:
    s = unicodedata.normalize("NFKC", s)
    if marks := [c for c in set(s) if unicodedata.category(c)[0] == "M"]:
        s = s.translate(dict.fromkeys(map(ord, marks)))
    return " ".join(s.casefold().split())


@F.pandas_udf(StringType())
def _normalized(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _fold(_strip(x)))


@F.pandas_udf(StringType())
def _compared(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _fold(x))


@functools.lru_cache(maxsize=1)
def _plain_class() -> str:
    """Characters, as ranges, on which compatibility forms, marks and digits have no say and whose case is folded by lower(); sharp s too.

    From the character database, for the blocks of Latin, Greek, Cyrillic, kana, ideographs and general punctuation.
    """

    def plain(c: str) -> bool:
        low = c.casefold()
        same = unicodedata.normalize("NFKC", c) == c and unicodedata.normalize("NFKC", low) == low and unicodedata.category(c)[0] not in "MZ"
        return c == "ß" or same and len(low) == 1 and low == c.lower() and not c.isdigit() and not c.isspace() and c not in "Σς"

    out, first = "\\x00-\\x7F", None
    for lo, hi in ((0xA1, 0x52F), (0x2010, 0x205E), (0x3041, 0x30FF), (0x4E00, 0x9FFF)):
        for c in range(lo, hi + 2):
            good = c <= hi and plain(chr(c))
            if good and first is None:
                first = c
            elif not good and first is not None:
                out += f"\\u{first:04x}-\\u{c - 1:04x}"
                first = None
    return out


def _guarded(text: Column, plain: Column, udf) -> Column:
    """`plain` for rows of plain characters; only the others' text goes to Python."""
    beyond = text.rlike(f"[^{_plain_class()}]")
    return F.coalesce(F.when(beyond, udf(F.when(beyond, text))), F.replace(plain, F.lit("ß"), F.lit("ss")), F.lit(""))


def normalize(text: Column) -> Column:
    """Punctuation removed, NFKC, marks dropped, case folded, blanks collapsed. Null gives the empty text."""
    return _guarded(text, F.trim(F.regexp_replace(F.lower(strip_punctuation(text)), BLANK, " ")), _normalized)


def normalize_for_compare(text: Column) -> Column:
    """As normalize, but punctuation stays."""
    return _guarded(text, F.trim(F.regexp_replace(F.lower(text), BLANK, " ")), _compared)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_extension(path: Column) -> Column:
    """The last extension with its dot, lower case; names without one (Makefile, .bashrc) as a whole."""
    base = F.lower(basename(path))
    extension = F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.when(extension != "", extension).otherwise(base)


def licence_name(path: Column) -> Column:
    """File name without its last extension, cut at the first underscore, so that variants of a licence are one."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.substring_index(F.regexp_replace(base, r"\.[^.]*$", ""), "_", 1)


def versions_of_name(name: Column) -> Column:
    """Every number of a licence's name, as text, repeats kept."""
    return F.regexp_extract_all(name, F.lit(f"({NUMBER})"), F.lit(1))


def versions_in_text(text: Column) -> Column:
    """Numbers behind version, v and license, distinct as text, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(VERSION), F.lit(1)))


def first_version(text: Column) -> Column:
    """The first of versions_in_text; null if there is none."""
    return F.nullif(F.regexp_extract(text, VERSION, 1), F.lit(""))


def whole_numbers(values: Column) -> Column:
    """Integers of any length become N.0 without leading zeros; anything else, null too, stays."""

    def one(x: Column) -> Column:
        x = F.trim(x)
        sign = F.when(x.startswith("-") & ~x.rlike("^-0+$"), "-").otherwise("")
        digits = F.regexp_replace(F.regexp_replace(x, "^[+-]", ""), "^0+(?=[0-9])", "")
        return F.when(x.rlike(r"^[+-]?[0-9]+$"), F.concat(sign, digits, F.lit(".0"))).otherwise(x)

    return F.transform(values, one)


def match_percent(matches: Column, length: Column) -> Column:
    return F.when(length > 0, matches / length * F.lit(100.0))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), path.substr(F.lit(len(root) + 1), F.length(path))).otherwise(path)


def hyperlink(path: Column) -> Column:
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.concat(F.lit('=HYPERLINK("file:///'), slashes, F.lit('", "'), basename(slashes), F.lit('")'))


def decode(content: Column) -> Column:
    """Strict UTF-8 where it holds; of other content the bytes that fit nowhere are dropped."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, content.cast("string")).otherwise(_lenient(F.when(~valid, content)))


@F.pandas_udf(StringType())
def _lenient(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))


def digest(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest; built-in where Spark has it, else hashlib."""
    builtin = {"md5": F.md5, "sha1": F.sha1} | {f"sha{n}": (lambda c, n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)}
    if algorithm in builtin:
        return builtin[algorithm](content)
    if algorithm not in hashlib.algorithms_available:
        raise ValueError(f"unknown hash algorithm {algorithm}")

    @F.pandas_udf(StringType())
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else hashlib.new(algorithm, v.encode() if isinstance(v, str) else bytes(v)).hexdigest())

    return of(content)


@F.pandas_udf(BinaryType())
def _deflated(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else zlib.compress(bytes(v)))


@F.pandas_udf(BinaryType())
def _inflated(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else zlib.decompress(bytes(v)))


def compress_b64(content: Column) -> Column:
    """zlib and base64 without line breaks, for interchange; empty stays empty."""
    return F.when(F.length(content) == 0, "").otherwise(F.replace(F.base64(_deflated(F.when(F.length(content) > 0, content))), F.lit("\r\n"), F.lit("")))


def decompress_b64(text: Column) -> Column:
    return F.when(text == "", F.lit(b"")).otherwise(_inflated(F.unbase64(F.nullif(text, F.lit("")))))
