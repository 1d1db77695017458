import base64
import hashlib
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from corpusweave.functions import grams
from corpusweave.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("r")).collect())]


NORMALIZED = {
    "  Licensed under the Apache License, Version 2.0. ": "licensed under the apache license version 2.0",
    "v\\&. 2\\&.0\\&.": "v 2.0",
    "1.-2 1..2 1.0.0": "12 12 1.0.0",
    "Straße CAFÉ": "strasse café",
    "café": "café",
    "a b c\u001cd": "a b c d",
    "Ｆｕｌｌ，ｗｉｄｔｈ": "full,width",
    "“license”": "“license”",
    "x² 2.²": "x2 2.2",
    "http://www.apache.org/licenses/LICENSE-2.0": "httpwwwapacheorglicenseslicense2.0",
    "GPLv2+ / Visual C++": "gplv2 visual c",
    "": "",
    None: "",
}


def test_normalize(spark):
    assert column(spark, list(NORMALIZED), T.normalize) == list(NORMALIZED.values())


def test_normalize_matches_a_plain_model(spark, small):
    def model(s):
        s = (s or "").replace("\\&.", ".")
        kept = [c for i, c in enumerate(s) if (c == "." and 0 < i < len(s) - 1 and s[i - 1].isdigit() and s[i + 1].isdigit()) or not (c.isascii() and unicodedata.category(c)[0] in "PS")]
        s = unicodedata.normalize("NFKC", "".join(kept))
        return " ".join("".join(c for c in s if unicodedata.category(c)[0] != "M").casefold().split())

    rows = spark.read.parquet(f"{small}/documents.parquet").select("text", T.normalize(F.col("text"))).collect()
    assert all(model(a) == b for a, b in rows) and len(rows) >= 100
    every = [chr(c) for c in [*range(1, 0x530), *range(0x1E80, 0x2070), *range(0x3000, 0x3100), *range(0x4E00, 0xA000, 97)]]
    texts = [x for i, c in enumerate(every) for x in (f"A{c}B. {c}1.{c}2", "".join(every[i : i + 9]))]
    got = column(spark, texts, T.normalize)
    assert [t for t, g in zip(texts, got) if g != model(t)] == []


def test_compare_keeps_punctuation(spark):
    assert column(spark, ["A,  b!", "Ä,\tB", None], T.normalize_for_compare) == ["a, b!", "ä, b", ""]


def test_clean_control(spark):
    assert column(spark, ["a\x00\x01b", "a\\x00\\xFFb\tc", "\x1f", None, ""], T.clean_control) == ["a b", "a b\tc", " ", None, ""]


def test_paths(spark):
    assert column(spark, [".gitignore", "x/Makefile", "a.TAR.GZ", "..a", "d.e/f", None], T.file_extension) == [".gitignore", "makefile", ".gz", "..a", "f", None]
    assert column(spark, ["PSF_Gregory-P-Ward.txt", "x/GPL-2.0-or-later_v2.txt", "a\\b.c"], T.licence_name) == ["PSF", "GPL-2.0-or-later", "b"]
    assert column(spark, ["/r/a/b.c", "/rx/b"], lambda c: T.relative(c, "/r/")) == ["a/b.c", "/rx/b"]
    assert column(spark, ["a\\b.c"], T.hyperlink) == ['=HYPERLINK("file:///a/b.c", "b.c")']


def test_versions(spark):
    assert column(spark, ["W3C-20150513", "bzip2-1.0.6", "x"], T.versions_of_name) == [["3", "20150513"], ["2", "1.0", "6"], []]
    text = "version 2 or v2.0 gplv3 license 20 mpl v 1.1 version 1.0.6 lgpl version 21"
    assert column(spark, [text, "", None], T.versions_in_text) == [["2", "2.0", "20", "1.1", "1.0", "21"], [], None]
    assert column(spark, [text, "none"], T.first_version) == ["2", None]
    assert column(spark, [["2", "2.0", "007", "-0", "-3", " 5 ", "x", None, "9" * 40], None], T.whole_numbers, "array<string>") == [["2.0", "2.0", "7.0", "0.0", "-3.0", "5.0", "x", None, "9" * 40 + ".0"], None]


def test_bytes(spark):
    raw = [b"abc", "é".encode(), b"a\xffb", b"", None]
    assert column(spark, raw, T.decode, "binary") == ["abc", "é", "ab", "", None]
    for name in ("sha256", "md5", "sha512", "blake2b"):
        assert column(spark, raw, lambda c, n=name: T.digest(c, n), "binary") == [None if r is None else hashlib.new(name, r).hexdigest() for r in raw]
    with pytest.raises(ValueError):
        T.digest(F.lit("x"), "nothing")
    noise = hashlib.sha512(b"x").digest() * 3
    assert column(spark, [noise], T.compress_b64, "binary") == [base64.b64encode(zlib.compress(noise)).decode()]
    assert [None if x is None else bytes(x) for x in column(spark, [*raw, b"x" * 100_000], lambda c: T.decompress_b64(T.compress_b64(c)), "binary")] == [*raw, b"x" * 100_000]


def test_spans_and_anchors(spark):
    df = spark.createDataFrame([(1, "ab ü c"), (2, ""), (3, None), (4, "a b c d e a b c d")], "id int, text string").withColumn("pos", F.lit(9))
    rows = {(r.id, r.pos, r.word, r.start_char, r.end_char) for r in grams.with_spans(df, "text", ["id"]).collect()}
    assert {(1, 0, "ab", 0, 2), (1, 1, "ü", 3, 4), (1, 2, "c", 5, 6)} == {r for r in rows if r[0] == 1} and not {r for r in rows if r[0] in (2, 3)}
    words = df.select("id", grams.tokens(F.col("text")).alias("w"))
    index = {(r.id, r.gram): r.positions for r in grams.anchor_index(words, "w", ["id"]).collect()}
    assert index[4, "a b c d"] == [0, 5] and len([k for k in index if k[0] == 4]) == 5 and not [k for k in index if k[0] != 4]
