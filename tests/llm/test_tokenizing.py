import random

import pytest

from corpusweave.llm import mixing, splitting
from corpusweave.llm import tokenizing as K

pytest.importorskip("tiktoken")


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def awkward():
    random.seed(1)
    out = ["", " ", "\n\n  x", "<|endoftext|> text", "a'sb't", "x" * 9000, "ab" * 7000, "汉字" * 3000, "🙂" * 2000, "!?'s" * 3000, " " * 9000 + "x", "\n" * 5000, "é́" * 2000]
    return out + ["".join(random.choice("abcde ,.\n\t é汉🙂'1") for _ in range(random.randint(1, 400))) for _ in range(200)]


def test_encoding_is_that_of_the_other_library():
    enc, t = K.encoding(), tokenizer()
    for text in awkward():
        assert K.encode(enc, text) == K.encode_all(enc, [text])[0] == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [8, 33, 200])
def test_tree_of_any_leaf(leaf):
    enc = K.encoding()
    random.seed(leaf)
    for alphabet in ("ab", "abcdefghijklmnop", "é汉", "0123456789", "!?-="):
        for _ in range(20):
            piece = "".join(random.choice(alphabet) for _ in range(random.randint(1, 1500))).encode()
            assert K.tree(enc, piece, leaf) == enc._encode_single_piece(piece)


def test_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello <|endoftext|>", 5), (3, "hello <|endoftext|>", 5)], "doc_id long, text string, ids int")
    rows = K.encode_column(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows)[:2] == [(1, 0), (2, 0)] and len(rows) == 4
    assert 50256 not in [i for r in rows for i in r.ids]
    assert K.encode_column(df.where("false"), "doc_id", "text").count() == 0


def test_pieces(spark):
    random.seed(3)
    word = lambda: random.choice(["lorem", "ipsum", "汉字", "x" * 40, "é", "don't", "🙂🙂", "a.b", "12345"])
    texts = [" ".join(word() + random.choice(["", ".", "\n", "\n\n", "\n\n# Head\n", "\n    "]) for _ in range(random.randint(1, 600))) for _ in range(60)]
    texts += [None, "", "x" * 20000, "汉" * 5000, "🙂" * 3000, "\n" * 3000, " " * 5000 + "y", "'s" * 4000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' as units", "1 as ends", "2 as cuts")
    enc = K.encoding()
    for limit, overlap in ((512, 32), (64, 8), (64, 0)):
        by = {}
        for r in splitting.split(df, limit, overlap).collect():
            by.setdefault(r.doc_id, []).append(r)
        assert set(by) == {i for i, t in enumerate(texts) if len(K.encode(enc, t)) > limit}
        for i, rows in by.items():
            end = 0
            for k, r in enumerate(sorted(rows, key=lambda r: r.piece_no)):
                assert r.piece_no == k and r.piece == texts[i][r.start_char : r.end_char] and r.start_char <= end < r.end_char
                assert len(K.encode(enc, r.piece)) <= limit and 0 <= r.overlap_tokens <= overlap
                assert len(K.encode(enc, texts[i][r.start_char : end])) <= overlap
                end = r.end_char
            assert end == len(texts[i])
    assert splitting.split(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, 32, 32)


def test_natural_boundaries(spark):
    text = "".join(f"# Part {i}\n\n" + "Some plain words stand here in a row. " * 12 + "\n\n" for i in range(20))
    rows = splitting.split(spark.createDataFrame([(1, text)], "doc_id long, text string"), 256, 16).collect()
    assert {r.boundary for r in rows} <= {"H", "P", "E"} and len(rows) > 5


def test_mix(spark):
    random.seed(4)
    docs = [(i, random.choice(["Big", "big", "small", "other", None]), " ".join(["w"] * random.randint(0, 40))) for i in range(3000)] + [(9, None, "x"), (10, "big", None), (5, "big", "w w w")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens", "2 as prefix", "3 as pid")
    goals = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.5, 4), ("absent", 0.2, 3), ("zero", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixing.shares(df, goals).collect()}
    assert set(shares) == {"big", "small", "absent", "zero"} and shares["absent"].tokens == shares["zero"].tokens == 0
    assert abs(shares["big"].actual_share - 0.5) < 0.01 and shares["small"].most_repeats <= 4
    mixed = mixing.mix(df, goals).collect()
    for name, most in (("big", 1), ("small", 4)):
        mine = [r for r in mixed if r.source == name]
        assert sum(r.n_tokens for r in mine) == shares[name].tokens <= shares[name].budget < shares[name].tokens + 50
        assert max(r.repeat_no for r in mine) <= most
    assert {tuple(r) for r in mixing.mix(df, goals).collect()} == {tuple(r) for r in mixed}
    assert {r.source: r.tokens for r in mixing.shares(df.where("false"), goals).collect()} == dict.fromkeys(["big", "small", "absent", "zero"], 0)
    assert mixing.mix(df, goals.where("false")).count() == 0
    assert sum(r.tokens for r in mixing.shares(df, goals, total=1000).collect()) <= 1000
