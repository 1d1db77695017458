import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import neardup, spans


def brute_spans(records, length):
    w = {}
    for k, t in enumerate(records):
        for j in range(len(t or []) - length + 1):
            w.setdefault(tuple(t[j : j + length]), set()).add(k)
    out = set()
    for k, t in enumerate(records):
        now = None
        for j in range(len(t or []) - length + 1):
            if len(w[tuple(t[j : j + length])]) > 1:
                if now and j <= now[1]:
                    now[1] = j + length
                else:
                    if now:
                        out.add((k, *now))
                    now = [j, j + length]
        if now:
            out.add((k, *now))
    return out


@pytest.mark.parametrize("length", [16, 40, 80])
def test_spans_against_brute_force(spark, length):
    random.seed(length)
    common = [[random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(length - 3, 3 * length))] for _ in range(6)]
    records = []
    for _ in range(120):
        t = [f"t{random.randint(0, 50)}" for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            c = random.choice(common)
            a = random.randint(0, len(c) // 2)
            t += c[a : a + random.randint(1, len(c))] + [f"t{random.randint(0, 9)}"]
        records.append(t)
    records += [records[0]] * 40 + [None, [], ["a"] * (length - 1), ["a"] * length, ["a"] * (3 * length), ["b"] * (2 * length), [None] * length, [None] * (length + 1), common[0]]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(records)], "kind int, id long, tokens array<string>").selectExpr("*", "1 as digest", "2 as record", "3 as pos")
    got = {(r.id, r.start_tok, r.end_tok) for r in spans.shared_spans(df, length).collect()}
    assert got == brute_spans(records, length) and len(got) > 40
    share = {r.id: r for r in spans.shares(df, spans.shared_spans(df, length)).collect()}
    assert len(share) == len(records) and share[len(records) - 9].shared_percent == 0.0


def test_spans_edge_cases(spark):
    df = spark.createDataFrame([(0, 1, ["x"] * 100), (0, 1, ["x"] * 100)], "kind int, id long, tokens array<string>")
    assert spans.shared_spans(df).count() == 0  # a repeated row is no other record
    assert spans.shared_spans(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, 5)
    both = df.distinct().union(spark.createDataFrame([(1, 1, ["x"] * 90)], df.schema))
    assert {(r.kind, r.start_tok, r.end_tok) for r in spans.shared_spans(both).collect()} == {(0, 0, 100), (1, 0, 90)}


def brute_groups(rows, t=0.6, least=20):
    s = {}
    for kind, i, text in rows:
        w = [x for x in (text or "").split(" ") if x]
        if text is not None and len(w) >= least:
            s[kind, i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3))
    parent = {k: k for k in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(s, 2):
        if a[0] == b[0]:
            n = len(s[a] & s[b])
            if n >= t * (len(s[a]) + len(s[b]) - n) - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k)[1] for k in s}


def families(seed, n, families, noise):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[random.choice(vocabulary) for _ in range(random.choice([22, 30, 60, 95, 140, 300]))] for _ in range(families)]
    rows = []
    for i in range(n):
        t = list(random.choice(base))
        for _ in range(random.randint(0, noise)):
            k = random.randrange(len(t))
            what = random.random()
            if what < 0.4:
                t[k] = random.choice(vocabulary)
            elif what < 0.7:
                t.insert(k, random.choice(vocabulary))
            elif what < 0.85 and len(t) > 25:
                del t[k]
            else:
                a = random.randrange(len(t))
                t = t[a:] + t[:a]
        rows.append(("file" if i % 5 else "pattern", i, " ".join(t)))
    return rows


@pytest.mark.parametrize("most", [neardup.MOST, 4])
def test_groups_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = families(7, 260, 14, 9)
    rows += [("file", 1000 + i, rows[1][2]) for i in range(90)] + [("file", 2000, None), ("file", 2001, ""), ("file", 2002, "a " * 19), ("file", 2003, "a " * 400), ("file", 2004, "a " * 30), ("file", 2005, "a b " * 300)]
    df = spark.createDataFrame(rows, "kind string, id long, text string").selectExpr("*", "1 as doc", "2 as sig", "3 as size")
    got = {(r.kind, r.id): r.class_id for r in neardup.groups(df, most=most).collect()}
    expected = brute_groups(rows)
    assert got == expected and len(set(expected.values())) < len(expected) / 2


@pytest.mark.parametrize("threshold, most", [(0.8, 4), (0.45, 0)])
def test_other_thresholds(spark, threshold, most):
    rows = families(8, 150, 8, 6)
    df = spark.createDataFrame(rows, "kind string, id long, text string")
    assert {(r.kind, r.id): r.class_id for r in neardup.groups(df, threshold, most=most).collect()} == brute_groups(rows, threshold)


def test_group_edge_cases(spark):
    df = spark.createDataFrame([("file", 1, "x y z " * 10), ("file", 1, "x y z " * 10), (None, 2, "x y z " * 10), ("file", None, "x y z " * 10)], "kind string, id long, text string")
    assert [tuple(r) for r in neardup.groups(df).collect()] == [("file", 1, 1)]
    assert neardup.groups(df.where("false")).count() == 0
    assert neardup.groups(spark.createDataFrame([("f", 1, "a b"), ("f", 2, "a b"), ("f", 3, "c")], df.schema), least_words=1).count() == 3
    pairs = neardup.group_pairs(spark.createDataFrame([("f", 3, 1), ("f", 1, 1), ("f", 2, 1), ("g", 9, 9)], "kind string, id long, class_id long"))
    assert {tuple(r) for r in pairs.collect()} == {("f", 1, 2), ("f", 1, 3), ("f", 2, 3)}
    with pytest.raises(ValueError):
        neardup.groups(df, 0)


def test_every_link_shares_signatures():
    """The filter's promise, without Spark: two similar texts share a signature, whatever is rare."""
    t, known = Fraction(3, 5), neardup._Words()
    rows = families(11, 200, 6, 8)
    h = [neardup.shingles(r[2].split(), known) for r in rows]
    counts = np.zeros(1 << neardup.BITS, np.int64)
    for x in h:
        np.add.at(counts, x >> np.uint64(64 - neardup.BITS), 1)
    logs = neardup._log(counts)
    for rare in (0, 2, 10, 255):
        s = [neardup.signatures(x, logs, rare, t) for x in h]
        for a, b in itertools.combinations(range(len(h)), 2):
            n = len(np.intersect1d(h[a], h[b]))
            if n >= 0.6 * (len(h[a]) + len(h[b]) - n):
                shared = len(np.intersect1d(s[a][0], s[b][0]))
                need = 1 if s[a][1] and s[b][1] else min(neardup.SHARED, -(-(len(h[a]) + len(h[b])) * 3 // 8))
                assert shared >= need


@pytest.mark.parametrize("t", [Fraction(3, 5), Fraction(4, 5), Fraction(9, 20), Fraction(1)])
def test_every_link_shares_a_fine_signature(t):
    known = neardup._Words()
    rows = families(12, 200, 6, 8) + [("file", 900 + i, " ".join(f"s{j}" for j in range(i % 7, i % 7 + 4 + i % 3))) for i in range(20)]
    h = [neardup.shingles(r[2].split(), known) for r in rows]
    counts = np.zeros(1 << neardup.BITS, np.int64)
    for x in h:
        np.add.at(counts, x >> np.uint64(64 - neardup.BITS), 1)
    logs = neardup._log(counts)
    s = [dict(zip(*map(np.ndarray.tolist, neardup.fine_signatures(x, logs, t)))) for x in h]
    links = 0
    for a, b in itertools.combinations(range(len(h)), 2):
        n = len(np.intersect1d(h[a], h[b]))
        if n and n >= t * (len(h[a]) + len(h[b]) - n):
            links += 1
            assert [x for x in s[a].keys() & s[b].keys() if s[a][x] == s[b][x] == neardup.BOTH or s[a][x] != s[b][x]]
    assert links > 20


def boilerplate(n, common, own, more=()):
    """Unlike texts of own words around one common text, and families among them."""
    text = " ".join(f"b{i}" for i in range(common))
    rows = [("file", i, f"{text} " + " ".join(f"{i}x{j}" for j in range(own))) for i in range(n)]
    return rows + [("file", n + i, rows[k][2] + f" e{i}") for i, k in enumerate(more)]


def test_unlike_texts_with_common_words_do_not_meet(spark, monkeypatch):
    """Their links are found; the pairs that are verified stay in proportion to the texts."""
    rows = boilerplate(3000, 50, 30, more=range(0, 3000, 50))
    verified = []
    links = neardup._links
    monkeypatch.setattr(neardup, "_links", lambda pairs, *x: (verified.append(pairs.count()), links(pairs, *x))[1])
    df = spark.createDataFrame(rows, "kind string, id long, text string")
    got = {r.id: r.class_id for r in neardup.groups(df).collect()}
    assert got == {i: i for i in range(3000)} | {3000 + k: i for k, i in enumerate(range(0, 3000, 50))}
    assert sum(verified) < (neardup.ORDERS + 1) * len(rows), verified


def test_a_centre_of_another_size_loses_no_link(spark):
    """Two texts share signatures only with a short text that is the first of each large group and no partner of theirs."""
    orders = [F.xxhash64(F.xxhash64(F.lit("file"), "id"), F.lit(k).cast("long")).alias(f"h{k}") for k in range(neardup.ORDERS)]
    ids = sorted((max(r[1:]), min(r[1:]), r.id) for r in spark.range(3000).select("id", *orders).collect())
    short = ids[0][2]
    a, b = [i for _, least, i in ids if least > ids[0][0]][:2]
    common = [f"c{i}" for i in range(33)]
    rows = [("file", short, " ".join(common[:23]))] + [("file", i, " ".join(common + [f"{i}x{j}" for j in range(10)])) for i in (a, b)]
    rows += [("pattern", i, " ".join([*common[10:], f"p{i}"])) for i in range(6)]  # they make the later runs less rare
    expected = brute_groups(rows)
    assert expected["file", a] == expected["file", b] != expected["file", short]
    df = spark.createDataFrame(rows, "kind string, id long, text string")
    assert {(r.kind, r.id): r.class_id for r in neardup.groups(df, most=1).collect()} == expected


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    import corpusweave

    root = Path(corpusweave.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "corpusweave.llm" in p.read_text()]
    assert F is not None
