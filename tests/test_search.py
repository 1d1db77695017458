import random

from pyspark.sql import functions as F

from corpusweave.operators import search

FILES = "path int, text string"
PATTERNS = "seq int, name string, text string"


def test_aligner_reference_case():
    f = "x this program is free gnu software you can share it".split()
    p = "this program is free software you can redistribute it".split()
    assert search.align(f, p, 1, 0) == (8, 10)


def brute(files, patterns):
    out = {}
    for path, text in files:
        f = (text or "").split()
        for seq, _, ptext in patterns:
            p, best = ptext.split(), None
            for i in range(len(f) - 3):
                for j in range(len(p) - 3):
                    if f[i : i + 4] == p[j : j + 4]:
                        m, last = search.align(f, p, i, j)
                        if best is None or m > best[0]:
                            best = m, i, last
            if best and best[0] / len(p) * 100.0 > 50.0:
                out[path, seq] = (best[0] / len(p) * 100.0, " ".join(f[best[1] : best[2] + 1]))
    return out


def test_fuzzy_against_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(30)]
    patterns = [(s, f"L-{s}.0", " ".join(random.choice(words) for _ in range(random.randint(4, 24)))) for s in range(12)]
    files = []
    for k in range(60):
        body = [random.choice(words) for _ in range(random.randint(0, 20))]
        for _ in range(random.randint(0, 2)):
            body += [w for w in random.choice(patterns)[2].split() if random.random() > 0.12]
        files.append((k, " ".join(body)))
    files += [(900, None), (901, "")]
    df = spark.createDataFrame(files, FILES).withColumn("seq", F.lit(7)).withColumn("name", F.lit("clash"))
    got = search.fuzzy(df, spark.createDataFrame(patterns, PATTERNS).withColumn("path", F.lit("clash"))).collect()
    expected = brute(files, patterns)
    by_block = search.fuzzy(df, spark.createDataFrame(patterns, PATTERNS), limit=200)
    assert {(r.path, r.seq) for r in by_block.collect()} == set(expected)
    assert {(r.path, r.seq): (r.match_percent, r.matched_substring) for r in got} == expected and len(expected) > 20


def test_contained_with_and_without_broadcast(spark):
    files = spark.createDataFrame([(1, "a b c d e"), (2, "xa b cx"), (3, None), (4, ""), (5, "c")], FILES)
    patterns = spark.createDataFrame([(1, "P", "a b c"), (2, "Q", "c"), (3, "R", ""), (4, "S", None), (5, "T", "b c d")], PATTERNS)
    expected = {(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (5, 2)}
    for limit in (10**6, 0):
        assert {(r.path, r.seq) for r in search.contained(files, patterns, limit).collect()} == expected
    m = {r.path: r for r in search.full_matches(files, patterns).collect()}
    assert m[1].license_names == ["P", "Q", "T"] and m[1].license_match_strength == "EXACT" and m[3].license_names == [] and not m[4].has_full_license


def test_keywords(spark):
    files = spark.createDataFrame([(1, "the open source license"), (2, "opens source"), (3, "“license”"), (4, None)], FILES)
    terms = spark.createDataFrame([("g", 1, 0, "open source"), ("l", 0, 1, "license"), ("l", 0, 2, "license"), ("l", 0, 3, "")], "category string, cat_ord int, term_ord int, norm string")
    assert {(r.path, r.norm, r.term_ord) for r in search.keywords(files, terms).collect()} == {(1, "open source", 0), (1, "license", 1)}
    assert {(r.path, r.norm) for r in search.standalone_keywords(files, terms).collect()} == {(1, "open source"), (1, "license"), (3, "license")}
    for limit in (10**6, 0):
        assert search.keywords(files, terms, limit).count() == 2 and search.standalone_keywords(files, terms.where("false"), limit).count() == 0
    assert search.keyword_map(files, terms).collect()[0].keyword_matches == {"l": ["license"], "g": ["open source"]}


MATCH = "path int, seq int, license_name string, match_percent double, expected_versions array<string>, found_versions array<string>"


def test_resolve(spark):
    rows = [
        (1, 1, "A", 60.0, ["2.0"], ["2.0", "9.0"]), (1, 2, "B", 99.0, ["2.0"], ["2.0", "9.0"]), (1, 3, "C", 55.0, ["2.0"], ["2.0", "9.0", "3.0"]),
        (2, 1, "A", 90.0, [], []), (2, 2, "B", 60.0, ["1.0"], ["1.0"]), (2, 3, "C", 60.0, ["1.0"], ["1.0"]),
        (3, 1, "A", None, ["1.0"], None), (3, 2, "B", 70.0, ["1.0"], []), (3, 3, "C", 70.0, ["1.0"], []),
        (4, 1, "A", 70.0, ["2.0"], ["2.0"]), (4, 2, "B", 99.0, [], ["3.0"]),
    ]
    got = {r.path: (r.match_class, r.selected, r.license_name) for r in search.resolve(spark.createDataFrame(rows, MATCH)).collect()}
    assert got == {1: ("COMMON", ["A", "B", "C"], "C"), 2: ("ALL", ["B"], "B"), 3: ("NONE", ["B"], "B"), 4: ("ALL", ["A"], "A")}
    assert search.resolve(spark.createDataFrame([], MATCH)).count() == 0


def test_common_fold_of_the_fixture(spark):
    rows = [(1, 1, "A", 60.0, ["2.0", "x"], ["2.0"]), (1, 2, "B", 99.0, ["2.0", "x"], ["2.0"]), (1, 3, "C", 55.0, ["2.0"], ["2.0", "3.0"])]
    r = search.resolve(spark.createDataFrame(rows, MATCH)).collect()[0]
    assert (r.selected, r.license_name) == (["A", "C"], "C")


def test_resolve_in_order(spark):
    def model(ms):
        best = equal_best = 0.0
        taken, equal = None, False
        for _, name, p, e, f in ms:
            if e == f:
                if p > equal_best:
                    best, equal_best, taken, equal = p, p, name, True
            elif not equal and p > best:
                best, taken = p, name
            elif not e and p > equal_best:
                best, equal_best, taken, equal = p, p, name, True
        return taken

    random.seed(2)
    rows = []
    for path in range(300):
        for seq in range(random.randint(1, 6)):
            v = lambda: random.choice([[], ["1"], ["2"], ["1", "2"]])
            rows.append((path, seq, f"n{seq}", float(random.randint(0, 5)), v(), v()))
    got = {r.path: r.license_name for r in search.resolve_in_order(spark.createDataFrame(rows, MATCH)).collect()}
    for path in range(300):
        assert got.get(path) == model([(r[1], r[2], r[3], r[4], r[5]) for r in rows if r[0] == path])
