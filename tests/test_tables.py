import hashlib
import random

from pyspark.sql import functions as F

from corpusweave.operators import compare, files, snapshots
from corpusweave.operators.components import components

SNAP = "repo_id long, file_path string, file_hash string, licenses array<string>, file_content_is_text boolean, recorded_at timestamp"


def test_snapshot_differences(spark):
    rows = lambda xs: spark.createDataFrame(xs, "repo_id long, file_path string, file_hash string, licenses array<string>, file_content_is_text boolean, at string").select("*", F.col("at").cast("timestamp").alias("recorded_at"), F.lit(1).alias("_pos"), F.lit("x").alias("difference"))
    a = rows([
        (1, "a", "AA", ["x", "y"], True, "2020-01-02"), (1, ".\\a", "zz", None, None, "2020-01-01"), (1, "b", None, None, None, "2020-01-01"), (1, "c", "c", [], True, "2020-01-01"), (1, "c", "c", [], True, "2020-01-01"),
        (None, "n", "1", None, None, "2020-01-01"), (2, "only", "1", None, None, "2020-01-01"), (3, "d\\e", "1", ["q"], True, "2020-01-01"),
    ])
    b = rows([
        (1, "./a", "aa", ["y", "x", "x"], True, "2020-01-01"), (1, "b", "h", [], False, "2020-01-01"), (1, "c", "c", None, None, "2020-01-01"), (None, "n", "2", None, None, "2020-01-01"),
        (2, "other", None, None, None, "2020-01-01"), (3, "d/e", "1", ["r"], True, "2020-01-01"),
    ])
    got = {tuple(r) for r in snapshots.snapshot_differences(a, b).collect()}
    assert got == {
        (1, "b", "file_hash"), (1, "b", "file_content_is_text"), (1, "c", "file_content_is_text"), (None, "n", "file_hash"),
        (2, "only", "missing_in_mirror"), (2, "other", "missing_in_primary"), (3, "d/e", "licenses"),
    }
    empty = a.where("false")
    assert snapshots.snapshot_differences(empty, empty).count() == 0
    assert {r.difference for r in snapshots.snapshot_differences(a, empty).collect()} == {"missing_in_mirror"}


def test_differences_over_many_words_of_a_bitmap(spark):
    random.seed(3)
    left = {k: random.randint(0, 3) for k in range(3000) if random.random() < 0.8}
    right = {k: random.randint(0, 3) for k in range(3000) if random.random() < 0.8}
    frame = lambda m: spark.createDataFrame(list(m.items()), "k int, v int")
    got = {tuple(r) for r in compare.differences(frame(left), frame(right), ["k"], {"v": F.col("v")}, buckets=3).collect()}
    expected = {(k, "missing_in_right") for k in left.keys() - right.keys()} | {(k, "missing_in_left") for k in right.keys() - left.keys()} | {(k, "v") for k in left.keys() & right.keys() if left[k] != right[k]}
    assert got == expected


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(5, 5), (400, 400), (None, 1)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_diffs(spark):
    old = spark.createDataFrame([("a", "H1"), ("b", "h2"), ("c", None)], "file_path string, file_hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("d", None), ("e", "")], "file_path string, file_hash string")
    assert {r.file_path for r in files.new_or_changed(old, new).collect()} == {"b", "d", "e"}
    assert {r.file_path for r in files.removed(old, new).collect()} == {"b", "c"}
    assert files.new_or_changed(old.where("false"), new).count() == 4 and files.new_or_changed(old, new).columns == new.columns


def test_folder_digests(spark):
    tree = [("r", "b.txt", b"1"), ("r", "a/x", b"2"), ("r", "a/b/y", b""), ("r", "c", None), ("s", "z" * 10, b"z" * 100000)]
    df = spark.createDataFrame(tree, "folder string, path string, content binary").withColumn("order", F.lit(1))

    def expected(names):
        h = hashlib.sha256()
        by = {p: c or b"" for f, p, c in tree if f == "r"}
        for n in names:
            h.update(n.encode() + b"\0" + by[n])
        return h.hexdigest()

    whole = {r.folder: r.digest for r in files.folder_digests(df, "folder", "path", "content").collect()}
    level = {r.folder: r.digest for r in files.folder_digests(df, "folder", "path", "content", by_level=True).collect()}
    assert whole["r"] == expected(["a/b/y", "a/x", "b.txt", "c"]) and level["r"] == expected(["b.txt", "c", "a/x", "a/b/y"]) and whole["s"] == level["s"]
    assert {r.folder: r.digest for r in files.folder_digests(files.exclude(df, "path", ["a"]), "folder", "path", "content").collect()}["r"] == expected(["b.txt", "c"])


def test_table_maintenance(spark):
    df = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 2, 11), (1, "a", 2, 12), (None, "a", 1, 13)], "repo int, path string, at int, id int")
    assert {(r.repo, r.id) for r in files.upsert(df, ["repo", "path"], "at", "id").collect()} == {(1, 12), (None, 13)}
    assert {r.id for r in files.remove(df, df.where("id = 10").select("id"), ["id"]).collect()} == {11, 12, 13}
    paths = spark.createDataFrame([("src/test/x",), ("src\\testing",), ("lib/x",), (None,)], "file_path string")
    c = files.scan_counts(paths).collect()[0]
    assert (c.total_files, c.released_files) == (4, 1)
    assert files.scan_counts(paths.where("false")).collect()[0].total_files == 0


def test_hashes_only_where_there_are_none(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "KEPT"), (4, None, None), (5, "", None)], "id int, content string, file_hash string")
    got = {r.id: r.file_hash for r in files.hashed(df).collect()}
    assert got[1] == got[2] and got[3] == "KEPT" and got[4] is None and got[5].startswith("e3b0c442")
    assert {r.id for r in files.lookup(df, spark.createDataFrame([("a",), (None,)], "content string"), ["content"]).collect()} == {1, 2, 3}
