import bz2
import gzip
import io
import json
import lzma
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusweave.plans.assess import assess
from corpusweave.sinks import reports
from corpusweave.sources import archives, scan, terms
from corpusweave.streaming import incremental


def tar(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


KINDS = {"a.tar.gz": "multi", "a.txt.gz": "single", "README.gz": "multi", "a.xz": "single", "a.jar": "multi", "a.war": "none", "blobs/sha256/" + "a" * 64: "multi", "other/" + "a" * 64: "none", "x.TGZ": "multi", "d/.gz": "none"}


def test_classify(spark):
    df = spark.createDataFrame([(k,) for k in KINDS], "p string")
    assert {r.p: r.k for r in df.select("p", archives.classify(F.col("p")).alias("k")).collect()} == KINDS
    assert {k: archives._kind(k) for k in KINDS} == KINDS


def test_expand():
    inner = zipped({"deep/x.txt": b"x", "y.txt.bz2": bz2.compress(b"y")})
    outer = tar({"top/inner.zip": inner, "top/plain": b"p", "../evil": b"e", "top/empty": b""})
    got = {p: (c, bool(e)) for p, c, e in archives.expand("d/top.tar.gz", outer)}
    assert got["d/top/top/plain"] == (b"p", False) and got["d/top/top/inner/deep/x.txt"] == (b"x", False) and got["d/top/top/inner/y.txt"] == (b"y", False)
    assert got["d/top/../evil"][1] and got["d/top/top/empty"] == (b"", False)
    flat = {p for p, _, _ in archives.expand("d/top.tgz", tar({"top/a": b"1", "top/b/c": b"2"}))}
    assert flat == {"d/top/a", "d/top/b/c"}
    assert list(archives.expand("b.zip", b"broken"))[0][:2] == ("b.zip", b"broken") and list(archives.expand("b.xz", b"broken"))[0][2]
    assert [r[:2] for r in archives.expand("README.gz", gzip.compress(b"read"))] == [("README", b"read")]
    assert [r[:2] for r in archives.expand("a.c.lzma", lzma.compress(b"c", lzma.FORMAT_ALONE))] == [("a.c", b"c")]
    assert list(archives.expand("big.txt.gz", gzip.compress(b"0" * 1000), most=10))[0][2]


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "src/test").mkdir(parents=True)
    text = "You may copy this file under the open terms version 1.0 of the makers and nobody else for ever and ever"
    (src / "a.py").write_text("# " + text)
    (src / "b.txt").write_text("see " + text.replace("makers", "good makers") + " license")
    (src / ".hidden").write_bytes(b"")
    (src / "bin").write_bytes(b"\xff\xfe\x00abc")
    (src / "src/test/t.py").write_text(text)
    (src / "z.tar.gz").write_bytes(tar({"in/LICENSE": text.encode()}))
    for folder in ("full", "headers"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Open-1.0_v1.txt").write_text(text + "\n")
    (tmp_path / "full/blank.txt").write_text("  ")
    (tmp_path / "full/notes.md").write_text("no")
    return tmp_path


def test_assess_and_reports(spark, tree):
    config = scan.Config(source=str(tree / "src"), full_texts=(str(tree / "full"), str(tree / "absent")), headers=(str(tree / "headers"),))
    got = assess(spark, config)
    rows = {r.file_path: r for r in got.files.collect()}
    assert set(rows) == {"a.py", "b.txt", ".hidden", "bin", "z/in/LICENSE"}
    assert rows["a.py"].license_names == ["Open-1.0", "Open-1.0"] and rows["a.py"].has_full_license and rows["a.py"].match_percent == 100.0
    assert rows["b.txt"].license_names == ["Open-1.0"] and rows["b.txt"].keyword_matches["license"] == ["license"]
    assert rows[".hidden"].file_is_empty and rows["bin"].file_content == "\x00abc" and not rows["bin"].file_content_is_text
    reports.write_csv(got.files, str(tree / "csv"), one_file=True)
    assert spark.read.csv(str(tree / "csv"), header=True, escape='"').count() == 5
    for kind, path in (("parquet", "snap"), ("json", "snap.json")):
        reports.write_snapshot(got.files, str(tree / path), kind=kind)
        assert {r.file_path for r in scan.read_snapshot(spark, str(tree / path)).collect()} == set(rows)
    again = assess(spark, scan.Config(source=str(tree / "src"), previous=str(tree / "snap")))
    assert again.changed.count() == 0 and again.removed.count() == 0
    assert scan.read_snapshot(spark, str(tree / "nothing")).count() == 0
    t = reports.totals(got.files).collect()[0]
    assert (t.files, t.empty) == (5, 1)
    report = reports.fuzzy_report(got.fuzzy).collect()
    assert [r.path for r in report] == ["a.py", "b.txt", "z/in/LICENSE"] and {r.percent for r in report} == {"100.00"}


def test_trees_and_values(spark, tree):
    names = {"a.py", "b.txt", ".hidden", "bin", "src/test/t.py"}
    got = {r.path: bytes(r.content) for r in scan.read_tree(spark, str(tree / "src")).collect()}
    assert set(got) == names | {"z/in/LICENSE"} and got[".hidden"] == b""
    assert {r.path for r in scan.read_tree(spark, f"file://{tree}/src/a.py").collect()} == {"a.py"}
    assert {r.path for r in scan.read_tree(spark, f"file://{tree}/src", archives=False).collect()} == names | {"z.tar.gz"}
    (tree / "none").mkdir()
    assert scan.read_tree(spark, str(tree / "none")).count() == 0
    with pytest.raises(ValueError):
        scan.read_tree(spark, str(tree / "absent"))
    scan.write_tree(spark.createDataFrame([("x/y", bytearray(b"1")), ("z", bytearray(b""))], "path string, content binary"), str(tree / "out"))
    assert {r.path: bytes(r.content) for r in scan.read_tree(spark, str(tree / "out")).collect()} == {"x/y": b"1", "z": b""}
    p = {"A": "/x", "n": "7", "bad": "y"}
    assert (scan.value(p, "A"), scan.value(p, "A", ["b", "c"], True), scan.value(p, "A", separator=True)) == ("/x", "/x/b/c/", "/x/")
    with pytest.raises(ValueError):
        scan.get_int(p, "bad")
    (tree / "array.json").write_text(' [{"file_path": "p", "licenses": ["L"]}]')
    assert scan.read_snapshot(spark, str(tree / "array.json")).collect()[0].licenses == ["L"]


def test_scopes(spark, tmp_path):
    from pathlib import Path

    from corpusweave import runtime

    outside = runtime.written(spark.range(3), "outside")
    with runtime.scope():
        inside = runtime.written(spark.range(5), "inside")
        superseded = runtime.written(spark.range(5), "superseded")
        runtime.free(superseded)
        at = [Path(x._corpusweave_path.removeprefix("file://")) for x in (outside, inside, superseded)]
        assert [p.exists() for p in at] == [True, True, False] and inside.count() == 5
    assert [p.exists() for p in at] == [True, False, False] and outside.count() == 3
    spark.range(40).write.parquet(str(tmp_path / "t"))
    assert runtime.spread(spark.range(9).repartition(1)).rdd.getNumPartitions() == 1
    assert runtime.spread(spark.read.parquet(str(tmp_path / "t")).where("id > 3").limit(5)).rdd.getNumPartitions() <= 4


def test_command_line(spark, tree, capsys):
    from corpusweave.__main__ import main

    arguments = [str(tree / "src"), "--output", str(tree / "o"), "--headers", str(tree / "headers"), "--texts", str(tree / "full")]
    assert main(arguments) == 0 and "files=5" in capsys.readouterr().out
    assert main([*arguments[:1], "--output", str(tree / "p"), "--previous", str(tree / "o/snapshot")]) == 0 and "changed=0 removed=0" in capsys.readouterr().out
    assert spark.read.csv(str(tree / "o/report.csv"), header=True, escape='"').count() == 5
    with pytest.raises(SystemExit):
        main([])


def test_properties_and_lists(spark, tmp_path):
    p = tmp_path / "p.properties"
    p.write_text("# no\n; no\n\na=1\nb: x:y\nc=d:e\na=2\nIGNORE_DIRS=src/test, src\\\\test\nflag=Yes\n")
    got = scan.load_properties(str(p))
    assert got["a"] == "2" and got["b"] == "x:y" and got["c"] == "d:e" and scan.get_bool(got, "flag") and scan.get_int(got, "a") == 2 and scan.get_int(got, "absent", 7) == 7
    assert scan.Config.of(got, "s").ignored == ("src/test", "src\\\\test")
    (tmp_path / "l.json").write_text(json.dumps({"licenses": [{"licenseId": "A", "name": "a", "detailsUrl": "u"}, {"licenseId": "B", "detailsUrl": "u", "isDeprecatedLicenseId": True}, {"licenseId": "", "detailsUrl": "u"}, {"licenseId": "C"}]}))
    assert [r.license_id for r in scan.licence_list(spark, str(tmp_path / "l.json")).collect()] == ["A"]
    (tmp_path / "d.json").write_text(json.dumps({"licenseId": "A/B", "licenseText": "T,  x", "standardLicenseHeader": "", "standardLicenseHeaderTemplate": "H"}))
    r = scan.licence_texts(spark, str(tmp_path / "d.json")).collect()[0]
    assert (r.file_name, r.license_text, r.header) == ("A_B.txt", "t, x", "H")
    assert scan.download_counts(scan.licence_texts(spark, str(tmp_path / "d.json"))).first() == (1, 1, 0)
    assert terms.frame(spark).where("norm = 'gplv2'").count() == 2


def test_run_tools(tmp_path, capsys):
    t = reports.Timer()
    with t.stage("x"):
        time.sleep(0.01)
    assert t.took["x"] > 0
    with reports.tee_stdout(str(tmp_path / "o.txt")):
        print("both")
    assert (tmp_path / "o.txt").read_text() == "both\n" and "both" in capsys.readouterr().out
    reports.logger("t", str(tmp_path)).info("hello")
    assert "hello" in (tmp_path / "t.log").read_text()


def test_streaming(spark, small, tmp_path):
    files = spark.read.parquet(f"{small}/files.parquet")
    files.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.first_seen(incremental.arriving(spark, str(tmp_path / "in"), files, 1), late="36500 days")
    q = incremental.normalized(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    expected = files.where("file_hash is not null").select(F.lower("file_hash")).distinct().count()
    assert spark.table("seen").count() == expected == spark.table("seen").select("file_hash").distinct().count()
