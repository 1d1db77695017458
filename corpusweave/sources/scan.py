"""Reading source trees, pattern folders, snapshots, property files and downloaded licence lists."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.operators.files import is_ignored
from corpusweave.sources.archives import expand_rows

SNAPSHOT = "file_path string, file_hash string, licenses array<string>, file_content_b64 string, file_content_is_text boolean"


@dataclass(frozen=True)
class Config:
    """What a run needs; passed along, never global."""

    source: str
    assessment: str = "assessment"
    ignored: tuple[str, ...] = ("src/test",)
    hash_algorithm: str = "sha256"
    full_texts: tuple[str, ...] = ()
    headers: tuple[str, ...] = ()
    output: str = "output"
    previous: str | None = None
    extra: dict = field(default_factory=dict, hash=False)

    @classmethod
    def of(cls, p: dict[str, str], source: str | None = None) -> Config:
        def listed(*names: str) -> tuple[str, ...]:
            return tuple(x for n in names if (x := p.get(n, "").strip()))

        return cls(
            source=source or p.get("SOURCE_DIR", ""), assessment=p.get("ASSESSMENT_NAME", "assessment"), hash_algorithm=p.get("FILE_HASH_ALGORITHM", "sha256"),
            ignored=tuple(x.strip() for x in p.get("IGNORE_DIRS", "src/test").split(",") if x.strip()), output=p.get("OUTPUT_DIR", "output"),
            full_texts=listed("SPDX_LICENSES_DIR", "MANUAL_LICENSES_DIR"), headers=listed("SPDX_LICENSE_HEADERS_DIR", "MANUAL_LICENSE_HEADERS_DIR"), extra=dict(p),
        )


def load_properties(path: str, encoding: str = "utf-8") -> dict[str, str]:
    """key=value lines (key:value where there is no '='); blank lines and those that begin with # or ; are skipped; the last of a key wins."""
    out = {}
    for line in Path(path).read_text(encoding).splitlines():
        line = line.strip()
        if line and line[0] not in "#;":
            key, sign, value = line.partition("=" if "=" in line else ":")
            if sign:
                out[key.strip()] = value.strip()
    return out


def get_bool(p: dict[str, str], key: str, default: bool = False) -> bool:
    return p[key].strip().lower() in ("1", "true", "yes", "y", "on") if key in p else default


def get_int(p: dict[str, str], key: str, default: int = 0) -> int:
    """The number of a key, the default where it is missing; what is no number raises ValueError."""
    return int(p[key]) if key in p else default


def value(p: dict[str, str], key: str, parts: Sequence[str] = (), separator: bool = False) -> str:
    """The value of a key (KeyError without one), joined with further path parts, if wanted with a separator at the end."""
    path = posixpath.join(p[key], *parts) if parts else p[key]
    return path + "/" if separator and not path.endswith("/") else path


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (file, hdfs, object stores) and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def _below(files: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    """Files below a folder, names with a leading dot and empty ones too, folder by folder."""
    todo = [folder]
    while todo:
        for x in files.get_file_info(fs.FileSelector(todo.pop())):
            if x.type == fs.FileType.Directory:
                todo.append(x.path)
            elif x.type == fs.FileType.File:
                yield x


def _relative(path: str, root: str) -> str:
    return path[len(root) :].lstrip("/")


def read_tree(spark: SparkSession, root: str, archives: bool = True) -> DataFrame:
    """(path, content, extract_error) of a tree, or of one file, that driver and executors both see.

    The driver lists the upper folders only, until there is one for each core; tasks walk what is below and then, spread anew, read
    the contents. The built-in binary source would drop empty files and names with a leading dot. Unreadable files are left out.
    """
    files, base = filesystem(root)
    top = files.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise ValueError(f"no file or folder: {root}")
    cores = spark.sparkContext.defaultParallelism
    if top.type == fs.FileType.File:
        base, entries = os.path.dirname(base), [(top.path, False)]
    else:
        entries, level = [], [base]
        for _ in range(4):
            found = [x for folder in level for x in files.get_file_info(fs.FileSelector(folder))]
            entries += [(x.path, False) for x in found if x.type == fs.FileType.File]
            level = [x.path for x in found if x.type == fs.FileType.Directory]
            if len(level) >= cores or not level:
                break
        entries += [(x, True) for x in level]
    entries = spark.createDataFrame(pd.DataFrame(entries, columns=["at", "folder"]), "at string, folder boolean").repartition(max(1, min(len(entries), 4 * cores)))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, _ = filesystem(root)
        for frame in frames:
            yield pd.DataFrame({"at": frame["at"][~frame["folder"]]})
            for folder in frame["at"][frame["folder"]]:
                paths = []
                for x in _below(mine, folder):
                    paths.append(x.path)
                    if len(paths) == 10_000:
                        yield pd.DataFrame({"at": paths})
                        paths = []
                yield pd.DataFrame({"at": paths}, dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, _ = filesystem(root)
        for frame in frames:
            for at in frame["at"]:
                try:
                    with mine.open_input_stream(at, compression=None) as f:
                        data = f.read()
                except OSError:
                    continue
                yield pd.DataFrame({"path": [_relative(at, base)], "content": [data]})

    rows = entries.mapInPandas(listed, "at string").repartition(4 * cores).mapInPandas(run, "path string, content binary")
    return expand_rows(rows) if archives else rows.withColumn("extract_error", F.lit(None).cast("string"))


def write_tree(rows: DataFrame, root: str) -> None:
    """The rows (path, content) as files below a folder that all executors see; paths are unique and relative."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, base = filesystem(root)
        made, n = set(), 0
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                at = f"{base}/{path}"
                if (folder := os.path.dirname(at)) not in made:
                    mine.create_dir(folder)
                    made.add(folder)
                with mine.open_output_stream(at, compression=None) as f:
                    f.write(bytes(content))
                n += 1
        yield pd.DataFrame({"n": [n]})

    rows.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def file_rows(tree: DataFrame, algorithm: str = "sha256", ignored: Sequence[str] = ("src/test",)) -> DataFrame:
    """One row a file with content, hash, extension, normalised text and flags, from (path, content): a projection only."""
    content = tree.withColumn("file_content", T.decode(F.col("content")))
    return content.select(
        F.col("path").alias("file_path"), "file_content", T.file_extension(F.col("path")).alias("file_extension"),
        T.normalize(T.clean_control(F.col("file_content"))).alias("file_content_normalized"), T.normalize(F.col("file_content")).alias("text"),
        T.digest(F.col("content"), algorithm).alias("file_hash"), (F.length("content") == 0).alias("file_is_empty"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("file_content_is_text"), (~is_ignored(F.col("path"), ignored)).alias("is_released"),
    )


def read_patterns(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(seq, path, name, text) of the .txt files of pattern folders, normalised; seq goes by folder, then path.

    Missing folders, unreadable and blank files are left out. A pattern collection is small; it is read on the driver.
    """
    rows = []
    for k, folder in enumerate(folders):
        files, base = filesystem(folder)
        if files.get_file_info(base).type != fs.FileType.Directory:
            continue
        for x in _below(files, base):
            if x.path.lower().endswith(".txt"):
                try:
                    with files.open_input_stream(x.path, compression=None) as f:
                        body = f.read().decode().strip()
                except (OSError, UnicodeDecodeError):
                    continue
                if body:
                    rows.append((k, _relative(x.path, base), body))
    rows.sort(key=lambda r: (r[0], r[1]))
    df = spark.createDataFrame([(i, p, t) for i, (_, p, t) in enumerate(rows)], "seq int, path string, raw string")
    return df.select("seq", "path", T.licence_name(F.col("path")).alias("name"), T.normalize(F.col("raw")).alias("text"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot, Parquet or JSON (lines, or one file with one array, which is one task); an absent one is empty."""
    files, at = filesystem(path)
    kind = files.get_file_info(at).type
    if kind == fs.FileType.NotFound:
        return spark.createDataFrame([], SNAPSHOT)
    if not path.endswith(".json"):
        return spark.read.schema(SNAPSHOT).parquet(path)
    head = b""
    if kind == fs.FileType.File:
        with files.open_input_stream(at, compression=None) as f:
            head = f.read(64)
    return spark.read.schema(SNAPSHOT).json(path, multiLine=head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"["))


def licence_list(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, name, details_url) of a downloaded licence list: entries without id or address and deprecated ones are left out."""
    kind = "licenses array<struct<licenseId:string,name:string,detailsUrl:string,isDeprecatedLicenseId:boolean>>"
    x = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("licenses").alias("x"))
    x = x.select(F.col("x.licenseId").alias("license_id"), F.col("x.name").alias("name"), F.col("x.detailsUrl").alias("details_url"), F.coalesce("x.isDeprecatedLicenseId", F.lit(False)).alias("old"))
    return x.where("license_id <> '' and details_url <> '' and not old").drop("old")


def licence_texts(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, file_name, license_text, header) of downloaded licence details (JSON files in a folder): the header, or else its template."""
    kind = "licenseId string, licenseText string, standardLicenseHeader string, standardLicenseHeaderTemplate string"
    x = spark.read.schema(kind).json(path, multiLine=True).where("licenseId <> ''")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return x.select(
        F.col("licenseId").alias("license_id"), F.concat(F.regexp_replace("licenseId", r"[/\\]", "_"), F.lit(".txt")).alias("file_name"),
        T.normalize_for_compare(F.col("licenseText")).alias("license_text"), F.coalesce(blank("standardLicenseHeader"), blank("standardLicenseHeaderTemplate")).alias("header"),
    )


def download_counts(texts: DataFrame) -> DataFrame:
    """One row (saved, with_header, without_text) of downloaded licences, as licence_texts gives them."""
    empty = F.coalesce("license_text", F.lit("")) == ""
    return texts.agg(F.count_if(~empty).alias("saved"), F.count_if(F.col("header").isNotNull()).alias("with_header"), F.count_if(empty).alias("without_text"))
