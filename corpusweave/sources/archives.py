"""Archives as a source: what a path is, and its members, nested ones too, as rows."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import basename

#: Most bytes of one unpacked member; larger ones are reported, not unpacked.
MOST = 1 << 30

# Endings of compressed tars, of other archives of many files, and of single compressed files.
COMPOUND = (".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
MANY = (".zip", ".tar", ".jar")
ALONE = (".bz2", ".xz", ".lzma")


def _ends(endings: tuple[str, ...]) -> str:
    return "(" + "|".join(re.escape(x) for x in endings) + ")$"


def looks_like_hash(name: Column) -> Column:
    return F.lower(name).rlike("^[0-9a-f]{32,128}$")


def is_layer(path: Column) -> Column:
    """A name that is a hash without an extension, below a folder named sha256."""
    return looks_like_hash(basename(path)) & F.lower(path).rlike("(^|/)sha256/")


def classify(path: Column) -> Column:
    """'multi', 'single' or 'none'; for .gz it depends on whether another dot is in the name before."""
    low = F.lower(path)
    lone = low.rlike(r"(^|/)[^./][^./]*\.gz$")
    multi = low.rlike(_ends(COMPOUND)) | low.rlike("[^/]" + _ends(MANY)) | lone | is_layer(path)
    return F.when(multi, "multi").when(low.rlike("[^/]" + _ends((*ALONE, ".gz"))), "single").otherwise("none")


def without_suffix(path: Column) -> Column:
    """The path without its compound archive ending, else without its last extension."""
    compound = "(?i)" + _ends(COMPOUND)
    return F.when(path.rlike(compound), F.regexp_replace(path, compound, "")).otherwise(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""))


def _kind(path: str) -> str:
    low, base = path.lower(), posixpath.basename(path).lower()
    stem, suffix = posixpath.splitext(base)
    if low.endswith(COMPOUND) or suffix in MANY:
        return "multi"
    if suffix == ".gz":
        return "single" if "." in stem else "multi"
    if not suffix and 32 <= len(base) <= 128 and not set(base) - set("0123456789abcdef") and "sha256" in low.split("/")[:-1]:
        return "multi"
    return "single" if suffix in ALONE else "none"


def _inside(name: str) -> str | None:
    """The member's path below its archive; None if it would leave it."""
    path = posixpath.normpath(name.replace("\\", "/"))
    return None if path.startswith(("/", "../")) or path in ("..", ".") or ":" in path.split("/")[0] else path


def _bounded(f, most: int) -> bytes:
    data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"larger than {most} bytes")
    return data


class _Archive:
    """An archive's files: their names at once, their contents one at a time. Raises if it is no archive."""

    def __init__(self, content: bytes):
        if zipfile.is_zipfile(io.BytesIO(content)):
            self.of = zipfile.ZipFile(io.BytesIO(content))
            self.files = [m for m in self.of.infolist() if not m.is_dir()]
            self.names, self.open = [m.filename for m in self.files], self.of.open
        else:
            self.of = tarfile.open(fileobj=io.BytesIO(content), mode="r:*")
            self.files = [m for m in self.of if m.isfile()]  # no folders, links, devices
            self.names, self.open = [m.name for m in self.files], self.of.extractfile
        self.paths = [_inside(n) for n in self.names]

    def __iter__(self) -> Iterator[tuple[bytes | None, str | None]]:
        """(content, error) of each file, in the order of the names."""
        for m, path in zip(self.files, self.paths):
            try:
                yield (None, "outside the archive") if path is None else (_bounded(self.open(m), self.most), None)
            except Exception as e:  # noqa: BLE001 - one bad member is no reason to lose the others
                yield None, str(e)

    most = MOST


def _level(paths: list[str], base: str) -> list[str]:
    """If all lies in one top folder named like the archive, that level is dropped."""
    tops = {p.split("/", 1)[0] for p in paths if not p.startswith("__MACOSX")}
    return [p.split("/", 1)[1] if "/" in p else p for p in paths] if tops == {base} and all("/" in p or p.startswith("__MACOSX") for p in paths) else paths


def expand(path: str, content: bytes, most: int = MOST, depth: int = 32) -> Iterator[tuple[str, bytes, str | None]]:
    """(path, content, extract_error) of a file: itself, or what is in it to any depth. What can't be unpacked stays a file."""
    kind = _kind(path) if depth else "none"
    if kind == "none":
        yield path, content, None if depth else "nested too deep"
        return
    try:
        if kind == "single":
            opener = {".bz2": bz2, ".gz": gzip}.get(posixpath.splitext(path.lower())[1], lzma)
            yield from expand(posixpath.splitext(path)[0], _bounded(opener.open(io.BytesIO(content)), most), most, depth - 1)
            return
        archive = _Archive(content)
        archive.most = most
    except Exception as e:  # noqa: BLE001
        if kind == "multi" and path.lower().endswith(".gz") and not path.lower().endswith(".tar.gz"):
            try:  # a lone name.gz that holds one plain file
                yield posixpath.splitext(path)[0], _bounded(gzip.open(io.BytesIO(content)), most), None
                return
            except Exception:  # noqa: BLE001
                pass
        yield path, content, str(e)
        return
    low = path.lower()
    root = next((path[: -len(x)] for x in COMPOUND if low.endswith(x)), posixpath.splitext(path)[0])
    names = _level([p or n for p, n in zip(archive.paths, archive.names)], posixpath.basename(root))
    for name, (data, error) in zip(names, archive):
        if data is None:
            yield f"{root}/{name}", b"", error
        else:
            yield from expand(f"{root}/{name}", data, most, depth - 1)


def packed(files: DataFrame) -> DataFrame:
    """(path, content): each of the files (archive, path, content) in a zip, which is in a compressed tar of the name of its archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for archive, path, content in zip(frame["archive"], frame["path"], frame["content"]):
                inner, outer = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(path, bytes(content))
                with tarfile.open(fileobj=outer, mode="w:gz", compresslevel=1) as t:
                    info = tarfile.TarInfo("in.zip")
                    info.size = len(inner.getvalue())
                    t.addfile(info, io.BytesIO(inner.getvalue()))
                done.append((f"{archive}.tar.gz", outer.getvalue()))
            yield pd.DataFrame(done, columns=["path", "content"])

    return files.select("archive", "path", "content").mapInPandas(run, "path string, content binary")


def expand_rows(files: DataFrame, most: int = MOST) -> DataFrame:
    """(path, content, extract_error) of files (path string, content binary), nested archives in one pass without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                rows, size = [], 0
                for row in expand(path, bytes(content) if content is not None else b"", most):
                    rows.append(row)
                    size += len(row[1])
                    if size > 64 << 20:
                        yield pd.DataFrame(rows, columns=["path", "content", "extract_error"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["path", "content", "extract_error"])

    return files.where("path is not null").select("path", "content").mapInPandas(run, "path string, content binary, extract_error string")
