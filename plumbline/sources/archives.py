"""Archives as a source and a sink.

`spark.read.format("archive").load(dir)` gives (archive, name, type, size, data): each archive is read by one task, entry
by entry, with limits on their number and sizes. `archive` is its path below dir, so archives of one name in two
folders stay apart. One that is broken, too large or of an unknown kind gives a row of type "error", whose name says why,
and those entries that were read before; the others are read all the same.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions.fixed import ARCHIVE_LIMITS
from plumbline.operators.common import ship

SCHEMA = "archive string, name string, type string, size long, data binary"
Entry = tuple[str, str, int, bytes | None]


class ArchiveError(ValueError):
    pass


def kind_of(name: str) -> str:
    n = name.lower()
    for suffix, kind in ((".zip", "zip"), (".gz", "tar.gz"), (".tgz", "tar.gz"), (".tar", "tar"), (".7z", "7z"), (".rar", "rar")):
        if n.endswith(suffix):
            return kind
    raise ArchiveError(f"Cannot detect archive type: {name}")


def safe_name(name: str) -> str:
    out = name.lstrip("/").replace("..", "")
    while "//" in out:
        out = out.replace("//", "/")
    return out.strip()


class _Limits:
    def __init__(self, limits: dict[str, int]):
        self.most, self.n, self.total = limits, 0, 0

    def entry(self) -> None:
        self.n += 1
        if self.n > self.most["entries"]:
            raise ArchiveError(f"Too many files in archive (more than {self.most['entries']})")

    def size(self, name: str, size: int) -> None:
        if size > self.most["entry_bytes"]:
            raise ArchiveError(f"File too large in archive: {name}")
        self.total += size
        if self.total > self.most["total_bytes"]:
            raise ArchiveError("Archive too large when extracted")


def read_zip(data: bytes, limits: dict[str, int]) -> Iterator[Entry]:
    """Entries of a zip; those that leave the directory or can't be read are skipped."""
    guard = _Limits(limits)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            guard.entry()
            name = safe_name(info.filename)
            if not name or ".." in Path(info.filename).parts:
                continue
            if info.is_dir():
                yield name, "directory", 0, None
                continue
            guard.size(name, info.file_size)
            try:
                yield name, "file", info.file_size, z.read(info)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                continue


def salvage_zip(data: bytes, limits: dict[str, int]) -> Iterator[Entry]:
    """Entries found by their local headers, for a zip without a readable directory; stored and deflated ones only."""
    guard, at = _Limits(limits), data.find(b"PK\x03\x04")
    while at >= 0 and at + 30 <= len(data):
        method, packed, plain, n_name, n_extra = struct.unpack_from("<8xH8xIIHH", data, at)
        start = at + 30 + n_name + n_extra
        raw = data[at + 30 : at + 30 + n_name].decode("utf-8", "replace")
        if ".." in Path(raw).parts:
            raise ArchiveError(f"Path traversal in archive: {raw}")
        if method not in (0, 8) or start + packed > len(data):
            return
        guard.entry()
        guard.size(raw, plain)
        name, body = safe_name(raw), data[start : start + packed]
        if raw.endswith("/"):
            yield name, "directory", 0, None
        else:
            out = body if method == 0 else zlib.decompressobj(-15).decompress(body, limits["entry_bytes"] + 1)
            # The header may declare less than comes out.
            guard.size(raw, max(len(out), plain) - plain)
            if len(out) > limits["entry_bytes"]:
                raise ArchiveError(f"File too large in archive: {raw}")
            yield name, "file", max(len(out), plain), out
        at = data.find(b"PK\x03\x04", start + packed)


def read_tar(data: bytes, mode: str, limits: dict[str, int]) -> Iterator[Entry]:
    """Files of a tar as a stream; entries that leave the directory are skipped."""
    guard = _Limits(limits)
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as t:
        for info in t:
            guard.entry()
            if not info.isfile() or ".." in Path(info.name).parts:
                continue
            guard.size(info.name, info.size)
            yield safe_name(info.name), "file", info.size, t.extractfile(info).read()


def readable(data: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)):
            return True
    except zipfile.BadZipFile:
        return False


def rows_of(archive: str, data: bytes) -> Iterator[tuple]:
    """(archive, name, type, size, data) of each entry, and of the error that ends the reading, if any."""
    try:
        for e in entries(archive, data):
            yield (archive, *e)
    except (ArchiveError, zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError) as e:
        yield archive, str(e), "error", 0, None


def entries(name: str, data: bytes, limits: dict[str, int] = ARCHIVE_LIMITS) -> Iterator[Entry]:
    kind = kind_of(name)
    if kind == "zip":
        # The directory is read before the first entry; without one, nothing has been given out yet.
        yield from read_zip(data, limits) if readable(data) else salvage_zip(data, limits)
    elif kind in ("tar", "tar.gz"):
        try:
            yield from read_tar(data, "r|gz" if kind == "tar.gz" else "r|", limits)
        except tarfile.TarError as e:
            raise ArchiveError(f"Invalid archive: {e}") from e
    else:
        raise ArchiveError(f"Unsupported archive format: {kind} is not supported yet")


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[_Part]:
        root = Path(self.path)
        found = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.is_file())
        return [_Part(str(p)) for p in found]

    def read(self, partition: _Part) -> Iterator[tuple]:
        path, root = Path(partition.path), Path(self.path)
        yield from rows_of(path.name if path == root else str(path.relative_to(root)), path.read_bytes())


class ArchiveSource(DataSource):
    """Archives in a folder that every executor sees under the same path, one task each."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives from any store Spark reads, one archive at a time in each task."""
    ship(spark)
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toString()
    below = F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", len(root) + 2, 1 << 30)).otherwise(F.element_at(F.split("path", "/"), -1))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(below.alias("archive"), F.col("content").alias("bytes"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["archive"], pdf["bytes"], strict=True):
                yield pd.DataFrame(list(rows_of(name, bytes(data))), columns=["archive", "name", "type", "size", "data"])

    return raw.mapInPandas(run, SCHEMA)


def source_files(archived: DataFrame) -> DataFrame:
    """(project, path, content, size_bytes): an archive is a project."""
    return archived.where("type = 'file'").select(F.col("archive").alias("project"), F.col("name").alias("path"), F.make_valid_utf8(F.col("data").cast("string")).alias("content"), F.col("size").alias("size_bytes"))


def zip_tree(folder: str | Path, target: str | Path) -> int:
    """Zip a directory tree at the highest level; returns the number of files."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(folder))
                n += 1
    return n
