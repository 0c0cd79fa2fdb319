"""Source files of projects: discovery rules, validation, and readers and sinks of tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions import fixed
from plumbline.functions.paths import basename, extension, stem
from plumbline.operators.common import ship

P = "project"


def eligible(kind: str, path: Column | str = "path", size: Column | str = "size_bytes") -> Column:
    """Whether a file is looked at: extension, directories above it and size, by the rules of an analysis.

    The security scan takes all extensions and sizes but no directory that starts with a dot (files may).
    """
    p = F.col(path) if isinstance(path, str) else path
    n = F.col(size) if isinstance(size, str) else size
    folders = F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    ignored = F.exists(folders, lambda d: d.isin(*fixed.IGNORED[kind]))
    if kind == "security":
        return ~ignored & ~F.exists(folders, lambda d: d.startswith(".") & ~d.isin(".", ".."))
    return ~ignored & extension(p).isin(*["." + e for e in fixed.EXTENSIONS[kind]]) & (n <= fixed.MAX_BYTES[kind])


def discover(files: DataFrame, kind: str = "advanced") -> DataFrame:
    return files.where(eligible(kind))


def check_projects(files: DataFrame, kind: str = "advanced") -> DataFrame:
    """(project, n, error, warning): no files, too many, or none that looks like an entry point."""
    entry = F.max(F.lower(basename("path")).rlike("|".join(fixed.ENTRY_NAMES)).cast("int")) == 1
    c = files.groupBy(P).agg(F.count(F.lit(1)).alias("n"), entry.alias("entry"))
    return c.select(P, "n", F.when(F.col("n") > fixed.MAX_FILES[kind], F.lit("Too many files")).alias("error"), F.when(~F.col("entry"), F.lit("No entry point found")).alias("warning"))


def require_valid(files: DataFrame, kind: str = "advanced") -> DataFrame:
    """files, or an error if there are none or a project has too many."""
    if files.isEmpty():
        raise ValueError("No files to analyze")
    bad = check_projects(files, kind).where("error is not null").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r[P]}: {r['error']} ({r['n']})" for r in bad))
    return files


class _Files(InputPartition):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["path"].removeprefix("file://"), options.get("kind", "advanced")

    def partitions(self) -> list[_Files]:
        """Groups of files of about 16 MB; ignored directories are not entered, files of other kinds not listed."""
        wanted = None if self.kind == "security" else tuple("." + e for e in fixed.EXTENSIONS[self.kind])
        groups, held, size = [], [], 0
        for folder, below, names in os.walk(self.root):
            below[:] = sorted(d for d in below if d not in fixed.IGNORED[self.kind])
            for name in sorted(names):
                path = os.path.join(folder, name)
                n = os.path.getsize(path) if os.path.isfile(path) else -1
                if n < 0 or n > fixed.MAX_BYTES[self.kind] or (wanted and not name.endswith(wanted)):
                    continue
                held.append(os.path.relpath(path, self.root))
                size += n
                if size >= 16 << 20 or len(held) >= 2000:
                    groups.append(_Files(self.root, held))
                    held, size = [], 0
        return [*groups, _Files(self.root, held)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            with open(os.path.join(partition.root, name), "rb") as f:
                data = f.read()
            yield name, data, len(data)


class TreeSource(DataSource):
    """Files of a directory tree that every executor sees, names that begin with . or _ included (Spark's own file
    sources skip those)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "rel string, content binary, length long"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def read_directory(spark: SparkSession, path: str, project: str | None = None, kind: str = "advanced") -> DataFrame:
    """(project, path, content, size_bytes) of a directory tree. Files are filtered by name and size before they are read.

    The project is `project`, or the first directory below path. A path with another scheme than file:// is read by
    Spark's binaryFile source, which doesn't see names that begin with . or _.
    """
    if "://" not in path or path.startswith("file://"):
        ship(spark)
        spark.dataSource.register(TreeSource)
        raw = spark.read.format("tree").option("kind", kind).load(path)
    else:
        glob = "*" if kind == "security" else "*.{" + ",".join(fixed.EXTENSIONS[kind]) + "}"
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
        root = path.rstrip("/") + "/"
        raw = raw.where(F.col("length") <= fixed.MAX_BYTES[kind]).withColumn("rel", F.element_at(F.split("path", r"\Q" + root + r"\E", 2), -1))
    own = raw.select("rel", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size_bytes"))
    named = own.select(F.lit(project).alias(P), F.col("rel").alias("path"), "content", "size_bytes") if project else own.select(F.substring_index("rel", "/", 1).alias(P), F.regexp_replace("rel", "^[^/]*/", "").alias("path"), "content", "size_bytes")
    return named.where(eligible(kind))


def read_repository_listing(spark: SparkSession, path: str) -> DataFrame:
    """Repository records from saved JSON pages, newest first when sorted by updated_at."""
    schema = "id long, name string, full_name string, description string, private boolean, html_url string, clone_url string, default_branch string, language string, stargazers_count long, forks_count long, updated_at timestamp"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def listing_page(repositories: DataFrame, page: int = 1, size: int = 30) -> DataFrame:
    return repositories.orderBy(F.desc("updated_at"), "id").offset((page - 1) * size).limit(size)


def decoded(contents: DataFrame, column: str = "content") -> DataFrame:
    """Text of base64 file contents; line breaks in them are ignored."""
    return contents.withColumn(column, F.make_valid_utf8(F.unbase64(F.regexp_replace(column, r"\s", "")).cast("string")))


def search_files(files: DataFrame, words: str, ext: str | None = None) -> DataFrame:
    """Files whose path or content holds the words, of one extension if given."""
    hit = F.lower("content").contains(words.lower()) | F.lower("path").contains(words.lower())
    return files.where(hit & (extension("path") == "." + ext if ext else F.lit(True)))


def languages(files: DataFrame) -> DataFrame:
    """(project, extension, bytes)."""
    return files.groupBy(P, extension("path").alias("extension")).agg(F.sum("size_bytes").alias("bytes"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_analyses(analyses: DataFrame, path: str) -> None:
    """Append to the history of analyses, a directory of Parquet partitioned by project."""
    analyses.write.mode("append").partitionBy(P).parquet(path)


__all__ = ["append_analyses", "check_projects", "decoded", "discover", "eligible", "languages", "listing_page", "read_directory", "read_repository_listing", "require_valid", "search_files", "stem", "write_json"]
