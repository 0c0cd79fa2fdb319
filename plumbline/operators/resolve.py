"""Dependencies: from the spelling of an import to the file it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import fixed
from plumbline.functions.lexing import imports
from plumbline.functions.paths import basename, dirname, extension, stem
from plumbline.operators.common import cut

P = "project"
#: Beginnings of words up to which they are broadcast.
HEADS = 50_000


def raw_imports(files: DataFrame, literal: bool = False) -> DataFrame:
    """(project, src, dep, ordinal) from (project, path, content)."""
    return files.select(P, F.col("path").alias("src"), F.posexplode(imports("path", "content", literal)).alias("ordinal", "dep"))


def joined_path(directory: Column, relative: Column) -> Column:
    """Normal form of directory/relative: `.` is dropped and `..` takes the part before it."""
    parts = F.filter(F.split(F.concat(directory, F.lit("/"), relative), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).when(x == "..", a).otherwise(F.concat(a, F.array(x))))
    return F.array_join(up, "/")


def keys(files: DataFrame) -> DataFrame:
    """(project, key, target): name without extension, parent/name and full path; the greatest path wins a key."""
    parent = F.concat(basename(dirname("path")), F.lit("/"), stem("path"))
    rows = files.select(P, F.explode(F.array_distinct(F.array(stem("path"), parent, F.col("path")))).alias("key"), F.col("path").alias("target"))
    return rows.groupBy(P, "key").agg(F.max("target").alias("target"))


def candidates(src: Column, dep: Column, kind: str = "advanced") -> Column:
    """Keys to try, in order: as written; then for relative spellings the joined path, with extensions, as a directory.

    Python dots become directories, Java names a path with its extension, C includes are looked up beside the file; these
    come after the others.
    """
    exts = fixed.RESOLVE_EXTENSIONS[kind]
    full = joined_path(dirname(src), dep)
    relative = F.concat(F.array(full), *[F.array(F.concat(full, F.lit("." + e))) for e in exts], *[F.array(F.concat(full, F.lit("/index." + e))) for e in exts])
    e = extension(src)
    dotted = F.regexp_replace(F.regexp_replace(dep, r"^\.+", ""), r"\.", "/")
    up = F.repeat(F.lit("../"), F.length(F.regexp_extract(dep, r"^(\.*)", 1)) - 1)
    python = F.when(dep.startswith("."), joined_path(dirname(src), F.concat(up, dotted))).otherwise(dotted)
    more = (
        F.when(e == ".py", F.array(F.concat(python, F.lit(".py")), F.concat(python, F.lit("/__init__.py"))))
        .when(e == ".java", F.array(F.concat(dotted, F.lit(".java"))))
        .when(e.isin(".cpp", ".c", ".h", ".hpp"), F.array(full, dep))
        .otherwise(F.array().cast("array<string>"))
    )
    local = dep.startswith(".") & (e != ".py") | dep.startswith("./") | dep.startswith("../")
    first = F.when(dep.startswith("/"), F.array(dep, F.substring(dep, 2, 1 << 20))).otherwise(F.array(dep))
    return F.concat(first, F.when(local, relative).otherwise(F.array().cast("array<string>")), more)


def resolve(raw: DataFrame, files: DataFrame, kind: str = "advanced") -> DataFrame:
    """(project, src, dep, ordinal, dst): the first candidate that is a key, or null for an external one.

    kind base: only spellings that start with `.` or `/` are looked up, and files don't depend on themselves.
    """
    tried = raw.where(F.col("dep").startswith(".") | F.col("dep").startswith("/")) if kind == "base" else raw
    each = tried.select(P, "src", "dep", "ordinal", F.posexplode(candidates(F.col("src"), F.col("dep"), kind)).alias("priority", "key"))
    found = each.join(keys(files), [P, "key"]).groupBy(P, "src", "dep", "ordinal").agg(F.min_by("target", "priority").alias("dst"))
    if kind == "base":
        found = found.where("src <> dst")
    return raw.join(found, [P, "src", "dep", "ordinal"], "left")


def edges(resolved: DataFrame, distinct: bool = True) -> DataFrame:
    """(project, src, dst). The base analysis keeps repeated edges, the advanced one doesn't."""
    e = resolved.where("dst is not null").select(P, "src", "dst")
    return e.distinct() if distinct else e


def external(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst is null").select(P, "src", "dep").distinct()


def node_cluster(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(project, node, community): the first cluster that lists the node, else null."""
    first = membership.groupBy(P, "node").agg(F.min("community").alias("community"))
    return nodes.join(first, [P, "node"], "left")


def heads_at(text: str) -> Column:
    """array<struct<at, head>>: up to three characters from each place of a text on, whole and shortened to two and one."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.struct(i.alias("at"), F.substr(F.col(text), i, F.lit(3)).alias("x")))
    return F.flatten(F.transform(at, lambda p: F.array_distinct(F.array(*[F.struct(p["at"].alias("at"), F.substr(p["x"], F.lit(1), F.lit(n)).alias("head")) for n in (3, 2, 1)]))))


def containing(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """texts joined with words (distinct) of the same project that they contain; a pair once for each place.

    Where the first three characters of some word stand, the text is cut to the lengths of the words that begin so, and the
    cuts are joined to the words as a whole: a beginning that many words share costs as many cuts as they have lengths.
    """
    heads = cut(words.groupBy(P, F.substring(word, 1, 3).alias("head")).agg(F.collect_set(F.length(word)).alias("lengths")))
    near = F.broadcast(heads) if heads.count() <= HEADS else heads
    found = texts.withColumn("h", F.explode(heads_at(text))).select(*texts.columns, "h.at", "h.head").join(near, [P, "head"])
    cuts = found.select(*texts.columns, F.explode(F.transform("lengths", lambda n: F.substr(F.col(text), F.col("at"), n))).alias(word))
    return cuts.join(words.hint("merge"), [P, word])


def file_cluster_by_name(files: DataFrame, cluster_files: DataFrame) -> DataFrame:
    """(project, path, cluster): first cluster with a file that equals the path or contains its basename, else Unclustered.

    cluster_files: (project, ordinal, cluster, file). A file that equals the path contains its basename.
    """
    f = files.select(P, "path").distinct().withColumn("name", basename("path"))
    hit = containing(cluster_files.select(P, "ordinal", "cluster", "file"), "file", f.select(P, "name").distinct(), "name")
    best = hit.groupBy(P, "name").agg(F.min_by("cluster", "ordinal").alias("cluster"))
    return f.join(best, [P, "name"], "left").select(P, "path", F.coalesce("cluster", F.lit("Unclustered")).alias("cluster"))


def links(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, src, dep, target): the first node (by ordinal) that equals the dependency or whose path contains it.

    deps: (project, src, dep); nodes: (project, ordinal, node). Distinct spellings are matched once.
    """
    n, each = nodes.select(P, "ordinal", F.col("node").alias("target")), deps.select(P, "dep").distinct()
    hit = containing(n, "target", each.where("dep <> ''"), "dep").groupBy(P, "dep").agg(F.min_by("target", "ordinal").alias("target"))
    # Every path contains the empty spelling.
    blank = each.where("dep = ''").join(n.groupBy(P).agg(F.min_by("target", "ordinal").alias("target")), P)
    return deps.join(hit.unionByName(blank), [P, "dep"]).select(P, "src", "dep", "target")


def first_of_each(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")
