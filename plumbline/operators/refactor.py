"""Plans that move files into directories by cluster, and their execution."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import fixed
from plumbline.functions.grades import complexity_level, half_up
from plumbline.functions.paths import any_of, basename, safe_directory

P = "project"


def any_holds(files: Column, words: list[str]) -> Column:
    return F.exists(files, lambda f: any_of([F.lower(f).contains(w) for w in words]))


def purpose(files: Column) -> Column:
    """First purpose of which any file holds a word."""
    out = None
    for name, words, _ in fixed.REFACTOR_PURPOSES:
        hit = any_holds(files, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general functionality")


def directory_name(purpose_col: Column, level: Column) -> Column:
    """<simple, standard or complex>-<slug>: clusters may share it."""
    slug = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for name, _, s in fixed.REFACTOR_PURPOSES for x in (name, s)]), purpose_col), F.lit("modules"))
    return safe_directory(F.concat(F.when(level == "low", "simple-").when(level == "high", "complex-").otherwise("standard-"), slug))


def structures(clusters: DataFrame) -> DataFrame:
    """(project, cluster_key, files, complexity, purpose, directory) from described clusters."""
    level = complexity_level("avg_complexity")
    return clusters.select(P, "cluster_key", "files", "avg_complexity", level.alias("complexity"), purpose(F.col("files")).alias("purpose")).withColumn("directory", directory_name(F.col("purpose"), F.col("complexity")))


def moves(structure: DataFrame) -> DataFrame:
    """(project, cluster_key, from, to, reason, collision). collision: another file moves to the same place."""
    each = structure.select(P, "cluster_key", "purpose", "complexity", "directory", F.explode("files").alias("from"))
    to = F.concat(F.col("directory"), F.lit("/"), basename("from"))
    reason = F.concat(F.lit("Grouped with "), F.col("purpose"), F.lit(" files ("), F.col("complexity"), F.lit(" complexity)"))
    return each.select(P, "cluster_key", "from", to.alias("to"), reason.alias("reason")).withColumn("collision", F.count(F.lit(1)).over(W.partitionBy(P, "to")) > 1)


def improvement(structure: DataFrame) -> DataFrame:
    """(project, estimated_improvement, n_directories, variety, complexity_balance, size_balance)."""
    s = structure.withColumn("size", F.size("files"))
    k = F.col("k").cast("double")
    a = s.groupBy(P).agg(F.count(F.lit(1)).alias("k"), F.count_distinct("purpose").alias("purposes"), F.count_distinct("directory").alias("n_directories"), *[F.count_if(F.col("complexity") == x).alias(x) for x in ("low", "medium", "high")], F.avg("size").alias("mean"), F.stddev_pop("size").alias("sd"))
    spread = sum(((F.col(x) - k / 3) * (F.col(x) - k / 3) for x in ("medium", "high")), (F.col("low") - k / 3) * (F.col("low") - k / 3)) / 3
    a = a.withColumn("variety", F.col("purposes") / k).withColumn("complexity_balance", F.greatest(F.lit(0.0), 1 - spread / (k / 3 * k / 3))).withColumn("size_balance", F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean")))
    return a.select(P, half_up(10 * (0.4 * F.col("variety") + 0.3 * F.col("complexity_balance") + 0.3 * F.col("size_balance"))).alias("estimated_improvement"), "n_directories", "variety", "complexity_balance", "size_balance")


def summary(structure: DataFrame) -> DataFrame:
    """(project, total_moves, directories in first-seen order, estimated_improvement)."""
    first = structure.groupBy(P, "directory").agg(F.min("cluster_key").alias("seen"), F.sum(F.size("files")).alias("n"))
    rolled = first.groupBy(P).agg(F.sum("n").alias("total_moves"), F.transform(F.sort_array(F.collect_list(F.struct("seen", "directory"))), lambda x: x["directory"]).alias("directories_created"))
    return rolled.join(improvement(structure).select(P, "estimated_improvement"), P)


def apply_plan(structure: DataFrame, project: str, source: str | Path, target: str | Path) -> dict[str, int]:
    """Copy one project's files into their directories with a README each and an overview.

    Works on local folders, for one project of at most the analyzer's file limit; the plan streams in, one row at a time.
    """
    source, target = Path(source), Path(target)
    made, copied, lines = 0, 0, []
    for row in structure.where(F.col(P) == project).orderBy("cluster_key").toLocalIterator():
        folder = target / row["directory"]
        folder.mkdir(parents=True, exist_ok=True)
        made += 1
        names = []
        for name in row["files"]:
            if (source / name).is_file():
                shutil.copyfile(source / name, folder / Path(name).name)
                copied += 1
            names.append(Path(name).name)
        listed = "\n".join(f"- {n}" for n in names)
        (folder / "README.md").write_text(f"# {row['directory']}\n\nPurpose: {row['purpose']}\n\nComplexity: {row['complexity']}\n\n## Files\n\n{listed}\n")
        lines.append(f"- {row['directory']}: {row['purpose']}, {len(names)} files, {row['complexity']} complexity")
    (target / "OVERVIEW.md").write_text("# Project overview\n\n" + "\n".join(lines) + "\n")
    return {"directories": made, "files": copied}
