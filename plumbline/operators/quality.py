"""Rollups and scores of whole projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import grades
from plumbline.functions.paths import basename

P = "project"


def metadata(files: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(project, total_files, total_clusters, avg_complexity, total_complexity, total_loc)."""
    f = files.groupBy(P).agg(F.count(F.lit(1)).alias("total_files"), F.avg("complexity").alias("avg_complexity"), F.sum("complexity").alias("total_complexity"), F.sum("loc").alias("total_loc"))
    if clusters is None:
        return f.withColumn("total_clusters", F.lit(0).cast("long"))
    return f.join(clusters.groupBy(P).agg(F.count(F.lit(1)).alias("total_clusters")), P, "left").fillna(0, ["total_clusters"])


def weight_statistics(nodes: DataFrame) -> DataFrame:
    """(project, total, average, population variance, share above twice the average)."""
    s = nodes.groupBy(P).agg(F.sum("weight").alias("total_complexity"), F.avg("weight").alias("average_complexity"), F.var_pop("weight").alias("complexity_variance"), F.count(F.lit(1)).alias("n"))
    high = nodes.join(s.select(P, "average_complexity"), P).groupBy(P).agg(F.count_if(F.col("weight") > 2 * F.col("average_complexity")).alias("n_high"))
    return s.join(high, P).withColumn("high_share", F.col("n_high") / F.col("n"))


def quality_metrics(stats: DataFrame, topology: DataFrame, coupling: DataFrame) -> DataFrame:
    """structural_health (saturating) and its scaled form, maintainability, risk and debt, each 0 to 100.

    topology: (project, modularity, clustering, density); coupling: (project, avg_coupling).
    """
    x = stats.join(topology, P).join(coupling, P, "left").fillna(0.0, ["avg_coupling"])
    health = 50 * F.col("modularity") + 30 * F.col("clustering") + 20 * (1 - F.col("density"))
    x = x.withColumn("structural_health", grades.clamp(100 * health)).withColumn("structural_health_scaled", grades.clamp(health))
    x = x.withColumn("maintainability_score", grades.clamp(100 - 2 * F.col("average_complexity") - 50 * F.col("avg_coupling")))
    x = x.withColumn("evolutionary_risk", grades.clamp(10 * F.sqrt("complexity_variance") + 100 * F.col("high_share")))
    return x.withColumn("technical_debt", grades.clamp(0.4 * F.col("evolutionary_risk") + 0.4 * (100 - F.col("maintainability_score")) + 0.2 * (100 - F.col("structural_health"))))


def complexity_buckets(files: DataFrame) -> DataFrame:
    counts = files.groupBy(P, grades.complexity_bucket("complexity").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy(P)))


def top_files(files: DataFrame, k: int = 10) -> DataFrame:
    """(project, rank, path, complexity): the k most complex, ties by path.

    A row_number with a limit below it lets Spark keep k rows a task before the shuffle.
    """
    w = W.partitionBy(P).orderBy(F.desc("complexity"), "path")
    return files.select(P, "path", "complexity").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def heuristic_modularity(clusters: DataFrame) -> DataFrame:
    """(project, modularity): from number and spread of cluster sizes alone."""
    s = clusters.groupBy(P).agg(F.count(F.lit(1)).alias("k"), F.var_pop("size").alias("spread"))
    return s.select(P, F.least(F.lit(1.0), F.least(F.col("k") / 10, F.lit(0.8)) + F.greatest(F.lit(0.0), 0.3 - F.col("spread") / 100)).alias("modularity"))


def opportunities(members: DataFrame, graded: DataFrame) -> DataFrame:
    """(project, community, type, priority, description, files, estimated_effort) for clusters with files graded F.

    A cluster's files make one list: it is no longer than the cluster.
    """
    bad = members.join(graded.where("grade = 'F'").select(P, "node"), [P, "node"])
    out = bad.groupBy(P, "community").agg(F.sort_array(F.collect_list("node")).alias("files"))
    return out.select(P, "community", F.lit("complexity_reduction").alias("type"), F.lit("high").alias("priority"), F.concat(F.size("files").cast("string"), F.lit(" files need complexity reduction")).alias("description"), "files", F.lit("medium").alias("estimated_effort"))


def important_nodes(nodes: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Nodes worth a label: betweenness over .1, weight over 50, or selected."""
    return nodes.where((F.col("betweenness") > 0.1) | (F.col("weight") > 50) | F.col("node").isin(*(selected or [""])))


def extents(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.groupBy(P).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def ui_nodes(files: DataFrame) -> DataFrame:
    """Files keyed by basename; of files with the same name the last path stays."""
    f = files.withColumn("name", basename("path"))
    return f.groupBy(P, "name").agg(F.max_by(F.struct(*files.columns), "path").alias("x")).select("name", "x.*")
