"""The two analyses of projects, from source files to scores.

Files are (project, path, content, size_bytes). Results are DataFrames by name; expose() makes them temporary views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import grades, lexing, metrics
from plumbline.functions.paths import extension, file_type, language
from plumbline.operators import clusters, graph, kernels, quality, refactor, resolve, security
from plumbline.operators.common import cut
from plumbline.sources.files import discover, require_valid

P = "project"


def expose(results: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in results.items():
        df.createOrReplaceTempView(prefix + name)


def scan(files: DataFrame, strict: bool = True, severities: tuple[str, ...] = tuple(security.SEVERITIES)) -> DataFrame:
    """Issues of the files that the scan looks at; strict raises for blocked and oversized ones."""
    return security.scan(discover(files, "security"), strict, severities)


def base_files(files: DataFrame) -> DataFrame:
    """(project, path, language, type, loc, complexity, imports, exports). A null content counts as empty."""
    e, text = extension("path"), F.coalesce("content", F.lit(""))
    js = e.isin(".js", ".jsx", ".ts", ".tsx")
    complexity = F.when(js, metrics.complexity_base_javascript(text)).when(e == ".py", metrics.cyclomatic_base_python(text)).otherwise(metrics.complexity_base_generic(text))
    exports = F.when(js, lexing.javascript_exports(text)).when(e == ".py", lexing.python_exports(text)).otherwise(F.array().cast("array<string>"))
    return files.select(P, "path", language("path").alias("language"), file_type("path").alias("type"), metrics.lines(text).alias("loc"), complexity.alias("complexity"), lexing.imports("path", text).alias("imports"), exports.alias("exports"))


def analyze(files: DataFrame, skip_security: bool = False) -> dict[str, DataFrame]:
    """Scalar complexity, dependencies and clusters by rule."""
    files = require_valid(discover(files, "base"), "base")
    issues = scan(files, strict=False)
    if not skip_security:
        security.enforce(issues)
    own = cut(base_files(files))
    raw = own.select(P, F.col("path").alias("src"), F.posexplode("imports").alias("ordinal", "dep"))
    resolved = cut(resolve.resolve(raw, own.select(P, "path"), "base"))
    edges = resolve.edges(resolved, distinct=False)
    members = cut(clusters.type_clusters(own.select(P, "path", "type"), edges))
    described = clusters.describe_clusters(members, own, edges)
    described = described.withColumn("quality", grades.cluster_quality("avg_complexity", "size", "connections")).withColumn("complexity_level", grades.complexity_level("avg_complexity"))
    meta = quality.metadata(own, described)
    return {
        "files": own.withColumn("grade", grades.base_grade("complexity")).withColumn("risk", grades.base_risk("complexity")),
        "dependencies": edges, "external": resolve.external(resolved), "clusters": described, "metadata": meta, "issues": issues,
        "scores": meta.select(P, *[c.alias(n) for n, c in grades.saved_scores("avg_complexity", "total_files", "total_clusters").items()], grades.saved_recommendations("avg_complexity", "total_files", "total_clusters").alias("recommendations")),
        "heuristics": quality.heuristic_modularity(described).join(graph.density(own.select(P, F.col("path").alias("node")), edges).select(P, "density"), P),
    }


def analyze_advanced(files: DataFrame, skip_security: bool = False, coupling_in_weight: bool = True, literal_imports: bool = False, dangling: str = "uniform") -> dict[str, DataFrame]:
    """Twelve metrics a file, centralities, communities, cluster quality, topology and project scores."""
    files = require_valid(discover(files, "advanced"), "advanced")
    if not skip_security:
        # Only critical issues stop an analysis, and no others are returned here.
        security.enforce(scan(files, strict=True, severities=("critical",)))
    measured = cut(metrics.with_metrics(files.select(P, F.col("path").alias("node"), "content"), path="node"))
    resolved = cut(resolve.resolve(resolve.raw_imports(files, literal_imports), files.select(P, "path")))
    edges = cut(resolve.edges(resolved))
    nodes = measured.select(P, "node")
    coupling = F.col("cbo") if coupling_in_weight else F.lit(0)
    whole = measured.join(graph.degrees(nodes, edges), [P, "node"]).withColumn("weight", metrics.weight(F.col("cyclomatic"), F.col("cognitive"), F.col("halstead"), F.col("mi"), coupling))
    paths = cut(graph.path_levels(nodes, edges))
    for measure in (graph.betweenness(nodes, edges), graph.closeness(nodes, paths), graph.pagerank(nodes, edges, dangling=dangling), graph.eigenvector(nodes, edges)):
        whole = whole.join(measure, [P, "node"])
    whole = cut(whole)
    partitions = cut(kernels.communities(whole, edges))
    judged = []
    for algo in ("louvain", "spectral", "greedy"):
        m = partitions.where(F.col("algo") == algo)
        judged.append(clusters.cluster_quality(m, edges).join(clusters.silhouette(m, whole), [P, "community"]).withColumn("algo", F.lit(algo)))
    rated = cut(judged[0].unionByName(judged[1]).unionByName(judged[2]))
    best = clusters.best_partition(rated)
    chosen = rated.join(best.select(P, "algo"), [P, "algo"])
    members = cut(partitions.join(best.select(P, "algo"), [P, "algo"]))
    topology = graph.modularity(edges, members).join(graph.small_world(nodes, edges, paths), P).join(graph.density(nodes, edges).select(P, "density"), P).join(graph.scale_free(graph.degree_histogram(graph.degrees(nodes, edges))), P)
    scores = quality.quality_metrics(quality.weight_statistics(whole), topology, chosen.groupBy(P).agg(F.avg("coupling").alias("avg_coupling")))
    graded = whole.withColumn("grade", grades.complexity_grade("cyclomatic", "cognitive", "mi", "nesting")).withColumn("risk", grades.risk_level("cyclomatic", "cognitive", "cbo", "mi")).withColumn("priority", grades.refactoring_priority("weight", "betweenness", "cbo"))
    return {
        "nodes": resolve.node_cluster(graded, members), "edges": edges, "external": resolve.external(resolved), "membership": members,
        "clusters": chosen.withColumn("grade", grades.cluster_grade("cohesion", "coupling", "modularity", "silhouette")).withColumn("recommendations", grades.cluster_recommendations("cohesion", "coupling", "modularity", "conductance", "size")),
        "opportunities": quality.opportunities(members, graded),
        "metrics": scores.withColumn("recommendations", grades.project_recommendations("modularity", "average_complexity", "density")),
    }


def plan_refactor(clusters_described: DataFrame) -> dict[str, DataFrame]:
    s = refactor.structures(clusters_described)
    return {"structures": s, "moves": refactor.moves(s), "summary": refactor.summary(s)}


def to_json(spark: SparkSession, results: dict[str, DataFrame]) -> DataFrame:
    """(section, row): all results as JSON rows."""
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row")) for name, df in results.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out
