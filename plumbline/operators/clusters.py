"""Quality of clusters, selection among partitions, and clusters by rule."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import fixed
from plumbline.functions.paths import basename, dirname, holds
from plumbline.operators import kernels, packed
from plumbline.operators.common import cut, ship

P = "project"


def cluster_quality(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Sizes and densities of each (project, community) from one pass over the edges.

    Every edge is counted at both of its ends: it is internal if they share a community, external otherwise.
    """
    m = membership.select(P, "node", "community")
    src = m.select(P, F.col("node").alias("src"), F.col("community").alias("cs"))
    dst = m.select(P, F.col("node").alias("dst"), F.col("community").alias("cd"))
    named = edges.join(src, [P, "src"]).join(dst, [P, "dst"])
    own = F.col("cs") == F.col("cd")
    ends = named.select(P, F.explode(F.array(F.struct(F.col("cs").alias("community"), own.alias("inside"), F.lit(1).alias("first")), F.struct(F.col("cd").alias("community"), own.alias("inside"), F.lit(0).alias("first")))).alias("x")).select(P, "x.*")
    counted = ends.groupBy(P, "community").agg(F.count(F.lit(1)).alias("ends"), F.count_if(~F.col("inside")).alias("outer"), F.sum(F.when(F.col("inside"), F.col("first")).otherwise(0)).alias("inner"))
    pairs = named.where(own & (F.col("src") != F.col("dst"))).select(P, F.col("cs").alias("community"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy(P, "community").agg(F.count(F.lit(1)).alias("pairs"))
    sizes = m.groupBy(P, "community").agg(F.count(F.lit(1)).alias("size"))
    totals = m.groupBy(P).agg(F.count(F.lit(1)).alias("n")).join(edges.groupBy(P).agg(F.count(F.lit(1)).alias("e")), P, "left")
    x = sizes.join(totals, P).join(counted, [P, "community"], "left").join(pairs, [P, "community"], "left").fillna(0, ["ends", "outer", "inner", "pairs", "e"])
    part = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)
    n, e = F.col("size"), F.col("e")
    share = F.col("ends") / (2 * F.greatest(e, F.lit(1)))
    return x.select(
        P, "community", "size",
        part(F.col("pairs"), n * (n - 1) / 2).alias("cohesion"), part(F.col("outer"), F.col("ends")).alias("coupling"),
        F.when(e > 0, (F.col("inner") - share * share * e) / F.greatest(e, F.lit(1))).otherwise(0.0).alias("modularity"),
        part(F.col("inner"), n * (n - 1)).alias("internal_density"), part(F.col("outer"), n * (F.col("n") - n)).alias("external_density"),
        part(F.col("outer"), F.col("ends")).alias("conductance"),
    )


def silhouette(membership: DataFrame, metrics: DataFrame) -> DataFrame:
    """(project, community, silhouette): mean over nodes of (b - a) / b where b > a, else 0.

    a: mean distance to the others of the cluster; b: least distance to any node outside. Both need the distances of all
    pairs within a project, so equal vectors are merged first: pairs are made of distinct (community, vector) only, block by
    block in memory, in parts that are dealt over all tasks. Time stays quadratic in them, what is held or moved is linear.
    """
    cols = list(kernels.METRICS)
    v = membership.select(P, "node", "community").join(metrics.select(P, "node", *cols), [P, "node"]).groupBy(P, "community", *cols).agg(F.count(F.lit(1)).alias("k"))
    v = v.select(P, F.col("community").cast("long").alias("community"), *[F.col(c).cast("double").alias(c) for c in cols], "k")
    ship(v.sparkSession)
    rows = cut(v.groupBy(P).applyInArrow(kernels.vectors, f"{P} string, n long, community binary, scaled binary, k binary"))
    per = packed.in_parts(rows, F.col("n") * F.col("n") / kernels.PAIRS, kernels.silhouettes, f"{P} string, community long, score double, size double")
    out = per.groupBy(P, "community").agg((F.sum("score") / F.sum("size")).alias("silhouette"))
    return out.withColumn("community", F.col("community").cast(membership.schema["community"].dataType))


def best_partition(quality: DataFrame) -> DataFrame:
    """(project, algo, score): the partition with the best mean quality; ties go to the first of louvain, spectral, greedy.

    quality: (project, algo, community, modularity, silhouette, cohesion, coupling).
    """
    score = 0.3 * F.avg("modularity") + 0.3 * F.avg("silhouette") + 0.2 * F.avg("cohesion") + 0.2 * F.avg(1 - F.col("coupling"))
    order = F.when(F.col("algo") == "louvain", 0).when(F.col("algo") == "spectral", -1).when(F.col("algo") == "greedy", -2).otherwise(-3)
    per = quality.groupBy(P, "algo").agg(score.alias("score"))
    best = per.groupBy(P).agg(F.max(F.struct(F.round("score", 12).alias("score"), order.alias("first"), F.col("algo").alias("algo"))).alias("b"))
    return best.select(P, "b.algo", "b.score")


def count_holding(paths: Column, words: list[str]) -> Column:
    return F.size(F.filter(paths, lambda p: holds(F.lower(p), words)))


def cluster_context(paths: Column) -> Column:
    """First context whose words are in 60 % of the paths or more; null if none."""
    need = F.ceil(F.size(paths) * 0.6)
    out = None
    for name, words in fixed.CONTEXTS:
        hit = count_holding(paths, words) >= need
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def cluster_name(kind: Column, average: Column, index: Column, context: Column) -> Column:
    """Label of the type with a size prefix, number and context. index: from 0 where a type was split, else null."""
    pairs = [x for k, label in fixed.CLUSTER_LABELS.items() for x in (F.lit(k), F.lit(label))]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("Modules"))
    mark = F.when(average > 25, "Complex ").when(average < 5, "Simple ").otherwise("")
    numbered = F.concat(label, F.when(index > 0, F.concat(F.lit(" "), (index + 1).cast("string"))).otherwise(""))
    return F.concat(mark, F.when(context.isNotNull(), F.concat(context, F.lit(" "))).otherwise(""), numbered)


def cluster_purpose(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in fixed.PURPOSES.items() for x in p]), kind), F.lit("General functionality"))


def _grow(limit: int):
    """Clusters of one project and type: from each file not yet taken, breadth first along edges out, then in."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path").reset_index(drop=True)
        files, here = list(pdf["path"]), set(pdf["path"])
        out = {p: [d for d in (ds if ds is not None else ()) if d in here] for p, ds in zip(pdf["path"], pdf["targets"], strict=True)}
        into: dict[str, list[str]] = {}
        for p in files:
            for d in dict.fromkeys(out[p]):
                into.setdefault(d, []).append(p)
        taken: dict[str, tuple[int, int]] = {}
        k = 0
        for start in files:
            if start in taken:
                continue
            queue, size, at = [start], 0, 0
            while at < len(queue) and size < limit:
                p = queue[at]
                at += 1
                if p in taken:
                    continue
                taken[p] = (k, size)
                size += 1
                queue += [d for d in [*out[p], *into.get(p, ())] if d not in taken]
            k += 1
        return pd.DataFrame({"project": pdf["project"], "type": pdf["type"], "path": files, "ordinal": [taken[p][0] for p in files], "place": [taken[p][1] for p in files]})

    return run


def type_clusters(files: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """(project, type, path, ordinal, place): files by type; types over `limit` files are split along their edges.

    ordinal is null where the type is one cluster. Only types that need it go through the sequential kernel.
    """
    ship(files.sparkSession)
    counts = files.groupBy(P, "type").agg(F.count(F.lit(1)).alias("n"))
    named = files.select(P, "type", "path").join(counts, [P, "type"])
    order = W.partitionBy(P, "type").orderBy("path")
    small = named.where(F.col("n") <= limit).select(P, "type", "path", F.lit(None).cast("long").alias("ordinal"), (F.row_number().over(order) - 1).cast("long").alias("place"))
    targets = edges.groupBy(P, F.col("src").alias("path")).agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    large = named.where(F.col("n") > limit).join(targets, [P, "path"], "left").select(P, "type", "path", "targets")
    grown = large.groupBy(P, "type").applyInPandas(_grow(limit), "project string, type string, path string, ordinal long, place long")
    return small.unionByName(grown)


def describe_clusters(members: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each cluster: cluster_key, id, files, averages, connections, purpose.

    id is a display name and may repeat; cluster_key doesn't. connections counts edges to files of other clusters.
    """
    key = F.concat_ws("#", "type", F.coalesce(F.col("ordinal").cast("string"), F.lit("all")))
    m = members.withColumn("cluster_key", key)
    rolled = m.join(files.select(P, "path", "complexity", "loc"), [P, "path"]).groupBy(P, "cluster_key", "type", "ordinal").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("files"), F.avg("complexity").alias("avg_complexity"), F.sum("loc").alias("total_loc"), F.count(F.lit(1)).alias("size"))
    src = m.select(P, F.col("path").alias("src"), "cluster_key")
    dst = m.select(P, F.col("path").alias("dst"), F.col("cluster_key").alias("other"))
    outer = edges.join(src, [P, "src"]).join(dst, [P, "dst"], "left").where(F.col("other").isNull() | (F.col("other") != F.col("cluster_key"))).groupBy(P, "cluster_key").agg(F.count(F.lit(1)).alias("connections"))
    out = rolled.join(outer, [P, "cluster_key"], "left").fillna(0, ["connections"])
    return out.withColumn("id", cluster_name(F.col("type"), F.col("avg_complexity"), F.col("ordinal"), cluster_context(F.col("files")))).withColumn("purpose", cluster_purpose(F.col("type")))


def directory_clusters(files: DataFrame, limit: int = 12) -> DataFrame:
    """(project, id, path): files by their grandparent directory, in chunks of `limit`."""
    d = dirname("path")
    group = F.when(dirname(d) == ".", d).otherwise(dirname(d))
    g = files.select(P, "path", group.alias("dir"))
    w = W.partitionBy(P, "dir")
    g = g.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("chunk", F.floor((F.row_number().over(w.orderBy("path")) - 1) / limit))
    return g.select(P, F.concat(basename("dir"), F.lit(" Modules"), F.when(F.col("n") > limit, F.concat(F.lit(" "), (F.col("chunk") + 1).cast("string"))).otherwise("")).alias("id"), "path")


def ui_name(clusters: DataFrame) -> DataFrame:
    """(project, cluster_key, ui_name): the name with most (file, word) hits, the first of equals, prefixed if complex.

    clusters: (project, cluster_key, ordinal from 0, files, avg_complexity).
    """
    scores = F.array(*[F.struct(count_hits(F.col("files"), words).alias("score"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(fixed.UI_NAMES)])
    best = F.array_max(scores)
    name = F.when(best["score"] > 0, best["name"]).otherwise(F.concat(F.lit("Module Group "), (F.col("ordinal") + 1).cast("string")))
    return clusters.select(P, "cluster_key", F.concat(F.when(F.col("avg_complexity") > 20, "Complex ").otherwise(""), name).alias("ui_name"))


def count_hits(paths: Column, words: list[str]) -> Column:
    """Number of (path, word) pairs where the path holds the word."""
    hit = lambda path, w: F.when(F.lower(path).contains(w), 1).otherwise(0)
    return F.aggregate(paths, F.lit(0), lambda a, f: a + sum((hit(f, w) for w in words[1:]), hit(f, words[0])))
