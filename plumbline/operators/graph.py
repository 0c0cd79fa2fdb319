"""Graph measures over an edge table (project, src, dst) and a node table (project, node).

Everything is joins and aggregations, keyed by project first, so that many projects are worked off side by side. Ranks of a
project and searches from its nodes are kernels over arrays of its edges instead. Edges are distinct; self-loops count in
degrees, densities and modularity but not in paths and triangles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import kernels, packed
from plumbline.operators.common import cut

P = "project"
#: Nodes and edges up to which a project's ranks are one task's work.
SMALL = 200_000
#: Nodes and edges up to which a project is held as arrays of numbers by one task.
LARGE = 20_000_000


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(P, F.col("src").alias("node")).union(edges.select(P, F.col("dst").alias("node"))).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(P, F.col("dst").alias("src"), F.col("src").alias("dst"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(project, node, other): both directions, a node itself if it has a self-loop."""
    return edges.select(P, F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select(P, F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, node, fan_in, fan_out, cbo): one pass over both ends of the edges."""
    ends = edges.select(P, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(P, F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counted = ends.groupBy(P, "node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(counted, [P, "node"], "left").select(P, "node", zero("fan_in"), zero("fan_out")).withColumn("cbo", F.col("fan_in") + F.col("fan_out"))


def degree_histogram(deg: DataFrame) -> DataFrame:
    return deg.groupBy(P, F.col("cbo").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def scale_free(histogram: DataFrame) -> DataFrame:
    """(project, exponent): slope of the log-log histogram, without sign; 0 for fewer than three positive degrees."""
    h = histogram.where("degree > 0").groupBy(P).agg(F.count(F.lit(1)).alias("k"), F.abs(F.regr_slope(F.log("n"), F.log("degree"))).alias("slope"))
    every = histogram.select(P).distinct()
    return every.join(h, P, "left").select(P, F.when(F.col("k") >= 3, F.coalesce("slope", F.lit(0.0))).otherwise(0.0).alias("exponent"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(P).agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy(P).agg(F.count(F.lit(1)).alias("e"))
    return n.join(e, P, "left").select(P, "n", F.coalesce("e", F.lit(0)).alias("e")).withColumn("density", F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))


def clustering_coefficient(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, node, coefficient): linked pairs of neighbours over all pairs, on the undirected simple graph.

    Triangles are found from edges directed from the smaller to the greater (degree, node), so that a hub's neighbours
    are never paired: a node has at most sqrt(2 E) such edges.
    """
    simple = edges.where("src <> dst").select(P, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = simple.select(P, F.explode(F.array("a", "b")).alias("node")).groupBy(P, "node").agg(F.count(F.lit(1)).alias("k"))
    named = lambda c, k: deg.select(P, F.col("node").alias(c), F.col("k").alias(k))
    ranked = simple.join(named("a", "ka"), [P, "a"]).join(named("b", "kb"), [P, "b"])
    up = F.struct("ka", "a") < F.struct("kb", "b")
    directed = cut(ranked.select(P, F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = directed.alias("x").join(directed.alias("y"), (F.col(f"x.{P}") == F.col(f"y.{P}")) & (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v"))).select(F.col(f"x.{P}").alias(P), F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    triangles = wedges.join(simple, [P, "a", "b"]).select(P, F.explode(F.array("u", "a", "b")).alias("node")).groupBy(P, "node").agg(F.count(F.lit(1)).alias("t"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return nodes.join(deg, [P, "node"], "left").join(triangles, [P, "node"], "left").select(P, "node", F.when(F.col("k") >= 2, F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0).alias("coefficient"))


def shortest_paths(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(project, src, dst, dist, paths) for src <> dst that can be reached, with the number of shortest paths.

    Breadth-first from all nodes at once: the frontier meets the edges, what has been seen is taken out. Self-loops play
    no part. `most` bounds the length; without it the search goes on until no frontier is left.
    """
    steps = edges.where("src <> dst").select(P, F.col("src").alias("at"), F.col("dst").alias("next"))
    frontier = nodes.select(P, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("dist"), F.lit(1.0).alias("paths"))
    seen, level = frontier, 0
    while most is None or level < most:
        level += 1
        reached = frontier.select(P, "src", F.col("dst").alias("at"), "paths").join(steps, [P, "at"]).groupBy(P, "src", F.col("next").alias("dst")).agg(F.sum("paths").alias("paths"))
        frontier = cut(reached.join(seen.select(P, "src", "dst"), [P, "src", "dst"], "left_anti").select(P, "src", "dst", F.lit(level).alias("dist"), "paths"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where("dist > 0")


def path_levels(nodes: DataFrame, edges: DataFrame, most: int | None = None, large: int = LARGE) -> DataFrame:
    """(project, src, dist, pairs, paths): how many nodes are dist away from src, on how many shortest paths in all.

    What closeness and mean lengths need of shortest_paths(), without a row for each pair: searches in parts of a project's
    nodes, each in memory. Projects of over `large` nodes and edges are searched by joins.
    """
    def small(own, links):
        names, rows = packed.searchable(own, links)
        found = packed.searches(rows, packed.level_rows(most), f"{P} string, i int, dist int, pairs long, paths double")
        return found.join(names.select(P, "i", F.col("node").alias("src")), [P, "i"]).select(P, "src", "dist", "pairs", "paths")

    def joins(own, links):
        return shortest_paths(own, links, most).groupBy(P, "src", "dist").agg(F.count(F.lit(1)).alias("pairs"), F.sum("paths").alias("paths"))

    return split(nodes, edges, [(large, small)], joins)


def counted(paths: DataFrame) -> DataFrame:
    """Rows of shortest_paths() as such of path_levels(), which stay."""
    return paths if "pairs" in paths.columns else paths.withColumn("pairs", F.lit(1))


def closeness(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """paths: of shortest_paths() or path_levels(), as for the measures below."""
    c = counted(paths).groupBy(P, F.col("src").alias("node")).agg((F.sum("pairs") / F.sum(F.col("dist") * F.col("pairs"))).alias("closeness"))
    return nodes.join(c, [P, "node"], "left").fillna(0.0, ["closeness"])


def average_path_length(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    a = counted(paths).groupBy(P).agg((F.sum(F.col("dist") * F.col("pairs")) / F.sum("pairs")).alias("average_path_length"), F.sum("pairs").alias("reachable"))
    return nodes.select(P).distinct().join(a, P, "left").fillna(0.0, ["average_path_length"]).fillna(0, ["reachable"])


def efficiency(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(project, efficiency): mean inverse distance over all ordered pairs."""
    n = nodes.groupBy(P).agg(F.count(F.lit(1)).alias("n"))
    s = counted(paths).groupBy(P).agg(F.sum(F.col("pairs") / F.col("dist")).alias("s"))
    return n.join(s, P, "left").select(P, F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("efficiency"))


def betweenness(nodes: DataFrame, edges: DataFrame, paths: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """(project, node, betweenness): shares of shortest paths through a node, over (n - 1)(n - 2) / 2.

    Dependencies are summed backwards from each source, one distance at a time: what depends on w passes on to each
    predecessor v of w by paths(v) / paths(w). A project of up to `large` nodes and edges is searched in parts of its nodes,
    each in memory; `paths` (its shortest_paths) serve larger ones only, which go by joins, one with the edges a level.
    """
    def small(own, links):
        names, rows = packed.searchable(own, links)
        found = packed.searches(rows, packed.dependency_rows, f"{P} string, i int, raw double").groupBy(P, "i").agg(F.sum("raw").alias("raw"))
        return found.join(names.select(P, "i", "node"), [P, "i"]).select(P, "node", "raw")

    def joins(own, links):
        return dependencies(links, shortest_paths(own, links) if paths is None else paths.join(own.select(P).distinct(), P, "left_semi"))

    b = split(nodes, edges, [(large, small)], joins)
    n = nodes.groupBy(P).agg(F.count(F.lit(1)).alias("n"))
    scaled = F.when(F.col("n") > 2, F.coalesce("raw", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2) / 2)).otherwise(0.0)
    return nodes.join(n, P).join(b, [P, "node"], "left").select(P, "node", scaled.alias("betweenness"))


def dependencies(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(project, node, raw): what depends on a node, summed over all sources."""
    steps = edges.where("src <> dst").select(P, F.col("src").alias("v"), F.col("dst").alias("w"))
    whole = cut(paths.select(P, F.col("src").alias("s"), F.col("dst").alias("w"), "dist", "paths"))
    deepest = whole.agg(F.max("dist")).first()[0] or 0
    total = carried = None
    for level in range(deepest, 1, -1):
        at = whole.where(F.col("dist") == level).select(P, "s", "w", F.col("paths").alias("pw"))
        at = at.withColumn("dep", F.lit(0.0)) if carried is None else at.join(carried, [P, "s", "w"], "left").fillna(0.0, ["dep"])
        before = whole.where(F.col("dist") == level - 1).select(P, "s", F.col("w").alias("v"), F.col("paths").alias("pv"))
        moved = at.join(steps, [P, "w"]).join(before, [P, "s", "v"]).groupBy(P, "s", F.col("v").alias("w")).agg(F.sum(F.col("pv") / F.col("pw") * (1 + F.col("dep"))).alias("dep"))
        carried = cut(moved)
        total = carried if total is None else total.unionAll(carried)
    if total is None:
        return steps.limit(0).select(P, F.col("v").alias("node"), F.lit(0.0).alias("raw"))
    return total.groupBy(P, F.col("w").alias("node")).agg(F.sum("dep").alias("raw"))


def split(nodes: DataFrame, edges: DataFrame, ways: list, joins) -> DataFrame:
    """Projects worked off by the first of ways, (most nodes and edges, make), that they fit, larger ones by joins.

    All but joins hold one project in one task, whose size is checked here; rounds of joins cost a job each, which only
    a very large project repays.
    """
    sizes = cut(nodes.select(P).unionAll(edges.select(P)).groupBy(P).agg(F.count(F.lit(1)).alias("size")))
    out, above = None, -1
    for most, make in [*ways, (None, joins)]:
        own = sizes.where((F.col("size") > above) & (F.lit(True) if most is None else F.col("size") <= most)).select(P)
        above = max(above, most or 0)
        if out is None and most == ways[-1][0] or not own.isEmpty():
            made = make(nodes.join(own, P, "left_semi"), edges.join(own, P, "left_semi"))
            out = made if out is None else out.unionByName(made)
    return out


def by_size(nodes: DataFrame, edges: DataFrame, column: str, kernel, joins, small: int, large: int) -> DataFrame:
    """(project, node, <column>) by kernel for projects of up to `large` nodes and edges, by joins for larger ones.

    Those of over `small` are numbered by Spark first, so that the task holds no names.
    """
    def few(own, links):
        return kernels.per_project(own, links, column, kernel)

    def many(own, links):
        names = packed.numbered(own.select(P, "node").distinct())
        found = packed.in_parts(packed.packed(names, links), F.lit(1), kernels.whole(column, kernel), f"{P} string, i int, {column} double")
        return own.join(found.join(names, [P, "i"]).select(P, "node", column), [P, "node"])

    return split(nodes, edges, [(small, few), (max(small, large), many)], joins)


def reach_of(small: int, large: int | None) -> int:
    """`large`; where only `small` is chosen, larger projects go by joins."""
    return large if large is not None else LARGE if small == SMALL else small


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, dangling: str = "uniform", iterations: int | None = None, tolerance: float = 1e-6, most: int = 100, every: int = 5, small: int = SMALL, large: int | None = None) -> DataFrame:
    """(project, node, pagerank). dangling: uniform spreads the rank of nodes without edges, drop loses it.

    With `iterations` so many rounds are made; else rounds end when the L1 change of a project (of all those worked off
    by joins) is below tolerance.
    """
    if dangling not in ("uniform", "drop"):
        raise ValueError(f"dangling: {dangling}")

    def kernel(n, src, dst):
        return kernels.pagerank(n, src, dst, damping, dangling, iterations, tolerance, most)

    def joins(own, links):
        return pagerank_by_joins(own, links, damping, dangling, iterations, tolerance, most, every)

    return by_size(nodes, edges, "pagerank", kernel, joins, small, reach_of(small, large))


def pagerank_by_joins(nodes: DataFrame, edges: DataFrame, damping: float, dangling: str, iterations: int | None, tolerance: float, most: int, every: int) -> DataFrame:
    """Edges keep their partitioning by source over all rounds; ranks are cut off their lineage every few rounds."""
    n = nodes.groupBy(P).agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = edges.groupBy(P, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    base = cut(nodes.join(n, P).join(out, [P, "node"], "left").select(P, "node", "n", F.coalesce("out", F.lit(0)).alias("out")))
    links = cut(edges.select(P, F.col("src").alias("node"), F.col("dst").alias("to")))
    ranks = base.withColumn("pr", 1 / F.col("n"))
    for i in range(1, (iterations or most) + 1):
        shares = ranks.where("out > 0").select(P, "node", (F.col("pr") / F.col("out")).alias("part")).join(links, [P, "node"])
        got = shares.groupBy(P, F.col("to").alias("node")).agg(F.sum("part").alias("got"))
        new = base.join(got, [P, "node"], "left")
        spread = F.lit(0.0)
        if dangling == "uniform":
            loose = ranks.groupBy(P).agg(F.sum(F.when(F.col("out") == 0, F.col("pr")).otherwise(0.0)).alias("loose"))
            new, spread = new.join(loose, P), F.col("loose") / F.col("n")
        new = new.select(P, "node", "n", "out", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + spread)).alias("pr"))
        if iterations:
            # Uniform rounds read the ranks twice, so their plans would double each time.
            ranks = cut(new) if dangling == "uniform" or i % every == 0 else new
            continue
        new = cut(new)
        moved = new.select(P, "node", F.col("pr").alias("now")).join(ranks, [P, "node"]).groupBy(P).agg(F.sum(F.abs(F.col("now") - F.col("pr"))).alias("d")).agg(F.max("d")).first()[0]
        ranks = new
        if moved is None or moved < tolerance:
            break
    return ranks.select(P, "node", F.col("pr").alias("pagerank"))


def eigenvector(nodes: DataFrame, edges: DataFrame, iterations: int = 50, small: int = SMALL, large: int | None = None) -> DataFrame:
    """(project, node, eigenvector): power iteration on A + I (right vector), length 1, not negative.

    The shift makes the iteration converge on graphs whose spectrum is all zero or comes in pairs.
    """
    def kernel(n, src, dst):
        return kernels.eigenvector(n, src, dst, iterations)

    return by_size(nodes, edges, "eigenvector", kernel, lambda own, links: eigenvector_by_joins(own, links, iterations), small, reach_of(small, large))


def eigenvector_by_joins(nodes: DataFrame, edges: DataFrame, iterations: int) -> DataFrame:
    links = cut(edges.select(P, F.col("src").alias("node"), F.col("dst").alias("to")))
    base = cut(nodes)
    x = base.withColumn("x", F.lit(1.0))
    for _ in range(iterations):
        got = links.join(x.select(P, F.col("node").alias("to"), "x"), [P, "to"]).groupBy(P, "node").agg(F.sum("x").alias("got"))
        # Cut here: the step below reads y twice, which would double the plan in every round.
        y = cut(x.join(got, [P, "node"], "left").select(P, "node", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x")))
        norm = y.groupBy(P).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        x = y.join(norm, P).select(P, "node", (F.col("x") / F.col("norm")).alias("x"))
    return x.select(P, "node", F.col("x").alias("eigenvector"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(project, modularity) of a partition: E_in / E - sum over communities of (K / E)^2, K the sum of out-degrees."""
    m = membership.select(P, "node", "community")
    src = m.select(P, F.col("node").alias("src"), F.col("community").alias("cs"))
    dst = m.select(P, F.col("node").alias("dst"), F.col("community").alias("cd"))
    named = edges.join(src, [P, "src"]).join(dst, [P, "dst"], "left")
    per = named.groupBy(P, "cs").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("cs") == F.col("cd")).alias("inside"))
    q = per.groupBy(P).agg(F.sum("k").alias("e"), F.sum("inside").alias("inside"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    return m.select(P).distinct().join(q, P, "left").select(P, F.when(F.col("e") > 0, F.col("inside") / F.col("e") - F.col("kk") / (F.col("e").cast("double") * F.col("e"))).otherwise(0.0).alias("modularity"))


def small_world(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(project, clustering, average_path_length, small_world): their ratio, 0 without paths."""
    c = clustering_coefficient(nodes, edges).groupBy(P).agg(F.avg("coefficient").alias("clustering"))
    return c.join(average_path_length(nodes, paths).select(P, "average_path_length"), P).withColumn("small_world", F.when(F.col("average_path_length") > 0, F.col("clustering") / F.col("average_path_length")).otherwise(0.0))


def community_assignment(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(project, node, community): -1 for nodes without one."""
    return nodes.join(membership.select(P, "node", "community"), [P, "node"], "left").withColumn("community", F.coalesce("community", F.lit(-1)))
