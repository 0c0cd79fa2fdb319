"""Values worked out by hand, and kernels against definitions."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clusters, graph, kernels, packed

NODES = ["app", "database", "index", "router", "utils"]
EDGES = [("index", "app"), ("index", "utils"), ("app", "router"), ("app", "database")]


@pytest.fixture(scope="module")
def basic(spark):
    n = spark.createDataFrame([("p", x) for x in NODES], "project string, node string").cache()
    e = spark.createDataFrame([("p", a, b) for a, b in EDGES], "project string, src string, dst string").cache()
    return n, e


def by_node(df, column):
    return {r["node"]: round(r[column], 6) for r in df.collect()}


def test_paths(basic):
    n, e = basic
    p = graph.shortest_paths(n, e)
    assert p.count() == 6
    assert round(graph.average_path_length(n, p).first()["average_path_length"], 6) == 1.333333
    assert by_node(graph.closeness(n, p), "closeness") == {"index": 0.666667, "app": 1.0, "utils": 0.0, "router": 0.0, "database": 0.0}
    assert by_node(graph.betweenness(n, e, p), "betweenness") == {"app": 0.333333, "index": 0.0, "utils": 0.0, "router": 0.0, "database": 0.0}


def test_pagerank(basic):
    n, e = basic
    drop = by_node(graph.pagerank(n, e, dangling="drop", iterations=60), "pagerank")
    assert drop == {"index": 0.03, "app": 0.04275, "utils": 0.04275, "router": 0.048169, "database": 0.048169}
    uniform = by_node(graph.pagerank(n, e, tolerance=1e-9), "pagerank")
    assert uniform == {"index": 0.141618, "app": 0.201806, "utils": 0.201806, "router": 0.227385, "database": 0.227385}


def test_topology(basic):
    n, e = basic
    assert graph.density(n, e).first()["density"] == 0.2
    deg = graph.degrees(n, e)
    assert {(r["degree"], r["n"]) for r in graph.degree_histogram(deg).collect()} == {(1, 3), (2, 1), (3, 1)}
    assert round(graph.scale_free(graph.degree_histogram(deg)).first()["exponent"], 6) == 1.06299
    assert by_node(graph.clustering_coefficient(n, e), "coefficient") == dict.fromkeys(NODES, 0.0)


def test_cluster_quality(spark, basic):
    _, e = basic
    m = spark.createDataFrame([("p", x, int(x in ("app", "router", "database"))) for x in NODES], "project string, node string, community long")
    assert graph.modularity(e, m).first()["modularity"] == 0.25
    got = {r["community"]: [round(r[c], 6) for c in ("cohesion", "coupling", "modularity", "internal_density", "external_density", "conductance")] for r in clusters.cluster_quality(m, e).collect()}
    assert got == {0: [1.0, 0.333333, 0.109375, 0.5, 0.166667, 0.333333], 1: [0.666667, 0.2, 0.109375, 0.333333, 0.166667, 0.2]}


def test_empty_edges(spark, basic):
    n, e = basic
    none = e.limit(0)
    assert graph.shortest_paths(n, none).count() == 0
    assert set(by_node(graph.betweenness(n, none, graph.shortest_paths(n, none)), "betweenness").values()) == {0.0}
    assert graph.modularity(none, n.withColumn("community", F.lit(0))).first()["modularity"] == 0.0


def random_graph(seed, n=18, p=0.15):
    rng = random.Random(seed)
    return kernels.Graph([f"n{i:02d}" for i in range(n)], [(i, j) for i in range(n) for j in range(n) if i != j and rng.random() < p])


def definition_q(g, c):
    a, k = g.matrix(), g.matrix().sum(axis=1)
    two_m = a.sum()
    return sum(a[i, j] - k[i] * k[j] / two_m for i in range(g.n) for j in range(g.n) if c[i] == c[j]) / two_m


@pytest.mark.parametrize("seed", range(4))
def test_modularity_is_its_definition(seed):
    g = random_graph(seed)
    c = [random.Random(seed).randrange(4) for _ in range(g.n)]
    assert abs(g.modularity(c) - definition_q(g, c)) < 1e-12


@pytest.mark.parametrize("seed", range(4))
def test_greedy_takes_the_best_move(seed):
    g = random_graph(seed, 10)
    c = list(range(g.n))
    while True:
        q = definition_q(g, c)
        best = max(((definition_q(g, [to if x == i else y for x, y in enumerate(c)]), -i) for i in range(g.n) for to in {c[j] for j in g.near(i)} if to != c[i]), default=(q, 0))
        if best[0] <= q + 1e-12:
            break
        for i in range(g.n):
            moved = False
            for to in dict.fromkeys(c[j] for j in g.near(i)):
                t = [to if x == i else y for x, y in enumerate(c)]
                if to != c[i] and abs(definition_q(g, t) - best[0]) < 1e-12:
                    c, moved = t, True
                    break
            if moved:
                break
    assert abs(definition_q(g, kernels.greedy(g)) - definition_q(g, c)) < 1e-9


def test_kernels_partition_nodes():
    g = random_graph(7, 25)
    for f in (kernels.louvain, kernels.spectral, kernels.greedy):
        c = f(g)
        assert len(c) == g.n
    x = np.array([[0.0] * 5, [0.1] * 5, [9.0] * 5, [9.1] * 5])
    c = kernels.agglomerative(x)
    assert c[0] == c[1] != c[2] == c[3]


def test_frame_and_kernel_agree(spark):
    g = random_graph(3, 16)
    n = spark.createDataFrame([("p", x) for x in g.nodes], "project string, node string")
    e = spark.createDataFrame([("p", g.nodes[i], g.nodes[j]) for i in range(g.n) for j in g.out[i]], "project string, src string, dst string")
    p = graph.shortest_paths(n, e)
    far = np.full((g.n, g.n), np.inf)
    for i in range(g.n):
        far[i, i] = 0
        for j in g.out[i]:
            far[i, j] = 1
    for k in range(g.n):
        far = np.minimum(far, far[:, [k]] + far[[k], :])
    want = {(g.nodes[i], g.nodes[j]): far[i, j] for i in range(g.n) for j in range(g.n) if i != j and np.isfinite(far[i, j])}
    assert {(r["src"], r["dst"]): r["dist"] for r in p.collect()} == want


def test_small_and_large_projects_agree(spark):
    rng = random.Random(5)
    rows = [(p, f"n{a}", f"n{b}") for p, n in (("a", 12), ("b", 30), ("c", 3)) for a in range(n) for b in rng.sample(range(n + 1), rng.randint(0, 3))]
    rows += [("a", "stranger", "n1"), ("b", "n1", "n2"), ("b", "n1", "n2"), ("nowhere", "x", "y")]
    e = spark.createDataFrame(rows, "project string, src string, dst string")
    n = spark.createDataFrame([(p, f"n{i}") for p, k in (("a", 12), ("b", 30), ("c", 3), ("lonely", 1)) for i in range(k)], "project string, node string")
    for make in (
        lambda s: graph.pagerank(n, e, dangling="uniform", iterations=8, small=s),
        lambda s: graph.pagerank(n, e, dangling="drop", iterations=8, small=s),
        lambda s: graph.eigenvector(n, e, iterations=6, small=s),
    ):
        ways = [{(r[0], r[1]): r[2] for r in make(s).collect()} for s in (1000, 40, 0)]
        assert len(ways[0]) == 46
        for other in ways[1:]:
            assert ways[0].keys() == other.keys()
            assert all(abs(v - other[k]) < 1e-12 for k, v in ways[0].items())


def test_ranks_of_nodes_taken_from_edges(basic):
    _, e = basic
    assert graph.pagerank(graph.nodes_of(e), e, iterations=3).count() == 5
    assert graph.eigenvector(graph.nodes_of(e), e, iterations=3).count() == 5


def test_names_without_a_cluster(spark):
    from plumbline.operators import resolve

    f = spark.createDataFrame([("p", "src/a.js"), ("p", "src/b.js"), ("p", "src/c.js")], "project string, path string")
    c = spark.createDataFrame([("p", 2, "two", "src/a.js"), ("p", 1, "one", "old/b.js.old")], "project string, ordinal int, cluster string, file string")
    assert {(r["path"], r["cluster"]) for r in resolve.file_cluster_by_name(f, c).collect()} == {("src/a.js", "two"), ("src/b.js", "one"), ("src/c.js", "Unclustered")}
    m = spark.createDataFrame([("p", 3, "src/a.js"), ("p", 1, "src/a.js")], "project string, community int, node string")
    got = resolve.node_cluster(f.withColumnRenamed("path", "node"), m)
    assert {(r["node"], r["community"]) for r in got.collect()} == {("src/a.js", 1), ("src/b.js", None), ("src/c.js", None)}


def test_searches_agree_with_joins(spark):
    """Kernels count from each node what rows of pairs give: over many rows for a batch, strangers, loops, no edges."""
    rng = random.Random(9)
    rows = [(p, f"n{a}", f"n{b}") for p, n in (("a", 40), ("b", 15)) for a in range(n) for b in rng.sample(range(n), rng.randint(0, 3))]
    rows += [("a", "n1", "stranger"), ("a", "stranger", "n2"), ("b", "n3", "n3")]
    e = spark.createDataFrame(rows, "project string, src string, dst string").distinct().cache()
    n = spark.createDataFrame([(p, f"n{i}") for p, k in (("a", 40), ("b", 15), ("lonely", 1)) for i in range(k)], "project string, node string").cache()
    p = graph.shortest_paths(n, e).cache()
    want = {tuple(r) for r in p.groupBy("project", "src", "dist").agg(F.count(F.lit(1)), F.sum("paths")).collect()}
    for large in (1000, 50, 0):
        levels = graph.path_levels(n, e, large=large)
        assert {tuple(r) for r in levels.collect()} == want
        got = {(r[0], r[1]): r[2] for r in graph.betweenness(n, e, large=large).collect()}
        if large == 1000:
            first = got
        assert len(got) == 56 and all(abs(v - first[k]) < 1e-12 for k, v in got.items())
    assert {tuple(r) for r in graph.path_levels(n, e, most=2).collect()} == {w for w in want if w[2] <= 2}
    for measure in (graph.closeness, graph.average_path_length, graph.efficiency):
        ways = [{r[:-1]: r[-1] for r in map(tuple, measure(n, x).select("project", *(c for c in measure(n, x).columns if c != "project")).collect())} for x in (p, levels)]
        assert ways[0].keys() == ways[1].keys() and all(abs(v - ways[1][k]) < 1e-12 for k, v in ways[0].items())


def test_search_follows_an_edge_once():
    """A chain of 3,000 nodes has as many levels: no work a level may grow with the whole project."""
    n = 3000
    starts, targets = np.minimum(np.arange(n + 1), n - 1).astype(np.int32), np.arange(1, n, dtype=np.int32)
    begun = time.time()
    found = [len(x[0]) for _, levels in packed.search(n, starts, targets, np.arange(0, n, 3, dtype=np.int32), None) for x in levels]
    assert sum(found) == sum(n - s for s in range(0, n, 3))
    assert time.time() - begun < 20


def test_grades_at_their_limits(spark):
    """Scores that are exactly 10, 20, 35 and 50; sums of binary fractions fall short of them."""
    from plumbline.functions import grades

    score = lambda c, g, m, n: 0.25 * c + 0.30 * g + 0.25 * (100 - m) + 0.40 * n
    rows = [(c, g, float(m), n, x) for c in range(0, 50, 3) for g in range(0, 70, 3) for m in range(0, 101, 7) for n in range(7) for x in (10, 20, 35, 50) if 25 * c + 30 * g + 25 * (100 - m) + 40 * n == 100 * x and score(c, g, m, n) < x]
    assert len({r[4] for r in rows}) >= 3
    df = spark.createDataFrame(rows, "cyclomatic long, cognitive long, mi double, nesting long, x int")
    got = df.select("x", grades.complexity_grade("cyclomatic", "cognitive", "mi", "nesting").alias("g")).distinct().collect()
    assert {r["x"]: r["g"] for r in got}.items() <= {10: "B", 20: "C", 35: "D", 50: "F"}.items() and len(got) == len({r[4] for r in rows})


def test_silhouette_in_blocks():
    """Against its definition, in several parts; what is held must not grow with pairs."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 3000
    community, k = np.array([7, 3, 9])[rng.integers(0, 3, n)], rng.integers(1, 4, n)
    community[0], k[0] = 1, 1
    x = {c: rng.integers(0, 30, n).astype(float) for c in kernels.METRICS}
    x["mi"][5] = np.nan
    row = kernels.vectors(pa.table({"project": ["p"] * n, "community": community, "k": k, **x})).to_pylist()[0]
    tracemalloc.start()
    parts = [kernels.silhouettes(row, i, 3).to_pandas() for i in range(3)]
    assert tracemalloc.get_traced_memory()[1] < n * n * 8 / 10
    tracemalloc.stop()
    got = pd.concat(parts).groupby("community")[["score", "size"]].sum()
    v = np.column_stack([x[c] / s for c, s in kernels.METRICS.items()])
    want = {}
    for i in range(n):
        d = np.sqrt(((v[i] - v) ** 2).sum(axis=1))
        same = community == community[i]
        a, b = np.nansum(d[same] * k[same]) / max(k[same].sum() - 1, 1), np.nanmin(d[~same]) if i != 5 else 0.0
        want[community[i]] = want.get(community[i], 0.0) + (k[i] * (b - a) / b if b > a and i != 5 else 0.0)
    assert dict(got["size"]) == {c: k[community == c].sum() for c in want}
    assert all(abs(got["score"][c] - s) < 1e-9 for c, s in want.items())


@pytest.mark.parametrize("kind", ("random", "chain", "split"))
def test_spectral_from_lists_is_dense_spectral(kind, monkeypatch):
    rng = random.Random(3)
    n = 400
    pairs = [(i, i + 1) for i in range(n - 1)] + ([(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)] if kind == "random" else [])
    if kind == "split":
        pairs = [(i, j) for i, j in pairs if (i < 150) == (j < 150)]
    g = kernels.Graph([f"n{i}" for i in range(n)], pairs)
    dense = kernels.spectral(g)
    monkeypatch.setattr(kernels, "DENSE", 10)
    monkeypatch.setattr(kernels.Graph, "matrix", None)
    # With two components any mix of both is a vector of eigenvalue 0; the one taken tells them apart.
    assert kernels.spectral(g) == ([int(i >= 150) for i in range(n)] if kind == "split" else dense)


def test_spectral_of_many_nodes_holds_no_matrix():
    """20,000 nodes: a dense matrix would be 3.2 GB."""
    import tracemalloc

    rng = random.Random(3)
    n = 20_000
    pairs = [(i, i + 1) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(4 * n)]
    tracemalloc.start()
    c = kernels.spectral(kernels.Graph([str(i) for i in range(n)], pairs))
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    assert 0 < sum(c) < n


def slow_louvain(g):
    """By its definition: links to a community are counted anew for each."""
    c, total, m = list(range(g.n)), g.k.copy(), g.e / 2
    for _ in range(kernels.SWEEPS):
        moved = False
        for i in range(g.n):
            best, where, ki = 0.0, c[i], g.k[i]
            for to in dict.fromkeys(c[j] for j in g.near(i)):
                if to != c[i]:
                    inside = sum(c[j] == to and j != i for j in g.out[i])
                    gain = inside / m - ((total[to] + ki) / (2 * m)) ** 2 + (total[to] / (2 * m)) ** 2 + (ki / (2 * m)) ** 2
                    if gain > best:
                        best, where = gain, to
            if where != c[i]:
                total[c[i]] -= ki
                total[where] += ki
                c[i], moved = where, True
        if not moved:
            break
    return c


def test_louvain_works_by_degree():
    """The same moves as by definition; a hub that links 3,000 communities isn't gone through once for each of them."""
    g = random_graph(11, 60, 0.1)
    assert kernels.louvain(g) == slow_louvain(g)
    hub = kernels.Graph([str(i) for i in range(3000)], [(0, i) for i in range(3000)] + [(i, i % 2999 + 1) for i in range(1, 3000)])
    begun = time.time()
    kernels.louvain(hub)
    assert time.time() - begun < 8


def test_greedy_keeps_unchanged_moves():
    """A chain of 2,000 nodes: each move asks near nodes only, not all again."""
    g = kernels.Graph([str(i) for i in range(2000)], [(i, i + 1) for i in range(1999)])
    begun = time.time()
    kernels.greedy(g)
    assert time.time() - begun < 8


def test_ranks_by_numbers_agree_with_names(spark):
    """Projects over `small` are numbered and held as arrays up to `large`; strangers and repeated edges as by names."""
    rng = random.Random(6)
    rows = [(p, f"n{a}", f"n{b}") for p, n in (("a", 12), ("b", 30)) for a in range(n) for b in rng.sample(range(n + 1), rng.randint(0, 3))]
    rows += [("a", "stranger", "n1"), ("b", "n1", "n2"), ("b", "n1", "n2"), ("nowhere", "x", "y")]
    e = spark.createDataFrame(rows, "project string, src string, dst string").cache()
    n = spark.createDataFrame([(p, f"n{i}") for p, k in (("a", 12), ("b", 30), ("lonely", 1)) for i in range(k)], "project string, node string").cache()
    for make in (lambda **k: graph.pagerank(n, e, iterations=8, **k), lambda **k: graph.pagerank(n, e, dangling="drop", iterations=8, **k), lambda **k: graph.eigenvector(n, e, iterations=6, **k)):
        names, numbers = ({(r["project"], r["node"]): r[2] for r in make(**k).collect()} for k in ({"small": 1000}, {"small": 30, "large": 1000}))
        assert names.keys() == numbers.keys() and len(names) == 43
        assert all(abs(v - numbers[k]) < 1e-12 for k, v in names.items())
