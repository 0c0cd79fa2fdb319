"""Whole projects as arrays of numbers, for work that each task does on a part of a project but that needs all of it.

A node is numbered from 0 within its project. The edges of a project become one row of two binary columns, 4 bytes a node
and 4 an edge; the row is repeated for each part, and parts are dealt over all tasks. What a task holds grows with one
project's edges, never with pairs of nodes. Rows have `parts` as many as the cluster works on at once, a few times over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.common import cut, ship

P = "project"
#: Steps of a search that are worth a task of their own.
WORK = 100_000_000
#: Places of (source, node) and edges of sources that a task works on at once.
CELLS, STEPS = 1 << 22, 1 << 21


def numbered(names: DataFrame) -> DataFrame:
    """names, distinct in (project, node), with i: the number of a node in its project."""
    return cut(names.withColumn("i", (F.row_number().over(W.partitionBy(P).orderBy("node")) - 1).cast("int")))


def packed(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, n, e, starts, targets): edges by source, as numbers; -1 for a target that is no node.

    Edges from what is no node are left out. Repeated edges stay.
    """
    ship(names.sparkSession)
    a, b = (names.select(P, F.col("node").alias(c), F.col("i").alias(k)) for c, k in (("src", "a"), ("dst", "b")))
    links = edges.select(P, "src", "dst").join(a, [P, "src"]).join(b, [P, "dst"], "left").select(F.col(P).alias("of"), "a", F.coalesce("b", F.lit(-1)).alias("b"))
    sizes = names.groupBy(P).agg(F.count(F.lit(1)).cast("int").alias("n"))

    def run(size: pa.Table, links: pa.Table) -> pa.Table:
        n = size["n"].to_pylist()[0] if size.num_rows else 0
        src, dst = (links[c].to_numpy().astype(np.int32) for c in ("a", "b"))
        order = np.lexsort((dst, src))
        starts = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))).astype(np.int32)
        return pa.table({P: size[P].combine_chunks(), "n": pa.array([n], pa.int32()), "e": pa.array([len(src)], pa.int64()), "starts": pa.array([starts.tobytes()], pa.binary()), "targets": pa.array([dst[order].tobytes()], pa.binary())})

    return cut(sizes.groupBy(P).cogroup(links.groupBy("of")).applyInArrow(run, f"{P} string, n int, e long, starts binary, targets binary"))


def in_parts(rows: DataFrame, parts, run, schema: str) -> DataFrame:
    """run(row, part, parts) of every row, `parts` (a column) times: tables of the schema, in as many tasks."""
    sc = rows.sparkSession.sparkContext
    most = 4 * sc.defaultParallelism
    each = rows.withColumn("parts", F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(parts))).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def one(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        return run(row, row["part"], row["parts"])

    return each.repartition(most, P, "part").groupBy(P, "part").applyInArrow(one, schema)


def arrays(row: dict) -> tuple[int, np.ndarray, np.ndarray]:
    """n, starts and targets of a packed row."""
    return row["n"], np.frombuffer(row["starts"], np.int32), np.frombuffer(row["targets"], np.int32)


def ends(starts: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sources and targets of all edges, in the order of a packed row."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts)), targets.astype(np.int64)


def search(n: int, starts: np.ndarray, targets: np.ndarray, sources: np.ndarray, most: int | None):
    """Breadth-first from many sources: for each batch of them its levels, each (keys, paths, origin, place).

    A key is (place of the source in the batch) * n + node; paths are numbers of shortest paths. origin and place are the
    edges of shortest paths, as places in the levels before and here. Only edges that a source reaches are followed, once each.
    """
    width = max(1, min(len(sources), CELLS // max(n, 1), STEPS // max(len(targets), 1)))
    seen, mark = np.zeros(width * n, bool), np.zeros(width * n, np.int32)
    for lo in range(0, len(sources), width):
        batch = sources[lo : lo + width]
        keys = np.arange(len(batch), dtype=np.int64) * n + batch
        paths = np.ones(len(batch))
        seen[keys] = True
        levels = [(keys, paths, None, None)]
        while len(keys) and (most is None or len(levels) <= most):
            v = keys % n
            first, deg = starts[v], starts[v + 1] - starts[v]
            upto = np.cumsum(deg)
            origin = np.repeat(np.arange(len(keys)), deg)
            to = targets[np.arange(upto[-1]) + np.repeat(first - (upto - deg), deg)] + (keys - v)[origin]
            fresh = ~seen[to]
            origin, to = origin[fresh], to[fresh]
            turn = np.arange(len(to), dtype=np.int32)
            mark[to] = turn  # the last of equals stays
            found = to[mark[to] == turn]
            mark[found] = np.arange(len(found), dtype=np.int32)
            place = mark[to]
            keys, paths = found, np.bincount(place, paths[origin], len(found))
            seen[keys] = True
            if len(keys):
                levels.append((keys, paths, origin, place))
        for keys, _, _, _ in levels:
            seen[keys] = False
        yield batch, levels


def level_rows(most: int | None):
    """(project, i, dist, pairs, paths) of a part of a packed row's sources."""
    def run(row: dict, part: int, parts: int) -> pa.Table:
        n, starts, targets = arrays(row)
        sources = np.frombuffer(row["sources"], np.int32)[part::parts]
        out = [np.zeros((4, 0))]
        for batch, levels in search(n, starts, targets, sources, most):
            for dist, (keys, paths, _, _) in enumerate(levels[1:], 1):
                own = keys // n
                pairs = np.bincount(own, minlength=len(batch))
                some = np.flatnonzero(pairs)
                out.append(np.stack([batch[some], np.full(len(some), dist), pairs[some], np.bincount(own, paths, len(batch))[some]]))
        i, dist, pairs, paths = np.concatenate(out, axis=1)
        return pa.table({P: pa.array([row[P]] * len(i), pa.string()), "i": pa.array(i.astype(np.int32)), "dist": pa.array(dist.astype(np.int32)), "pairs": pa.array(pairs.astype(np.int64)), "paths": pa.array(paths)})

    return run


def dependency_rows(row: dict, part: int, parts: int) -> pa.Table:
    """(project, i, raw): what depends on a node, summed over a part of the sources (Brandes)."""
    n, starts, targets = arrays(row)
    raw = np.zeros(n)
    for _, levels in search(n, starts, targets, np.frombuffer(row["sources"], np.int32)[part::parts], None):
        dep = np.zeros(len(levels[-1][0]))
        for at in range(len(levels) - 1, 1, -1):
            _, paths, origin, place = levels[at]
            keys, before = levels[at - 1][:2]
            dep = np.bincount(origin, before[origin] / paths[place] * (1 + dep[place]), len(keys))
            raw += np.bincount(keys % n, dep, n)
    i = np.flatnonzero(raw)
    return pa.table({P: pa.array([row[P]] * len(i), pa.string()), "i": pa.array(i.astype(np.int32)), "raw": pa.array(raw[i])})


def searchable(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project, node, i), also for ends of edges that are no nodes, and the packed rows with `sources`: the nodes' numbers."""
    steps = edges.where("src <> dst")
    others = steps.select(P, F.explode(F.array("src", "dst")).alias("node"), F.lit(False))
    names = numbered(nodes.select(P, "node", F.lit(True).alias("own")).unionAll(others).groupBy(P, "node").agg(F.max("own").alias("own")))
    own = names.where("own").select(P, "i")

    def run(table: pa.Table) -> pa.Table:
        return pa.table({P: table[P].slice(0, 1).combine_chunks(), "sources": pa.array([np.sort(table["i"].to_numpy()).tobytes()], pa.binary())})

    return names, packed(names, steps).join(own.groupBy(P).applyInArrow(run, f"{P} string, sources binary"), P)


def searches(rows: DataFrame, run, schema: str) -> DataFrame:
    return in_parts(rows, F.length("sources") / 4 * F.col("e") / WORK, run, schema)
