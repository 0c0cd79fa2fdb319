"""Mixing sources to target weights by entropy balancing.

Sources in code point order (null last) weigh 5, 2, 1 and so on, and share `share` of all sizes; a target stops at
`most` times its source's size, and the excess is reshared by weight until none is above: target = min(cap, weight * t),
where t is found by sharing, capping and sharing again, each round an aggregation.

Rates: a document of size z gets the exponentially tilted rate r = min(most, exp(b z)), the minimum of the relative entropy
to rate 1 under the token constraint sum z r = target of its source and the bound r <= most. The multiplier b of each
source solves the convex dual by Newton steps, kept inside a bracket: every step sums gradient and curvature over
(source, size) counts with a distributed aggregation.

Rounding: documents of a source and size share a rate, so of n such documents floor(n r) copies or one more are taken:
one more where the running sum of the fractions, from the largest size to the smallest, passes a half. So at most half a
copy is missing or too much over any sizes, and half of the largest document in words. What is then left of the target is
evened out from the largest size to the smallest, by as many whole copies as fit, down to less than the
smallest document (or to where no copies are left to give or take). Which of the n documents get the additional copy
is settled by the order of a hash of the id, in buckets of a bounded size, so that a size or source that holds a large
part of all rows is never sorted by one task, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import GAP, dropped, let, named, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
STEPS, TOLERANCE, BUCKET = 60, 1e-9, 20_000


def size_of(text: Column) -> Column:
    """Words of a text: separators are removed at the ends, then runs of them counted."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}$", "")
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(GAP)) + 1).cast("long")


def ranked(per: DataFrame) -> DataFrame:
    """per with `place`: the place of its source in code point order, null last, from 0. Sources are sorted in ranges."""
    dealt = stored(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each partition.
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "offset")
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.join(F.broadcast(offsets), "part").withColumn("place", F.col("offset") + inside - 1).drop("part", "offset")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n)."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    wide = stored(ranked(per).select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap")), "mix-weights")
    total = share * (wide.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, -1
    while True:
        free = F.lit(True) if level is None else F.col("cap") > F.col("weight") * level
        full, weights_left, n = wide.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight"))), F.count_if(~free)).first()
        if n == capped or not weights_left:
            break
        level, capped = (total - (full or 0.0)) / weights_left, n
    goal = F.col("cap") if level is None or not weights_left else F.least("cap", F.col("weight") * level)
    return wide.select("source", "source_size", goal.alias("target"))


def rate(b: Column, z: Column, most: float = MOST) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), b * z))))


def multipliers(sizes: DataFrame, goals: DataFrame, most: float = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, b, scale): the multiplier b of size / scale. Null b: rate 0 (no target) or `most` (target at its cap)."""
    scale = sizes.groupBy("source").agg(F.max("size").cast("double").alias("scale"))
    same = F.col("source").eqNullSafe(F.col("from"))
    state = stored(goals.join(scale.withColumnRenamed("source", "from"), same).where(F.col("source_size") > 0).select("source", "target", "source_size", "scale", F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("error")).withColumn("inner", (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))), "mix-state")
    for _ in range(steps):
        r = rate(F.col("b"), F.col("size") / F.col("scale"), most)
        terms = sizes.withColumnRenamed("source", "from").join(state.where("inner"), same).groupBy("source", "target", "source_size", "scale", "b", "lo", "hi", "inner").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("words"), F.sum(F.when(r < most, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * r).otherwise(0.0)).alias("slope"))
        gap = F.col("words") - F.col("target")
        lo, hi = F.when(gap <= 0, F.col("b")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("b")).otherwise(F.col("hi"))
        # Outside the bracket a Newton step gives way: to the middle, or to twice the distance where one end is open.
        step = F.col("b") - gap / F.greatest("slope", F.lit(1e-300))
        wide = F.when(F.col("l").isNull(), F.greatest(F.col("step"), F.col("h") - 1 - 2 * F.abs("h"))).when(F.col("h").isNull(), F.least(F.col("step"), F.col("l") + 1 + 2 * F.abs("l"))).when((F.col("step") > F.col("l")) & (F.col("step") < F.col("h")), F.col("step")).otherwise((F.col("l") + F.col("h")) / 2)
        moved = terms.withColumns({"l": lo, "h": hi, "step": step, "e": F.abs(gap) / F.col("target")}).select("source", "target", "source_size", "scale", F.when(F.col("e") <= tolerance, F.col("b")).otherwise(wide).alias("b"), F.col("l").alias("lo"), F.col("h").alias("hi"), F.col("e").alias("error"), "inner")
        after = stored(moved.unionByName(state.where("not inner")), "mix-state")
        worst = after.where("inner").agg(F.max("error")).first()[0]
        dropped(state)
        state = after
        if worst is None or worst <= tolerance:
            break
    return state.select("source", "scale", F.when(F.col("inner"), F.col("b")).alias("b"))


def copies(rated: DataFrame, most: float) -> DataFrame:
    """rated (source_key, size, n, r, target and others) with k, the copies that the n documents get together."""
    run = W.partitionBy("source_key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    x = rated.withColumn("whole", F.floor(F.col("n") * F.col("r"))).withColumn("passed", F.floor(F.sum(F.col("n") * F.col("r") - F.col("whole")).over(run) + 0.5))
    more = F.col("passed") - F.coalesce(F.lag("passed").over(W.partitionBy("source_key").orderBy(F.desc("size"))), F.lit(0))
    first = stored(x.withColumn("k", F.least(F.col("whole") + more, most * F.col("n")).cast("long")).drop("whole", "passed"), "mix-rounded")
    # One row a source: its distinct sizes, which text lengths bound and documents don't. Only the few changes are kept.
    per = first.where("size > 0").groupBy("source_key").agg((F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("left"), F.sort_array(F.collect_list(F.struct("size", "n", "k")), asc=False).alias("c"))

    def even(a: Column, x: Column) -> Column:
        fit = F.floor(F.abs(a["left"]) / x["size"])
        move = F.when(a["left"] > 0, F.least(fit, most * x["n"] - x["k"])).otherwise(-F.least(fit, x["k"])).cast("long")
        return let(move, lambda m: F.when(m == 0, a).otherwise(named(left=a["left"] - m * x["size"], out=F.concat(a["out"], F.array(named(size=x["size"], m=m))))))

    start = named(left=F.col("left").cast("double"), out=F.array().cast("array<struct<size:bigint,m:bigint>>"))
    moved = per.select("source_key", F.explode(F.aggregate("c", start, even)["out"]).alias("x")).select("source_key", "x.size", "x.m")
    return first.join(moved, ["source_key", "size"], "left").withColumn("k", F.col("k") + F.coalesce("m", F.lit(0))).drop("m")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """<id_col>, size, source_size, target, rate, copies, taken for each row of docs.

    taken = copies * size, 0 <= copies <= most. Null text: size 0, which takes one copy. Null source: a source of its
    own, last. Null ids and repeated rows count as documents. A source without words has target 0. Empty docs: no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_of(F.col(f"`{text_col}`")).alias("size"))
    rows = stored(own.withColumn("order", F.xxhash64("id")), "mix-sizes")
    sizes = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    goals = stored(targets(sizes, weights, share, most), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("from"))
    solved = goals.join(multipliers(sizes, goals, most).withColumnRenamed("source", "from"), same, "left").drop("from")
    r = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("b").isNotNull(), rate(F.col("b"), F.col("size") / F.col("scale"), most)).when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    rated = sizes.withColumnRenamed("source", "from").join(solved, same).select("source", "source_size", "target", "size", "n", r.alias("r"))
    keyed = rated.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    counted = copies(keyed, most).select("source", "source_size", "target", "size", "n", F.col("r").alias("rate"), "k")
    counted = stored(counted.withColumn("base", F.floor(F.col("k") / F.col("n")).cast("long")).withColumn("extra", F.col("k") - F.col("n") * F.col("base")), "mix-copies")
    # Buckets of a (source, size): the extra copies are dealt to them in proportion, by rounding running sums down.
    plan = counted.withColumnRenamed("source", "from").withColumnRenamed("size", "of").withColumn("buckets", F.ceil(F.col("n") / BUCKET).cast("long"))
    dealt = rows.join(plan, same & (F.col("size") == F.col("of"))).withColumn("bucket", F.pmod(F.xxhash64("order", "size"), F.col("buckets"))).drop("from", "of", "buckets")
    dealt = dealt.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = dealt.groupBy("source_key", "size", "bucket", "n", "extra").agg(F.count(F.lit(1)).alias("m"))
    run = F.sum("m").over(W.partitionBy("source_key", "size").orderBy("bucket"))
    share_of = sums.withColumn("run", run).withColumn("quota", F.floor(F.col("extra") * F.col("run") / F.col("n")) - F.floor(F.col("extra") * (F.col("run") - F.col("m")) / F.col("n"))).select(F.col("source_key").alias("ks"), F.col("size").alias("kz"), F.col("bucket").alias("kb"), "quota")
    dealt = dealt.join(share_of, (F.col("source_key") == F.col("ks")) & (F.col("size") == F.col("kz")) & (F.col("bucket") == F.col("kb")))
    rank = F.row_number().over(W.partitionBy("source_key", "size", "bucket").orderBy("order", "id"))
    out = dealt.withColumn("copies", F.col("base") + (rank <= F.col("quota")).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
