"""Quality rules whose cutoffs come with a bound on false rejection.

A rule rejects a document whose feature exceeds a cutoff of a fixed grid. The labelled documents of a stratum (language) are
the holdout; a hash of the id deals them into two halves. One half orders the steps "rule r gets cutoff c": those of positive
gain (share of bad documents rejected less `cost` times the share of good ones), by the good documents they reject there,
then by the bad ones. The other half tests the union of the first t steps for t = 1, 2 and so on: the null hypothesis
"these rules together reject more than `risk` of the good documents" is refused if the exact binomial probability of so
few false rejections is at most `delta / strata` (Bonferroni over the strata that have labels). The order is fixed before
this half is looked at and testing stops at the first hypothesis that stands, so no further correction is needed inside: with
probability 1 - delta no stratum loses more than `risk` of its good documents to all rules together. Each rule takes
its strictest cutoff among the certified steps. Strata with too few labels for any step keep all their documents: without a
false rejection, log(delta / strata) / log(1 - risk) good documents are needed in a half (86 for four strata).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import agreed, count_of, let, named, row_key, stored, words_of

#: feature: cutoffs, the most lenient first.
GRID: dict[str, list[float]] = {
    "symbol_ratio": [3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05],
    "dup_line_ratio": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4],
    "repeat_ratio": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "shout_ratio": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "bang_ratio": [4.0, 3.0, 2.0, 1.5, 1.0, 0.5, 0.25],
    "mean_word": [16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5],
}
RISK, DELTA, COST = 0.05, 0.05, 10.0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of three words found twice or more in the text.

    If the 64-bit hashes of all windows differ, so do the windows. Only other texts pay for the sort by hash that finds the
    places of the repeated windows, whose words are compared as well.
    """
    def places(hashes: Column, words: Column) -> Column:
        window = lambda p: F.array(*[F.get(words, p["i"].cast("int") + d) for d in range(3)])

        def repeated(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            like = lambda i, j: (F.get(pairs, i)["t"] == F.get(pairs, j)["t"]) & (window(F.get(pairs, i)) == window(F.get(pairs, j)))
            same = lambda i: ((i > 0) & like(i - 1, i)) | ((i < last) & like(i + 1, i))
            at = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.when(same(i), F.get(pairs, i)["i"])), lambda p: p.isNotNull())
            start = named(n=F.lit(0).cast("long"), p=F.lit(-3).cast("long"))
            return F.aggregate(F.sort_array(at), start, lambda a, p: named(n=a["n"] + F.least(F.lit(3).cast("long"), p - a["p"]), p=p))["n"]

        return let(F.sort_array(F.transform(hashes, lambda t, i: named(t=t, i=i.cast("long")))), repeated)

    def counted(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(places(h, ws))))

    return let(words, counted)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keyed: bool = False) -> DataFrame:
    """Counts of every whole text; no shuffle. A null text counts as empty. keyed: with a key of the row."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{stratum_col}`").alias("stratum"), *([row_key(id_col, text_col, stratum_col).alias("key")] if keyed else []))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        count_of(F.col("text"), r"[\x20\x09-\x0D]+").alias("word_chars"),
        count_of(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: named(n=F.size(x).cast("long"), dup=(F.size(x) - F.size(F.array_distinct(x))).cast("long"))).alias("lines"),
        repeated_words(words_of(F.col("text"))).alias("n_repeat_words"),
        count_of(F.col("text"), r"[^A-Z]+").alias("n_upper"),
        count_of(F.col("text"), r"[^!]+").alias("n_bang"),
    )
    row = ["key"] if keyed else []
    c = own.select("doc_id", "stratum", *row, counts.alias("c"))
    return c.select("doc_id", "stratum", *row, "c.n_words", "c.word_chars", "c.n_symbols", F.col("c.lines.dup").alias("n_dup_lines"), "c.n_repeat_words", F.col("c.lines.n").alias("n_lines"), "c.n_upper", "c.n_bang")


def ratios() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_ratio": share("n_symbols", "n_words"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "shout_ratio": share("n_upper", "word_chars"), "bang_ratio": share("n_bang", "n_words"), "mean_word": share("word_chars", "n_words")}


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), its terms summed from logarithms."""
    import math

    odds = math.log(p / (1 - p))
    start = named(t=(n * math.log1p(-p)).cast("double"), s=F.exp(n * math.log1p(-p)))
    step = lambda a, i: let(a["t"] + F.log((n - i + 1) / i) + odds, lambda t: named(t=t, s=a["s"] + F.exp(t)))
    several = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step)["s"]
    return F.when(k >= n * p, F.lit(1.0)).when(k <= 0, F.exp(n * math.log1p(-p))).otherwise(F.least(several, F.lit(1.0)))


def cutoffs(counted: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", good_col: str = "quality", grid: dict[str, list[float]] = GRID, risk: float = RISK, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, <feature>_max for each rule): the certified cutoff, or null where the rule isn't used.

    Labels that are null or neither 0 nor 1 don't count. A document labelled more than once counts as good if any label
    says so.
    """
    known = agreed(labels, doc_id=id_col, good=good_col).where(F.col("good").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("good").cast("long").alias("good"))
    values = F.array(*[F.struct(F.lit(r).alias("rule"), x.alias("x"), F.array(*map(F.lit, grid[r])).alias("cuts")) for r, x in ratios().items() if r in grid])
    key = F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit(""))
    held = counted.join(known, "doc_id").select("doc_id", "stratum", key.alias("s"), "good", in_first_half(F.col("doc_id")).alias("ordering"), F.explode(values).alias("v"))
    # The first cutoff that the feature exceeds; the number of cutoffs if there is none.
    held = stored(held.select("doc_id", "stratum", "s", "good", "ordering", "v.rule", (F.size("v.cuts") - F.size(F.filter("v.cuts", lambda c: F.col("v.x") > c))).alias("first")), "quality-held")
    steps = stored(ordered(held.where("ordering"), grid, cost), "quality-steps")
    tested = held.where("not ordering")
    reach = tested.join(steps, ["s", "rule"]).where("j >= first").groupBy("s", "doc_id").agg(F.min("step").alias("t"), F.max("good").alias("good"))
    lost = reach.groupBy("s", F.col("t").alias("step")).agg(F.sum("good").alias("lost"))
    n_good = tested.groupBy("s").agg(F.count_distinct(F.when(F.col("good") == 1, F.col("doc_id"))).alias("n_good")).where("n_good > 0")
    n_strata = n_good.count()
    path = W.partitionBy("s").orderBy("step")
    tests = steps.join(n_good, "s").join(lost, ["s", "step"], "left").withColumn("k", F.sum(F.coalesce("lost", F.lit(0))).over(path))
    tests = tests.withColumn("certified", F.min(binomial_cdf(F.col("k"), F.col("n_good"), risk) <= delta / max(n_strata, 1)).over(path))
    return tests.where("certified").groupBy("s").agg(F.max("stratum").alias("stratum"), *[F.max(F.when(F.col("rule") == r, F.struct("j", "cut")))["cut"].alias(f"{r}_max") for r in grid]).drop("s")


def in_first_half(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("ordering"), id_col.cast("string")), F.lit(2)) == 0


def ordered(held: DataFrame, grid: dict[str, list[float]], cost: float) -> DataFrame:
    """(s, stratum, rule, j, cut, step): the steps of each stratum in order, from the half of the labels that fixes it."""
    by_first = held.groupBy("s", "rule", "first").agg(F.max("stratum").alias("stratum"), F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    totals = by_first.groupBy("s", "rule").agg(F.max("stratum").alias("stratum"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    cuts = F.array(*[F.struct(F.lit(r).alias("of"), F.lit(j).alias("j"), F.lit(c).alias("cut")) for r, cuts in grid.items() for j, c in enumerate(cuts)])
    every = totals.select("s", "stratum", "rule", "n_good", "n_bad", F.explode(cuts).alias("g")).where("rule = g.of").select("s", "stratum", "rule", "n_good", "n_bad", "g.j", "g.cut")
    at = by_first.select("s", "rule", F.col("first").alias("j"), "good", "bad")
    run = W.partitionBy("s", "rule").orderBy("j")
    every = every.join(at, ["s", "rule", "j"], "left").withColumns({"k": F.sum(F.coalesce("good", F.lit(0))).over(run), "hit": F.sum(F.coalesce("bad", F.lit(0))).over(run)})
    gain = F.col("hit") / F.greatest("n_bad", F.lit(1)) - cost * F.col("k") / F.greatest("n_good", F.lit(1))
    # At most as many rows a stratum as the grid has cutoffs.
    order = W.partitionBy("s").orderBy("k", F.desc("hit"), "rule", "j")
    return every.where(F.round(gain, 9) > 0).withColumn("step", F.row_number().over(order)).select("s", "stratum", "rule", "j", "cut", "step")


def decided(counted: DataFrame, chosen: DataFrame, grid: dict[str, list[float]] = GRID) -> DataFrame:
    """counted with base_failed and kept."""
    limits = chosen.withColumnRenamed("stratum", "chosen_for")
    failed = [F.coalesce(x > F.col(f"{r}_max"), F.lit(False)) for r, x in ratios().items() if r in grid]
    either = failed[0]
    for x in failed[1:]:
        either = either | x
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.join(limits, F.col("stratum").eqNullSafe(F.col("chosen_for")), "left").withColumn("base_failed", base).withColumn("kept", ~base & ~either)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", grid: dict[str, list[float]] = GRID, risk: float = RISK, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """One row for each row of docs: its counts, base_failed and kept.

    Null or empty text: all counts 0, base_failed. Null stratum: a stratum of its own. Null ids: decided like others,
    never labelled. Empty docs: no rows. Empty labels: no cutoff, kept is "not base_failed". Repeated rows stay.
    """
    counted = stored(features(docs, id_col, text_col, stratum_col), "quality")
    chosen = stored(cutoffs(counted, labels, good_col=good_col, grid=grid, risk=risk, delta=delta, cost=cost), "quality-cutoffs")
    return decided(counted, chosen, grid)


def kept_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", grid: dict[str, list[float]] = GRID, risk: float = RISK, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their own columns only.

    Only counts are written; rows that are alike in id, text and stratum have one key and one verdict.
    """
    counted = stored(features(docs, id_col, text_col, stratum_col, keyed=True), "quality")
    chosen = stored(cutoffs(counted, labels, good_col=good_col, grid=grid, risk=risk, delta=delta, cost=cost), "quality-cutoffs")
    kept = decided(counted, chosen, grid).where("kept").select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key(id_col, text_col, stratum_col)).join(kept, "__key", "left_semi").drop("__key")
