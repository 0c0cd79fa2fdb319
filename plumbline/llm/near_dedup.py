"""Near-dedup by verified shingle similarity.

A text is the set of the XXH64 hashes of its `shingle`-word shingles; texts with equal sets are one node. Nodes are linked
if the Jaccard similarity of their sets is `similarity` or more, and a component is what links reach.

Candidates come from two sides. One is op4's method: every set has a SimHash fingerprint, and fingerprints that differ in
at most four bits are linked by their Golay keys (`simhash.linked`); sets whose fingerprints are in one component share a
key. At 0.8 most fingerprints differ in more bits, so MinHash adds BANDS keys of ROWS minima each, of which two sets with
similarity s share one with probability 1 - (1 - s^ROWS)^BANDS (at 0.8 all but 2 in 100,000 pairs, at 0.9 all). Every link
is verified on the whole sets, whichever key it is found by.

Keys with one node are dropped first, and then nodes that no other can be similar to: a shingle that only one node has is
in no intersection, so of two sets with n and m shingles, u and v of them found nowhere else, at most min(n - u, m - v)
are shared. Edited copies of one text carry such shingles wherever they are edited.

Links are then sought in rounds: a third of the keys, their nodes dealt into small buckets by a hash, each node verified
against its bucket's least one. That joins most groups by about as many verifications as rows. At last, nodes whose
component isn't the largest one under their key are verified against all nodes of other components, so no link between
components is lost. There, four bits of each minimum go before the sets: pairs with over UNLIKE unlike minima, 4.4 standard
deviations beyond those of similarity 0.8 (1 in 200,000 of such pairs), aren't verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, row_key, stored, with_repeats
from plumbline.llm.components import components
from plumbline.llm.simhash import linked, majority, renamed
from plumbline.operators.common import ship

SHINGLE, SIMILARITY, ROWS, BANDS, SEED = 5, 0.8, 6, 36, 42
CHUNK, UNLIKE, ROUNDS, BUCKET = 1024, 66, 3, 8


def shingles_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.array([hash64(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True)


def signature(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """One key for each band, and a sketch of four bits for each minimum; neither for an empty set."""
    import xxhash

    if not len(hashes):
        return [], []
    rng = np.random.default_rng(SEED)
    factors, shifts = (rng.integers(0, 1 << 32, ROWS * BANDS, np.uint32) for _ in range(2))
    factors |= np.uint32(1)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), CHUNK):
        least = np.minimum(least, (low[lo : lo + CHUNK, None] * factors + shifts).min(axis=0))
    bits = np.zeros(-(-len(least) // 16) * 16, np.uint64)
    bits[: len(least)] = least * np.uint32(0x9E3779B1) >> np.uint32(28)
    sketch = np.bitwise_or.reduce(bits.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)], sketch.tolist()


def unlike(x: str, y: str):
    """The number of minima that differ by two sketches. Loops over the array, as unrolled code is too long to be compiled."""
    def differing(n, v):
        some = v.bitwiseOR(F.shiftright(v, 1)).bitwiseOR(F.shiftright(v, 2)).bitwiseOR(F.shiftright(v, 3))
        return n + F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(x, y, lambda v, w: v.bitwiseXOR(w)), F.lit(0), differing)


def _nodes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingles_of(t, shingle) for t in part["text"].to_pylist()]
                signatures = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part["row"], part["id"], pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)), *[pa.array([x[k] for x in signatures], pa.list_(pa.int64())) for k in (0, 1)]], ["row", "id", "node", "n", "fp", "bands", "sketch"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([shingles_of(t, shingle).view(np.int64) for t in part["text"].to_pylist()], pa.list_(pa.int64()))], ["node", "hashes"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs (a, b and others) whose sets are similar."""
    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(F.col("shared") >= similarity * (F.size("of_a") + F.size("of_b") - F.col("shared"))).select(*pairs.columns)


def possible(n: str, common: str, m: str, with_common: str, similarity: float):
    """Whether two sets can be similar: of n and m shingles, `common` and `with_common` are in other sets as well."""
    most = F.least(F.col(common), F.col(with_common))
    return most >= similarity * (F.col(n) + F.col(m) - most)


def dealt(member: DataFrame, turn: int) -> DataFrame:
    """A third of the keys: each node (with n, common, component) beside the least one of its bucket under a key."""
    own = member.where(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == turn)
    several = own.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "copies")
    place = F.xxhash64("node", F.lit(turn))
    each = stored(with_repeats(own, stored(several, "near-several"), "key").withColumn("bucket", F.pmod(place, F.ceil(F.col("copies") / BUCKET).cast("long"))).drop("copies"), "near-buckets")
    lead = each.groupBy("key", "bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("place"), "node", "n", "common", "component")).alias("l"))
    lead = lead.select("key", "bucket", F.col("l.node").alias("other"), F.col("l.n").alias("m"), F.col("l.common").alias("with_common"), F.col("l.component").alias("with"))
    return each.join(lead, ["key", "bucket"]).where("component <> with")


def merged(pairs: DataFrame, sets: DataFrame, similarity: float, member: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """member and label with the components that verified pairs link as one."""
    links = stored(verified(pairs, sets, similarity).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "near-links")
    if links.isEmpty():
        return member, label
    roots = stored(components(links), "near-roots")
    return stored(renamed(member, roots), "near-members"), renamed(label, roots)


def with_simhash_key(nodes: DataFrame, fps: DataFrame) -> DataFrame:
    """nodes with one more band for each set that isn't empty: the component of its fingerprint by Golay keys."""
    others = linked(fps).where("fp <> component")
    key = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))
    bands = F.when(F.col("n") > 0, F.concat("bands", F.array(key))).otherwise(F.col("bands"))
    return nodes.join(others, "fp", "left").withColumn("bands", bands).drop("fp", "component")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: <id_col> and component_id (least id that links reach).

    Texts without words are one node. Null ids take part; a component of null ids only has a null component_id. Repeated
    rows stay. Empty docs: no rows. similarity is 0.8 or more: below, the keys miss too much.
    """
    if similarity < SIMILARITY:
        raise ValueError("the keys find pairs of similarity 0.8 or more")
    ship(docs.sparkSession)
    own = docs.select(row_key(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    rows = stored(own.mapInArrow(_nodes(shingle), f"row bigint, id {kind}, node bigint, n bigint, fp bigint, bands array<bigint>, sketch array<bigint>"), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bands").alias("bands"), F.max("sketch").alias("sketch"))
    nodes = stored(with_simhash_key(nodes, stored(rows.where("n > 0").select("fp").distinct(), "near-fingerprints")), "near-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = stored(with_repeats(stored(keyed, "near-keyed"), stored(counted, "near-keys"), "key").select("key", "node"), "near-shared")
    wanted = stored(nodes.join(shared.select("node").distinct(), "node").select("row", "node"), "near-wanted")
    texts = own.join(wanted, "row").select("node", "text").mapInArrow(_sets(shingle), "node bigint, hashes array<bigint>")
    sets = stored(texts.dropDuplicates(["node"]), "near-sets")
    alone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("of"), F.min("node").alias("node")).where("of = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    able = sets.select("node", F.size("hashes").alias("n")).join(alone.hint("merge"), "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("common"))
    able = stored(able.where(F.col("common") >= similarity * F.col("n")), "near-able")
    member = stored(shared.join(able, "node").select("key", "node", "n", "common", F.col("node").alias("component")), "near-members")
    label = nodes.select("node", "least", F.col("node").alias("component"))
    for turn in range(ROUNDS):
        tried = stored(dealt(member, turn).where(possible("n", "common", "m", "with_common", similarity)).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.when(F.col("node") < F.col("other"), F.col("component")).otherwise(F.col("with")).alias("ca"), F.when(F.col("node") < F.col("other"), F.col("with")).otherwise(F.col("component")).alias("cb")).distinct(), "near-tried")
        member, label = merged(tried, sets, similarity, member, label)
    main = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("several"), F.sum("size").alias("copies")).where("several > 1").select("key", "main", "copies")
    rest = with_repeats(member, stored(main, "near-main"), "key").drop("copies")
    rest = stored(rest.join(nodes.select("node", "bands", "sketch"), "node"), "near-rest")
    minor = rest.where("component <> main").select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("common").alias("with_common"), F.col("bands").alias("with_bands"), F.col("sketch").alias("with_sketch"), F.col("component").alias("with"))
    crossed = rest.join(minor.hint("merge"), "key").where("component <> with").where(possible("n", "common", "m", "with_common", similarity))
    # A pair that shares several keys is looked at under the least one.
    crossed = crossed.where(F.array_min(F.array_intersect("bands", "with_bands")) == F.col("key")).where(unlike("sketch", "with_sketch") <= UNLIKE)
    pairs = stored(crossed.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.when(F.col("node") < F.col("other"), F.col("component")).otherwise(F.col("with")).alias("ca"), F.when(F.col("node") < F.col("other"), F.col("with")).otherwise(F.col("component")).alias("cb")).distinct(), "near-pairs")
    member, label = merged(pairs, sets, similarity, member, label)
    label = stored(label, "near-components")
    for x in (member, sets, rest, shared):
        dropped(x)
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select("id", "node").join(label.join(least, "component").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")
