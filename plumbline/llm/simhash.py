"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprint: 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of the text's 4-word shingles.
Two fingerprints that differ in at most four bits are linked; a component is what links reach.

Candidates: a fingerprint is cut into segments A and B of 23 bits and R of 18 bits. Segments A and B are decoded to the
Golay codewords near them (one or six keys), which two segments share if at most two of their bits differ; halves and
thirds of a segment are alike somewhere if at most one or two of its bits differ. Where at most four of 64 bits differ,
one of these compound keys is shared:
- R alike: A or B differs in two bits at most: (R, keys of A), (R, keys of B);
- A alike (B likewise): B differs in two bits at most, (A, keys of B); or R differs in one at most, (A, a third of R);
- all differ, so A or B in one bit: if A does, then either B in one and R in two at most, (half of A, half of B, third of
  R), or B in two and R in one, (half of A, keys of B, half of R); likewise with A and B exchanged.
The first two cases are worked off first, then the third one with the components found so far. Equal fingerprints are one
node from the start, and keys whose members are all in one component are dropped before anything is joined. Of a key's
other members, each is first verified against the least and the greatest one, which joins most groups by edges as many as
rows. Then only members whose component isn't the largest one under their key are verified against all members of other
components, so a large group is never paired with itself and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import golay
from plumbline.llm.common import dropped, stored
from plumbline.llm.components import components
from plumbline.operators.common import ship

SHINGLE, BITS = 4, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; 0 for null and for texts without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, each set if it is set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                own = np.array([fingerprint(t, shingle) for t in part["text"].to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(own)], ["id", "fp"])

    return run


def _keys(late: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys, at = key_rows(part["fp"].to_numpy(zero_copy_only=False), late)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part["value"].take(pa.array(at))], ["key", "value"])

    return run


def key_rows(fp: np.ndarray, late: bool) -> tuple[np.ndarray, np.ndarray]:
    """Compound keys (with the kind in the top bits) and the place of the fingerprint of each.

    late: those of the case that all segments differ, else those of the other cases.
    """
    bits = fp.view(np.uint64)
    a, b, r = (((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    ka, kb = golay.keys(a), golay.keys(b)
    cut = lambda x, width, n: np.stack([(x >> (i * width) & ((1 << width) - 1)) | i << 12 for i in range(n)], axis=1)  # noqa: E731  pieces with their numbers
    thirds = cut(r, 6, 3)
    if late:
        ha, hb, hr = cut(a, 12, 2), cut(b, 12, 2), cut(r, 9, 2)
        some = [(7, product(product(ha, hb, 14), thirds, 14)), (8, product(product(ha, kb, 12), hr, 14)), (9, product(product(hb, ka, 12), hr, 14))]
    else:
        some = [(1, product(r[:, None], ka, 12)), (2, product(r[:, None], kb, 12)), (3, product(a[:, None], kb, 12)), (4, product(b[:, None], ka, 12)), (5, product(a[:, None], thirds, 14)), (6, product(b[:, None], thirds, 14))]
    rows, at = [], []
    for kind, keys in some:
        found = np.nonzero(keys >= 0)
        rows.append(keys[found] | kind << 44)
        at.append(found[0])
    return np.concatenate(rows), np.concatenate(at)


def product(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """All pairs of a column of x and one of y, of `width` bits; -1 where either is missing."""
    both = np.where((x < 0)[:, :, None] | (y < 0)[:, None, :], -1, x[:, :, None] << width | y[:, None, :])
    return both.reshape(len(x), -1)


def near(bits: int):
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits


def linked(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component) for the fingerprints of fps (fp, distinct); component is the least fingerprint reachable."""
    if bits > BITS:
        raise ValueError("the keys find pairs of up to 4 differing bits")
    ship(fps.sparkSession)
    label = fps.select("fp", F.col("fp").alias("component"))
    for late in (False, True):
        keyed = lambda value, late=late, label=label: label.select("fp", F.col(value).alias("value")).mapInArrow(_keys(late), "key bigint, value bigint")
        # Nearly all keys have one member, or members of one component: those of the others are few rows.
        mixed = keyed("component").groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high").select("key")
        # Spark sizes the keys like their fingerprints, of which each has some fifty: unhinted, it would broadcast them all.
        members = keyed("fp").withColumnRenamed("value", "fp").join(mixed.hint("merge"), "key").join(label.hint("merge"), "fp")
        member = stored(members.select("key", "fp", "component"), "members")
        for edges in (star_edges, cross_edges):
            found = stored(edges(member, bits), "component-edges")
            if not found.isEmpty():
                roots = stored(components(found), "component-roots")
                member, label = renamed(member, roots), renamed(label, roots)
            dropped(found)
        label = stored(label, "components")
        dropped(member)
    return label


def renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their component, where it has one."""
    own = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return rows.join(own, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")


def star_edges(member: DataFrame, bits: int) -> DataFrame:
    """(a, b): components of members of a key and of its least or greatest member that are near them."""
    ends = member.groupBy("key").agg(F.min(F.struct("fp", "component")).alias("low"), F.max(F.struct("fp", "component")).alias("high"))
    each = member.join(ends.hint("merge"), "key").select("fp", "component", F.explode(F.array("low", "high")).alias("end")).select("fp", "component", F.col("end.fp").alias("other"), F.col("end.component").alias("with"))
    return each.where("component <> with").where(near(bits)).select(F.col("component").alias("a"), F.col("with").alias("b")).distinct()


def cross_edges(member: DataFrame, bits: int) -> DataFrame:
    """(a, b): near members of a key in unlike components, one of them outside the key's largest component."""
    main = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("several")).where("several > 1").select("key", "main")
    rest = member.join(main.hint("merge"), "key")
    minor = rest.where("component <> main").select("key", F.col("fp").alias("other"), F.col("component").alias("with"))
    return member.join(minor.hint("merge"), "key").where("component <> with").where(near(bits)).select(F.col("component").alias("a"), F.col("with").alias("b")).distinct()


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: <id_col>, fingerprint (16 hex digits), component_id (least id that links reach).

    Null and empty texts have fingerprint zero and are linked like others. Null ids take part; a component of null ids
    only has a null component_id. Repeated rows stay. Empty docs: no rows.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    prints = stored(own.mapInArrow(_fingerprints(shingle), f"id {kind}, fp bigint"), "fingerprints")
    fps = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    groups = fps.join(linked(fps, bits), "fp")
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
