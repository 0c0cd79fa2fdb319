"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower case. Every n-gram of a document that some test item has is a seed; the seeds
of an item that lie near each other in a document make a passage. Passages with two seeds or more are aligned to the item
word by word, however many documents have the seeds; the score is the best local alignment's (match 2, other pairs and
gaps -1) as a share of the item's alignment to itself. Only passages whose words can't reach the least score, whatever
their order, are left out.

The benchmark is worked off in blocks of `block` words, whose seeds are sent to the executors; documents are read once
for each block. Nothing that grows with the documents leaves the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import stored
from plumbline.operators.common import ship

NGRAM, LEAST, BLOCK = 3, 0.5, 400_000
MATCH, MISS, GAP_COST = 2, -1, -1
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def alignment(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of word numbers; start and end are places in passage.

    Row by row over the item. With a linear gap cost the best gap within a row is a running maximum.
    """
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP_COST
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diag = score[:-1] + np.where(passage == w, MATCH, MISS)
        up = score[1:] + GAP_COST
        row, came = np.zeros(n + 1, np.int64), np.arange(n + 1)
        row[1:] = np.maximum(np.maximum(diag, up), 0)
        came[1:] = np.where(row[1:] == 0, came[1:], np.where(diag >= up, begin[:-1], begin[1:]))
        level = row + ramp
        top = np.maximum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == top, np.arange(n + 1), 0))
        left = top - ramp
        came = np.where(left > row, came[at], came)
        score, begin = np.maximum(row, left), came
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(begin[end]), end)
    return best


class Seeds:
    """The n-grams of a block of items, by word numbers."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.items: list[np.ndarray] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids = [i for i, _ in items]
        # Items are numbered by place; those without an id are items of their own.
        places: dict = {}
        self.first = [at if i is None else places.setdefault(i, at) for at, i in enumerate(self.ids)]
        codes, owners = [], []
        for at, (_, text) in enumerate(items):
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int64)
            self.items.append(own)
            self.bags.append(np.unique(own, return_counts=True))
            for k in range(len(own) - n + 1):
                codes.append(tuple(own[k : k + n].tolist()))
                owners.append(at)
        self.grams = {g: i for i, g in enumerate(dict.fromkeys(codes))}
        self.owners: list[list[int]] = [[] for _ in self.grams]
        for g, at in dict.fromkeys(zip(codes, owners, strict=True)):
            self.owners[self.grams[g]].append(at)
        self.of: list[set[int]] = [set() for _ in items]
        for g, owners_of in enumerate(self.owners):
            for at in owners_of:
                self.of[at].add(g)
        # A number for each run of words: pairs of numbers are looked up in sorted tables, n - 1 times.
        self.steps: list[np.ndarray] = []
        prefix = {(w,): w for w in range(len(self.vocabulary))}
        for k in range(2, n + 1):
            runs = sorted({(prefix[g[: k - 1]], g[k - 1]) for g in self.grams})
            table = np.array([a * len(self.vocabulary) + b for a, b in runs], np.int64)
            order = {r: i for i, r in enumerate(runs)}
            prefix = {g[:k]: order[prefix[g[: k - 1]], g[k - 1]] for g in self.grams}
            self.steps.append(table)
        self.gram_at = np.zeros(len(self.grams), np.int64)
        for g, i in self.grams.items():
            self.gram_at[prefix[g]] = i

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places, seeds) of the n-grams of a text that items have."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        if len(ids) < self.n or not self.grams:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
        run = ids[at]
        for k, table in enumerate(self.steps, 1):
            inside = at + k < len(ids)
            at, run = at[inside], run[inside]
            after = ids[at + k]
            code = np.where(after >= 0, run * len(self.vocabulary) + after, -1)
            place = np.searchsorted(table, code)
            place[place == len(table)] = 0
            good = table[place] == code
            at, run = at[good], place[good]
        return at, self.gram_at[run]

    def passages(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item, from, to) of the passages of a text with two seeds or all of the item's."""
        places, seeds = self.hits(words)
        by_item: dict[int, list[tuple[int, int]]] = {}
        for p, s in zip(places.tolist(), seeds.tolist(), strict=True):
            for item in self.owners[s]:
                by_item.setdefault(item, []).append((p, s))
        out = []
        for item, found in by_item.items():
            reach = len(self.items[item])
            run: list[tuple[int, int]] = []
            for x in [*found, (1 << 60, -1)]:
                if run and x[0] - run[-1][0] > reach:
                    if len({s for _, s in run}) >= min(2, len(self.of[item])):
                        out.append((item, max(0, run[0][0] - reach), min(len(words), run[-1][0] + self.n + reach)))
                    run = []
                run.append(x)
        return out

    def shared(self, passage: np.ndarray, item: int) -> int:
        """Words of an item that a passage has, in any order: the alignment can't match more."""
        words, counts = self.bags[item]
        at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        return int(np.minimum(np.bincount(at[words[at] == passage], minlength=len(words)), counts).sum())

    def found(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        """(item, score, start, end): the best alignment of each item that a text holds; texts with one id are one item."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for at, a, b in self.passages(words):
            item, passage = self.items[at], np.array([self.vocabulary.get(w, -1) for w in words[a:b]], np.int64)
            if self.shared(passage, at) < least * len(item):
                continue
            score, start, end = alignment(passage, item)
            if score >= least * MATCH * len(item):
                one = (round(score / (MATCH * len(item)), 6), -(a + start), a + end)
                best[self.first[at]] = max(one, best.get(self.first[at], one))
        return [(i, score, -first, end) for i, (score, first, end) in best.items()]


def _search(sent, least: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [(i, *x) for i, text in enumerate(part["text"].to_pylist()) for x in own.found(text, least)]
                at, items, scores, starts, ends = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(at, pa.int64())), pa.array([own.ids[x] for x in items], item_type), pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "item", "score", "start", "end"])

    return run


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[list[tuple[object, str]]]:
    """Items with a text, by id, in lists of about `block` words; one partition of them is held at a time."""
    own = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct().orderBy("id", "text")
    held, n = [], 0
    for row in own.toLocalIterator():
        held.append((row["id"], row["text"]))
        n += len(row["text"].split()) + 1
        if n >= block:
            yield held
            held, n = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(<id_col>, item_id, score, start, end): documents that hold an item, its best alignment and the words it covers.

    Null and empty texts hold nothing, nor do items with fewer words than an n-gram match anything. Repeated items with
    one id count once, by their best score; item_id has any type, and items without one are searched too, each text as
    an item of its own. Null ids stay null; repeated rows give repeated results. Empty docs or
    benchmark: no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ship(docs.sparkSession)
    spark, kind = docs.sparkSession, own.schema["id"].dataType.simpleString()
    item_type = benchmark.select(F.col(f"`{item_col}`").alias("id")).schema["id"].dataType
    results = []
    for items in blocks_of(benchmark, item_col, item_text_col, block):
        sent = spark.sparkContext.broadcast(Seeds(items, ngram))
        searched = own.mapInArrow(_search(sent, least, to_arrow_type(item_type)), f"id {kind}, item {item_type.simpleString()}, score double, start bigint, end bigint")
        results.append(stored(searched.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "score", "start", "end"), "leaks"))
    if not results:
        return own.where(F.lit(False)).select(F.col("id").alias(id_col), F.lit(None).cast(item_type).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    out = results[0]
    for x in results[1:]:
        out = out.unionAll(x)
    return out
