"""Language identification, word first with backoff to character n-grams.

Learned from labelled rows: for each language, frequencies of words and of character n-grams (1 to 4, with marks at a
word's ends). A known word scores by the log of its smoothed frequency in each language. An
unknown word backs off: the longest n of which any n-gram is known scores by the mean of its known n-grams. A text's
score of a language is the sum over its words; its probability is the softmax of these sums.

Learning takes about `sample` documents of each language (chosen by a hash of the id) and keeps all their words and
n-grams: what the driver gathers and sends grows with languages and with the texts of the sample, not with the corpus. A
word takes a cell only in the languages that have it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import agreed
from plumbline.operators.common import ship

WORD = re.compile(r"[^\W\d_]+")
SAMPLE, LONGEST, SMOOTH = 1500, 4, 0.1
UNKNOWN = "und"
#: Unknown words whose scores a task remembers; then it starts anew.
REMEMBERED = 100_000


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1. Null ids are not held out (nor learned from)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[tuple[str, int, str]] = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for word, k in Counter(WORD.findall((text or "").lower())).items():
                seen[lang, 0, word] += k
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        seen[lang, n, g] += k
        lang, n, gram = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "n", "gram", "k"])


class Table:
    """Counts of words, or of n-grams of one length, as sparse rows.

    Where a language lacks an entry its smoothed log frequency is `base`; other cells hold what they exceed that by.
    """

    def __init__(self, counts: dict[str, list[tuple[int, int]]], langs: int):
        self.at = {gram: i for i, gram in enumerate(counts)}
        cells = [cell for row in counts.values() for cell in row]
        self.starts = np.cumsum([0, *map(len, counts.values())])
        self.column = np.array([c for c, _ in cells], np.int64)
        k = np.array([k for _, k in cells], np.float64)
        self.base = -np.log(np.bincount(self.column, k, langs) + SMOOTH * max(len(counts), 1))
        self.base += np.log(SMOOTH)
        self.above = np.log1p(k / SMOOTH)

    def total(self, rows: list[int]) -> np.ndarray:
        """Sum of the log frequencies of some rows, by language."""
        own = np.array(rows, np.int64)
        first, sizes = self.starts[own], self.starts[own + 1] - self.starts[own]
        cells = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return len(rows) * self.base + np.bincount(self.column[cells], self.above[cells], len(self.base))


class Model:
    """Scores of words (table 0) and n-grams. What all languages' scores share cancels out and is left out."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]]):
        self.langs = langs
        column = {x: i for i, x in enumerate(langs)}
        counts: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(LONGEST + 1)]
        for lang, n, gram, k in rows:
            counts[n].setdefault(gram, []).append((column[lang], k))
        self.tables = [Table(x, len(langs)) for x in counts]
        self.met: dict[str, np.ndarray] = {}

    def unknown(self, word: str) -> np.ndarray:
        found = self.met.get(word)
        if found is None:
            found = np.zeros(len(self.langs))
            for n in range(LONGEST, 0, -1):
                at = self.tables[n].at
                rows = [i for g in grams_of(word, n) if (i := at.get(g)) is not None]
                if rows:
                    found = self.tables[n].total(rows) / len(rows)
                    break
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            self.met[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        at = self.tables[0].at
        ids = [at.get(w, -1) for w in words]
        total = self.tables[0].total([i for i in ids if i >= 0])
        for w, i in zip(words, ids, strict=True):
            if i < 0:
                total = total + self.unknown(w)
        chances = np.exp(total - total.max())
        best = int(chances.argmax())
        return self.langs[best], float(chances[best] / chances.sum())


def learned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Model of the rows that are not held out and have an id, a text and a language."""
    ship(docs.sparkSession)
    own = agreed(docs, id=id_col, text=text_col, lang=lang_col).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    # One row for each language: documents to learn from. What is collected grows with languages, not with documents.
    n_of = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n_of:
        return Model([], [])
    chance = F.create_map(*[F.lit(x) for lang, n in n_of.items() for x in (lang, min(1.0, sample / n))])
    u = F.pmod(F.xxhash64(F.lit("language"), F.col("id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    taken = own.where(u < F.element_at(chance, F.col("lang"))).select("lang", "text")
    counted = taken.mapInArrow(_counts, "lang string, n int, gram string, k bigint").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    return Model(sorted(n_of), sorted(counted.toPandas().itertuples(index=False, name=None)))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, held_out, lang_pred, score for each row of docs; nothing but the text is used for a prediction.

    Null text or no letter: `und` with score 0; so is everything if nothing was learned. A text whose letters are all
    unknown gets the first language with an even score. Repeated rows stay; empty docs: no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [own.predict(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], part["held_out"], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    own = agreed(docs, id=id_col, text=text_col).withColumn("held_out", held_out(F.col("id")))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    return identify(docs, learned(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds), id_col=id_col, text_col=text_col)
