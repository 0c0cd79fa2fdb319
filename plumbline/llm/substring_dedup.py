"""Substring dedup by hashing lines or paragraphs.

A text is cut into units: lines, paragraphs (runs of text between blank lines), or passages. A passage begins with any
clause and is the shortest run of whole clauses with `least_words` words or more; a clause ends with a line or with a word
that ends in one of `.!?,;:`. So passages overlap, and one that stands inside longer lines or begins in the middle of one
is found wherever it is, but for the words before its first clause and after its last one. Short repeated lines and clauses
alone are no passage.

A unit is normalised: lower case, runs of ASCII white space become one space, ends trimmed. Units of `least_words` words
or more are grouped over the whole corpus by the 128-bit digest of their normalised form; the first by (doc_id, start)
stays, others are removed. Offsets refer to code points of the original text.

Of all units only one half of the digest is counted; the rows of those that occur twice are found with with_repeats. What
goes is all their places but the first ones, an anti-join by place: no task holds the rows of a frequent digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import let, named, row_key, stored, with_repeats
from plumbline.operators.common import ship

LEAST_WORDS, PASSAGE_WORDS = 8, 24
MARKS = {"line": "\n", "paragraph": "\n\n"}
SPANS = "array<struct<start:bigint,end:bigint>>"
#: What may end a clause, and a clause: up to such a character before white space, a line's end or the text's end.
ENDS = ".!?,;:"
CLAUSE = re.compile(rf"[^{ENDS}\n]*+(?:[{ENDS}](?![\x20\x09-\x0D])[^{ENDS}\n]*+)*+[{ENDS}\n]?")
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: str, mark: str, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each line or paragraph that is long enough."""
    at = 0
    for piece in text.split(mark):
        words = piece.lower().encode().split()
        if len(words) >= least_words:
            yield at, at + len(piece), hashlib.md5(b" ".join(words)).digest()
        at += len(piece) + len(mark)


def passages_of(text: str, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the passage from each clause on; the ends of a text are too short for one."""
    starts, ends, words = [], [], [0]
    line: list[bytes] = []
    for m in CLAUSE.finditer(text):
        clause = m[0].strip(SPACE)
        if clause:
            line += clause.lower().encode().split()
            words.append(len(line))
            starts.append(m.start() + len(m[0]) - len(m[0].lstrip(SPACE)))
            ends.append(m.end() - len(m[0]) + len(m[0].rstrip(SPACE)))
    last = 0
    for i, start in enumerate(starts):
        while last < len(ends) and words[last + 1] - words[i] < least_words:
            last += 1
        if last == len(ends):
            return
        yield start, ends[last], hashlib.md5(b" ".join(line[words[i] : words[last + 1]])).digest()


def units_of(text: str, unit: str, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    return passages_of(text, least_words) if unit == "passage" else lines_of(text, MARKS[unit], least_words)


def _unit_rows(unit: str, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows, starts, ends, digests = [], [], [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    for s, e, d in units_of(text, unit, least_words):
                        rows.append(i)
                        starts.append(s)
                        ends.append(e)
                        digests.append(d)
                at = pa.array(rows, pa.int64())
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part["key"].take(at), part["id"].take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["key", "id", "start", "end", "digest", "other"])

    return run


def _clean(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for text, gone in zip(part[text_col].to_pylist(), part["removed"].to_pylist(), strict=True):
                    kept, at = [], 0
                    for x in gone or ():
                        kept.append(text[at : x["start"]])
                        at = x["end"]
                    out.append(text if not gone else "".join([*kept, text[at:]]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "clean_text"])

    return run


def together(spans: Column) -> Column:
    """Sorted spans with those that overlap as one: one begins where none before it reaches, and ends before the next."""
    reach = F.transform(spans, lambda x, i: x["end"])
    begins = let(reach, lambda e: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] > F.get(e, i - 1))))
    return let(spans, lambda s: let(begins, lambda b: F.transform(b, lambda i, k: named(start=F.get(s, i)["start"], end=F.get(s, F.coalesce(F.get(b, k + 1), F.size(s)) - 1)["end"]))))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "passage", least_words: int | None = None) -> DataFrame:
    """docs with removed (array<struct<start, end>>, original code points, overlapping units as one) and clean_text.

    unit: "passage", "line" or "paragraph", with `least_words` words (24, or 8 for the others) or more. clean_text is the text without the removed ranges; the separators stay, so other offsets can still be told. Null
    text: null, nothing removed. Null ids rank first. Rows with the same id and text are one occurrence. Columns named
    removed or clean_text, or starting with "__", are left out. Empty docs: no rows.
    """
    ship(docs.sparkSession)
    least_words = least_words or (PASSAGE_WORDS if unit == "passage" else LEAST_WORDS)
    whole = docs.drop("removed", "clean_text", *[c for c in docs.columns if c.startswith("__")])
    own = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    kind = own.schema["id"].dataType.simpleString()
    places = stored(own.mapInArrow(_unit_rows(unit, least_words), f"key bigint, id {kind}, start int, end int, digest bigint, other bigint"), "units")
    counted = stored(places.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "unit-repeats")
    again = stored(with_repeats(places, counted, "digest").drop("copies"), "unit-candidates")
    first = again.groupBy("digest", "other").agg(F.min(F.struct("id", "key", "start")).alias("first")).select("first.key", "first.start")
    gone = again.join(first, ["key", "start"], "left_anti")
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    removed = gone.groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("removed")).withColumnRenamed("key", "__key")
    joined = whole.withColumn("__key", row_key(id_col, text_col)).join(removed, "__key", "left").drop("__key")
    full = joined.withColumn("removed", F.coalesce(together(F.col("removed")), F.array().cast(SPANS)))
    return full.mapInArrow(_clean(text_col), T.StructType([*full.schema.fields, T.StructField("clean_text", T.StringType())]))


def oracle(docs: str = "documents", least_words: int = LEAST_WORDS) -> str:
    """DuckDB SQL of op8 for lines, where doc_id is unique."""
    return f"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {docs} WHERE text IS NOT NULL)),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM l),
r AS (SELECT *, length(norm) - length(replace(norm, ' ', '')) >= {least_words - 1} AS unit, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS later FROM p)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, '') AS removed_spans, clean AS clean_text
FROM {docs} d LEFT JOIN (SELECT doc_id, count(*) FILTER (unit AND later) AS n, string_agg(start || ':' || (start + length(line)), ',' ORDER BY i) FILTER (unit AND later) AS spans, string_agg(CASE WHEN unit AND later THEN '' ELSE line END, chr(10) ORDER BY i) AS clean FROM r GROUP BY doc_id) USING (doc_id)"""


def passage_oracle(docs: str = "documents", least_words: int = PASSAGE_WORDS) -> str:
    """DuckDB SQL of op8, passages by words, where doc_id is unique."""
    return f"""
WITH t AS (SELECT doc_id, unnest(x) AS tok, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+') AS x FROM {docs} WHERE text IS NOT NULL)),
w AS (SELECT doc_id, k, regexp_replace(tok, '^[\\x20\\x09-\\x0D]+', '') AS word, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop, lead(tok) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM t),
e AS (SELECT doc_id, k, word, stop, right(word, 1) IN ('.', '!', '?', ',', ';', ':') OR next IS NULL OR contains(next, chr(10)) AS ends FROM w),
b AS (SELECT doc_id, k, stop - length(word) AS start, coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY k), true) AS begins,
             min(CASE WHEN ends THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {least_words - 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS till FROM e),
l AS (SELECT doc_id, list(lower(word) ORDER BY k) AS words, list(stop ORDER BY k) AS stops FROM w GROUP BY doc_id),
p AS (SELECT doc_id, start, stops[till] AS stop, row_number() OVER (PARTITION BY array_to_string(list_slice(words, k, till), ' ') ORDER BY doc_id, start) > 1 AS later FROM b JOIN l USING (doc_id) WHERE begins AND till IS NOT NULL),
g AS (SELECT doc_id, start, stop, coalesce(start > lag(stop) OVER (PARTITION BY doc_id ORDER BY start), true) AS fresh FROM p WHERE later),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM g),
s AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, island),
c AS (SELECT doc_id, start, stop, substr(text, coalesce(lag(stop) OVER o, 0) + 1, start - coalesce(lag(stop) OVER o, 0)) AS before FROM s JOIN {docs} USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
r AS (SELECT doc_id, count(*) AS n, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans, string_agg(before, '' ORDER BY start) AS head, max(stop) AS last FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, '') AS removed_spans, CASE WHEN n IS NULL THEN text ELSE head || substr(text, last + 1) END AS clean_text
FROM {docs} d LEFT JOIN r USING (doc_id)"""
