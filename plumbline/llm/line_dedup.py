"""Line dedup by content-defined chunks of lines.

The lines of a text have 28-bit hashes h. A rolling hash over the last two, (31 h[i-1] + h[i]) mod `divisor`, marks line i
(i > 0) if it is 0; a chunk ends after a marked line whose line before is not marked, so that every chunk but the last has
two lines or more. A boundary depends on three lines only: lines put in or taken out elsewhere don't shift it.

Chunks of two lines or more that hold a word are removed wherever they aren't the first (by doc_id, then place) with the
same bytes. Only 64-bit digests of all chunks are shuffled; texts follow just for digests that occur twice, and are
grouped by their bytes. What remains of a text is its other chunks, joined by newlines.

A chunk that holds a foreign line matches nothing, so short shared passages mostly stay. passage_dedup takes every two
successive lines that hold a word (with the blank lines between them) as a unit besides the chunks: each passage of two
such lines or more that an earlier place has goes as a whole, wherever it begins. The first place of a line never goes.

No step groups or joins the rows of one digest in one task: digests and chunks are counted with partial aggregates, the
repeated ones are found with with_repeats, and what goes is all places but the first ones, an anti-join by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, marked, marks, named, row_key, stored, with_repeats

DIVISOR = 2
WORDED = r"[^\x20\x09-\x0D]"
BLANK = r"[\x20\x09\x0B-\x0D]*+"
#: A text of two lines that hold a word, and blank lines between; nothing is given back, so it is read once.
PAIR = rf"\A{BLANK}[^\x20\x09-\x0D][^\n]*+\n(?:{BLANK}\n)*+{BLANK}[^\x20\x09-\x0D][^\n]*+\z"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunk_ends(lines: Column, divisor: int) -> Column:
    """Places of the last lines of all chunks."""
    last = F.size(lines) - 1
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))

    def ends(h: Column) -> Column:
        at = lambda i: (i > 0) & ((F.get(h, i - 1) * 31 + F.get(h, i)) % divisor == 0)
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (at(i) & ~at(i - 1)))

    return let(hashes, ends)


def spanned(lines: Column, a: Column, b: Column) -> Column:
    """Lines a to b, taken one by one: slice() would copy the whole array each time."""
    return named(a=a, b=b, text=F.array_join(F.transform(F.sequence(a, b), lambda i: F.get(lines, i)), "\n"))


def chunks_of(lines: Column, divisor: int) -> Column:
    """array<struct<a, b, text>>: first and last line and text of each chunk of two lines or more that holds a word."""
    def cut(e: Column) -> Column:
        every = F.transform(e, lambda b, k: spanned(lines, F.coalesce(F.get(e, k - 1), F.lit(-1)) + 1, b))
        return F.filter(every, lambda c: (c["b"] > c["a"]) & c["text"].rlike(WORDED))

    return let(chunk_ends(lines, divisor), cut)


def passages_of(lines: Column, divisor: int) -> Column:
    """Each pair of successive lines that hold a word, with the blank lines between, and the chunks that are no such pair."""
    held = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORDED))
    pairs = let(held, lambda w: F.filter(F.transform(w, lambda i, k: F.when(k > 0, spanned(lines, F.get(w, k - 1), i))), lambda u: u.isNotNull()))
    return F.concat(F.filter(chunks_of(lines, divisor), lambda c: ~c["text"].rlike(PAIR)), pairs)


def removed(docs: DataFrame, id_col: str, text_col: str, units_of, divisor: int) -> DataFrame:
    """(__key, __gone): the units, as array<struct<a, b>> of lines, that an earlier place has, by row_key(id, text)."""
    own = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").contains("\n"))
    units = let(lines_of(F.col("text")), lambda x: units_of(x, divisor))
    digests = F.transform(units, lambda u, k: named(k=k, digest=F.xxhash64(u["text"])))
    places = stored(own.select("key", F.explode(digests).alias("u")).select("key", "u.k", "u.digest"), "line-places")
    counted = stored(places.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "line-repeats")
    flagged = with_repeats(places, counted, "digest").groupBy("key").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    # A text is cut once; the units wanted are chosen inside the row.
    wanted = let(marks(F.col("ks")), lambda m: F.filter(F.transform(units, lambda u, k: named(k=k, a=u["a"], b=u["b"], text=u["text"])), lambda u: marked(m, u["k"])))
    held = own.join(flagged, "key").select("key", "id", F.explode(wanted).alias("u")).select("key", "id", "u.*")
    texts = stored(held, "line-candidates")
    first = texts.groupBy("text").agg(F.min(F.struct("id", "key", "k")).alias("first")).select("first.key", "first.k")
    gone = texts.join(first, ["key", "k"], "left_anti")
    return gone.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("__gone")).withColumnRenamed("key", "__key")


def cleaned(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with its text without the lines of gone, and __n (lines removed) and __gone."""
    joined = docs.withColumn("__key", row_key(id_col, text_col)).join(gone.hint("merge"), "__key", "left").drop("__key")
    text = F.col(f"`{text_col}`")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("__gone", lambda g: F.sequence(g["a"], g["b"])))))
    left = let(places, lambda p: let(marks(p), lambda m: named(n=F.size(p).cast("long"), text=F.array_join(F.filter(lines_of(text), lambda x, i: ~marked(m, i)), "\n"))))
    out = joined.withColumn("__left", F.when(F.col("__gone").isNotNull(), left))
    columns = [F.coalesce("__left.text", text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, F.coalesce("__left.n", F.lit(0).cast("long")).alias("__n"), text.alias("__text"), "__gone")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """docs with its text cleaned, and n_chunks, removed_chunks, removed_lines (long).

    Columns of docs that have one of these three names or start with "__" are replaced. Null text: stays null, counts 0.
    Empty text: one chunk of one line, kept. Rows with the same id and text are one occurrence: all of them stay or lose
    the same chunks. Null ids rank first. Empty docs: no rows.
    """
    names = ("n_chunks", "removed_chunks", "removed_lines")
    whole = docs.drop(*names, *[c for c in docs.columns if c.startswith("__")])
    out = cleaned(whole, removed(docs, id_col, text_col, chunks_of, divisor), id_col, text_col)
    text = F.col("__text")
    n = F.when(text.isNull(), 0).when(text.contains("\n"), F.size(let(lines_of(text), lambda x: chunk_ends(x, divisor)))).otherwise(1)
    return out.select(*[F.col(f"`{c}`") for c in whole.columns], n.cast("long").alias("n_chunks"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("removed_chunks"), F.col("__n").alias("removed_lines"))


def passage_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """docs with its text cleaned of repeated passages and chunks, and removed_lines (long).

    Nulls, ids and repeated rows as with line_dedup; columns named removed_lines or starting with "__" are replaced.
    """
    whole = docs.drop("removed_lines", *[c for c in docs.columns if c.startswith("__")])
    out = cleaned(whole, removed(docs, id_col, text_col, passages_of, divisor), id_col, text_col)
    return out.select(*[F.col(f"`{c}`") for c in whole.columns], F.col("__n").alias("removed_lines"))


def oracle(docs: str = "documents", divisor: int = DIVISOR) -> str:
    """DuckDB SQL for doc_id, text and the counts, where doc_id is unique."""
    return f"""
WITH l AS (SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h
           FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {docs} WHERE text IS NOT NULL))),
m AS (SELECT *, coalesce((31 * lag(h) OVER w + h) % {divisor} = 0, false) AS marked FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, marked AND NOT coalesce(lag(marked) OVER w, false) AS ends FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, k),
r AS (SELECT *, n >= 2 AND regexp_matches(chunk, '\\S') AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x.kept, '') END AS text, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(removed_chunks, 0)::BIGINT AS removed_chunks, coalesce(removed_lines, 0)::BIGINT AS removed_lines
FROM {docs} d LEFT JOIN (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone) AS kept, count(*) AS n_chunks, count(*) FILTER (gone) AS removed_chunks, sum(n) FILTER (gone) AS removed_lines FROM r GROUP BY doc_id) x USING (doc_id)"""
