"""Personal data by patterns and by bootstrapped contextual extraction.

Base spans come from fixed patterns of four kinds (email, ip, card, phone). They seed the method, and so do, for a fifth kind
(secret), quoted values of 32 letters and digits or more that are assigned with `=` or `:`. A token that looks like an
identifier (by its shape: a kind) makes an edge between an instance and each of its lexical patterns: the two words before
it on its line, and the last of them alone if it ends like a label, in one of `:=#` (digits as 9, lower case, quotes
left out, 200 characters back at most). Over this graph Spark scores in rounds
- an instance: 1 if it was seeded, else 1 - product of (1 - score) of the trusted patterns it was found by;
- a pattern: sum of its instances' scores / (their number + `prior`). It is trusted with a score of `trust` or more, `support`
  distinct instances or more, and two of them or more that are believed by `trust` or more.
So what a trusted pattern discovers supports other patterns in the next round. In the end trusted patterns discover
the instances they precede that no base span covers. Only texts are cut by Python; the graph is joins and aggregations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.operators.common import ship

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")
ROUNDS, PRIOR, SUPPORT, TRUST = 4, 2.0, 5, 0.7
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole (possessively): a match that starts inside one would have started at its beginning.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The shape of a key or token, which has letters and digits.
SECRET = re.compile(r"[0-9A-Za-z+/=_-]{12,}")
#: From a token's first character only, and without giving characters back, so that long runs are read once.
TOKEN = re.compile(r"(?<![^\s\"'<>\[\]{},;|])[^\s\"'<>\[\]{},;|0-9@]*+[0-9@][^\s\"'<>\[\]{},;|]*+(?:[\x20-][0-9]++)*+")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ backwards, so that long runs of letters cost no more than their length."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    return [(k, *x) for k, find in enumerate((emails, ips, cards, phones)) for x in find(text)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for k, s, e in spans)


def kind_of(token: str) -> int | None:
    """Kind that a token's shape suggests."""
    if "@" in token:
        return 0 if re.fullmatch(r"[^@\s]+@[^@\s]+", token) else None
    digits = sum("0" <= c <= "9" for c in token)
    if digits * 3 < len(token) * 2:
        return 4 if SECRET.fullmatch(token) and 2 <= digits <= len(token) - 2 else None
    if token.count(".") == 3 and 4 <= digits <= 12:
        return 1
    return 2 if 13 <= digits <= 19 else 3 if 7 <= digits <= 12 else 4 if SECRET.fullmatch(token) and digits <= len(token) - 2 else None


def contexts(text: str, start: int) -> list[str]:
    """The two words before a place on its line, or fewer, and the last of them alone if it ends like a label."""
    before = text[max(0, start - 200) : start].rpartition("\n")[2].rstrip("\"' \t").split()[-2:]
    words = re.sub("[0-9]", "9", " ".join(before)).lower().split()
    return [" ".join(words)] * bool(words) + ([words[-1]] if len(words) > 1 and len(words[-1]) > 1 and words[-1][-1] in ":=#" else [])


def assigned(text: str, start: int, end: int) -> bool:
    """Whether a token of 32 characters or more stands in quotes after = or :."""
    quote = text[start - 1 : start]
    return end - start >= 32 and quote in ("'", '"') and text[end : end + 1] == quote and text[max(0, start - 9) : start - 1].rstrip().endswith(("=", ":"))


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, list[str], str, bool, bool]]:
    """(kind, start, end, contexts, instance, seed, base): base spans, then tokens of such a shape that none touches."""
    for k, s, e in base:
        yield k, s, e, contexts(text, s), re.sub(r"[^0-9a-z@.]", "", text[s:e].lower()), True, True
    taken = sorted((s, e) for _, s, e in base)
    i = 0
    for m in TOKEN.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end():
            continue
        token = m[0].rstrip(".!?:)")
        if (k := kind_of(token)) is not None:
            end = m.start() + len(token)
            yield k, m.start(), end, contexts(text, m.start()), re.sub(r"[^0-9a-z@.]", "", token.lower()), k == 4 and assigned(text, m.start(), end), False


SPANS = "array<struct<kind:int,start:bigint,end:bigint,contexts:array<string>,instance:bigint,seed:boolean,base:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("contexts", pa.list_(pa.string())), ("instance", pa.int64()), ("seed", pa.bool_()), ("base", pa.bool_())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            counts, sums, found = [], [], []
            for text in part["text"].to_pylist():
                text = text or ""
                base = base_spans(text)
                counts.append([sum(k == x[0] for x in base) for k in range(4)])
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append([{"kind": k, "start": s, "end": e, "contexts": c, "instance": int.from_bytes(hashlib.blake2b(i.encode(), digest_size=8).digest(), "big", signed=True), "seed": x, "base": b} for k, s, e, c, i, x, b in candidates(text, base)])
            yield pa.RecordBatch.from_arrays([part["id"], *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(sums, pa.string()), pa.array(found, pa.list_(span))], ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "found"])


def trusted(found: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(kind, context, score) of the patterns that discover, from (kind, contexts, instance, seed)."""
    edges = found.select("kind", F.explode("contexts").alias("context"), "instance", "seed").groupBy("kind", "context", "instance").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pii-edges")
    seeds = edges.groupBy("kind", "instance").agg(F.max("seed").alias("seeded"))
    able = edges.groupBy("kind", "context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    graph = stored(edges.drop("seed").join(able, ["kind", "context"]).join(seeds, ["kind", "instance"]), "pii-graph")
    believed, scores = graph.withColumn("belief", F.col("seeded").cast("double")), None
    for turn in range(rounds):
        if scores is not None:
            noisy = F.when(F.max("seeded"), F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.coalesce("score", F.lit(0.0)))))))
            beliefs = graph.join(scores, ["kind", "context"], "left").groupBy("kind", "instance").agg(noisy.alias("belief"))
            believed = graph.join(beliefs, ["kind", "instance"])
        per = believed.groupBy("kind", "context").agg((F.sum("belief") / (F.first("n") + prior)).alias("score"), F.sum((F.col("belief") >= trust).cast("long")).alias("firm"))
        scores = stored(per.where((F.col("score") >= trust) & (F.col("firm") >= 2)).select("kind", "context", "score"), f"pii-scores-{turn}")
    return scores


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, prior: float = PRIOR, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """<id_col>, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found for each row of docs.

    spans holds base spans and discovered ones (n_found of them) by kind (secret last), then start, as kind:start:end in
    code points.
    Null and empty texts: none. Null ids and repeated rows stay rows of their own. Empty docs: no rows.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    scanned = own.mapInArrow(_scan, f"id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, found {SPANS}")
    rows = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    found = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    patterns = trusted(found, rounds, prior, support, trust)
    new = found.where("not base").withColumn("context", F.explode("contexts")).join(patterns, ["kind", "context"]).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    every = F.sort_array(F.concat(F.transform(F.filter("found", lambda f: f["base"]), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))), F.coalesce("new", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, NAMES)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.join(new, "row", "left").select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_found"))
