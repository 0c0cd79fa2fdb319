"""Each operator against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat_format, components, decontamination, golay, language_id, licenses, line_dedup, mixing, near_dedup, pii, quality_rules, simhash, substring_dedup
from plumbline.llm import queries as llm
from tests.compare import SF, assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql(spark, name):
    assert_same(llm.QUERIES[name](spark, SF), llm.ORACLES[name])


def dice(unit, template):
    grams = lambda t: {tuple(w[i : i + 2]) for w in [re.sub(r"[\W_]+", " ", t.lower()).split()] for i in range(len(w) - 1)}
    a, b = grams(unit), grams(template)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES["MIT"][1]
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    extra = [(10_001, "x\n" + mit.replace("free of charge", "without charge") + "\ny", None), (10_002, half, None), (10_003, "\n".join(mit.split(", ")), None), (10_004, "released under the mit licence", None)]
    every = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    want = {}
    for r in every.collect():
        t = r["text"] or ""
        units = t.split("\n") + ([x for x in t.split("\n\n") if "\n" in x] + [t] if "\n" in t else [])
        for name, templates in licenses.TEMPLATES.items():
            best = max(dice(u, x) for u in units for x in templates)
            if best >= 0.8:
                want[r["doc_id"], name] = round(best, 6)
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.license_scan(every).collect()}
    assert got == want and any(k[0] == 10_001 for k in got) and any(k[0] == 10_003 for k in got)


def shares(sizes, share=1.5):
    """Targets by resharing the excess until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **t}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, docs):
    rng = random.Random(1)
    extra = [(20_000 + i, " ".join(["w"] * rng.choice([0, 1, 3, 30, 300])), None, rng.choice([None, "é", "zz"]), 0) for i in range(300)]
    every = docs.unionByName(spark.createDataFrame(extra, DOCS))
    rows = mixing.mix(every).collect()
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in every.collect()}
    source = {r["doc_id"]: r["source"] for r in every.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    per, taken = collections.Counter(), collections.Counter()
    for r in rows:
        per[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = shares(per)
    smallest = collections.defaultdict(lambda: 1 << 60)
    for r in rows:
        smallest[source[r["doc_id"]]] = min(smallest[source[r["doc_id"]]], r["size"] or 1 << 60)
    rated = collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]], abs=1e-6) and r["source_size"] == per[source[r["doc_id"]]]
        rated[source[r["doc_id"]]] += r["rate"] * r["size"]
    for s in per:
        assert rated[s] == pytest.approx(want[s], rel=1e-6)
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], smallest[s])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(every.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixing_follows_the_tilt(spark):
    """Within a source one multiplier explains all rates below 2: log(r) is linear in size."""
    d = spark.createDataFrame([(i, "w " * (i % 40 + 1), None, f"s{i % 3}", 0) for i in range(600)], DOCS)
    for r in mixing.mix(d).where("rate > 0 and rate < 2").withColumn("b", F.log("rate") / F.col("size")).groupBy("source_size", "target").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).collect():
        assert r["lo"] == pytest.approx(r["hi"], rel=1e-6)


def test_mixing_of_many_sizes_and_sources(spark):
    """A source of 12,000 distinct sizes is rounded in linear time, and thousands of sources are shared out alike."""
    sizes = spark.range(12_000).select(F.lit("wide").alias("source"), (F.col("id") + 1).alias("size"), F.lit(1).cast("long").alias("n"))
    some = spark.range(3000).select(F.format_string("s%05d", "id").alias("source"), (F.col("id") % 7).alias("size"), (F.col("id") % 5 + 1).alias("n"))
    every = sizes.unionByName(some)
    per = collections.Counter()
    for r in every.collect():
        per[r["source"]] += r["size"] * r["n"]
    want = shares(per)
    assert {r["source"]: r["target"] for r in mixing.targets(every).collect()} == pytest.approx(want, abs=1e-6)
    r = (F.lit(1) + (F.col("size") % 100) / 101).alias("r")
    rated = sizes.select(F.col("source").alias("source_key"), "size", "n", r, F.lit(1e8).alias("target")).repartition(3)
    began = time.time()
    rows = mixing.copies(rated, 2).collect()
    assert time.time() - began < 20 and len(rows) == 12_000
    assert abs(sum(x["k"] * x["size"] for x in rows) - 1e8) < 1.5 and all(0 <= x["k"] <= 2 * x["n"] for x in rows)


def test_line_dedup_shift(spark):
    """A block repeats after other lines: its boundaries come back within it."""
    rng = random.Random(4)
    block = [f"line {i} {rng.random()}" for i in range(60)]
    d = spark.createDataFrame([(1, "\n".join(["a", "b", *block, "c"]), None, None, 0), (2, "\n".join(["x", *block, "y", "z"]), None, None, 0), (3, "\n".join(block[:1] * 1), None, None, 0)], DOCS)
    r = {x["doc_id"]: x for x in line_dedup.line_dedup(d).collect()}
    assert r[1]["removed_chunks"] == 0 and r[2]["removed_lines"] >= 45 and r[3]["text"] == block[0]
    assert {"x", "y", "z"} <= set(r[2]["text"].split("\n"))


def test_pipeline_lines_take_short_passages(spark):
    """Passages of two to five lines between foreign lines go whole, and the first place of every line stays."""
    rng = random.Random(5)
    shared = [[f"shared {k} {i} {rng.random()}" for i in range(2 + k % 4)] for k in range(40)]
    rows = [(d * 100 + k, "\n".join([f"own {d} {k} {rng.random()}", *p, "", f"end {d} {k} {rng.random()}"]), "en", "s", 0) for d in (1, 2) for k, p in enumerate(shared)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.lines(spark, d, SF).collect()}
    for k, p in enumerate(shared):
        assert got[100 + k] == rows[k][1].split("\n")
        assert [x for x in got[200 + k] if x] == [x for x in rows[40 + k][1].split("\n") if x and x not in p]
    # What the chunks of op3 lose is lost here as well.
    chunks = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.line_dedup(d).collect()}
    assert all(set(got[i]) <= set(x) for i, x in chunks.items())


def test_golay_keys():
    rng = np.random.default_rng(0)
    assert {int((row >= 0).sum()) for row in golay.patterns()} == {1, 6}
    w = rng.integers(0, 1 << 23, 2000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 3), replace=False)) for _ in w])
    for a, b in zip(golay.keys(w), golay.keys(w ^ flips), strict=True):
        assert {x for x in a if x >= 0} & {x for x in b if x >= 0}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
def test_near_fingerprints_share_a_key(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    keys = lambda v: {k for late in (False, True) for k in simhash.key_rows(np.array([v], np.uint64).view(np.int64), late)[0].tolist()}
    assert keys(x) & keys(y)


def slow_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """{id: least id} over {id: fingerprint}, by all pairs."""
    ids, parent = sorted(prints), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    rng = random.Random(2)
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of it".split() * 3
    extra = [(30_000, None), (30_001, ""), (30_002, "ONE two"), (30_003, "one TWO")]
    for i in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i % 40}"
        extra.append((30_100 + i, " ".join(w)))
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in every.collect()}
    rows = simhash.simhash_dedup(every).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == slow_components(prints)


def test_pipeline_near_duplicates(spark):
    """Short texts with a word or two changed go if their 5-word shingles are alike by 0.8 or more, and stay else."""
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(50, 140))]
        for edits in (0, 1, 2, 4):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for b in range(len(texts)):
        for a in range(b):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = sorted({find(i) for i in range(len(texts))})
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert 60 < len(want) < 200
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()) == want


def test_pipeline_near_duplicates_by_fingerprints(spark):
    """Two texts alike by 0.86 that share no MinHash key, but whose SimHash fingerprints differ in four bits, are one."""
    rng = random.Random(5)
    one = [f"w{rng.randrange(10**6)}" for _ in range(480)]
    two, far = list(one), list(one)
    for at, word in ((27, "e2973"), (255, "e705177"), (13, "e217711"), (54, "e647433"), (71, "e715411"), (34, "e858603"), (44, "e486887")):
        two[at] = word
    for at in range(0, 480, 20):
        far[at] = f"x{at}"
    sets = [near_dedup.shingles_of(" ".join(w)) for w in (one, two)]
    assert not set(near_dedup.signature(sets[0])[0]) & set(near_dedup.signature(sets[1])[0])
    assert len(np.intersect1d(*sets)) >= 0.86 * len(np.union1d(*sets))
    d = spark.createDataFrame([(i, " ".join(w), "en", "s", len(w)) for i, w in enumerate((one, two, far, [], ["w"]))], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()) == [0, 2, 3, 4]


def test_linked_broadcasts_no_keys(spark, monkeypatch):
    """A fingerprint has some fifty keys, which Spark counts as one row: 12.9 million of them, 1 GB, went through the driver."""
    plans = {}

    def stored(df, name, **more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name, **more)

    keep = simhash.stored
    monkeypatch.setattr(simhash, "stored", stored)
    fps = spark.createDataFrame([(i * 2654435761 % (1 << 62),) for i in range(300)], "fp long")
    assert simhash.linked(keep(fps, "few")).count() == 300
    assert "MapInArrow" in plans["members"] and "Broadcast" not in plans["members"]


def test_linked_on_chains(spark):
    """Fingerprints in long chains and dense balls, where stars alone don't join what links do."""
    rng = random.Random(5)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(2, 14)):
            prints.append(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5])):
                x ^= 1 << b
    center = rng.getrandbits(64)
    prints += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(120)]
    own = {int(np.array([p], np.uint64).view(np.int64)[0]): p for p in prints}
    got = {r["fp"]: r["component"] for r in simhash.linked(spark.createDataFrame([(x,) for x in own], "fp long")).collect()}
    want = slow_components({p: p for p in own.values()})
    groups = lambda of: {frozenset(v) for v in of.values()}
    a, b = collections.defaultdict(set), collections.defaultdict(set)
    for s, u in own.items():
        a[got.get(s, s)].add(u)
        b[want[u]].add(u)
    assert groups(a) == groups(b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def slow_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_base(spark, docs):
    extra = [(1_000_000 + i, t, None, None, 0) for i, t in enumerate([None, "", "a", "a a a a a", "a b c a b c", "x\n\nx\n \nx y", "\x0b a\x0cb\rc\td", "a b a b a b a", "no\xa0break #*$%&|<> é"])]
    every = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.quality_rules(every, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert got == {r["doc_id"]: slow_base(r["text"]) for r in every.collect()}


def test_binomial(spark):
    cases = [(0, 100, 0.01), (3, 200, 0.02), (20, 1000, 0.05), (1, 1, 0.5), (40, 1000, 0.05)]
    for k, n, p in cases:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        got = spark.range(1).select(quality_rules.binomial_cdf(F.lit(k), F.lit(n), p).alias("x")).first()["x"]
        assert got == pytest.approx(want, rel=1e-9)


def test_quality_cutoffs(spark):
    """The certified cutoffs by the definition, step by step; too few labels give none."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(4000):
        lang = "en" if i < 3000 else "xx" if i < 3900 else "yy"
        bad = i % 4 == 0
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if bad and i % 8 or rng.random() < 0.002:
            words = [w + "#" * rng.choice([1, 1, 2]) if rng.random() < 0.8 else w for w in words]
        if bad and i % 8 == 0 or rng.random() < 0.03:
            words = [w + "!" if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grid = {k: quality_rules.GRID[k] for k in ("symbol_ratio", "bang_ratio")}
    half = {r["i"]: r["h"] for r in spark.range(4000).select(F.col("id").alias("i"), quality_rules.in_first_half(F.col("id")).alias("h")).collect()}
    got = {r["stratum"]: {k: r[f"{k}_max"] for k in grid} for r in quality_rules.cutoffs(quality_rules.features(d), lab, grid=grid).collect()}
    want = {}
    for lang in ("en", "xx", "yy"):
        own = [({"symbol_ratio": t.count("#") / 60, "bang_ratio": t.count("!") / 60}, labels[i][1], half[i]) for i, t, la, *_ in rows if la == lang]
        one, two = [x for x in own if x[2]], [x for x in own if not x[2]]
        n_good, n_bad = sum(g for _, g, _ in one), sum(1 - g for _, g, _ in one)
        steps = []
        for rule, cuts in grid.items():
            for j, cut in enumerate(cuts):
                k, hit = sum(g for x, g, _ in one if x[rule] > cut), sum(1 - g for x, g, _ in one if x[rule] > cut)
                if round(hit / max(1, n_bad) - 10 * k / max(1, n_good), 9) > 0:
                    steps.append((k, -hit, rule, j, cut))
        n, best = sum(g for _, g, _ in two), {}
        for t in range(1, len(steps) + 1):
            some = sorted(steps)[:t]
            k = sum(g for x, g, _ in two if any(x[rule] > cut for _, _, rule, _, cut in some))
            p = sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) if k < n * 0.05 else 1.0
            if p > 0.05 / 3:
                break
            best = {rule: min((cut for _, _, r, _, cut in some if r == rule), default=None) for rule in grid}
        if best:
            want[lang] = best
    assert got == want and {"en", "xx"} <= set(want) and all(any(x is not None for x in w.values()) for w in want.values())
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(d, lab, grid=grid).collect()}
    for i, t, lang, *_ in rows:
        cuts = want.get(lang, {})
        assert kept[i] == (not any(cuts.get(k) is not None and t.count(c) / 60 > cuts[k] for k, c in (("symbol_ratio", "#"), ("bang_ratio", "!"))))


def test_quality_rejects(spark):
    """At sf0.01 the English stratum has labels enough: bad documents go by the cutoffs, labelled good ones stay."""
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("not base_failed").join(labels, "doc_id").where("stratum = 'en'").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("kept")).collect()
    by = {r["quality"]: r for r in rows}
    assert by[0]["kept"] <= 0.1 * by[0]["n"] and by[1]["kept"] >= 0.95 * by[1]["n"]


def slow_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), min_size=1, max_size=15))
def test_alignment(a, b):
    score, start, end = decontamination.alignment(np.array(a, np.int64), np.array(b, np.int64))
    assert score == slow_alignment(a, b)
    if score:
        assert 0 <= start < end <= len(a) and slow_alignment(a[start:end], b) == score


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng = random.Random(8)
    items = {r["item_id"]: decontamination.words_of(r["text"]) for r in bench.collect()}
    extra, planted = [], set()
    for k, (i, w) in enumerate(items.items()):
        edited = [x if rng.random() > 0.12 else f"zq{rng.randrange(99)}" for x in w if rng.random() > 0.06]
        extra.append((40_000 + k, "noise before " * 5 + " ".join(edited) + " noise after" * 5, None, None, 0))
        if slow_alignment(decontamination.words_of(extra[-1][1]), w) >= len(w):
            planted.add((40_000 + k, i))
    every = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.decontaminate(every, bench).collect()}
    want = {}
    for r in every.collect():
        w = decontamination.words_of(r["text"])
        seen = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for i, x in items.items():
            if len(seen & {tuple(x[k : k + 3]) for k in range(len(x) - 2)}) >= 2 and (s := slow_alignment(w, x)) >= len(x):
                want[r["doc_id"], i] = round(s / (2 * len(x)), 6)
    assert got == want
    assert len(planted & set(got)) >= 0.95 * len(planted)
    blocks = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.decontaminate(every, bench, block=300).collect()}
    assert blocks == got


def test_decontamination_of_a_hot_group(spark):
    """One exact copy of an item doesn't hide the many copies that have a word changed."""
    item = [f"word{i}" for i in range(20)]
    edited = " ".join([*item[:10], "other", *item[11:]])
    docs = spark.createDataFrame([(0, " ".join(item), None, None, 0), *[(i, edited, None, None, 0) for i in range(1, 301)]], DOCS)
    got = {r["doc_id"]: r["score"] for r in decontamination.decontaminate(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {0: 1.0, **{i: round(37 / 40, 6) for i in range(1, 301)}}


def test_decontamination_by_any_item_id(spark):
    """Items without an id, or with one that isn't a number, are searched as well."""
    items = [("a-1", "the first item has these seven words"), (None, "another item without any id at all"), (None, "yet one more item that lacks its id")]
    docs = spark.createDataFrame([(k, f"before {t} after", None, None, 0) for k, (_, t) in enumerate(items)], DOCS)
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in got.collect()) == [(0, "a-1", 1.0), (1, None, 1.0), (2, None, 1.0)]


def legal(roles):
    return re.fullmatch(r"(s?(ua)+)?", "".join(roles)) is not None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["system", "user", "assistant", "tool", None]), max_size=7))
def test_repair_is_cheapest(names):
    roles = [chat_format.role_of(n) for n in names]
    text, n = chat_format.render([(r, f"t{i}") for i, r in enumerate(names)], chat_format.START, None, False, True, chat_format.TEMPLATE)
    out = re.findall(r"<\|(system|user|assistant)\|>\n", text)
    assert legal([r[0] for r in out]) and n["turns"] == len(out) and text.count("<|end|>") == len(out)
    assert [m for m in re.findall(r"t\d", text)] == [f"t{i}" for i in range(len(names))]

    # Cheapest by search over all states and moves, without the table of moves.
    best = {0: 0}
    for role in roles:
        after = {}
        for s, c in best.items():
            for own in (1, 2, 3):
                base = c + (0 if own == role else chat_format.RELABEL)
                options = [base] if own in chat_format.NEXT[s] else []
                options += [base + chat_format.MERGE] if own == s else []
                options += [base + chat_format.INSERT for g in chat_format.NEXT[s] if own in chat_format.NEXT[g]]
                for x in options:
                    after[own] = min(after.get(own, 1 << 40), x)
        best = after
    assert n["cost"] == min(c + {0: 0, 1: 2, 2: 1, 3: 0}[s] * chat_format.INSERT for s, c in best.items())


def test_chat_in_parts_is_chat_in_one(spark):
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"c{c}t{i} <|x") for c in range(3) for i in range((400, 5, 1)[c])]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    many = chat_format.chat_format(d, partitions=16, part_turns=30).orderBy("conv_id", "part").collect()
    for c in range(3):
        own = [(r, t) for cc, _, r, t in rows if cc == c]
        text, n = chat_format.render(own, chat_format.START, None, False, True, chat_format.TEMPLATE)
        parts = [x for x in many if x["conv_id"] == c]
        assert sum(x["cost"] for x in parts) == n["cost"] and sum(x["n_turns"] for x in parts) == len(own)
        whole = "".join(x["rendered"] for x in parts)
        assert re.findall(r"c\dt\d+", whole) == re.findall(r"c\dt\d+", text)
        assert legal([r[0] for r in re.findall(r"<\|(system|user|assistant)\|>\n", whole)])
    assert [x["part"] for x in many if x["conv_id"] == 0] == list(range(14))
    for partitions in (1, 64):
        assert chat_format.chat_format(d, partitions=partitions, part_turns=30).orderBy("conv_id", "part").collect() == many


def test_chat_rows_do_not_depend_on_partitions(spark):
    """The whole table, one row a conversation, each as a search over its turns in order gives it."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    own = collections.defaultdict(list)
    for r in turns.collect():
        own[r["conv_id"]].append((r["turn"] is None, r["turn"] or 0, r["role"] is None, r["role"] or "", r["text"] is None, r["text"] or "", r["role"], r["text"]))
    want = {}
    for c, rows in own.items():
        text, n = chat_format.render([x[-2:] for x in sorted(rows, key=lambda x: x[:6])], chat_format.START, None, False, True, chat_format.TEMPLATE)
        want[c] = (len(rows), n["turns"], n["cost"], n["merged"], n["relabelled"], n["inserted"], text)
    for partitions in (1, 8, 64):
        got = chat_format.chat_format(turns, partitions=partitions).collect()
        assert len(got) == len(want) and {r["conv_id"]: tuple(r)[2:] for r in got} == want


def spans_of(rows):
    return rows.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("removed_spans"), "clean_text")


def test_lines_by_sql(spark, docs):
    assert_same(spans_of(substring_dedup.substring_dedup(docs.select("doc_id", "text"), unit="line")), substring_dedup.oracle())


def slow_passages(text, least=24):
    """{(start, end): words} of the passage from each clause on, word by word."""
    words = list(WORD.finditer(text))
    ends = [m[0][-1] in ".!?,;:" or i + 1 == len(words) or "\n" in text[m.end() : words[i + 1].start()] for i, m in enumerate(words)]
    out = {}
    for i, m in enumerate(words):
        if i == 0 or ends[i - 1]:
            j = next((j for j in range(i + least - 1, len(words)) if ends[j]), None)
            if j is not None:
                out[m.start(), words[j].end()] = " ".join(x[0].lower() for x in words[i : j + 1])
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB.,!\n\t \x0b;é"), max_size=120))
def test_passages(text):
    want = {k: hashlib.md5(v.encode()).digest() for k, v in slow_passages(text, 4).items()}
    assert {(s, e): d for s, e, d in substring_dedup.passages_of(text, 4)} == want


def test_passages_inside_lines(spark):
    """A passage of 60 words goes from the inside of other lines but for its torn ends; short stock lines stay."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}" + rng.choice(["", "", "", ",", "."])
    passage = " ".join(word() for _ in range(60))
    rows = [(i, "Licensed under the terms of this very short stock line.\n" + " ".join([*[word() for _ in range(30)], passage, *[word() for _ in range(30)]]), "en", "s", 0) for i in range(20)]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0]["removed"] == [] and got[0]["clean_text"] == rows[0][1]
    for i in range(1, 20):
        gone = " ".join(rows[i][1][x["start"] : x["end"]] for x in got[i]["removed"])
        assert len(gone.split()) >= 35 and gone in passage and got[i]["clean_text"].startswith("Licensed")


def test_paragraphs(spark):
    p = "one two three four five six seven eight nine"
    d = spark.createDataFrame([(2, f"{p.upper()}\nmore\n\nother text", None, None, 0), (1, f"é\n\n{p}\nmore", None, None, 0)], DOCS)
    r = {x["doc_id"]: x for x in substring_dedup.substring_dedup(d, unit="paragraph").collect()}
    assert r[1]["clean_text"] == f"é\n\n{p}\nmore" and [tuple(x) for x in r[2]["removed"]] == [(0, len(p) + 5)] and r[2]["clean_text"] == "\n\nother text"


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0


def slow_base_spans(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda x: sum("0" <= c <= "9" for c in x)
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= digits(m[0]) <= 19 and slow_luhn(m[0])]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= digits(m[0]) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a1.9@+- ()%_é05"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base_spans(text)


def test_pii(spark, docs):
    rows = pii.find_pii(docs).collect()
    for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), [x["text"] for x in docs.orderBy("doc_id").collect()], strict=True):
        base = slow_base_spans(t or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))  or not base


def test_pii_discovers(spark):
    """Card numbers after "my card:" seed the pattern; it then finds one that fails the check digit."""
    good = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "30000000000004", "4012888888881881", "5105105105105100", "378282246310005", "4222222222222", "6011111111111117"]
    rows = [(i, f"pay with my card: {g} now", None, None, 0) for i, g in enumerate(good)]
    rows += [(50, "pay with my card: 4111111111111112 now", None, None, 0), (51, "lucky number 4111111111111112 here", None, None, 0)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[50]["spans"] == "card:18:34" and got[50]["n_card"] == 0 and got[50]["n_found"] == 1
    assert got[51]["spans"] == "" and got[0]["spans"] == "card:18:34" and got[0]["n_found"] == 0


def slow_trusted(found, rounds=4, prior=2.0, support=5, trust=0.7):
    """{(kind, context): score} by the definition, over rows of (kind, contexts, instance, seed)."""
    edges, seeded = collections.defaultdict(set), set()
    for kind, some, instance, seed in found:
        for c in some:
            edges[kind, c].add((kind, instance))
        if seed and some:
            seeded.add((kind, instance))
    edges = {p: x for p, x in edges.items() if len(x) >= support}
    scores = None
    for _ in range(rounds):
        belief = {i: 1.0 if i in seeded else 0.0 for x in edges.values() for i in x}
        for i in belief:
            if scores is not None and i not in seeded:
                belief[i] = 1 - math.prod(1 - scores.get(p, 0.0) for p, x in edges.items() if i in x)
        every = {p: (sum(belief[i] for i in x) / (len(x) + prior), sum(belief[i] >= trust for i in x)) for p, x in edges.items()}
        scores = {p: s for p, (s, firm) in every.items() if s >= trust and firm >= 2}
    return scores


def test_pii_patterns(spark):
    """Scores by the definition; what one pattern discovers supports another that no seed has."""
    rng = random.Random(13)
    found = [(4, ["token ="], i, True) for i in range(30)] + [(4, ["token ="], i, False) for i in range(30, 34)]
    found += [(4, ["key :", "key:"], i, False) for i in (*range(20, 34), 99)] + [(4, ["commit"], rng.randrange(10**6), i < 3) for i in range(40)] + [(2, [f"c{i % 7}"], rng.randrange(40), rng.random() < 0.7) for i in range(300)]
    found += [(4, ["sealed:"], i, False) for i in range(28, 34)] * 2
    got = {(r["kind"], r["context"]): r["score"] for r in pii.trusted(spark.createDataFrame(found, "kind int, contexts array<string>, instance long, seed boolean")).collect()}
    want = slow_trusted(found)
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    assert {(4, "token ="), (4, "key:")} <= set(got) and (4, "commit") not in got


def test_pii_finds_secrets(spark):
    """At sf0.01 every value assigned to `token` is discovered, in quotes or not, and no hash elsewhere."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    extra = [(90_001, "leak token = abcdef0123456789 here"), (90_002, f"the blob {'ab12' * 10} stands alone")]
    every = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    planted = {r["doc_id"] for r in every.collect() if re.search(r"token = \S*[0-9a-f]{16}", r["text"] or "")}
    rows = {r["doc_id"]: r for r in pii.find_pii(every).collect()}
    caught = {i for i in planted if "secret:" in rows[i]["spans"]}
    assert len(planted) >= 10 and caught == planted and rows[90_002]["n_found"] == 0 and rows[90_001]["spans"] == "secret:13:29"


def test_long_runs_are_fast():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "+" + "1 " * 150_000):
        list(pii.candidates(t, pii.base_spans(t)))


def test_language_id(spark, docs):
    model = language_id.learned(docs)
    rows = language_id.identify(docs, model).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    assert {r["doc_id"]: r["held_out"] for r in rows} == held
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(right) >= 0.95 * len(right) and all(0 <= r["score"] <= 1 for r in rows)
    # Counts and scores again, dense and from the rows: fewer of a language than the sample, so all are learned from.
    counts = [collections.Counter() for _ in range(5)]
    for r in docs.collect():
        if not held[r["doc_id"]] and r["lang"] is not None:
            for w in language_id.WORD.findall((r["text"] or "").lower()):
                counts[0][w, r["lang"]] += 1
                for n in range(1, 5):
                    counts[n].update((g, r["lang"]) for g in language_id.grams_of(w, n))
    entries = [{g for g, _ in c} for c in counts]
    sums = [collections.Counter() for _ in counts]
    for c, s in zip(counts, sums, strict=True):
        for (_, x), k in c.items():
            s[x] += k

    def logs(n, gram):
        return np.array([np.log((counts[n][gram, x] + 0.1) / (sums[n][x] + 0.1 * len(entries[n]))) for x in model.langs])

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = [(None, t, *model.predict(t)) for t in ("the of and zzzz", "12 34 !", "", "\u4e2d\u6587")]
    for _, text, lang_pred, score in some + [(r["doc_id"], texts[r["doc_id"]], r["lang_pred"], r["score"]) for r in rows]:
        words = language_id.WORD.findall((text or "").lower())
        total = np.zeros(len(model.langs))
        for w, times in collections.Counter(words).items():
            if w in entries[0]:
                total += times * logs(0, w)
                continue
            for n in range(4, 0, -1):
                known = [logs(n, g) for g in language_id.grams_of(w, n) if g in entries[n]]
                if known:
                    total += times * np.mean(known, axis=0)
                    break
        chances = np.exp(total - total.max())
        expected = chances.max() / chances.sum() if words else 0
        assert abs(score - expected) < 1e-6
        assert lang_pred == "und" if not words else (lang_pred == model.langs[int(total.argmax())] or expected < 0.51)


def test_language_model_is_sparse():
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(f"l{i:03}", 0, word(i), 3) for i in range(300)] + [(f"l{i:03}", 0, "all", 2) for i in range(300)]
    model = language_id.Model([f"l{i:03}" for i in range(300)], rows)
    assert len(model.tables[0].above) == 600 and len(model.tables[0].at) == 301
    assert model.predict(f"{word(7)} all") == ("l007", pytest.approx(31 / (31 + 299)))


def test_language_ignores_held_out_and_other_columns(spark, docs):
    swapped = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(docs).collect()}
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(swapped).collect()}
