"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat_format, decontamination, language_id, licenses, line_dedup, mixing, pii, quality_rules, simhash, substring_dedup
from tests.compare import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 5000}" for i in range(120_000))
ROWS = [(1, None, None, None, None), (None, "a b c d e\nf g", "en", "s", 9), (None, None, None, None, None), (2, "", "en", None, 0), (3, "same text here\nand there", "en", "s", 5), (3, "same text here\nand there", "en", "s", 5), (4, "same text here\nand there", None, "s", 5), (5, LONG, "en", "t", 9), (6, "\n \n\t\n", "fr", "t", 4)]
#: Names that operators use themselves.
CLASH = ["size", "taken", "key", "row", "id", "fp", "component", "kept", "removed", "n_chunks", "clean_text", "spans", "found", "held_out", "score", "stratum", "copies", "__key", "quality"]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ROWS, DOCS)
    for c in CLASH:
        d = d.withColumn(c, F.lit("clash"))
    return d.cache()


@pytest.fixture(scope="module")
def side(spark):
    return {"labels": spark.createDataFrame([(3, 1, None), (None, None, None), (5, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "same text here and there"), (None, "x"), (2, None), (3, "a"), (1, "same text here and there")], "item_id long, text string")}


OPERATORS = {
    "licenses": lambda d, s: licenses.license_scan(d), "mixing": lambda d, s: mixing.mix(d), "lines": lambda d, s: line_dedup.line_dedup(d), "simhash": lambda d, s: simhash.simhash_dedup(d),
    "quality": lambda d, s: quality_rules.quality_rules(d, s["labels"]), "leaks": lambda d, s: decontamination.decontaminate(d, s["benchmark"]), "substrings": lambda d, s: substring_dedup.substring_dedup(d),
    "pii": lambda d, s: pii.find_pii(d), "language": lambda d, s: language_id.language_id(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, odd, side):
    rows = OPERATORS[name](odd, side).collect()
    if name not in ("licenses", "leaks"):
        assert len(rows) == len(ROWS)
    if name == "leaks":
        assert sorted(r["doc_id"] for r in rows) == [3, 3, 4]
    if name == "lines":
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], set()).add(r["text"])
        assert by[3] == {"same text here\nand there"} and by[1] == {None} and by[2] == {""} and by[5] == {LONG}
        assert by[4] <= {"same text here\nand there", ""}
    if name == "mixing":
        assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 6))
    if name == "simhash":
        assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3} and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 6)} == {1}
    if name == "language":
        assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 6)} == {"und"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, odd, side):
    assert OPERATORS[name](odd.limit(0), side).count() == 0


def test_empty_sides(odd, side):
    assert decontamination.decontaminate(odd, side["benchmark"].limit(0)).count() == 0
    kept = quality_rules.quality_rules(odd, side["labels"].limit(0))
    assert kept.where("kept = base_failed").count() == 0


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (1, None, "ASSISTANT ", None), (2, 0, "system", ""), (None, 1, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.chat_format(d.coalesce(1)).collect() if r["part"] == 0}
    assert set(got) == {1, 2, None}
    assert chat_format.chat_format(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name, odd, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == corpus_pipeline.COLUMNS
    assert out.count() <= len(ROWS)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_pipeline_against_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    one = corpus_pipeline.quality(spark, docs, SF).cache()
    assert {r["doc_id"] for r in one.collect()} == kept
    two = corpus_pipeline.lines(spark, one, SF).cache()
    assert {r["doc_id"] for r in two.collect()} <= kept and two.where("n_chars <> length(text)").count() == one.where("n_chars <> length(text)").count()
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_dedup(two).collect()}
    three = corpus_pipeline.near_duplicates(spark, two, SF).cache()
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(groups.values()))
    leaks = {r["doc_id"] for r in decontamination.decontaminate(three, bench).collect()}
    four = corpus_pipeline.decontaminated(spark, three, SF).cache()
    assert {r["doc_id"] for r in four.collect()} == set(groups.values()) - leaks
    five = corpus_pipeline.mixed(spark, four, SF)
    assert five.where("taken <> copies * size or copies < 1 or copies > 2").count() == 0
    whole = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {r["doc_id"]: r["taken"] for r in five.collect()}
