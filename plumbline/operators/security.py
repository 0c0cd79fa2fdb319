"""Scan of texts for risky patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.metrics import WORD
from plumbline.functions.paths import extension

SEVERITIES = ["low", "medium", "high", "critical"]
_extra: list[tuple[int, str, bool, str, str]] = []


def register_rule(pattern: str, severity: str, message: str, case_sensitive: bool = False) -> int:
    """Add a rule to those that scans use; returns its number."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity: {severity}")
    _extra.append((len(fixed.SECURITY_RULES) + len(_extra) + 1, pattern, case_sensitive, severity, message))
    return _extra[-1][0]


def rules() -> list[tuple[int, str, bool, str, str]]:
    return [*fixed.SECURITY_RULES, *_extra]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "rule_id int, pattern string, case_sensitive boolean, severity string, message string")


def line_hits(text: Column, rule: int, pattern: str, severity: str, message: str) -> Column:
    """Array of the matches of a rule, line by line."""
    def row(line: Column, hit: Column) -> Column:
        return F.named_struct(F.lit("line"), line, F.lit("rule_id"), F.lit(rule), F.lit("severity"), F.lit(severity), F.lit("message"), F.lit(message), F.lit("pattern"), hit)

    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.named_struct(F.lit("line"), (i + 1).cast("int"), F.lit("hits"), F.regexp_extract_all(x, F.lit(pattern), 0)))
    return F.flatten(F.transform(F.filter(lines, lambda x: F.size(x["hits"]) > 0), lambda x: F.transform(x["hits"], lambda h: row(x["line"], h))))


def scan(files: DataFrame, strict: bool = False, severities: tuple[str, ...] = tuple(SEVERITIES)) -> DataFrame:
    """(project, file, line, rule_id, severity, message, pattern): one row for each match of a rule of these severities.

    A rule is a literal of the plan, tried on a whole text first: lines are cut only where it hits. Blocked and oversized
    files give a row each (line 0); strict raises for them instead. Only text files are searched.
    """
    ext = F.lower(extension("path"))
    named = files.select("project", F.col("path").alias("file"), F.coalesce("content", F.lit("")).alias("content"), ext.alias("ext"), F.coalesce("size_bytes", F.octet_length("content")).alias("size"))
    blocked = F.col("ext").isin(*["." + e for e in fixed.BLOCKED])
    oversize = F.col("size") > fixed.MAX_BYTES["security"]
    refused = named.where(blocked | oversize).select("project", "file", F.lit(0).alias("line"), F.lit(0).alias("rule_id"), F.lit("high").alias("severity"), F.when(blocked, "blocked extension").otherwise("oversize").alias("message"), F.col("ext").alias("pattern"))
    if strict and (bad := refused.limit(5).collect()):
        raise ValueError("dangerous files: " + ", ".join(f"{r['file']} ({r['message']})" for r in bad))
    texts = named.where(~blocked & ~oversize & F.col("ext").isin(*["." + e for e in fixed.TEXT_EXTENSIONS]))
    found = []
    for rule, pattern, case, severity, message in rules():
        if severity not in severities:
            continue
        p = ("" if case else "(?i)") + pattern.replace(r"\b", WORD)
        hits = line_hits(F.col("content"), rule, p, severity, message)
        found.append(F.when(F.col("content").rlike(p), hits).otherwise(F.array().cast("array<struct<line:int,rule_id:int,severity:string,message:string,pattern:string>>")))
    if not found:
        return refused
    issues = texts.select("project", "file", F.explode(F.concat(*found)).alias("x")).select("project", "file", "x.*")
    return issues.unionByName(refused)


def gate(issues: DataFrame) -> DataFrame:
    """(project, n_issues, n_critical, passes, messages): any critical issue stops a project."""
    critical = F.col("severity") == "critical"
    return issues.groupBy("project").agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(critical).alias("n_critical"), F.array_join(F.sort_array(F.collect_set(F.when(critical, F.col("message")))), "; ").alias("messages")).withColumn("passes", F.col("n_critical") == 0)


def enforce(issues: DataFrame) -> None:
    """Raise if any project has a critical issue."""
    bad = gate(issues).where("not passes").limit(10).collect()
    if bad:
        raise ValueError("security: critical issues: " + "; ".join(f"{r['project']}: {r['messages']}" for r in bad))
