"""Metrics of one file, as expressions on its text and language."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.paths import col

#: Word boundary for ASCII words: Java's \b also knows accented letters.
WORD = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
OPERAND = rf"""{WORD}[a-zA-Z_$][a-zA-Z0-9_$]*{WORD}|{WORD}[0-9]+(?:\.[0-9]+)?{WORD}|"[^"]*"|'[^']*'"""


def by_language(language: Column, make) -> Column:
    """make(name) for each language; generic for those not known."""
    out = None
    for name in fixed.KEYWORDS:
        if name != "generic":
            out = F.when(language == name, make(name)) if out is None else out.when(language == name, make(name))
    return out.otherwise(make("generic"))


def words(names: list[str]) -> str:
    return f"{WORD}(?:{'|'.join(names)}){WORD}"


def bound(value: Column, make) -> Column:
    """make(value), with value computed once."""
    return F.transform(F.array(value), make)[0]


def lines(text: Column | str) -> Column:
    """Number of lines; a trailing empty one counts."""
    return F.size(F.split(col(text), "\n", -1)).cast("long")


def logical_lines(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), "\n", -1), lambda x: x.rlike(r"\S"))).cast("long")


def comment_lines(text: Column | str, language: Column | str) -> Column:
    return by_language(col(language), lambda n: F.size(F.filter(F.split(col(text), "\n", -1), lambda x: x.rlike(fixed.COMMENTS[n])))).cast("long")


def comment_density(text: Column | str, language: Column | str) -> Column:
    return comment_lines(text, language) / F.greatest(F.lit(1), logical_lines(text))


def literal_count(text: Column, literal: Column | str) -> Column:
    mark = F.lit(literal) if isinstance(literal, str) else literal
    return ((F.length(text) - F.length(F.replace(text, mark, F.lit("")))) / F.length(mark)).cast("long")


def cyclomatic(text: Column | str, language: Column | str, word_bounded_logical: bool = False) -> Column:
    """1 + keywords + logical operators. `and` and `or` count wherever they stand unless bounded."""
    t = col(text)
    marks = [F.regexp_count(t, F.lit(words([w]))) if word_bounded_logical and w.isalpha() else literal_count(t, w) for w in fixed.LOGICAL]
    return (1 + by_language(col(language), lambda n: F.regexp_count(t, F.lit(words(fixed.KEYWORDS[n])))) + sum(marks[1:], marks[0])).cast("long")


def cyclomatic_base_python(text: Column | str) -> Column:
    return (1 + F.regexp_count(col(text), F.lit(words(fixed.BASE_PYTHON_KEYWORDS)))).cast("long")


def complexity_base_generic(text: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(logical_lines(text) / 10).cast("long"))


def complexity_base_javascript(text: Column | str) -> Column:
    """Tokens in place of syntax nodes: 1 + if, while, for(;;), case or default, ?, and the three logical operators."""
    t = col(text)
    loops = F.regexp_count(t, F.lit(rf"{WORD}for\s*\([^;)]*;[^;]*;"))
    branches = F.regexp_count(t, F.lit(words(["if", "while", "case", "default"])))
    ternary = F.regexp_count(t, F.lit(r"(?<!\?)\?(?![?.:])"))
    return (1 + loops + branches + ternary + literal_count(t, "&&") + literal_count(t, "||") + literal_count(t, "??")).cast("long")


def cognitive(text: Column | str, language: Column | str) -> Column:
    """Fold over the lines: an opener nests, a closing brace at the start unnests, a keyword adds 1 + nesting."""
    def fold(name: str) -> Column:
        def step(a: Column, line: Column) -> Column:
            opened = a["nest"] + F.when(line.rlike(fixed.OPENERS[name]), 1).otherwise(0)
            nest = opened if name == "python" else F.greatest(F.lit(0), opened - F.when(line.rlike(r"^\}"), 1).otherwise(0))
            return F.named_struct(F.lit("nest"), nest, F.lit("total"), a["total"] + F.when(line.rlike(words(fixed.KEYWORDS[name])), 1 + nest).otherwise(0))

        start = F.named_struct(F.lit("nest"), F.lit(0), F.lit("total"), F.lit(0))
        trimmed = F.transform(F.split(col(text), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        return F.aggregate(trimmed, start, step)["total"]

    return by_language(col(language), fold).cast("long")


def nesting_depth(text: Column | str) -> Column:
    """Greatest depth of braces and parentheses; only these characters are walked."""
    marks = F.regexp_replace(col(text), r"[^{}()]+", "")
    start = F.named_struct(F.lit("now"), F.lit(0), F.lit("most"), F.lit(0))

    def step(a: Column, c: Column) -> Column:
        now = F.when(c.isin("{", "("), a["now"] + 1).when(c.isin("}", ")"), F.greatest(F.lit(0), a["now"] - 1)).otherwise(a["now"])
        return F.named_struct(F.lit("now"), now, F.lit("most"), F.greatest(a["most"], now))

    return F.aggregate(F.split(marks, ""), start, step)["most"].cast("long")


def operator_counts(text: Column, operators: list[str]) -> Column:
    """struct<kinds, total>: how many of the operators the text has, and how often, as literal substrings.

    Operators of marks stand within runs of these marks, so they are sought in the text with all else squeezed out.
    """
    start = F.struct(F.lit(0).cast("long").alias("kinds"), F.lit(0).cast("long").alias("total"))

    def count_in(where: Column, names: list[str], so_far: Column) -> Column:
        def step(a: Column, op: Column) -> Column:
            n = literal_count(where, op)
            return bound(n, lambda k: F.struct((a["kinds"] + (k > 0).cast("long")).alias("kinds"), (a["total"] + k).alias("total")))

        return F.aggregate(F.array(*map(F.lit, names)), so_far, step)

    spelled = [op for op in operators if op.isalpha()]
    marks = "".join(sorted({c for op in operators if not op.isalpha() for c in op}))
    runs = F.regexp_replace(text, f"[^{re.escape(marks)}]+", " ")
    counted = bound(runs, lambda r: count_in(r, [op for op in operators if not op.isalpha()], start))
    return count_in(text, spelled, counted) if spelled else counted


def halstead_parts(text: Column | str, language: Column | str) -> Column:
    """struct<n_1, total_1, n_2, total_2>: distinct and all operators, distinct and all operands."""
    t = col(text)
    counts = by_language(col(language), lambda n: operator_counts(t, fixed.OPERATORS[n]))
    operands = F.regexp_extract_all(t, F.lit(OPERAND), 0)

    def parts(c: Column, found: Column) -> Column:
        return F.struct(
            c["kinds"].alias("n_1"), c["total"].alias("total_1"),
            F.size(F.array_distinct(found)).cast("long").alias("n_2"), F.size(found).cast("long").alias("total_2"),
        )

    return bound(counts, lambda c: bound(operands, lambda found: parts(c, found)))


def halstead_volume(parts: Column) -> Column:
    n = parts["n_1"] + parts["n_2"]
    return F.when(n == 0, F.lit(0.0)).otherwise((parts["total_1"] + parts["total_2"]) * F.log2(F.greatest(n, F.lit(1))))


def maintainability(volume: Column | str, cyclo: Column | str, loc: Column | str) -> Column:
    """0 to 100; 100 for an empty file."""
    v, lg = col(volume), col(loc)
    raw = 171 - 5.2 * F.log(F.when(v > 0, v)) - 0.23 * col(cyclo) - 16.2 * F.log(F.when(lg > 0, lg))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), F.lit(100.0))


def weight(cyclo: Column, cog: Column, volume: Column, mi: Column, cbo: Column) -> Column:
    """Counts are weighed in whole hundredths, which are exact."""
    w, hundredths = fixed.WEIGHTS, {k: round(100 * v) for k, v in fixed.WEIGHTS.items()}
    counts = (hundredths["cyclomatic"] * cyclo + hundredths["cognitive"] * cog) / 100
    return counts + w["halstead"] * volume / 100 + w["maintainability"] * (100 - mi) + hundredths["coupling"] * cbo / 100


def with_metrics(files, *, path: str = "path", content: str = "content"):
    """files with language and all metrics of a file alone; content is dropped, nothing shuffles."""
    from plumbline.functions.paths import language

    c, lang = F.col("__text"), F.col("language")
    out = files.withColumn("language", language(path)).withColumn("__text", F.coalesce(content, F.lit("")))
    out = out.withColumns({"loc": lines(c), "lloc": logical_lines(c), "comment_lines": comment_lines(c, lang), "cyclomatic": cyclomatic(c, lang), "cognitive": cognitive(c, lang), "nesting": nesting_depth(c), "__h": halstead_parts(c, lang)})
    out = out.withColumn("halstead", halstead_volume(F.col("__h"))).withColumn("comment_density", F.col("comment_lines") / F.greatest(F.lit(1), F.col("lloc")))
    return out.withColumn("mi", maintainability("halstead", "cyclomatic", "lloc")).drop("__text", "__h", content)
