"""What a file imports and exports, by patterns on its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.paths import col, extension

#: Fixed patterns of the literal mode.
JS_IMPORT = r"""import\s+(?:(?:\*\s+as\s+\w+)|(?:\{[^}]*\})|(?:\w+))\s+from\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
JS_DYNAMIC = r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)"""
JAVA_IMPORT = r"""import\s+(?:static\s+)?([a-zA-Z0-9_.]+?)(?:\.\*)?;"""
C_INCLUDE = r"""#include\s*[<"]([^>"]+)[>"]"""
#: Also side-effect imports, default with named imports, and re-exports.
JS_ANY = r"""(?:import|export)\s+(?:[\w*{}\s,$]+?\s+from\s+)?['"]([^'"]+)['"]"""


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def javascript_imports(text: Column | str, literal: bool = False) -> Column:
    t = col(text)
    return F.array_distinct(F.concat(_found(t, JS_IMPORT if literal else JS_ANY), _found(t, JS_REQUIRE), _found(t, JS_DYNAMIC)))


def strip_types(text: Column | str) -> Column:
    """Without type annotations, interfaces, aliases and assertions."""
    t = F.regexp_replace(col(text), r":\s*\w+(\[\])?", "")
    t = F.regexp_replace(t, r"interface\s+\w+\s*\{[^}]*\}", "")
    t = F.regexp_replace(t, r"type\s+\w+\s*=[^;]+;", "")
    return F.regexp_replace(t, r"as\s+\w+", "")


def python_imports(text: Column | str, literal: bool = False) -> Column:
    """Module of `from X import`, or each name of `import a as b, c`. The literal mode wants lines without indent."""
    t, lead = col(text), "" if literal else r"[ \t]*"
    froms = F.regexp_extract_all(t, F.lit(rf"(?m)^{lead}(?:from[ \t]+(\S+)[ \t]+)?import[ \t]+(.+)$"), 1)
    names = F.regexp_extract_all(t, F.lit(rf"(?m)^{lead}(?:from[ \t]+(\S+)[ \t]+)?import[ \t]+(.+)$"), 2)
    each = F.zip_with(froms, names, lambda a, b: F.when(a != "", F.array(a)).otherwise(F.transform(F.split(b, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")))))
    return F.array_distinct(F.filter(F.flatten(each), lambda x: x != ""))


def base_python_imports(text: Column | str) -> Column:
    """One entry a line: the module, or the first of a list with its alias kept."""
    t = col(text)
    pattern = r"(?m)^(?:from[ \t]+(\S+)[ \t]+)?import[ \t]+(.+)$"
    return F.zip_with(F.regexp_extract_all(t, F.lit(pattern), 1), F.regexp_extract_all(t, F.lit(pattern), 2), lambda a, b: F.when(a != "", a).otherwise(F.trim(F.get(F.split(b, ","), F.lit(0)))))


def java_imports(text: Column | str) -> Column:
    return F.array_distinct(_found(col(text), JAVA_IMPORT))


def c_includes(text: Column | str) -> Column:
    return F.array_distinct(_found(col(text), C_INCLUDE))


def imports(path: Column | str, text: Column | str, literal: bool = False) -> Column:
    """By the extension of the path. Types are stripped for metrics only: stripping would lose imports."""
    e = extension(path)
    return (
        F.when(e.isin(".js", ".jsx", ".ts", ".tsx"), javascript_imports(text, literal))
        .when(e == ".py", python_imports(text, literal))
        .when(e == ".java", java_imports(text))
        .when(e.isin(".cpp", ".c", ".h", ".hpp"), c_includes(text))
        .otherwise(F.array().cast("array<string>"))
    )


def python_exports(text: Column | str) -> Column:
    """Names of top-level functions and classes."""
    return F.regexp_extract_all(col(text), F.lit(r"(?m)^(?:def|class)\s+(\w+)"), 1)


def javascript_exports(text: Column | str) -> Column:
    """Names of `export const`."""
    return F.regexp_extract_all(col(text), F.lit(r"export\s+const\s+([A-Za-z_$][\w$]*)"), 1)
