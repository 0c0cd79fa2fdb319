"""Expressions on paths, names and URLs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def holds(text: Column, words: list[str]) -> Column:
    return any_of([text.contains(w) for w in words])


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """Everything before the last slash; `.` without one."""
    p = col(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column | str) -> Column:
    """From the last dot of the basename on, dot included; empty without one. A leading dot is no extension."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column | str) -> Column:
    """Language by extension, case-sensitive. TypeScript is measured as JavaScript."""
    e = extension(path)
    return F.when(e.isin(".js", ".jsx", ".ts", ".tsx"), "javascript").when(e == ".py", "python").when(e == ".java", "java").when(e.isin(".cpp", ".c", ".h", ".hpp"), "cpp").otherwise("generic")


def file_type(path: Column | str) -> Column:
    """Type by the first of ten rules that holds. "Starts with a capital" is tested on the name as written."""
    own = col(path)
    p, f, d = F.lower(own), F.lower(basename(own)), F.lower(dirname(own))
    first = F.substring(basename(own), 1, 1)
    ends = lambda *x: any_of([p.endswith(e) for e in x])
    return (
        F.when(holds(p, ["test", "spec"]), "test")
        .when(holds(p, ["/api/", "/routes/", "/endpoints/"]) | holds(f, ["route", "endpoint", "controller"]), "api")
        .when(ends(".tsx", ".jsx") & (p.contains("/component") | (first == F.upper(first))), "component")
        .when(holds(p, ["/page", "/view", "/screen"]) | holds(d, ["pages", "views", "screens"]), "page")
        .when(f.startswith("use") & ends(".ts", ".tsx", ".js"), "hook")
        .when(holds(p, ["/util", "/helper", "/lib"]) | holds(f, ["util", "helper", "common"]), "utility")
        .when(holds(p, ["/service", "/client", "/adapter"]) | holds(f, ["service", "client", "api"]), "service")
        .when(holds(p, ["/config", ".env"]) | holds(f, ["config", "setting", "constant"]), "config")
        .when(ends(".d.ts") | holds(f, ["type", "interface"]) | p.contains("/types/") | d.endswith("types"), "type")
        .when(ends(".css", ".scss", ".less") | p.contains("/style") | holds(f, ["style", "theme"]), "style")
        .otherwise("generic")
    )


def archive_type(path: Column | str) -> Column:
    """Kind by the lower-case suffix; any .gz counts as tar.gz; null if unknown."""
    p = F.lower(col(path))
    return F.when(p.endswith(".zip"), "zip").when(p.endswith(".gz") | p.endswith(".tgz"), "tar.gz").when(p.endswith(".tar"), "tar").when(p.endswith(".7z"), "7z").when(p.endswith(".rar"), "rar")


def safe_path(path: Column | str) -> Column:
    """Without leading slashes and `..`, with single slashes, trimmed."""
    p = F.regexp_replace(F.regexp_replace(col(path), "^/+", ""), r"\.\.", "")
    return F.trim(F.regexp_replace(p, "/+", "/"))


def safe_directory(name: Column | str) -> Column:
    """Lower case; other characters than a-z, 0-9, - and _ become -, runs of - one, none at the ends."""
    n = F.regexp_replace(F.lower(col(name)), "[^a-z0-9_-]", "-")
    return F.regexp_replace(F.regexp_replace(n, "-+", "-"), "^-|-$", "")


def is_repository_url(url: Column | str) -> Column:
    """The host is github.com and the path has an owner and a name."""
    host = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return (F.lower(host) == "github.com") & (F.size(F.split(path, "/")) >= 3)


def file_size(n: Column | str) -> Column:
    """Bytes as text: two decimals at most, trailing zeros dropped."""
    b = col(n).cast("double")
    text = lambda v, unit: F.concat(F.regexp_replace(F.regexp_replace((F.floor(v * 100 + 0.5) / 100).cast("decimal(20,2)").cast("string"), "0+$", ""), r"\.$", ""), F.lit(" " + unit))
    return F.when(b == 0, "0 Bytes").when(b < 1024, text(b, "Bytes")).when(b < 1024**2, text(b / 1024, "KB")).when(b < 1024**3, text(b / 1024**2, "MB")).otherwise(text(b / 1024**3, "GB"))


def upload_allowed(name: Column | str, mime: Column | str | None = None) -> Column:
    """An archive by its name or its media type."""
    n = F.lower(col(name))
    by_name = any_of([n.endswith(x) for x in (".zip", ".tar", ".gz", ".tgz", ".7z")])
    if mime is None:
        return by_name
    return by_name | col(mime).isin("application/zip", "application/x-zip-compressed", "application/gzip", "application/x-gzip", "application/x-tar")


#: Symbols by the lower-case part after the last dot.
ICONS = {"ts": "⚡", "tsx": "⚛️", "js": "📜", "jsx": "⚛️", "py": "🐍", "java": "☕", "cpp": "⚙️", "css": "🎨", "html": "🌐", "json": "📋", "md": "📝"}


def file_icon(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ICONS.items() for x in p]), F.lower(F.substring_index(col(path), ".", -1))), F.lit("📄"))
