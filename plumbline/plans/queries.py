"""Queries of all operators over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed, grades, lexing, metrics, paths
from plumbline.operators import clusters, graph, kernels, quality, refactor, resolve, security, tenancy
from plumbline.operators.common import cut
from plumbline.plans import analyze as plans
from plumbline.sources import corpus, files as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P = "project"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six decimals: sums in another order may differ in the last places."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def arr(xs: list[str]) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


# SQL of the corpus, its languages and graphs.
STEM = f"({arr(corpus.DIRS)})[CAST(floor(doc_id / 8) AS BIGINT) % 8 + 1] || '/' || source || '_' || doc_id"
EXT = f"({arr(corpus.EXTS)})[doc_id % 8 + 1]"
LANG = "CASE doc_id % 8 WHEN 0 THEN 'javascript' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' WHEN 3 THEN 'java' WHEN 4 THEN 'cpp' WHEN 5 THEN 'generic' WHEN 6 THEN 'javascript' ELSE 'cpp' END"
FILES = f"files AS (SELECT doc_id, lang, {STEM} || {EXT} AS path, {LANG} AS language, text AS content FROM documents)"
PAGES = "pg AS (SELECT 'web/page_' || page_id || '.js' AS path, html AS content, 'javascript' AS language FROM pages)"
LINES = "list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S'))"
SUPPLIERS = "e AS (SELECT DISTINCT format('S{:06d}', a) AS src, format('S{:06d}', b) AS dst FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER w AS b, l_quantity AS qa, lead(l_quantity) OVER w AS qb FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) WHERE qa >= 45 AND qb >= 45), nd AS (SELECT format('S{:06d}', s_suppkey) AS node, s_nationkey AS community FROM supplier)"
TRADE = "t0 AS (SELECT c_nationkey c, s_nationkey s, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT format('N{:02d}', c) AS src, format('N{:02d}', s) AS dst FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, s) AS k FROM t0) WHERE k <= 3), nd AS (SELECT format('N{:02d}', n_nationkey) AS node FROM nation)"
DEG = "deg AS (SELECT node, count(*) FILTER (o = 0)::BIGINT AS fan_in, count(*) FILTER (o = 1)::BIGINT AS fan_out FROM (SELECT src AS node, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e UNION ALL SELECT node, NULL FROM nd) GROUP BY node)"
METRIC = "mt AS (SELECT format('S{:06d}', s_suppkey) AS node, s_nationkey AS community, floor(abs(s_acctbal))::BIGINT % 50 AS cyclomatic, floor(abs(s_acctbal))::BIGINT % 70 AS cognitive, (floor(abs(s_acctbal))::BIGINT % 4000)::DOUBLE AS halstead, (s_suppkey % 101)::DOUBLE AS mi, floor(abs(s_acctbal))::BIGINT % 7 AS nesting FROM supplier)"
WEIGHT = "(0.25 * cyclomatic + 0.30 * cognitive + 0.20 * halstead / 100 + 0.15 * (100 - mi) + 0.10 * (fan_in + fan_out))"
WALKS = "RECURSIVE_b(src, dst, d, n) AS (SELECT node, node, 0, 1.0::DOUBLE FROM nd UNION ALL SELECT b.src, e.dst, b.d + 1, sum(b.n) FROM b JOIN e ON b.dst = e.src AND e.src <> e.dst WHERE b.d < 12 GROUP BY b.src, e.dst, b.d)".replace("RECURSIVE_b", "b")
PATHS = "sp AS (SELECT src, dst, min(d) AS dist, arg_min(n, d) AS paths FROM b WHERE src <> dst GROUP BY src, dst)"


def by_language(make) -> str:
    return "CASE language " + " ".join(f"WHEN '{n}' THEN {make(n)}" for n in fixed.KEYWORDS if n != "generic") + f" ELSE {make('generic')} END"


def matches(words: list[str], text: str = "content") -> str:
    return f"len(regexp_extract_all({text}, '\\b(?:{'|'.join(words)})\\b'))"


def literal(op: str, text: str = "content") -> str:
    return f"((length({text}) - length(replace({text}, {lit(op)}, ''))) // {len(op)})"


CYCLO = f"(1 + {by_language(lambda n: matches(fixed.KEYWORDS[n]))} + {' + '.join(literal(w) for w in fixed.LOGICAL)})"
PYCYCLO = f"(1 + {matches(fixed.BASE_PYTHON_KEYWORDS)})"
OPS = by_language(lambda n: "[" + ", ".join(literal(o) for o in fixed.OPERATORS[n]) + "]")
OPERANDS = """regexp_extract_all(content, '\\b[a-zA-Z_$][a-zA-Z0-9_$]*\\b|\\b[0-9]+(?:\\.[0-9]+)?\\b|"[^"]*"|''[^'']*''')"""
HALSTEAD = f"h0 AS (SELECT *, {OPS} AS ops, {OPERANDS} AS opd FROM @src), h AS (SELECT *, len(list_filter(ops, lambda x: x > 0))::BIGINT AS n_1, list_sum(ops)::BIGINT AS total_1, len(list_distinct(opd))::BIGINT AS n_2, len(opd)::BIGINT AS total_2 FROM h0), v AS (SELECT *, CASE WHEN n_1 + n_2 = 0 THEN 0 ELSE (total_1 + total_2) * log2(n_1 + n_2) END AS volume FROM h)"
DEPTH = "list_reduce(list_prepend({'now': 0, 'most': 0, 'c': ''}, list_transform(string_split(regexp_replace(content, '[^{}()]+', '', 'g'), ''), lambda x: {'now': 0, 'most': 0, 'c': x})), lambda a, x: {'now': CASE WHEN x.c IN ('{', '(') THEN a.now + 1 WHEN x.c IN ('}', ')') THEN greatest(0, a.now - 1) ELSE a.now END, 'most': greatest(a.most, CASE WHEN x.c IN ('{', '(') THEN a.now + 1 ELSE 0 END), 'c': ''}).most::BIGINT"


def cognitive_sql(n: str) -> str:
    opened = f"a.nest + CASE WHEN regexp_matches(x.t, {lit(fixed.OPENERS[n])}) THEN 1 ELSE 0 END"
    nest = opened if n == "python" else f"greatest(0, {opened} - CASE WHEN regexp_matches(x.t, '^\\}}') THEN 1 ELSE 0 END)"
    lines = "list_transform(string_split(content, chr(10)), lambda y: {'nest': 0, 'total': 0, 't': regexp_replace(y, '^\\s+|\\s+$', '', 'g')})"
    kw = f"CASE WHEN regexp_matches(x.t, '\\b(?:{'|'.join(fixed.KEYWORDS[n])})\\b') THEN 1 + ({nest}) ELSE 0 END"
    return f"list_reduce(list_prepend({{'nest': 0, 'total': 0, 't': ''}}, {lines}), lambda a, x: {{'nest': {nest}, 'total': a.total + {kw}, 't': ''}}).total"


def docs(spark, d):
    return corpus.source_files(spark, d).withColumn("language", paths.language("path"))


# 1. Metrics of files.


@query(f"WITH {FILES}, x AS (SELECT path, language, string_split(content, chr(10)) AS ls FROM files), y AS (SELECT path, len(ls)::BIGINT AS loc, len(list_filter(ls, lambda x: regexp_matches(x, '\\S')))::BIGINT AS lloc, {by_language(lambda n: f'len(list_filter(ls, lambda x: regexp_matches(x, {lit(fixed.COMMENTS[n])})))')}::BIGINT AS comment_lines FROM x) SELECT *, round(comment_lines / greatest(1, lloc), 6) AS comment_density FROM y")
def file_line_metrics(spark, d):
    x = docs(spark, d).select("path", metrics.lines("content").alias("loc"), metrics.logical_lines("content").alias("lloc"), metrics.comment_lines("content", "language").alias("comment_lines"))
    return r6(x.withColumn("comment_density", F.col("comment_lines") / F.greatest(F.lit(1), F.col("lloc"))), "comment_density")


@query(f"WITH {FILES}, {PAGES} SELECT path, {CYCLO}::BIGINT AS cyclomatic FROM files UNION ALL SELECT path, {CYCLO}::BIGINT FROM pg")
def cyclomatic_adv(spark, d):
    f = docs(spark, d).select("path", "content", "language")
    g = corpus.page_files(spark, d).select("path", "content", F.lit("javascript").alias("language"))
    return f.unionByName(g).select("path", metrics.cyclomatic("content", "language").alias("cyclomatic"))


@query(f"WITH {FILES} SELECT path, {PYCYCLO}::BIGINT AS complexity FROM files")
def cyclomatic_base_py(spark, d):
    return docs(spark, d).select("path", metrics.cyclomatic_base_python("content").alias("complexity"))


@query(f"WITH {FILES} SELECT path, greatest(1, len({LINES}) // 10)::BIGINT AS complexity FROM files")
def complexity_base_generic(spark, d):
    return docs(spark, d).select("path", metrics.complexity_base_generic("content").alias("complexity"))


@query()
def complexity_base_js(spark, d):
    return corpus.page_files(spark, d).select("path", metrics.complexity_base_javascript("content").alias("complexity"))


@query(f"WITH {FILES}, {HALSTEAD.replace('@src', 'files')} SELECT path, n_1, total_1, n_2, total_2, round(volume, 6) AS volume FROM v")
def halstead(spark, d):
    x = docs(spark, d).withColumn("h", metrics.halstead_parts("content", "language"))
    return r6(x.select("path", *[F.col(f"h.{c}") for c in ("n_1", "total_1", "n_2", "total_2")], metrics.halstead_volume(F.col("h")).alias("volume")), "volume")


@query(f"WITH {PAGES} SELECT path, {DEPTH} AS nesting FROM pg")
def nesting_depth(spark, d):
    return corpus.page_files(spark, d).select("path", metrics.nesting_depth("content").alias("nesting"))


@query(f"WITH {PAGES}, {FILES} SELECT path, ({by_language(cognitive_sql)})::BIGINT AS cognitive FROM (SELECT path, content, language FROM pg UNION ALL SELECT path, content, language FROM files)")
def cognitive(spark, d):
    g = corpus.page_files(spark, d).select("path", "content", F.lit("javascript").alias("language"))
    return g.unionByName(docs(spark, d).select("path", "content", "language")).select("path", metrics.cognitive("content", "language").alias("cognitive"))


MI = "CASE WHEN volume > 0 AND lloc > 0 THEN greatest(0, least(100, 171 - 5.2 * ln(volume) - 0.23 * cyclomatic - 16.2 * ln(lloc))) ELSE 100 END"


@query(f"WITH {FILES}, {HALSTEAD.replace('@src', 'files')}, m AS (SELECT path, volume, {CYCLO} AS cyclomatic, len({LINES}) AS lloc FROM v) SELECT path, round({MI}, 6) AS mi FROM m")
def maintainability(spark, d):
    return r6(metrics.with_metrics(corpus.source_files(spark, d)).select("path", "mi"), "mi")


@query(f"WITH {FILES}, {HALSTEAD.replace('@src', 'files')}, m AS (SELECT path, doc_id, lang, language, volume, {CYCLO} AS cyclomatic, ({by_language(cognitive_sql)})::BIGINT AS cognitive, {DEPTH} AS nesting, len({LINES}) AS lloc FROM v), g AS (SELECT *, {MI} AS mi FROM m), s AS (SELECT *, round(0.25 * cyclomatic + 0.30 * cognitive + 0.25 * (100 - mi) + 0.40 * nesting, 6) AS score FROM g), k AS (SELECT *, CASE WHEN score < 10 THEN 'A' WHEN score < 20 THEN 'B' WHEN score < 35 THEN 'C' WHEN score < 50 THEN 'D' ELSE 'F' END AS grade FROM s) SELECT lang, grade, count(*) AS n_files, sum(cyclomatic)::BIGINT AS cyclomatic, round(avg(score), 6) AS avg_score, max(nesting) AS deepest FROM k GROUP BY lang, grade")
def grade_rollup(spark, d):
    """The smallest slice from end to end: texts, metrics, grade, rollup."""
    m = metrics.with_metrics(corpus.source_files(spark, d))
    score = F.round(0.25 * F.col("cyclomatic") + 0.30 * F.col("cognitive") + 0.25 * (100 - F.col("mi")) + 0.40 * F.col("nesting"), 6)
    g = m.withColumn("score", score).withColumn("grade", grades.complexity_grade("cyclomatic", "cognitive", "mi", "nesting"))
    return r6(g.groupBy("lang", "grade").agg(F.count(F.lit(1)).alias("n_files"), F.sum("cyclomatic").alias("cyclomatic"), F.avg("score").alias("avg_score"), F.max("nesting").alias("deepest")), "avg_score")


def weighted(spark, d):
    nodes, edges = corpus.supplier_nodes(spark, d), corpus.supplier_graph(spark, d)
    x = corpus.supplier_metrics(spark, d).join(graph.degrees(nodes, edges), [P, "node"])
    return x.withColumn("weight", metrics.weight(F.col("cyclomatic"), F.col("cognitive"), F.col("halstead"), F.col("mi"), F.col("cbo")))


WEIGHTED = f"{SUPPLIERS}, {DEG}, {METRIC}, wt AS (SELECT *, fan_in + fan_out AS cbo, {WEIGHT} AS weight FROM mt JOIN deg USING (node))"


@query(f"WITH {WEIGHTED} SELECT node, round(weight, 6) AS weight FROM wt")
def node_weight(spark, d):
    return r6(weighted(spark, d).select("node", "weight"), "weight")


@query(f"""WITH {WEIGHTED}, s AS (SELECT *, 0.25 * cyclomatic + 0.30 * cognitive + 0.25 * (100 - mi) + 0.40 * nesting AS a, cyclomatic + cognitive + 2 * cbo + (100 - mi) AS b FROM wt)
SELECT node, CASE WHEN a < 10 THEN 'A' WHEN a < 20 THEN 'B' WHEN a < 35 THEN 'C' WHEN a < 50 THEN 'D' ELSE 'F' END AS grade, CASE WHEN b < 20 THEN 'low' WHEN b < 50 THEN 'medium' WHEN b < 100 THEN 'high' ELSE 'critical' END AS risk,
CASE WHEN cyclomatic <= 5 THEN 'A' WHEN cyclomatic <= 10 THEN 'B' WHEN cyclomatic <= 20 THEN 'C' WHEN cyclomatic <= 35 THEN 'D' ELSE 'F' END AS base_grade, CASE WHEN cyclomatic <= 10 THEN 'low' WHEN cyclomatic <= 25 THEN 'medium' WHEN cyclomatic <= 50 THEN 'high' ELSE 'critical' END AS base_risk FROM s""")
def grades_risk(spark, d):
    return weighted(spark, d).select("node", grades.complexity_grade("cyclomatic", "cognitive", "mi", "nesting").alias("grade"), grades.risk_level("cyclomatic", "cognitive", "cbo", "mi").alias("risk"), grades.base_grade("cyclomatic").alias("base_grade"), grades.base_risk("cyclomatic").alias("base_risk"))


# 2. Paths, names, imports.

PATHS_SQL = f"""ps AS (SELECT path, lower(path) AS p, lower(regexp_extract(path, '[^/]*$')) AS f, lower(regexp_replace(path, '/[^/]*$', '')) AS d, regexp_extract(path, '[^/]*$') AS nm FROM (
SELECT path FROM (SELECT {STEM} || {EXT} AS path FROM documents) UNION ALL SELECT regexp_replace(path, '[^/]*$', 'Use' || regexp_extract(path, '[^/]*$')) FROM (SELECT {STEM} || {EXT} AS path FROM documents)))"""


def has(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


@query(f"""WITH {PATHS_SQL} SELECT path, CASE WHEN {has('p', ['test', 'spec'])} THEN 'test' WHEN {has('p', ['/api/', '/routes/', '/endpoints/'])} OR {has('f', ['route', 'endpoint', 'controller'])} THEN 'api'
WHEN regexp_matches(p, '\\.(tsx|jsx)$') AND (contains(p, '/component') OR nm[1] = upper(nm[1])) THEN 'component' WHEN {has('p', ['/page', '/view', '/screen'])} OR {has('d', ['pages', 'views', 'screens'])} THEN 'page'
WHEN starts_with(f, 'use') AND regexp_matches(p, '\\.(ts|tsx|js)$') THEN 'hook' WHEN {has('p', ['/util', '/helper', '/lib'])} OR {has('f', ['util', 'helper', 'common'])} THEN 'utility' WHEN {has('p', ['/service', '/client', '/adapter'])} OR {has('f', ['service', 'client', 'api'])} THEN 'service'
WHEN {has('p', ['/config', '.env'])} OR {has('f', ['config', 'setting', 'constant'])} THEN 'config' WHEN ends_with(p, '.d.ts') OR {has('f', ['type', 'interface'])} OR contains(p, '/types/') OR ends_with(d, 'types') THEN 'type'
WHEN regexp_matches(p, '\\.(css|scss|less)$') OR contains(p, '/style') OR {has('f', ['style', 'theme'])} THEN 'style' ELSE 'generic' END AS type FROM ps""")
def classify_files(spark, d):
    p = docs(spark, d).select("path")
    both = p.unionAll(p.select(F.concat(paths.dirname("path"), F.lit("/Use"), paths.basename("path"))))
    return both.select("path", paths.file_type("path").alias("type"))


@query(f"WITH {FILES} SELECT language, count(*) AS n, sum(length(content))::BIGINT AS chars FROM files GROUP BY language")
def language_dispatch(spark, d):
    return docs(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {FILES} SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '\\.[a-z]+$') AS ext, CASE regexp_extract(path, '\\.[a-z]+$') WHEN '.js' THEN '📜' WHEN '.ts' THEN '⚡' WHEN '.py' THEN '🐍' WHEN '.java' THEN '☕' WHEN '.cpp' THEN '⚙️' WHEN '.tsx' THEN '⚛️' ELSE '📄' END AS icon FROM files")
def path_parts(spark, d):
    return docs(spark, d).select("path", paths.basename("path").alias("base"), paths.dirname("path").alias("dir"), paths.extension("path").alias("ext"), paths.file_icon("path").alias("icon"))


@query("WITH n AS (SELECT doc_id, (['a.zip','B.TAR.GZ','c.tgz','d.tar','e.7z','f.rar','g.txt','h.GZ'])[doc_id % 8 + 1] AS name FROM documents) SELECT doc_id, name, CASE WHEN lower(name) LIKE '%.zip' THEN 'zip' WHEN lower(name) LIKE '%.gz' OR lower(name) LIKE '%.tgz' THEN 'tar.gz' WHEN lower(name) LIKE '%.tar' THEN 'tar' WHEN lower(name) LIKE '%.7z' THEN '7z' WHEN lower(name) LIKE '%.rar' THEN 'rar' END AS kind, regexp_matches(lower(name), '\\.(zip|tar|gz|tgz|7z)$') AS accepted FROM n")
def archive_type(spark, d):
    names = F.array(*map(F.lit, ["a.zip", "B.TAR.GZ", "c.tgz", "d.tar", "e.7z", "f.rar", "g.txt", "h.GZ"]))
    n = corpus.table(spark, d, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 8).cast("int")).alias("name"))
    return n.select("doc_id", "name", paths.archive_type("name").alias("kind"), paths.upload_allowed("name").alias("accepted"))


@query("WITH n AS (SELECT page_id, '//..//' || url || '//x/../y ' AS raw FROM pages) SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(raw, '^/+', ''), '\\.\\.', '', 'g'), '/+', '/', 'g')) AS safe, regexp_replace(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS dir FROM n")
def sanitize_path(spark, d):
    n = corpus.table(spark, d, "pages").select("page_id", F.concat(F.lit("//..//"), "url", F.lit("//x/../y ")).alias("raw"))
    return n.select("page_id", paths.safe_path("raw").alias("safe"), paths.safe_directory("raw").alias("dir"))


@query("WITH n AS (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 7) * (o_orderkey % 5) * (o_orderkey % 3))::BIGINT AS b FROM orders), v AS (SELECT *, CASE WHEN b < 1024 THEN b::DOUBLE WHEN b < 1048576 THEN b / 1024 WHEN b < 1073741824 THEN b / 1048576 ELSE b / 1073741824 END AS v, CASE WHEN b < 1024 THEN ' Bytes' WHEN b < 1048576 THEN ' KB' WHEN b < 1073741824 THEN ' MB' ELSE ' GB' END AS u FROM n) SELECT o_orderkey, regexp_replace(regexp_replace((floor(v * 100 + 0.5) / 100)::DECIMAL(20,2)::VARCHAR, '0+$', ''), '\\.$', '') || u AS size FROM v WHERE b > 0 UNION ALL SELECT o_orderkey, '0 Bytes' FROM v WHERE b = 0")
def format_size(spark, d):
    k = F.col("o_orderkey")
    n = corpus.table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * (k % 7) * (k % 5) * (k % 3)).cast("long").alias("b"))
    return n.select("o_orderkey", paths.file_size("b").alias("size"))


@query("WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://github.com/o/r' || page_id WHEN 1 THEN 'https://github.com' WHEN 2 THEN url ELSE 'http://GitHub.com/o/r.git?x=1' END AS url FROM pages) SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) = 'github.com' AND len(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')) >= 3 AS valid FROM u")
def github_url_check(spark, d):
    i = F.col("page_id") % 4
    u = corpus.table(spark, d, "pages").select("page_id", F.when(i == 0, F.concat(F.lit("https://github.com/o/r"), F.col("page_id").cast("string"))).when(i == 1, "https://github.com").when(i == 2, F.col("url")).otherwise("http://GitHub.com/o/r.git?x=1").alias("url"))
    return u.select("page_id", "url", paths.is_repository_url("url").alias("valid"))


@query(f"WITH {FILES} SELECT doc_id, regexp_matches(path, '\\.(js|ts|jsx|tsx|py|java|cpp|c)$') AND strlen(content) <= 1048576 AS base, strlen(content) <= 10485760 AS advanced, true AS security FROM files")
def discover_files(spark, d):
    f = corpus.source_files(spark, d)
    return f.select("doc_id", sources.eligible("base").alias("base"), sources.eligible("advanced").alias("advanced"), sources.eligible("security").alias("security"))


@query("SELECT 'corpus' AS project, count(*) AS n, CASE WHEN count(*) > 10000 THEN 'Too many files' END AS error, 'No entry point found' AS warning FROM documents")
def check_projects(spark, d):
    return sources.check_projects(corpus.source_files(spark, d))


@query("SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, ':\\s*\\w+(\\[\\])?', '', 'g'), 'interface\\s+\\w+\\s*\\{[^}]*\\}', '', 'g'), 'type\\s+\\w+\\s*=[^;]+;', '', 'g'), 'as\\s+\\w+', '', 'g'))::BIGINT AS chars FROM pages")
def strip_types(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", F.length(lexing.strip_types("html")).cast("long").alias("chars"))


def spelled(spark, d):
    """Files whose text spells the imports of the corpus in their language."""
    i = corpus.import_statements(spark, d)
    e = paths.extension("src")
    line = F.when(e == ".py", F.concat(F.lit("import "), "dep", F.lit(" as m\n"))).when(e.isin(".cpp", ".h"), F.concat(F.lit('#include "'), "dep", F.lit('"\n'))).when(e == ".java", F.concat(F.lit("import a.b"), F.col("ordinal").cast("string"), F.lit(".C;\n"))).otherwise(F.concat(F.when(F.col("ordinal") == 0, F.lit("import x from '")).otherwise(F.lit("require('")), "dep", F.when(F.col("ordinal") == 0, F.lit("';\n")).otherwise(F.lit("');\n"))))
    return i.groupBy(P, F.col("src").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "").alias("content"))


DEPS = f"""n AS (SELECT count(*) AS n FROM documents), ds AS (SELECT doc_id, {STEM} AS stem, {EXT} AS ext, (({arr(corpus.DIRS)})[CAST(floor(doc_id / 8) AS BIGINT) % 8 + 1]) AS dir FROM documents),
im AS (SELECT a.doc_id, a.stem || a.ext AS src, a.ext AS sext, ordinal, b.stem AS tstem, b.ext AS text, b.dir AS tdir, CASE a.doc_id % 3 WHEN 0 THEN up || b.stem WHEN 1 THEN up || b.stem || b.ext ELSE regexp_extract(b.stem, '[^/]*$') END AS dep
FROM (SELECT *, CASE WHEN contains(dir, '/') THEN '../../' ELSE '../' END AS up FROM ds) a, n, (SELECT unnest([0, 1]) AS ordinal) o, ds b WHERE b.doc_id = CASE ordinal WHEN 0 THEN (7 * a.doc_id + 1) % n.n ELSE (13 * a.doc_id + 5) % n.n END)"""


@query(f"WITH {DEPS} SELECT DISTINCT src, CASE WHEN sext = '.java' THEN 'a.b' || ordinal || '.C' ELSE dep END AS dep FROM im WHERE sext <> '.go'")
def import_extract(spark, d):
    return resolve.raw_imports(spelled(spark, d)).select("src", "dep")


@query(f"WITH {DEPS} SELECT src, dep, ordinal, CASE WHEN doc_id % 3 IN (1, 2) OR text NOT IN ('.go', '.h') OR NOT contains(tdir, '/') THEN tstem || text END AS dst FROM im")
def resolve_dependencies(spark, d):
    return resolve.resolve(corpus.import_statements(spark, d), corpus.source_files(spark, d).select(P, "path")).select("src", "dep", "ordinal", "dst")


@query(f"WITH {DEPS}, r AS (SELECT src, CASE WHEN doc_id % 3 = 1 OR text NOT IN ('.go', '.h', '.java', '.cpp') OR NOT contains(tdir, '/') THEN tstem || text END AS dst FROM im WHERE doc_id % 3 < 2) SELECT dst AS path, count(DISTINCT src) AS dependents, count(*) AS edges FROM r WHERE dst IS NOT NULL AND dst <> src GROUP BY dst")
def base_dependents(spark, d):
    """Reverse edges of the base analysis, multiplicity kept."""
    r = resolve.resolve(corpus.import_statements(spark, d), corpus.source_files(spark, d).select(P, "path"), "base")
    return resolve.edges(r, distinct=False).groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("dependents"), F.count(F.lit(1)).alias("edges"))


# 3. Security.

SCAN = "ls AS (SELECT path AS file, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM @src), iss AS (" + " UNION ALL ".join(f"SELECT file, line::INT AS line, {i} AS rule_id, {lit(s)} AS severity, {lit(m)} AS message, unnest(regexp_extract_all(t, {lit(('' if c else '(?i)') + p)})) AS pattern FROM ls" for i, p, c, s, m in fixed.SECURITY_RULES) + ")"


@query(f"WITH {FILES}, {SCAN.replace('@src', 'files')} SELECT * FROM iss")
def security_scan(spark, d):
    return security.scan(corpus.source_files(spark, d)).select("file", "line", "rule_id", "severity", "message", "pattern")


@query(f"WITH {PAGES}, {SCAN.replace('@src', 'pg')} SELECT count(*) AS n_issues, count(*) FILTER (severity = 'critical') AS n_critical, coalesce(string_agg(DISTINCT message, '; ' ORDER BY message) FILTER (severity = 'critical'), '') AS messages, count(*) FILTER (severity = 'critical') = 0 AS passes FROM iss HAVING count(*) > 0")
def security_gate(spark, d):
    return security.gate(security.scan(corpus.page_files(spark, d))).drop(P)


# 4. Graphs.


def sup(spark, d):
    return corpus.supplier_nodes(spark, d), cut(corpus.supplier_graph(spark, d))


def trade(spark, d):
    return corpus.trade_nodes(spark, d), cut(corpus.trade_graph(spark, d))


@query(f"WITH {SUPPLIERS}, {DEG} SELECT node, fan_in, fan_out, fan_in + fan_out AS cbo FROM deg")
def fan_in_out(spark, d):
    return graph.degrees(*sup(spark, d)).drop(P)


@query(f"WITH {SUPPLIERS}, {DEG} SELECT fan_in + fan_out AS degree, count(*) AS n FROM deg GROUP BY 1")
def degree_histogram(spark, d):
    return graph.degree_histogram(graph.degrees(*sup(spark, d))).drop(P)


LINKS = """e AS (SELECT DISTINCT 'page:' || page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


@query(f"WITH {LINKS}, {DEG}, hist AS (SELECT fan_in + fan_out AS degree, count(*) AS n FROM deg GROUP BY 1) SELECT round(CASE WHEN count(*) >= 3 THEN coalesce(abs(regr_slope(ln(n), ln(degree))), 0) ELSE 0 END, 6) AS exponent FROM hist WHERE degree > 0")
def scale_free(spark, d):
    e = corpus.page_links(spark, d)
    return r6(graph.scale_free(graph.degree_histogram(graph.degrees(graph.nodes_of(e), e))).drop(P), "exponent")


@query(f"WITH {SUPPLIERS} SELECT n, e, round(e / (n * (n - 1)), 6) AS density FROM (SELECT (SELECT count(*) FROM nd) AS n, (SELECT count(*) FROM e) AS e)")
def network_density(spark, d):
    return r6(graph.density(*sup(spark, d)).drop(P), "density")


TRIANGLES = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), nb AS (SELECT a AS node, b AS o FROM u UNION ALL SELECT b, a FROM u), k AS (SELECT node, count(*) AS k FROM nb GROUP BY node), tr AS (SELECT x.node, count(*) AS t FROM nb x JOIN nb y ON x.node = y.node AND x.o < y.o JOIN u ON u.a = x.o AND u.b = y.o GROUP BY x.node), cc AS (SELECT nd.node, CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1) / 2) ELSE 0 END AS coefficient FROM nd LEFT JOIN k USING (node) LEFT JOIN tr USING (node))"


@query(f"WITH {SUPPLIERS}, {TRIANGLES} SELECT node, round(coefficient, 6) AS coefficient FROM cc")
def clustering_coefficient(spark, d):
    return r6(graph.clustering_coefficient(*sup(spark, d)).drop(P), "coefficient")


def sup_paths(spark, d):
    n, e = sup(spark, d)
    return n, e, cut(graph.path_levels(n, e))


@query(f"WITH RECURSIVE {SUPPLIERS}, {WALKS}, {PATHS} SELECT dist::BIGINT AS dist, count(*) AS pairs, sum(paths)::BIGINT AS paths FROM sp GROUP BY dist")
def shortest_paths(spark, d):
    _, _, p = sup_paths(spark, d)
    return p.groupBy(F.col("dist").cast("long").alias("dist")).agg(F.sum("pairs").alias("pairs"), F.sum("paths").cast("long").alias("paths"))


@query(f"WITH RECURSIVE {SUPPLIERS}, {WALKS}, {PATHS} SELECT node, round(coalesce(c, 0), 6) AS closeness FROM nd LEFT JOIN (SELECT src, count(*) / sum(dist) AS c FROM sp GROUP BY src) ON src = node")
def closeness(spark, d):
    n, _, p = sup_paths(spark, d)
    return r6(graph.closeness(n, p).drop(P), "closeness")


@query(f"WITH RECURSIVE {SUPPLIERS}, {WALKS}, {PATHS}, {TRIANGLES}, a AS (SELECT coalesce(avg(dist), 0) AS l, count(*) AS reachable, coalesce(sum(1 / dist), 0) AS inv FROM sp), c AS (SELECT avg(coefficient) AS c, count(*) AS n FROM cc) SELECT round(c, 6) AS clustering, round(l, 6) AS average_path_length, round(CASE WHEN l > 0 THEN c / l ELSE 0 END, 6) AS small_world, reachable, round(inv / (n * (n - 1)), 6) AS efficiency FROM a, c")
def topology(spark, d):
    n, e, p = sup_paths(spark, d)
    x = graph.small_world(n, e, p).join(graph.average_path_length(n, p).select(P, "reachable"), P).join(graph.efficiency(n, p), P)
    return r6(x.drop(P), "clustering", "average_path_length", "small_world", "efficiency")


BETWEEN = "bt AS (SELECT x.dst AS node, sum(x.paths * y.paths / z.paths) AS raw FROM sp x JOIN sp y ON x.dst = y.src JOIN sp z ON z.src = x.src AND z.dst = y.dst AND z.dist = x.dist + y.dist GROUP BY x.dst), bw AS (SELECT nd.node, coalesce(raw, 0) / (((SELECT count(*) FROM nd) - 1) * ((SELECT count(*) FROM nd) - 2) / 2) AS betweenness FROM nd LEFT JOIN bt USING (node))"


@query(f"WITH RECURSIVE {SUPPLIERS}, {WALKS}, {PATHS}, {BETWEEN} SELECT node, round(betweenness, 6) AS betweenness FROM bw")
def betweenness(spark, d):
    return r6(graph.betweenness(*sup(spark, d)).drop(P), "betweenness")


@query(f"WITH RECURSIVE {WEIGHTED}, {WALKS}, {PATHS}, {BETWEEN} SELECT node, round(least(100, 0.4 * weight + 15 * betweenness + 0.3 * cbo), 6) AS priority, betweenness > 0.1 OR weight > 50 AS important FROM wt JOIN bw USING (node)")
def refactor_priority(spark, d):
    x = weighted(spark, d).join(graph.betweenness(*sup(spark, d)), [P, "node"])
    return r6(x.select("node", grades.refactoring_priority("weight", "betweenness", "cbo").alias("priority"), ((F.col("betweenness") > 0.1) | (F.col("weight") > 50)).alias("important")), "priority")


ROUNDS = 20


def pagerank_sql(uniform: bool) -> str:
    steps = []
    for i in range(ROUNDS):
        loose = f" + (SELECT coalesce(sum(pr), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM e)) / n" if uniform else ""
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT nd.node, 0.15 / n + 0.85 * (coalesce(g, 0){loose}) AS pr FROM nd CROSS JOIN cn LEFT JOIN (SELECT e.dst, sum(pr / o) AS g FROM e JOIN od ON od.src = e.src JOIN r{i} ON r{i}.node = e.src GROUP BY e.dst) ON dst = nd.node)")
    return f"WITH {TRADE}, cn AS (SELECT count(*)::DOUBLE AS n FROM nd), od AS (SELECT src, count(*) AS o FROM e GROUP BY src), r0 AS MATERIALIZED (SELECT node, 1 / n AS pr FROM nd, cn), {', '.join(steps)} SELECT node, round(pr, 6) AS pagerank FROM r{ROUNDS}"


@query(pagerank_sql(False).replace(TRADE, SUPPLIERS))
def pagerank_drop(spark, d):
    return r6(graph.pagerank(*sup(spark, d), dangling="drop", iterations=ROUNDS).drop(P), "pagerank")


@query(pagerank_sql(True))
def pagerank_uniform(spark, d):
    return r6(graph.pagerank(*trade(spark, d), iterations=ROUNDS).drop(P), "pagerank")


@query(pagerank_sql(True).replace(TRADE, LINKS))
def pagerank_links(spark, d):
    """Pages and link targets: the targets have no links of their own."""
    e = cut(corpus.page_links(spark, d))
    return r6(graph.pagerank(graph.nodes_of(e), e, iterations=ROUNDS).drop(P), "pagerank")


EIGEN = ", ".join(f"y{i} AS MATERIALIZED (SELECT node, x{i - 1}.x + coalesce(g, 0) AS x FROM x{i - 1} LEFT JOIN (SELECT e.src, sum(x) AS g FROM e JOIN x{i - 1} ON node = e.dst GROUP BY e.src) ON src = node), x{i} AS MATERIALIZED (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})" for i in range(1, ROUNDS + 1))


@query(f"WITH {SUPPLIERS}, x0 AS (SELECT node, 1.0::DOUBLE AS x FROM nd), {EIGEN} SELECT node, round(x, 6) AS eigenvector FROM x{ROUNDS}")
def eigenvector(spark, d):
    return r6(graph.eigenvector(*sup(spark, d), iterations=ROUNDS).drop(P), "eigenvector")


@query(f"WITH {SUPPLIERS}, nb AS (SELECT src AS node, dst AS o FROM e UNION SELECT dst, src FROM e) SELECT node, count(*) AS n_neighbours, count(*) FILTER (o = node) AS loops, min(o) AS first FROM nb GROUP BY node")
def neighbours(spark, d):
    _, e = sup(spark, d)
    return graph.neighbours(e).groupBy("node").agg(F.count(F.lit(1)).alias("n_neighbours"), F.count_if(F.col("other") == F.col("node")).alias("loops"), F.min("other").alias("first"))


# 5. Communities and their quality.

MOD = "ee AS (SELECT e.*, a.community AS ca, b.community AS cb FROM e JOIN nd a ON a.node = src JOIN nd b ON b.node = dst), q AS (SELECT coalesce(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 0) AS modularity FROM (SELECT ca, count(*)::DOUBLE AS k, count(*) FILTER (ca = cb)::DOUBLE AS i FROM ee GROUP BY ca))"


@query(f"WITH {SUPPLIERS}, {MOD} SELECT round(modularity, 6) AS modularity FROM q")
def modularity(spark, d):
    _, e = sup(spark, d)
    return r6(graph.modularity(e, corpus.supplier_membership(spark, d)).drop(P), "modularity")


CQ = f"""{MOD}, sz AS (SELECT community, count(*) AS size FROM nd GROUP BY community), tot AS (SELECT (SELECT count(*) FROM nd) AS n, (SELECT count(*) FROM e)::DOUBLE AS e), en AS (SELECT c AS community, count(*) AS ends, count(*) FILTER (NOT own) AS outer_, count(*) FILTER (own AND f) AS inner_ FROM (SELECT ca AS c, ca = cb AS own, true AS f FROM ee UNION ALL SELECT cb, ca = cb, false FROM ee) GROUP BY c),
pr AS (SELECT community, count(*) AS pairs FROM (SELECT DISTINCT ca AS community, least(src, dst), greatest(src, dst) FROM ee WHERE ca = cb AND src <> dst) GROUP BY community),
cq0 AS (SELECT community, size, n, e, coalesce(ends, 0) AS ends, coalesce(outer_, 0) AS o, coalesce(inner_, 0) AS i, coalesce(pairs, 0) AS pairs FROM sz LEFT JOIN en USING (community) LEFT JOIN pr USING (community), tot),
cq AS (SELECT community, size, CASE WHEN size > 1 THEN pairs / (size * (size - 1) / 2) ELSE 0 END AS cohesion, CASE WHEN ends > 0 THEN o / ends ELSE 0 END AS coupling, (i - (ends / (2 * e)) * (ends / (2 * e)) * e) / e AS modularity, CASE WHEN size > 1 THEN i / (size * (size - 1)) ELSE 0 END AS internal_density, CASE WHEN n > size THEN o / (size * (n - size)) ELSE 0 END AS external_density, CASE WHEN ends > 0 THEN o / ends ELSE 0 END AS conductance FROM cq0)"""
CQ_COLS = ["cohesion", "coupling", "modularity", "internal_density", "external_density", "conductance"]


@query(f"WITH {SUPPLIERS}, {CQ} SELECT community, size, {', '.join(f'round({c}, 6) AS {c}' for c in CQ_COLS)} FROM cq")
def cluster_quality(spark, d):
    _, e = sup(spark, d)
    return r6(clusters.cluster_quality(corpus.supplier_membership(spark, d), e).drop(P), *CQ_COLS)


SIL = "pd AS (SELECT a.node, a.community AS c, b.community AS o, a.node = b.node AS self, sqrt(((a.cyclomatic - b.cyclomatic) / 50) ** 2 + ((a.cognitive - b.cognitive) / 50) ** 2 + ((a.halstead - b.halstead) / 1000) ** 2 + ((a.mi - b.mi) / 100) ** 2 + ((a.nesting - b.nesting) / 10) ** 2) AS d FROM mt a, mt b), sn AS (SELECT node, c, coalesce(avg(d) FILTER (c = o AND NOT self), 0) AS a, coalesce(min(d) FILTER (c <> o), 0) AS b FROM pd GROUP BY node, c), sil AS (SELECT c AS community, avg(CASE WHEN b > a THEN (b - a) / b ELSE 0 END) AS silhouette FROM sn GROUP BY c)"


@query(f"WITH {METRIC}, {SIL} SELECT community, round(silhouette, 6) AS silhouette FROM sil")
def silhouette(spark, d):
    return r6(clusters.silhouette(corpus.supplier_membership(spark, d), corpus.supplier_metrics(spark, d)).drop(P), "silhouette")


@query(f"""WITH {SUPPLIERS}, {METRIC}, {CQ}, {SIL}, x AS (SELECT *, 30 * cohesion + 30 * (1 - coupling) + 20 * modularity + 20 * silhouette AS s FROM cq JOIN sil USING (community)) SELECT community, CASE WHEN s > 80 THEN 'A' WHEN s > 65 THEN 'B' WHEN s > 50 THEN 'C' WHEN s > 35 THEN 'D' ELSE 'F' END AS grade, array_to_string(list_filter([
CASE WHEN cohesion < 0.3 THEN 'Low cohesion detected - consider splitting this cluster' END, CASE WHEN coupling > 0.7 THEN 'High coupling detected - review external dependencies' END, CASE WHEN modularity < 0.2 THEN 'Poor modularity - consider reorganizing cluster boundaries' END,
CASE WHEN conductance > 0.8 THEN 'High conductance - cluster may be poorly separated' END, CASE WHEN size > 15 THEN 'Large cluster - consider sub-clustering for better maintainability' END, CASE WHEN size < 3 THEN 'Small cluster - consider merging with related clusters' END], lambda r: r IS NOT NULL), '|') AS recommendations FROM x""")
def cluster_grades(spark, d):
    _, e = sup(spark, d)
    m = corpus.supplier_membership(spark, d)
    x = clusters.cluster_quality(m, e).join(clusters.silhouette(m, corpus.supplier_metrics(spark, d)), [P, "community"])
    return x.select("community", grades.cluster_grade("cohesion", "coupling", "modularity", "silhouette").alias("grade"), F.array_join(grades.cluster_recommendations("cohesion", "coupling", "modularity", "conductance", "size"), "|").alias("recommendations"))


@query(f"WITH {WEIGHTED}, f AS (SELECT node, community, 0.25 * cyclomatic + 0.30 * cognitive + 0.25 * (100 - mi) + 0.40 * nesting AS a FROM wt) SELECT community, count(*) || ' files need complexity reduction' AS description, string_agg(node, ',' ORDER BY node) AS files FROM f WHERE a >= 50 GROUP BY community")
def refactor_opportunities(spark, d):
    g = weighted(spark, d).withColumn("grade", grades.complexity_grade("cyclomatic", "cognitive", "mi", "nesting"))
    return quality.opportunities(corpus.supplier_membership(spark, d), g).select("community", "description", F.array_join("files", ",").alias("files"))


def partitions(spark, d, *algos):
    _, e = sup(spark, d)
    return kernels.communities(corpus.supplier_metrics(spark, d), e, algos)


@query()
def louvain(spark, d):
    return partitions(spark, d, "louvain").drop(P)


@query()
def spectral(spark, d):
    return partitions(spark, d, "spectral").drop(P)


@query()
def greedy_modularity(spark, d):
    _, e = trade(spark, d)
    m = corpus.trade_nodes(spark, d).withColumns({c: F.lit(0.0) for c in kernels.METRICS})
    return kernels.communities(m, e, ("greedy",)).drop(P)


@query()
def agglomerative(spark, d):
    _, e = trade(spark, d)
    k = F.substring("node", 2, 2).cast("double")
    m = corpus.trade_nodes(spark, d).withColumns({c: (k * i) % 17 for i, c in enumerate(kernels.METRICS, 3)})
    return kernels.communities(m, e, ("fallback",)).drop(P)


@query()
def select_best(spark, d):
    n, e = trade(spark, d)
    k = F.substring("node", 2, 2).cast("double")
    m = cut(n.withColumns({c: (k * i) % 17 for i, c in enumerate(kernels.METRICS, 3)}))
    p = cut(kernels.communities(m, e))
    rated = None
    for algo in ("louvain", "spectral", "greedy"):
        own = p.where(F.col("algo") == algo)
        q = clusters.cluster_quality(own, e).join(clusters.silhouette(own, m), [P, "community"]).withColumn("algo", F.lit(algo))
        rated = q if rated is None else rated.unionByName(q)
    return r6(clusters.best_partition(rated).drop(P), "score")


# 6. Projects: statistics, scores, advice.

STATS = "st AS (SELECT sum(weight) AS total, avg(weight) AS mean, var_pop(weight) AS var, count(*) AS n FROM wt), hi AS (SELECT count(*) FILTER (weight > 2 * mean) / max(n) AS share FROM wt, st)"


@query(f"WITH {WEIGHTED}, {STATS} SELECT round(total, 6) AS total_complexity, round(mean, 6) AS average_complexity, round(var, 6) AS complexity_variance, round(share, 6) AS high_share FROM st, hi")
def global_metrics(spark, d):
    return r6(quality.weight_statistics(weighted(spark, d)).select("total_complexity", "average_complexity", "complexity_variance", "high_share"), "total_complexity", "average_complexity", "complexity_variance", "high_share")


QM = f"""{STATS}, {CQ}, {TRIANGLES}, tp AS (SELECT q.modularity, (SELECT avg(coefficient) FROM cc) AS clustering, tot.e / (tot.n * (tot.n - 1)) AS density, (SELECT avg(coupling) FROM cq) AS coupling FROM q, tot),
s1 AS (SELECT *, 50 * modularity + 30 * clustering + 20 * (1 - density) AS health FROM tp, st, hi), s2 AS (SELECT *, greatest(0, least(100, 100 * health)) AS sh, greatest(0, least(100, health)) AS shs, greatest(0, least(100, 100 - 2 * mean - 50 * coupling)) AS ms, greatest(0, least(100, 10 * sqrt(var) + 100 * share)) AS er FROM s1)"""


@query(f"WITH {WEIGHTED}, {QM} SELECT round(sh, 6) AS structural_health, round(shs, 6) AS structural_health_scaled, round(ms, 6) AS maintainability_score, round(er, 6) AS evolutionary_risk, round(greatest(0, least(100, 0.4 * er + 0.4 * (100 - ms) + 0.2 * (100 - sh))), 6) AS technical_debt FROM s2")
def quality_metrics(spark, d):
    cols = ["structural_health", "structural_health_scaled", "maintainability_score", "evolutionary_risk", "technical_debt"]
    return r6(project_scores(spark, d).select(*cols), *cols)


def project_scores(spark, d):
    n, e = sup(spark, d)
    m = corpus.supplier_membership(spark, d)
    t = graph.modularity(e, m).join(graph.clustering_coefficient(n, e).groupBy(P).agg(F.avg("coefficient").alias("clustering")), P).join(graph.density(n, e).select(P, "density"), P)
    return quality.quality_metrics(quality.weight_statistics(weighted(spark, d)), t, clusters.cluster_quality(m, e).groupBy(P).agg(F.avg("coupling").alias("avg_coupling")))


@query(f"""WITH {WEIGHTED}, {QM} SELECT array_to_string(list_filter([CASE WHEN modularity < 0.3 THEN '🏗️ Architecture: Poor modularity detected. Consider restructuring into more cohesive modules.' END, CASE WHEN mean > 30 THEN '⚡ Complexity: High average complexity. Prioritize refactoring the most complex components.' END, CASE WHEN density > 0.3 THEN '🔗 Coupling: High network density indicates tight coupling. Consider introducing abstractions.' END], lambda r: r IS NOT NULL), '|') AS recommendations,
array_to_string(list_filter([CASE WHEN modularity > 0.6 THEN 'Good modularity score' END, CASE WHEN mean > 20 THEN 'High average complexity' END, CASE WHEN density > 0.4 THEN 'High coupling detected' END], lambda r: r IS NOT NULL), '|') AS insights FROM s2""")
def recommendations(spark, d):
    x = project_scores(spark, d)
    return x.select(F.array_join(grades.project_recommendations("modularity", "average_complexity", "density"), "|").alias("recommendations"), F.array_join(grades.insights("modularity", "average_complexity", "density"), "|").alias("insights"))


# Files of the corpus with a plain complexity, in directories as clusters.
DIRF = f"df AS (SELECT doc_id, lang, {STEM} || {EXT} AS path, ({arr(corpus.DIRS)})[CAST(floor(doc_id / 8) AS BIGINT) % 8 + 1] AS dir, greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) // 10)::BIGINT + doc_id % 40 AS complexity, len(string_split(text, chr(10)))::BIGINT AS loc FROM documents)"


def plain_files(spark, d):
    f = corpus.source_files(spark, d)
    return f.select(P, "path", "lang", "doc_id", paths.dirname("path").alias("dir"), (metrics.complexity_base_generic("content") + F.col("doc_id") % 40).alias("complexity"), metrics.lines("content").alias("loc"))


def dir_clusters(spark, d):
    return plain_files(spark, d).groupBy(P, F.col("dir").alias("cluster_key")).agg(F.sort_array(F.collect_list("path")).alias("files"), F.avg("complexity").alias("avg_complexity"), F.sum("loc").alias("total_loc"), F.count(F.lit(1)).alias("size"))


@query(f"WITH {DIRF} SELECT count(*) AS total_files, count(DISTINCT dir) AS total_clusters, round(avg(complexity), 6) AS avg_complexity, sum(complexity)::BIGINT AS total_complexity, sum(loc)::BIGINT AS total_loc FROM df")
def project_metadata(spark, d):
    return r6(quality.metadata(plain_files(spark, d), dir_clusters(spark, d)).select("total_files", "total_clusters", "avg_complexity", "total_complexity", "total_loc"), "avg_complexity")


@query(f"""WITH {DIRF}, x AS (SELECT dir, count(*) AS size, avg(complexity) AS a, sum(loc)::BIGINT AS total_loc, (count(*) * 2 - 60)::BIGINT AS connections FROM df GROUP BY dir), p AS (SELECT *, 100 - CASE WHEN a > 30 THEN 30 WHEN a > 20 THEN 15 WHEN a > 10 THEN 5 ELSE 0 END - CASE WHEN size > 15 THEN 20 WHEN size > 10 THEN 10 ELSE 0 END - CASE WHEN connections > 2 * size THEN 20 WHEN connections > size THEN 10 ELSE 0 END AS q FROM x)
SELECT dir AS cluster_key, size, round(a, 6) AS avg_complexity, total_loc, CASE WHEN q >= 85 THEN 'A' WHEN q >= 70 THEN 'B' WHEN q >= 55 THEN 'C' WHEN q >= 40 THEN 'D' ELSE 'F' END AS quality, CASE WHEN a <= 5 THEN 'low' WHEN a <= 15 THEN 'medium' ELSE 'high' END AS level FROM p""")
def cluster_rollup(spark, d):
    x = dir_clusters(spark, d).withColumn("connections", F.col("size") * 2 - 60)
    return r6(x.select("cluster_key", "size", "avg_complexity", "total_loc", grades.cluster_quality("avg_complexity", "size", "connections").alias("quality"), grades.complexity_level("avg_complexity").alias("level")), "avg_complexity")


@query(f"WITH {DIRF} SELECT CASE WHEN complexity <= 10 THEN 'low' WHEN complexity <= 25 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM df), 6) AS percent FROM df GROUP BY 1")
def complexity_buckets(spark, d):
    return r6(quality.complexity_buckets(plain_files(spark, d)).drop(P), "percent")


@query(f"WITH {DIRF} SELECT path, complexity, row_number() OVER (ORDER BY complexity DESC, path) AS rank FROM df QUALIFY rank <= 10")
def top_hotspots(spark, d):
    return quality.top_files(plain_files(spark, d), 10).drop(P)


@query(f"WITH {DIRF}, m AS (SELECT lang, avg(complexity) AS a, count(*) AS n FROM df GROUP BY lang) SELECT lang, floor(100 * (1 - a / 50) + 0.5)::BIGINT AS health, CASE WHEN a <= 10 THEN 'A' WHEN a <= 20 THEN 'B' WHEN a <= 35 THEN 'C' WHEN a <= 50 THEN 'D' ELSE 'F' END AS letter, CASE WHEN a > 15 THEN 'Needs attention' ELSE 'Good' END AS status, CASE WHEN a <= 15 THEN 'Excellent' WHEN a <= 25 THEN 'Good' ELSE 'Needs Work' END AS maintainability FROM m")
def ui_health(spark, d):
    m = plain_files(spark, d).groupBy("lang").agg(F.avg("complexity").alias("a"))
    return m.select("lang", *[c.alias(n) for n, c in grades.ui_health("a").items()])


@query(f"""WITH {DIRF}, m AS (SELECT lang, avg(complexity) AS a, count(*) AS n, count(DISTINCT dir) % 4 AS k FROM df GROUP BY lang) SELECT lang, floor(0.5 * greatest(0, 100 - 2 * a) + 0.2 * CASE WHEN n > 100 THEN 80 ELSE 100 END + 0.3 * CASE WHEN k > 0 THEN 80 ELSE 40 END + 0.5)::BIGINT AS overall_score, CASE WHEN a <= 5 THEN 'A' WHEN a <= 10 THEN 'B' WHEN a <= 20 THEN 'C' WHEN a <= 35 THEN 'D' ELSE 'F' END AS complexity_grade, round(greatest(0, least(100, 100 - 2 * a)), 6) AS maintainability_score,
CASE WHEN a > 50 THEN 'critical' WHEN a > 30 THEN 'high' WHEN a > 15 THEN 'medium' ELSE 'low' END AS security_risk, floor(a * n / 10 + 0.5)::BIGINT AS technical_debt, array_to_string(list_filter([CASE WHEN a > 20 THEN 'Consider refactoring files with high complexity scores' END, CASE WHEN n > 100 THEN 'Large codebase - consider modularization strategies' END, CASE WHEN k < 3 THEN 'Code organization could benefit from better separation of concerns' END], lambda r: r IS NOT NULL), '|') AS recommendations FROM m""")
def saved_scores(spark, d):
    m = plain_files(spark, d).groupBy("lang").agg(F.avg("complexity").alias("a"), F.count(F.lit(1)).alias("n"), (F.count_distinct("dir") % 4).alias("k"))
    return r6(m.select("lang", *[c.alias(n) for n, c in grades.saved_scores("a", "n", "k").items()], F.array_join(grades.saved_recommendations("a", "n", "k"), "|").alias("recommendations")), "maintainability_score")


@query(f"WITH {DIRF}, s AS (SELECT dir, count(*) AS size FROM df GROUP BY dir) SELECT round(least(1, least(count(*) / 10, 0.8) + greatest(0, 0.3 - var_pop(size) / 100)), 6) AS modularity FROM s")
def heuristic_modularity(spark, d):
    return r6(quality.heuristic_modularity(dir_clusters(spark, d)).drop(P), "modularity")


def ctx_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN len(list_filter({col}, lambda f: {has('lower(f)', w)})) >= ceil(len({col}) * 0.6) THEN {lit(n)}" for n, w in fixed.CONTEXTS) + " END"


@query(f"""WITH {DIRF}, t AS (SELECT dir, doc_id % 3 AS k, (['component', 'api', 'test', 'utility', 'config', 'page', 'service', 'type'])[CAST(floor(min(doc_id) / 8) AS BIGINT) % 8 + 1] AS type, list(CASE WHEN doc_id % 3 = 1 THEN dir || '/user_' || doc_id ELSE path END ORDER BY path) AS fs, avg(complexity) - (doc_id % 3) * 9 AS a FROM df GROUP BY dir, doc_id % 3), c AS (SELECT *, {ctx_sql('fs')} AS ctx FROM t)
SELECT dir, k::BIGINT AS k, CASE WHEN a > 25 THEN 'Complex ' WHEN a < 5 THEN 'Simple ' ELSE '' END || coalesce(ctx || ' ', '') || CASE type {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in fixed.CLUSTER_LABELS.items())} END || CASE WHEN k > 0 THEN ' ' || (k + 1) ELSE '' END AS id, CASE type {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in fixed.PURPOSES.items())} END AS purpose FROM c""")
def cluster_naming(spark, d):
    kinds = F.array(*map(F.lit, ["component", "api", "test", "utility", "config", "page", "service", "type"]))
    k = F.col("doc_id") % 3
    named = F.when(k == 1, F.concat(F.col("dir"), F.lit("/user_"), F.col("doc_id").cast("string"))).otherwise(F.col("path"))
    t = plain_files(spark, d).groupBy("dir", k.alias("k")).agg(F.get(kinds, (F.floor(F.min("doc_id") / 8) % 8).cast("int")).alias("type"), F.transform(F.sort_array(F.collect_list(F.struct("path", named.alias("n")))), lambda x: x["n"]).alias("fs"), F.avg("complexity").alias("m")).withColumn("a", F.col("m") - F.col("k") * 9)
    return t.select("dir", "k", clusters.cluster_name(F.col("type"), F.col("a"), F.col("k"), clusters.cluster_context(F.col("fs"))).alias("id"), clusters.cluster_purpose(F.col("type")).alias("purpose"))


UI_SCORES = "[" + ", ".join(f"{{'s': list_sum([0] || list_transform(fs, lambda f: {' + '.join(f'contains(lower(f), {lit(w)})::INT' for w in ws)})), 'o': {-i}, 'n': {lit(n)}}}" for i, (n, ws) in enumerate(fixed.UI_NAMES)) + "]"


@query(f"WITH {DIRF}, c AS (SELECT dir, list(path) AS fs, avg(complexity) AS a FROM df GROUP BY dir), s AS (SELECT *, list_max({UI_SCORES}) AS m FROM c) SELECT dir AS cluster_key, CASE WHEN a > 20 THEN 'Complex ' ELSE '' END || CASE WHEN m.s > 0 THEN m.n ELSE 'Module Group 1' END AS ui_name FROM s")
def ui_cluster_names(spark, d):
    return clusters.ui_name(dir_clusters(spark, d).withColumn("ordinal", F.lit(0))).drop(P)


@query(f"WITH {DIRF}, g AS (SELECT path, CASE WHEN NOT contains(dir, '/') THEN dir ELSE regexp_replace(dir, '/[^/]*$', '') END AS g FROM df), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, (row_number() OVER (PARTITION BY g ORDER BY path) - 1) // 12 AS c FROM g) SELECT path, regexp_extract(g, '[^/]*$') || ' Modules' || CASE WHEN n > 12 THEN ' ' || (c + 1) ELSE '' END AS id FROM n")
def directory_clusters(spark, d):
    return clusters.directory_clusters(plain_files(spark, d)).drop(P)


@query()
def bounded_bfs(spark, d):
    """Types of more than twelve files, split along resolved imports."""
    f = corpus.source_files(spark, d).select(P, "path", paths.file_type("path").alias("type"))
    e = resolve.edges(resolve.resolve(corpus.import_statements(spark, d), f, "base"), distinct=False)
    return clusters.type_clusters(f, e).drop(P)


@query()
def describe_clusters(spark, d):
    f = cut(plain_files(spark, d).withColumn("type", paths.file_type("path")))
    e = cut(resolve.edges(resolve.resolve(corpus.import_statements(spark, d), f.select(P, "path"), "base"), distinct=False))
    out = clusters.describe_clusters(clusters.type_clusters(f.select(P, "path", "type"), e), f, e)
    return out.select("cluster_key", "id", "purpose", "size", F.round("avg_complexity", 6).alias("avg_complexity"), "total_loc", "connections")


# 7. Refactor plans.

RP = "CASE " + " ".join(f"WHEN len(list_filter(fs, lambda f: {has('lower(f)', w)})) > 0 THEN {lit(n)}" for n, w, _ in fixed.REFACTOR_PURPOSES) + " ELSE 'general functionality' END"
PLAN = f"{DIRF}, c AS (SELECT dir, list(path ORDER BY path) AS fs, avg(complexity) AS a FROM df GROUP BY dir), s AS (SELECT *, {RP} AS purpose, CASE WHEN a <= 5 THEN 'low' WHEN a <= 15 THEN 'medium' ELSE 'high' END AS level FROM c), st AS (SELECT *, CASE level WHEN 'low' THEN 'simple-' WHEN 'high' THEN 'complex-' ELSE 'standard-' END || CASE purpose {' '.join(f'WHEN {lit(n)} THEN {lit(x)}' for n, _, x in fixed.REFACTOR_PURPOSES)} ELSE 'modules' END AS target FROM s)"


@query(f"WITH {PLAN} SELECT dir AS cluster_key, purpose, level AS complexity, target AS directory, len(fs)::BIGINT AS n_files FROM st")
def refactor_plan(spark, d):
    return refactor.structures(dir_clusters(spark, d)).select("cluster_key", "purpose", "complexity", "directory", F.size("files").cast("long").alias("n_files"))


@query(f"WITH {PLAN}, m AS (SELECT dir, unnest(fs) AS f, target, purpose, level FROM st), t AS (SELECT dir, f, target || '/' || regexp_extract(f, '[^/]*$') AS t, 'Grouped with ' || purpose || ' files (' || level || ' complexity)' AS reason FROM m) SELECT f AS \"from\", t AS \"to\", reason, count(*) OVER (PARTITION BY t) > 1 AS collision FROM t")
def refactor_moves(spark, d):
    return refactor.moves(refactor.structures(dir_clusters(spark, d))).select("from", "to", "reason", "collision")


@query(f"""WITH {PLAN}, a AS (SELECT count(*)::DOUBLE AS k, count(DISTINCT purpose) AS p, count(DISTINCT target) AS n_directories, count(*) FILTER (level = 'low') AS l, count(*) FILTER (level = 'medium') AS m, count(*) FILTER (level = 'high') AS h, avg(len(fs)) AS mean, stddev_pop(len(fs)) AS sd, sum(len(fs))::BIGINT AS total_moves FROM st),
b AS (SELECT *, p / k AS variety, greatest(0, 1 - ((l - k / 3) ** 2 + (m - k / 3) ** 2 + (h - k / 3) ** 2) / 3 / (k / 3) ** 2) AS cb, greatest(0, 1 - sd / mean) AS sb FROM a) SELECT n_directories, round(variety, 6) AS variety, round(cb, 6) AS complexity_balance, round(sb, 6) AS size_balance, floor(10 * (0.4 * variety + 0.3 * cb + 0.3 * sb) + 0.5)::BIGINT AS estimated_improvement FROM b""")
def refactor_improvement(spark, d):
    return r6(refactor.improvement(refactor.structures(dir_clusters(spark, d))).drop(P), "variety", "complexity_balance", "size_balance")


@query(f"WITH {PLAN}, f AS (SELECT target, min(dir) AS seen, sum(len(fs)) AS n FROM st GROUP BY target) SELECT sum(n)::BIGINT AS total_moves, string_agg(target, ',' ORDER BY seen) AS directories FROM f")
def refactor_summary(spark, d):
    x = refactor.summary(refactor.structures(dir_clusters(spark, d)))
    return x.select("total_moves", F.array_join("directories_created", ",").alias("directories"))


# 8. Joins and lookups.


@query(f"WITH {SUPPLIERS} SELECT node, community::BIGINT AS community FROM nd")
def node_cluster(spark, d):
    m = corpus.supplier_membership(spark, d)
    return graph.community_assignment(corpus.supplier_nodes(spark, d), resolve.node_cluster(corpus.supplier_nodes(spark, d), m)).select("node", F.coalesce("community", F.lit(-1)).cast("long").alias("community"))


CF = f"cf AS (SELECT row_number() OVER (ORDER BY path) AS ordinal, dir || '#' || (doc_id % 2) AS cluster, CASE WHEN doc_id % 4 = 1 THEN 'backup/' || regexp_extract(path, '[^/]*$') || '.old' ELSE path END AS file FROM df)"


@query(f"WITH {DIRF}, {CF} SELECT path, coalesce((SELECT arg_min(cluster, ordinal) FROM cf WHERE cf.file = df.path OR contains(cf.file, regexp_extract(df.path, '[^/]*$'))), 'Unclustered') AS cluster FROM df")
def file_cluster(spark, d):
    from pyspark.sql import Window as W

    f = plain_files(spark, d)
    i = F.col("doc_id") % 4
    cf = f.select(P, F.row_number().over(W.partitionBy(P).orderBy("path")).alias("ordinal"), F.concat("dir", F.lit("#"), (F.col("doc_id") % 2).cast("string")).alias("cluster"), F.when(i == 1, F.concat(F.lit("backup/"), paths.basename("path"), F.lit(".old"))).otherwise(F.col("path")).alias("file"))
    return resolve.file_cluster_by_name(f, cf).drop(P)


@query("WITH nd AS (SELECT page_id AS ordinal, url AS node FROM pages), dp AS (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS dep FROM pages) SELECT dep, arg_min(node, ordinal) AS target FROM dp JOIN nd ON contains(node, dep) GROUP BY dep")
def dependency_links(spark, d):
    p = corpus.table(spark, d, "pages")
    n = p.select(F.lit("web").alias(P), F.col("page_id").alias("ordinal"), F.col("url").alias("node"))
    deps = p.select(F.lit("web").alias(P), F.lit("x").alias("src"), paths.basename("url").alias("dep")).distinct()
    return resolve.links(deps, n).select("dep", "target")


@query(f"WITH {SUPPLIERS} SELECT node FROM nd WHERE community <> 0")
def external_nodes(spark, d):
    inside = corpus.supplier_membership(spark, d).where("community = 0")
    return corpus.supplier_nodes(spark, d).join(inside, [P, "node"], "left_anti").select("node")


@query(f"WITH {WEIGHTED} SELECT min(weight)::DECIMAL(20,6)::DOUBLE AS min_weight, max(weight)::DECIMAL(20,6)::DOUBLE AS max_weight, min(cbo)::BIGINT AS min_cbo, max(cbo)::BIGINT AS max_cbo FROM wt")
def extents(spark, d):
    return r6(quality.extents(weighted(spark, d), "weight", "cbo").drop(P), "min_weight", "max_weight")


# 9. Tenancy.

USERS = "us AS (SELECT DISTINCT user_id AS \"user\", (['free', 'pro', 'team'])[user_id % 3 + 1] AS tier FROM events)"


@query(f"WITH {USERS}, mx AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, count(*) AS used FROM events, mx WHERE event_type = 'view' AND ts >= date_trunc('month', now) GROUP BY user_id) SELECT \"user\", tier, coalesce(used, 0)::BIGINT AS used, CASE tier WHEN 'free' THEN 10 WHEN 'pro' THEN 200 ELSE 1000 END AS quota, coalesce(used, 0) < CASE tier WHEN 'free' THEN 10 WHEN 'pro' THEN 200 ELSE 1000 END AS can FROM us LEFT JOIN u ON user_id = \"user\"")
def quota_status(spark, d):
    return tenancy.quota_status(corpus.users(spark, d), tenancy.month_to_date(corpus.usage_log(spark, d), "view"), "run_analysis")


SAVED = "sv AS (SELECT c_custkey AS \"user\", c_custkey % 97 AS repo, c_custkey % 2 = 0 AS is_active, TIMESTAMP '2024-01-01 00:00:00' AS last_analyzed, c_custkey % 5 AS analysis_count FROM customer), wn AS (SELECT DISTINCT o_custkey AS \"user\", o_custkey % 97 + (o_orderkey % 3 = 0)::INT AS repo FROM orders)"


def saved(spark, d):
    k = F.col("c_custkey")
    return corpus.table(spark, d, "customer").select(k.alias("user"), (k % 97).alias("repo"), (k % 2 == 0).alias("is_active"), F.lit("2024-01-01").cast("timestamp").alias("last_analyzed"), (k % 5).alias("analysis_count"))


def wanted(spark, d):
    return corpus.table(spark, d, "orders").select(F.col("o_custkey").alias("user"), (F.col("o_custkey") % 97 + (F.col("o_orderkey") % 3 == 0).cast("int")).alias("repo"))


@query(f"WITH {SAVED} SELECT sv.\"user\", sv.repo, is_active OR wn.repo IS NOT NULL AS is_active, CASE WHEN wn.repo IS NULL THEN 'untouched' WHEN is_active THEN 'present' ELSE 'reactivated' END AS change FROM sv LEFT JOIN wn USING (\"user\", repo) UNION ALL SELECT \"user\", repo, true, 'inserted' FROM wn WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.\"user\" = wn.\"user\" AND sv.repo = wn.repo)")
def repo_upsert(spark, d):
    return tenancy.upsert(saved(spark, d), wanted(spark, d))


@query(f"WITH {SAVED} SELECT \"user\", count(*) AS used FROM sv WHERE is_active GROUP BY \"user\"")
def active_repositories(spark, d):
    return tenancy.active_repositories(saved(spark, d))


@query("WITH sv AS (SELECT DISTINCT s_suppkey % 50 AS repo FROM supplier) SELECT p_partkey AS id, p_partkey % 120 AS repo, sv.repo IS NOT NULL AS is_saved, CASE WHEN sv.repo IS NOT NULL THEN '2024-01-01' END AS last_analyzed FROM part LEFT JOIN sv ON sv.repo = p_partkey % 120")
def repo_enrichment(spark, d):
    s = corpus.table(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("repo"), F.lit("2024-01-01").alias("last_analyzed"))
    return tenancy.enrich(corpus.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 120).alias("repo")), s).select("id", "repo", "is_saved", "last_analyzed")


@query("WITH r AS (SELECT s_suppkey AS repo, s_suppkey % 5 AS n FROM supplier), u AS (SELECT user_id AS repo, count(*) AS k, max(ts) AS t FROM events GROUP BY user_id) SELECT repo, n + coalesce(k, 0) AS analysis_count, strftime(greatest(TIMESTAMP '2024-01-01 00:00:00', t), '%Y-%m-%d %H:%M') AS last_analyzed FROM r LEFT JOIN u USING (repo)")
def count_analyses(spark, d):
    s = F.col("s_suppkey")
    r = corpus.table(spark, d, "supplier").select(s.alias("repo"), (s % 5).alias("analysis_count"), F.lit("2024-01-01").cast("timestamp").alias("last_analyzed"))
    x = tenancy.count_analyses(r, corpus.usage_log(spark, d).select(F.col("user").alias("repo"), F.col("ts").cast("timestamp").alias("ts")))
    return x.select("repo", "analysis_count", F.date_format("last_analyzed", "yyyy-MM-dd HH:mm").alias("last_analyzed"))


@query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error')
SELECT l.user_id AS customer_id,
       CASE event_type WHEN 'error' THEN 'past_due' WHEN 'view' THEN 'canceled' WHEN 'click' THEN CASE WHEN l.event_id % 4 = 0 THEN 'inactive' ELSE 'active' END ELSE 'active' END AS status,
       CASE s.event_id % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'team' ELSE 'free' END AS tier, 1700000000 + s.event_id * 60 AS end_epoch
FROM l LEFT JOIN s ON l.user_id = s.user_id AND s.k = 1 WHERE l.k = 1""")
def billing_fold(spark, d):
    return tenancy.billing_state(corpus.billing_log(spark, d)).select("customer_id", "status", "tier", F.unix_timestamp("end_date").alias("end_epoch"))


@query(f"WITH {USERS} SELECT \"user\", CASE WHEN \"user\" % 2 = 0 THEN 'known_' || \"user\" ELSE 'cus_' || md5(\"user\"::VARCHAR)[1:14] END AS customer_id, \"user\" % 2 = 1 AS created FROM us")
def customers(spark, d):
    u = corpus.users(spark, d)
    known = u.where(F.col("user") % 2 == 0).select("user", F.concat(F.lit("known_"), F.col("user").cast("string")).alias("customer_id"))
    return tenancy.get_or_create_customers(u, known)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def daily_usage(spark, d):
    x = corpus.usage_log(spark, d)
    return x.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS repo, p_name AS name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30 OFFSET 30")
def listing_page(spark, d):
    r = corpus.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("updated_at"))
    return sources.listing_page(r, 2).select(F.col("id").alias("repo"), "name")


@query("WITH m AS (SELECT n_nationkey AS k, (['Unsupported archive format: rar', 'File too large', 'Too many files', 'security check failed', 'Path traversal', 'Invalid name', 'boom'])[n_nationkey % 7 + 1] AS message FROM nation) SELECT k, message, CASE k % 7 WHEN 0 THEN 400 WHEN 1 THEN 413 WHEN 2 THEN 413 WHEN 3 THEN 403 WHEN 4 THEN 400 WHEN 5 THEN 400 ELSE 500 END AS status FROM m")
def http_status(spark, d):
    texts = F.array(*map(F.lit, ["Unsupported archive format: rar", "File too large", "Too many files", "security check failed", "Path traversal", "Invalid name", "boom"]))
    m = corpus.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.get(texts, F.col("n_nationkey") % 7).alias("message"))
    return m.withColumn("status", grades.http_status("message"))


@query()
def analysis_base(spark, d):
    """The whole base analysis of the corpus' first files of each type as one project, as JSON rows."""
    f = corpus.source_files(spark, d).withColumn(P, F.concat(F.lit("p"), F.floor(F.col("doc_id") / 500).cast("string")))
    return plans.to_json(spark, {k: v for k, v in plans.analyze(f.select(P, "path", "content", "size_bytes"), skip_security=True).items() if k in ("clusters", "metadata", "scores", "heuristics")})


@query()
def analysis_advanced(spark, d):
    """The whole advanced analysis, scan included, of the documents in projects of 500 files, as JSON rows."""
    return plans.to_json(spark, plans.analyze_advanced(corpus.importing_files(spark, d)))
