"""Texts to metrics, imports, archives, plans."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lexing, metrics, paths
from plumbline.operators import refactor, resolve, security
from plumbline.plans import analyze as plans
from plumbline.sources import archives, files as sources


def value(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()["x"]


def test_imports(spark):
    js = "import a from './a'\nimport './b'\nimport D, {x} from \"./c\"\nexport {y} from './d'\nconst z = require('e')\nimport('f')\nimport * as g from 'g'"
    assert set(value(spark, js, lexing.javascript_imports("t"))) == {"./a", "./b", "./c", "./d", "e", "f", "g"}
    assert set(value(spark, js, lexing.javascript_imports("t", literal=True))) == {"./a", "e", "f", "g"}
    py = "import os, sys as s\nfrom a.b import c\n    import inner\nx = 1"
    assert value(spark, py, lexing.python_imports("t")) == ["os", "sys", "a.b", "inner"]
    assert value(spark, py, lexing.python_imports("t", literal=True)) == ["os", "sys", "a.b"]
    assert value(spark, py, lexing.base_python_imports("t")) == ["os", "a.b"]
    assert value(spark, "import static a.b.C;\nimport x.y.*;", lexing.java_imports("t")) == ["a.b.C", "x.y"]
    assert value(spark, '#include <a.h>\n#include "b/c.h"', lexing.c_includes("t")) == ["a.h", "b/c.h"]
    assert value(spark, "def f():\n  def g(): pass\nclass K: pass", lexing.python_exports("t")) == ["f", "K"]


def test_metrics(spark):
    text = "function f(x) {\n  if (x) {\n    while (x) { x-- }\n  } else {\n    for (;;) {}\n  }\n}\n"
    js = F.lit("javascript")
    # if, while, else and for; `function f` holds no keyword, `for` holds the letters "or".
    assert value(spark, text, metrics.cyclomatic("t", js)) == 1 + 4 + 1
    assert value(spark, text, metrics.cyclomatic("t", js, word_bounded_logical=True)) == 5
    assert value(spark, text, metrics.nesting_depth("t")) == 3
    assert value(spark, "{{((", metrics.nesting_depth("t")) == 4
    assert value(spark, "", metrics.lines("t")) == 1
    assert value(spark, "", metrics.halstead_volume(metrics.halstead_parts("t", js))) == 0.0
    assert value(spark, "éif x if", metrics.cyclomatic("t", js)) == 3
    f = spark.createDataFrame([("p", "a.js", ""), ("p", "b.py", None)], "project string, path string, content string")
    assert [r["mi"] for r in metrics.with_metrics(f).collect()] == [100.0, 100.0]


def test_file_types(spark):
    want = {"tests/a.js": "test", "src/api/x.ts": "api", "src/Button.tsx": "component", "src/pages/a.js": "page", "src/useThing.ts": "hook", "lib/src/helperx.js": "utility", "x/service/a.js": "service", "a/configs.js": "config", "a/b.d.ts": "type", "a/x.css": "style", "a/b.js": "generic", "src/button.tsx": "generic"}
    df = spark.createDataFrame([(p,) for p in want], "path string").select("path", paths.file_type("path").alias("t"))
    assert {r["path"]: r["t"] for r in df.collect()} == want


def test_resolution(spark):
    f = spark.createDataFrame([("p", x) for x in ("src/a.js", "src/lib/b.ts", "src/lib/index.js", "pkg/mod/x.py", "pkg/y.py", "j/C.java", "inc/h.hpp", "z/b.ts")], "project string, path string")
    raw = [("src/a.js", "./lib/b"), ("src/a.js", "./lib/b.ts"), ("src/a.js", "./lib"), ("src/a.js", "react"), ("src/a.js", "b"), ("pkg/y.py", ".mod.x"), ("pkg/y.py", "pkg.mod.x"), ("src/lib/b.ts", "../a"), ("src/a.js", "./a")]
    r = spark.createDataFrame([("p", s, d, i) for i, (s, d) in enumerate(raw)], "project string, src string, dep string, ordinal int")
    got = {(x["src"], x["dep"]): x["dst"] for x in resolve.resolve(r, f).collect()}
    assert got[("src/a.js", "./lib/b")] == got[("src/a.js", "./lib/b.ts")] == "src/lib/b.ts"
    assert got[("src/a.js", "./lib")] == "src/lib/index.js" and got[("src/a.js", "react")] is None
    assert got[("src/a.js", "b")] == "z/b.ts"  # the greatest path wins a name
    assert got[("pkg/y.py", ".mod.x")] == got[("pkg/y.py", "pkg.mod.x")] == "pkg/mod/x.py"
    assert got[("src/lib/b.ts", "../a")] == got[("src/a.js", "./a")] == "src/a.js"
    base = {(x["src"], x["dep"]): x["dst"] for x in resolve.resolve(r, f, "base").collect()}
    assert base[("src/a.js", "./a")] is None and base[("src/a.js", "b")] is None


def test_security(spark):
    bad = "eval(x)\nconst r = exec(\"rm -rf /\")\nel.innerHTML = y\n"
    f = spark.createDataFrame([("p", "a.js", bad, None), ("p", "b.js", "let x = 1", None), ("q", "c.js", "ok", None)], "project string, path string, content string, size_bytes long")
    issues = security.scan(f)
    assert sorted((r["rule_id"], r["line"]) for r in issues.collect()) == [(1, 1), (2, 2), (3, 3), (11, 2)]
    g = {r["project"]: r for r in security.gate(issues).collect()}
    assert g["p"]["n_critical"] == 3 and not g["p"]["passes"]
    with pytest.raises(ValueError, match="critical"):
        security.enforce(issues)
    exe = spark.createDataFrame([("p", "a.exe", "text", 4)], f.schema)
    assert security.scan(exe).first()["message"] == "blocked extension"
    with pytest.raises(ValueError, match="dangerous"):
        security.scan(exe, strict=True)


def zip_of(entries, how=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def tar_of(entries, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zip_of([("src/index.js", "import './x'"), ("src/x.js", "let a = 1"), ("../evil.js", "no")]))
    (tmp_path / "b.tar.gz").write_bytes(tar_of([("m/app.py", b"import os\n"), ("../evil.py", b"no")]))
    (tmp_path / "c.tar").write_bytes(tar_of([("main.c", b"#include <x.h>\n")], "w"))
    archives.register(spark)
    want = {("a.zip", "src/index.js"), ("a.zip", "src/x.js"), ("b.tar.gz", "m/app.py"), ("c.tar", "main.c")}
    one = spark.read.format("archive").load(str(tmp_path))
    two = archives.read_archives(spark, str(tmp_path))
    assert {(r["archive"], r["name"]) for r in one.collect()} == want == {(r["archive"], r["name"]) for r in two.collect()}
    result = plans.analyze(archives.source_files(two))
    assert result["dependencies"].select("src", "dst").collect() == [("src/index.js", "src/x.js")]


def test_archives_of_one_name_and_broken_ones(spark, tmp_path):
    for folder, text in (("one", b"a"), ("two", b"b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "src.zip").write_bytes(zip_of([("x.py", text)]))
    (tmp_path / "bad.7z").write_bytes(b"7z")
    (tmp_path / "bad.tar").write_bytes(b"no tar at all" * 100)
    archives.register(spark)
    for got in (spark.read.format("archive").load(str(tmp_path)), archives.read_archives(spark, str(tmp_path))):
        rows = {(r["archive"], r["type"]): r for r in got.collect()}
        assert set(rows) == {("one/src.zip", "file"), ("two/src.zip", "file"), ("bad.7z", "error"), ("bad.tar", "error")}
        assert "not supported" in rows["bad.7z", "error"]["name"]
        assert {(r["project"], r["content"]) for r in archives.source_files(got).collect()} == {("one/src.zip", "a"), ("two/src.zip", "b")}


def test_salvage_counts_what_comes_out():
    """Entries whose headers declare no bytes still count by the bytes they give."""
    data = bytearray(zip_of([(f"{i}.txt", b"x" * (9 << 20)) for i in range(12)]))
    at = data.find(b"PK\x03\x04")
    while at >= 0:
        data[at + 22 : at + 26] = bytes(4)
        at = data.find(b"PK\x03\x04", at + 4)
    with pytest.raises(archives.ArchiveError, match="Archive too large"):
        for _ in archives.salvage_zip(bytes(data), archives.ARCHIVE_LIMITS):
            pass


def test_archive_limits():
    small = {"entries": 2, "entry_bytes": 10, "total_bytes": 15}
    for data in ([("a", "x" * 11)], [("a", "x" * 9), ("b", "y" * 9)], [(str(i), "") for i in range(3)]):
        with pytest.raises(archives.ArchiveError):
            list(archives.entries("a.zip", zip_of(data), small))
    for how in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        cut = zip_of([("d/a.txt", "hello" * 20)], how)
        cut = cut[: cut.rfind(b"PK\x01\x02")]
        assert [(n, d) for n, _, _, d in archives.entries("x.zip", cut)] == [("d/a.txt", b"hello" * 20)]
    for name in ("a.7z", "a.rar"):
        with pytest.raises(archives.ArchiveError, match="not supported"):
            list(archives.entries(name, b""))
    with pytest.raises(archives.ArchiveError, match="detect"):
        archives.kind_of("a.txt")


def test_directory_source(spark, tmp_path):
    for name in ("p/src/index.js", "p/node_modules/x.js", "p/.env", "p/readme.md", "q/.hidden/a.js", "q/a.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    got = sources.read_directory(spark, str(tmp_path))
    assert {(r["project"], r["path"]) for r in got.collect()} == {("p", "src/index.js"), ("q", ".hidden/a.js"), ("q", "a.py")}
    scan = sources.read_directory(spark, str(tmp_path), kind="security")
    assert {(r["project"], r["path"]) for r in scan.collect()} == {("p", "src/index.js"), ("p", ".env"), ("p", "readme.md"), ("q", "a.py")}
    (tmp_path / "p/bad.js").write_bytes(b"a\xff\xfeb")
    (tmp_path / "q/__init__.py").write_text("")
    more = {(r["project"], r["path"]): r["content"] for r in sources.read_directory(spark, str(tmp_path)).collect()}
    assert more["p", "bad.js"].startswith("a") and more["q", "__init__.py"] == ""
    text = spark.createDataFrame([("aGVs\nbG8=",)], "content string")
    assert sources.decoded(text).first()["content"] == "hello"
    with pytest.raises(ValueError, match="No files"):
        sources.require_valid(got.limit(0))


def project(spark):
    f = {"index.js": "import './app.js'\nimport './utils/index.js'\n", "app.js": "import './router.js'\nimport './database.js'\nif (a && b) { c() }\n", "router.js": "export const r = 1\n", "database.js": "", "utils/index.js": "export const u = 2\n"}
    return spark.createDataFrame([("p", k, v, len(v)) for k, v in f.items()], "project string, path string, content string, size_bytes long")


def test_advanced_analysis(spark):
    r = plans.analyze_advanced(project(spark))
    assert {(x["src"], x["dst"]) for x in r["edges"].collect()} == {("index.js", "app.js"), ("index.js", "utils/index.js"), ("app.js", "router.js"), ("app.js", "database.js")}
    nodes = r["nodes"].collect()
    assert len(nodes) == 5 and abs(sum(x["pagerank"] for x in nodes) - 1) < 0.1
    assert all(0 <= x["mi"] <= 100 and x["betweenness"] >= 0 and x["eigenvector"] >= 0 and x["community"] is not None for x in nodes)
    m = r["metrics"].first()
    assert all(0 <= m[c] <= 100 for c in ("structural_health", "maintainability_score", "evolutionary_risk", "technical_debt"))
    assert -1 <= m["modularity"] <= 1 and 0 <= m["density"] <= 1 and 0 <= m["clustering"] <= 1
    assert all(0 <= x["conductance"] <= 1 and -1 <= x["silhouette"] <= 1 for x in r["clusters"].collect())


def test_refactor_applies(spark, tmp_path):
    f = project(spark)
    for r in f.collect():
        (tmp_path / "in" / r["path"]).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / r["path"]).write_text(r["content"])
    plan = plans.plan_refactor(plans.analyze(f)["clusters"])
    assert plan["summary"].first()["total_moves"] == 5
    n = refactor.apply_plan(plan["structures"], "p", tmp_path / "in", tmp_path / "out")
    assert n["files"] == 5 and (tmp_path / "out" / "OVERVIEW.md").exists()
    assert archives.zip_tree(tmp_path / "out", tmp_path / "x.zip") >= 5


def test_contained_names_with_one_beginning(spark):
    """Names that all begin alike: no pairs of all texts and names are looked at, and each text finds what it contains."""
    from plumbline.operators import resolve

    names = [*(f"web_{i}.js" for i in range(3000)), "x", "ab", "é_1.js", "missing.js"]
    texts = [*(f"src/old/web_{i}.js.old" for i in range(3000)), "ab/x", "web_1.js/web_1.js", "dir/é_1.js"]
    w = spark.createDataFrame([("p", x) for x in names], "project string, name string")
    t = spark.createDataFrame([("p", x) for x in texts], "project string, file string")
    hit = resolve.containing(t, "file", w, "name")
    got = {(r["file"], r["name"]) for r in hit.select("file", "name").collect()}
    assert got == {(x, y) for x in texts for y in names if y in x}
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan


def test_scan_for_some_severities(spark):
    """The rules of other severities aren't tried: the scan that only stops an analysis asks for critical ones."""
    from plumbline.functions import fixed
    from plumbline.operators import security

    texts = ["eval(x)", "el.innerHTML = x", "password = 'abcdefgh12'", "exec('rm -rf /')", "require('child_process')", "a = 1"]
    f = spark.createDataFrame([("p", f"f{i}.js", t, len(t)) for i, t in enumerate(texts)], "project string, path string, content string, size_bytes long")
    every, few = security.scan(f), security.scan(f, severities=("critical",))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in every.where("severity = 'critical'").collect()}
    assert every.where("severity <> 'critical'").count() > 0
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert not any(message in plan for *_, severity, message in fixed.SECURITY_RULES if severity != "critical")
