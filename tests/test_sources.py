"""Files, manifests, parsers, expressions and the query guard."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.plans.guard import check_sql, clamp, run_sql, search_strategy
from graphloom.sources import extract, files


def test_scan_and_projects(spark, tmp_path):
    for name, text in {"a/pyproject.toml": "[project]\ndependencies=['Foo>=1','bar']", "a/src/m.py": "x=1", "b/package.json": '{"dependencies":{"foo":"2","z":"1"}}', "node_modules/q.js": "", "a/sub/go.mod": "module x\nrequire ex.com/y v1.2.0", "k.log": "", "bad/pom.xml": "<"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    found = files.scan(spark, str(tmp_path), (*files.DEFAULT_EXCLUDES, "*.log", "!keep.log")).cache()
    assert sorted(r.path for r in found.collect()) == ["a/pyproject.toml", "a/src/m.py", "a/sub/go.mod", "b/package.json", "bad/pom.xml"]
    projects = files.detect_projects(found)
    assert {r.name for r in projects.collect()} == {"a", "sub", "b", "bad"}
    owners = {r.path: r.project_name for r in files.owning_project(found, projects).collect()}
    assert owners["a/src/m.py"] == "a" and owners["a/sub/go.mod"] == "sub"
    assert {tuple(r) for r in files.dependency_versions(found).collect()} == {("z", "1"), ("ex.com/y", "v1.2.0")}
    assert files.prioritised(found).first().path.count("/") == 2


def test_parsers(spark):
    py = "'''Doc'''\nimport os\nfrom .a import b\nclass A(B):\n    def f(self, x=1):\n        return g(x)\n"
    sql = "CREATE TABLE t (id INT PRIMARY KEY, o DECIMAL(3, 2) REFERENCES u(id), CONSTRAINT c CHECK (id > 0)); -- CREATE TABLE no (a INT)\nCREATE VIEW v AS SELECT * FROM t;"
    md = "# T\ntext [[Note|x]] and `A.f()`\n## S\n```\n# no\n```"
    df = spark.createDataFrame([("m", ".py", py), ("s", ".sql", sql), ("d.md", ".md", md), ("bad", ".py", "def ("), ("n", ".py", None)], "name string, suffix string, text string")
    rows = extract.extracted(df).collect()
    assert {(r.entity, r.kind) for r in rows if r.label} == {("m", "module"), ("m.A", "class"), ("m.A.f", "method"), ("s.t", "sql_table"), ("s.t.id", "sql_column"), ("s.t.o", "sql_column"), ("s.v", "sql_view"), ("d.md", "doc"), ("d.md#T", "section"), ("d.md#T/S", "section")}
    rels = {(r.entity, r.rel_type, r.target) for r in rows if r.rel_type}
    assert {("m", "IMPORTS", "os"), ("m", "IMPORTS", ".a.b"), ("m.A", "INHERITS", "B"), ("m.A.f", "CALLS", "g"), ("s.t", "USES_TYPE", "u"), ("s.v", "USES_TYPE", "t"), ("d.md#T", "LINKS_TO", "Note"), ("d.md#T", "DOCUMENTS", "A.f")} <= rels
    extract.register(spark)
    assert spark.sql("SELECT * FROM parse_source('q', '.py', 'def f(): pass')").count() == 3
    e = spark.createDataFrame([("out", "a", 1, 20), ("in", "a", 5, 9)], "uid string, file_path string, line_start int, line_end int")
    c = spark.createDataFrame([("a", 7, "WHY: x"), ("a", 15, "NOTE: y"), ("a", 30, "HACK: z")], "file_path string, line int, text string")
    assert {(r.uid, r.line) for r in extract.rationale_owners(e, c).collect()} == {("in", 7), ("out", 15)}


def test_expressions(spark):
    df = spark.createDataFrame([("src/tests/a.py", "f"), ("src/test_a.py", "f"), ("src/a.py", "f"), ("src/a.py", "test_f"), ("x.d.ts", "g"), (None, None)], "path string, name string")
    assert [r[0] for r in df.select(X.is_test(F.col("path"), F.col("name"))).collect()] == [True, True, False, True, False, False]
    assert [r[0] for r in df.select(X.is_stub(F.col("path"))).collect()] == [False, False, False, False, True, False]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.citation_keys(F.lit("ADR-007, rfc 12 adr_7"))) == ["ADR-7", "RFC-12"]
    assert one(X.module_name(F.lit("src/pkg/__init__.py"))) == "pkg" and one(X.module_name(F.lit("a/b.py"))) == "a.b"
    assert one(X.file_hash(F.lit("a  \n\n\n\nb"))) == one(X.file_hash(F.lit("a\n\nb")))
    assert [one(X.anchor_kind(F.lit(a))) for a in ("/x/y.py", "p:a/b.py#f", "p:a.b", "a/b.py")] == ["absolute", "project_path", "uid", "path"]
    assert one(X.rationale_markers(F.lit("x\n# NOTE: a b\n# WHY: c"))) == ["NOTE: a b", "WHY: c"]
    assert [tuple(r) for r in one(X.headings(F.lit("# A\ntext\n### B")))] == [(1, "A"), (3, "B")]
    assert one(X.is_resource_path(F.lit("conf/app.yaml"))) and not one(X.is_resource_path(F.lit("http://x/a.json")))


def test_guard(spark):
    assert check_sql("SELECT 'DROP TABLE x' LIMIT 3") == []
    assert check_sql("DROP TABLE x")[0].startswith("writes") and "not a query" in check_sql("hello")
    assert any("did you mean 'Callable'" in e for e in check_sql("SELECT * FROM nodes WHERE label = 'Calable' LIMIT 1"))
    n = spark.createDataFrame([("a", "Callable")], "uid string, label string")
    assert run_sql(n, n, "SELECT uid FROM nodes;").count() == 1 and clamp(None) == 20 and clamp(500) == 100
    with pytest.raises(ValueError):
        run_sql(n, n, "DELETE FROM nodes")
    assert [search_strategy(q) for q in ("why is it so", "who calls f", "get_node", "fast lookup of things")] == ["knowledge", "structure", "names", "meaning"]
