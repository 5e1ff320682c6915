"""Extraction by language, the way from files to a graph, git and the command line."""

import subprocess

import pytest

from graphloom.__main__ import run
from graphloom.sources import extract, files, git, indexing
from graphloom.sources.languages import LANGUAGES, yaml_keys
from graphloom.sources.store import GraphStore

CASES = {
    ".ts": (
        "import { a } from './a'; // import 'no'\nexport class Box<T> extends Base implements Shape, Other<T> {\n  constructor(x: string) { super(x); }\n  area(k = '}'): number { return helper(1) + Math.max(1, 2); }\n}\n"
        "interface Shape { area(): number }\nexport const run = async (x: number) => { await go(x); };\nfunction z(a = {b: 1}) { q() }\n",
        {"m.Box.area", "m.Shape", "m.run", "m.z"},
        {("m", "IMPORTS", "./a"), ("m.Box", "INHERITS", "Base"), ("m.Box", "IMPLEMENTS", "Shape"), ("m.Box", "IMPLEMENTS", "Other"), ("m.Box.area", "CALLS", "helper"), ("m.Box.area", "CALLS", "Math.max"), ("m.run", "CALLS", "go"), ("m.z", "CALLS", "q")},
    ),
    ".java": (
        "package p; import java.util.List; import static a.B.*;\npublic class A<T> extends B<T> implements C, D<E> {\n  public A(int y) { this.x = f(y); }\n  @Override public List<String> get(String s) throws IOException { return other.call(s); }\n  interface Inner { void go(); }\n}\n",
        {"m.A", "m.A.A", "m.A.get", "m.A.Inner", "m.A.Inner.go"},
        {("m", "IMPORTS", "java.util.List"), ("m", "IMPORTS", "a.B.*"), ("m.A", "INHERITS", "B"), ("m.A", "IMPLEMENTS", "C"), ("m.A", "IMPLEMENTS", "D"), ("m.A.A", "CALLS", "f"), ("m.A.get", "CALLS", "other.call")},
    ),
    ".cs": (
        'using System.Text; namespace N { public class Foo : Bar, IThing<int> { public async Task<int> Run(int a) => Go(a); void M() { Console.Write("x{"); } } public record P(int X); }',
        {"m.Foo", "m.Foo.Run", "m.Foo.M", "m.P"},
        {("m", "IMPORTS", "System.Text"), ("m.Foo", "INHERITS", "Bar"), ("m.Foo", "IMPLEMENTS", "IThing"), ("m.Foo.Run", "CALLS", "Go"), ("m.Foo.M", "CALLS", "Console.Write")},
    ),
    ".cpp": (
        '#include <vector>\n#include "a.h"\nclass A : public B, private ns::C { public: void f(int x) { g(x); } int h() const; };\nint A::h() const { return helper(1); }\nstatic std::vector<int> make(int n) { if (n) { return make(n-1); } }\n',
        {"m.A", "m.A.f", "m.A.h", "m.make"},
        {("m", "IMPORTS", "vector"), ("m", "IMPORTS", "a.h"), ("m.A", "INHERITS", "B"), ("m.A", "INHERITS", "ns::C"), ("m.A.f", "CALLS", "g"), ("m.A.h", "CALLS", "helper"), ("m.make", "CALLS", "make")},
    ),
    ".go": (
        'package m\nimport "fmt"\nimport (\n  x "a/b"\n)\ntype T struct {\n  Base\n  F Thing\n  n int\n}\ntype I interface { Do(x int) }\nfunc (t *T) Do(x int) { fmt.Println(x); helper() }\nfunc helper() {}\n',
        {"m.T", "m.I", "m.T.Do", "m.helper"},
        {("m", "IMPORTS", "fmt"), ("m", "IMPORTS", "a/b"), ("m.T", "INHERITS", "Base"), ("m.T", "USES_TYPE", "Thing"), ("m.T.Do", "CALLS", "fmt.Println"), ("m.T.Do", "CALLS", "helper")},
    ),
    ".rs": (
        "use std::io::Read; mod sub;\npub struct P { x: i32 }\ntrait Tr { fn go(&self); }\nimpl Tr for P { fn go(&self) { helper(1); } }\nimpl P { pub fn new() -> P { P::build(2) } }\nfn helper(x: i32) -> i32 { x }\n",
        {"m.P", "m.Tr", "m.P.go", "m.P.new", "m.helper"},
        {("m", "IMPORTS", "std.io.Read"), ("m", "IMPORTS", "sub"), ("m.P", "IMPLEMENTS", "Tr"), ("m.P.go", "CALLS", "helper"), ("m.P.new", "CALLS", "P.build")},
    ),
    ".php": (
        "<?php namespace A; use B\\C\\D; require_once 'x.php';\nclass K extends D implements I { public function f($a) { return $this->g($a) + H::make(1); } }\nfunction top() { return strlen('a(b'); } # c()\n",
        {"m.K", "m.K.f", "m.top"},
        {("m", "IMPORTS", "B.C.D"), ("m", "IMPORTS", "x.php"), ("m.K", "INHERITS", "D"), ("m.K", "IMPLEMENTS", "I"), ("m.K.f", "CALLS", "this.g"), ("m.K.f", "CALLS", "H.make"), ("m.top", "CALLS", "strlen")},
    ),
    ".rb": (
        "require 'set'\nmodule M\n  class K < Base::X\n    include Mix\n    def go(a)\n      helper(a) if ok?(a)\n    end\n    def self.make\n      new(1)\n    end\n  end\nend\ndef top\n  M::K.make()\nend\n",
        {"m.M", "m.M.K", "m.M.K.go", "m.M.K.make", "m.top"},
        {("m", "IMPORTS", "set"), ("m.M.K", "INHERITS", "Base.X"), ("m.M.K", "INHERITS", "Mix"), ("m.M.K.go", "CALLS", "helper"), ("m.M.K.go", "CALLS", "ok?"), ("m.top", "CALLS", "M.K.make")},
    ),
    ".cls": ("public with sharing class Acc extends Base implements Queueable { public void execute(QueueableContext c) { Helper.run(c); } }", {"m.Acc", "m.Acc.execute"}, {("m.Acc", "INHERITS", "Base"), ("m.Acc", "IMPLEMENTS", "Queueable"), ("m.Acc.execute", "CALLS", "Helper.run")}),
    ".sh": ("#!/bin/bash\nsource ./lib.sh\nbuild() { echo x; deploy now; }\nfunction deploy {\n  cp a b # build\n}\nif build; then deploy; fi\n", {"m.build", "m.deploy"}, {("m", "IMPORTS", "./lib.sh"), ("m.build", "CALLS", "deploy"), ("m", "CALLS", "build"), ("m", "CALLS", "deploy")}),
    ".tf": (
        'resource "aws_s3_bucket" "b" { bucket = var.name }\nvariable "name" { default = "x" }\nmodule "net" { source = "./net"\n id = aws_s3_bucket.b.id }\n',
        {"m.aws_s3_bucket.b", "m.var.name", "m.module.net"},
        {("m.aws_s3_bucket.b", "USES_TYPE", "m.var.name"), ("m.module.net", "IMPORTS", "./net"), ("m.module.net", "USES_TYPE", "m.aws_s3_bucket.b")} - {("m.module.net", "IMPORTS", "./net")} | {("m", "IMPORTS", "./net")},
    ),
    "Dockerfile": ("FROM python:3 AS base\nARG V=1\nRUN a && \\\n  b\nFROM base\nCOPY --from=base /a /b\nENV X=1\n", {"m.base", "m.base.V", "m.1", "m.1.X"}, {("m.base", "IMPORTS", "python:3"), ("m.1", "IMPORTS", "m.base")}),
    ".yaml": (
        "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: web\nspec:\n  containers:\n    - name: c\n      image: nginx:1\n      envFrom:\n        - configMapRef:\n            name: cfg\n---\napiVersion: v1\nkind: ConfigMap\nmetadata:\n  name: cfg\ndata:\n  a: |\n    kind: no\n",
        {"m.Deployment/web", "m.ConfigMap/cfg"},
        {("m.Deployment/web", "IMPORTS", "nginx:1"), ("m.Deployment/web", "USES_TYPE", "m.ConfigMap/cfg")},
    ),
    ".yml": ("services:\n  web:\n    image: a:1\n    depends_on:\n      - db\n  db:\n    image: pg\n", {"m.web", "m.db"}, {("m.web", "IMPORTS", "a:1"), ("m.web", "USES_TYPE", "m.db"), ("m.db", "IMPORTS", "pg")}),
    ".json": ('{"a": {"b": {"c": {"d": 1}}}, "l": [1]}', {"m.a", "m.a.b", "m.a.b.c", "m.l"}, {("m.a", "CONTAINS", "m.a.b"), ("m.a.b", "CONTAINS", "m.a.b.c")}),
    ".toml": ('[x]\ny = 1\n[x.z]\nw = "q"\n', {"m.x", "m.x.y", "m.x.z", "m.x.z.w"}, {("m.x", "CONTAINS", "m.x.z")}),
    ".xml": ('<r><a id="k"><b/></a></r>', {"m.r", "m.r.k", "m.r.k.b"}, {("m.r", "CONTAINS", "m.r.k")}),
    "-meta.xml": (
        '<?xml version="1.0"?><CustomObject xmlns="http://x"><fullName>Inv__c</fullName><fields><fullName>Acc__c</fullName><referenceTo>Account</referenceTo></fields></CustomObject>',
        {"m.Inv__c", "m.Inv__c.Acc__c"}, {("m.Inv__c", "IMPORTS", "Account")},
    ),
}


@pytest.mark.parametrize("suffix", CASES)
def test_language(suffix):
    source, entities, relations = CASES[suffix]
    rows = list(LANGUAGES[suffix]("m", source))
    assert entities <= {r[0] for r in rows if r[1]}
    found = {(r[0], r[4], r[5]) for r in rows if r[4] and r[4] != "DEFINES"}
    assert relations <= found
    assert {r for r in found if r[1] != "CONTAINS"} <= relations  # and nothing else
    assert {r[5] for r in rows if r[4] == "DEFINES"} | {r[5] for r in rows if r[4] == "CONTAINS"} >= entities
    assert list(LANGUAGES[suffix]("m", "<a/>" if "xml" in suffix else "{}" if suffix == ".json" else ""))[0][1] == "Module"


def test_spans_and_places():
    rows = list(LANGUAGES[".java"]("m", CASES[".java"][0]))
    at = {r[0]: (r[2], r[6], r[7], r[9]) for r in rows if r[1]}
    assert at["m.A"] == ("class", 2, 6, None) and at["m.A.A"] == ("constructor", 3, 3, "(int y)") and at["m.A.get"][3] == "(String s)"
    jobs = "on: push\njobs:\n  build:\n    steps:\n      - uses: actions/checkout@v4\n  test:\n    needs: [build]\n"
    assert {(r[0], r[4], r[5]) for r in LANGUAGES[".yml"]("w", jobs) if r[4] != "DEFINES" and r[4]} == {("w.build", "IMPORTS", "actions/checkout@v4"), ("w.test", "CALLS", "w.build")}
    book = "- name: Web\n  hosts: all\n  roles:\n    - common\n  tasks:\n    - include_tasks: t.yml\n"
    assert {(r[0], r[4], r[5]) for r in LANGUAGES[".yml"]("w", book) if r[4] == "IMPORTS"} == {("w.Web", "IMPORTS", "common"), ("w.Web", "IMPORTS", "t.yml")}
    assert [(p[1:], v) for _, p, v in yaml_keys("a: 'x: y' # c\nb:\n- 1\n- c: 2\n  d: 3\n\"e f\": g")] == [(["a"], "x: y"), (["b"], ""), (["b", "[0]"], "1"), (["b", "[1]", "c"], "2"), (["b", "[1]", "d"], "3"), (["e f"], "g")]


def test_python_facts_and_notes(spark):
    source = "import os\n@app.route('/x')\ndef f(a: Box, b: 'Other' = 1) -> List[int]:\n    os.getenv('HOME'); os.environ['KEY']; open('data/x.json'); open('rb')\n    register(g, key=h.i)\n    x: Thing = 1\n"
    rels = {(r[4], r[5]) for r in extract.parse_python("m", source) if r[0] == "m.f" and r[4]}
    assert {("USES_TYPE", "Box"), ("USES_TYPE", "Other"), ("USES_TYPE", "List"), ("USES_TYPE", "int"), ("USES_TYPE", "Thing"), ("READS_ENV", "HOME"), ("READS_ENV", "KEY"), ("REFERENCES_FILE", "data/x.json"), ("REFERENCES", "g"), ("REFERENCES", "h.i"), ("REGISTERED_BY", "app.route")} <= rels
    assert ("REFERENCES_FILE", "rb") not in rels
    assert [extract.looks_like_file(x) for x in ("a/b", ".env", "/abs/x.json", "s3://b/k.json", "data", "a//b", "x.yaml", "..")] == [True, True, False, False, False, False, True, False]
    note = "---\ntitle: Why\nanchors:\n  - src/a.py#f\nsupersedes: [old, older]\n---\n# T\nSee `pkg.Box()` and src/x/y.py.\n## make_it\n"
    rows = list(extract.parse_markdown("n.md", note))
    assert rows[0][1:4] == ("Note", "note", "Why") and {(r[2], r[4], r[5]) for r in rows if r[4] in ("DOCUMENTS", "SUPERSEDES")} == {("anchor", "DOCUMENTS", "src/a.py#f"), ("", "SUPERSEDES", "old"), ("", "SUPERSEDES", "older"), ("symbol_mention", "DOCUMENTS", "pkg.Box"), ("file_ref", "DOCUMENTS", "src/x/y.py"), ("explicit", "DOCUMENTS", "make_it")}
    assert any(r[:3] == ("s.add", "Callable", "sql_function") for r in extract.parse_sql("s", "CREATE FUNCTION add(a INT, b DECIMAL(3,2)) RETURNS INT;"))
    df = spark.createDataFrame([("big", ".py", "x = 1\n" * 9), ("bad", ".json", "{"), ("none", ".xyz", "q")], "name string, suffix string, text string")
    assert {(r.file, r.kind, r.entity) for r in extract.extracted(df, max_bytes=20).collect()} == {("big", "skipped", "big"), ("bad", "unparsed", "bad")}
    assert [extract.suffix_of(p) for p in ("a/Dockerfile", "Dockerfile.dev", "x/Acc.object-meta.xml", "b.py")] == ["Dockerfile", "Dockerfile", "-meta.xml", ".py"]


def test_rules_and_manifests(spark):
    df = spark.createDataFrame([(".gitignore", "*.log\n"), ("a/.gitignore", "!keep.log\nsub/\n"), ("x.log", ""), ("a/keep.log", ""), ("a/sub/y.py", ""), ("sub/z.py", "")], "path string, text string")
    assert {r.path for r in files.under_rules(df, files.nested_rules(df)).collect()} == {".gitignore", "a/.gitignore", "a/keep.log", "sub/z.py"}
    made = spark.createDataFrame([("go.mod", "require a.b/c v1\nreplace a.b/c v1 => a.b/d v2\n"), ("package.json", '{"dependencies": {"x": "1"}, "devDependencies": {"x": "2"}}'), ("Cargo.toml", '[workspace.dependencies]\nmy-crate = "3"\n'), ("pyproject.toml", "[project]\ndependencies=['my-lib>=2']")], "path string, text string")
    assert {tuple(r) for r in files.dependency_versions(made).collect()} == {("a.b/c", "v1"), ("x", "1"), ("my_crate", "3"), ("my_lib", ">=2")}
    projects = files.detect_projects(spark.createDataFrame([("a/b/package.json", ""), ("c/go.mod", "")], "path string, text string"), explicit={"a/b": "", "d": "own"})
    assert [(r.root, r.name) for r in projects.collect()] == [("c", "c"), ("d", "own"), ("a/b", "a-b")]


def test_index_git_and_command_line(spark, tmp_path):
    repo, root = tmp_path / "repo", f"file://{tmp_path}/store"
    (repo / "pkg").mkdir(parents=True)
    git_ = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    (repo / "pkg/a.py").write_text("import numpy\nclass Base:\n    def go(self):\n        return helper()\ndef helper():\n    return 1\n__all__ = ['helper']\n")
    (repo / "pkg/b.ts").write_text("export class Sub extends Base { go() { helper() } }\n")
    git_("init", "-q")
    git_("add", ".")
    git_("commit", "-qm", "one")
    first = git.current_commit(str(repo))
    (repo / "pkg/c.py").write_text("def test_helper():\n    helper()\n")
    git_("rm", "-q", "pkg/b.ts")
    git_("add", ".")
    git_("commit", "-qm", "two")
    assert {tuple(r) for r in git.changed_files(spark, str(repo), first).collect()} == {("pkg/c.py", "created"), ("pkg/b.ts", "deleted")}
    assert sorted((r.file, r.author) for r in git.history(spark, str(repo)).collect()) == [("pkg/a.py", "e@x"), ("pkg/b.ts", "e@x"), ("pkg/b.ts", "e@x"), ("pkg/c.py", "e@x")]
    out = run(spark, [root, "index", str(repo), "--project", "p"])
    assert out["results"][0]["change"] == "added"
    store = GraphStore(spark, root)
    e = {(r.from_uid, r.rel_type, r.to_uid) for r in store.edges.collect()}
    assert {("p:pkg.a.Base.go", "CALLS", "p:pkg.a.helper"), ("p:pkg.a", "DEFINES", "p:pkg.a.Base"), ("p:pkg.a.Base", "DEFINES", "p:pkg.a.Base.go"), ("p:pkg.a", "IMPORTS", "p:ext/numpy"), ("p:pkg.c.test_helper", "TESTS", "p:pkg.a.helper")} <= e
    assert run(spark, [root, "node", "helper"])["results"][0]["uid"] == "p:pkg.a.helper" and run(spark, [root, "search", "helper"])["count"] >= 1
    assert run(spark, [root, "mine-git-history", str(repo), "--project", "p"]) == {"files": 2} and run(spark, [root, "health"])[2][1] == "ok"
    assert run(spark, [root, "sql", "SELECT uid FROM nodes WHERE label = 'TypeDef'", "--limit", "1"])["count"] == 1 and "impact UID" in run(spark, [root, "guide"])
    indexing.register_detector("none", lambda n, e: e.where("false").select("from_uid", "to_uid", "rel_type"))
    indexing.run_detectors(GraphStore(spark, root), "none")
    kinds = spark.createDataFrame([("u", ["dataclass(frozen=True)"], None), ("v", None, ["BaseModel"]), ("w", ["x"], ["Y"])], "uid string, tags array<string>, bases array<string>")
    assert {r.uid: r.props["synthesis_framework"] for r in indexing.synthesised(kinds).collect()} == {"u": "dataclasses", "v": "pydantic"}
    assert run(spark, [root, "rm", "p"]) == {"removed": "p"} and GraphStore(spark, root).nodes.count() == 0
