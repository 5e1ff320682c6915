"""Scenarios on small graphs: traversal, analysis, resolution, change, search."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analysis as A
from graphloom.operators import delta as D
from graphloom.operators import resolve as R
from graphloom.operators import search as S
from graphloom.operators import traversal as V
from graphloom.schema import EDGE_SCHEMA, NODE_SCHEMA, conform, contract_violations


def node_rows(*names, label="Callable", **more):
    return [{"uid": f"p:{n}", "label": label, "project_name": "p", "name": n.split(".")[-1], "qualified_name": n, "file_path": n.split(".")[0] + ".py", "visibility": "public", "line_start": 1, "line_end": 5} | more for n in names]


@pytest.fixture(scope="module")
def make(spark):
    def nodes(*groups):
        return spark.createDataFrame([{f.name: r.get(f.name) for f in NODE_SCHEMA} for g in groups for r in g], NODE_SCHEMA)

    def edges(*rows):
        return spark.createDataFrame([{f.name: dict(zip(("from_uid", "to_uid", "rel_type"), (f"p:{r[0]}", f"p:{r[1]}", r[2]), strict=True), **(r[3] if len(r) > 3 else {})).get(f.name) for f in EDGE_SCHEMA} for r in rows], EDGE_SCHEMA)

    return nodes, edges


def ids(df, column="uid"):
    return sorted(r[column].removeprefix("p:") for r in df.collect())


def test_trace_path(make):
    _, edges = make
    e = edges(("a", "b", "CALLS", {"weight": 0.5}), ("b", "c", "CALLS"), ("a", "x", "CALLS"), ("x", "c", "CALLS"), ("c", "a", "CALLS"))
    assert [(r.hop, r.from_uid, r.to_uid, r.weight) for r in V.trace_path(e, "p:a", "p:c").orderBy("hop").collect()] == [(1, "p:a", "p:x", 1.0), (2, "p:x", "p:c", 1.0)]
    assert V.trace_path(e, "p:a", "p:c", max_depth=1).count() == 0
    assert V.trace_path(e, "p:a", "p:absent").count() == 0 and V.trace_path(e, "p:a", "p:a").count() == 0


def test_blast_radius(make):
    _, edges = make
    e = edges(("r", "t", "CALLS", {"confidence": "resolved", "weight": 1.0, "line": 3}), ("m", "t", "CALLS", {"confidence": "ambiguous", "weight": 0.5}), ("u", "m", "CALLS", {"from_test": True, "weight": 0.5}), ("t", "u", "CALLS"))
    got = {r.uid[2:]: (r.min_depth, r.score, r.ambiguous_only, r.test_only, r.line) for r in V.blast_radius(e, "p:t").collect()}
    assert got == {"r": (1, 1.0, False, False, 3), "m": (1, 0.5, True, False, None), "u": (2, 0.25, True, True, None)}
    assert V.blast_radius(e, "p:none").count() == 0
    assert ids(V.reach(e, "p:t", "callers", 1)) == ["m", "r"]


def test_cycles_and_communities(spark, make):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "g")], "a string, b string")
    assert sorted(map(tuple, V.strongly_connected(e).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert V.strongly_connected(e.where("false")).count() == 0
    cliques = [(x, y, 1.0) for g in ("abc", "xyz") for x in g for y in g if x < y] + [("c", "x", 0.25)]
    found = V.greedy_communities(cliques)
    assert found == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1} == V.greedy_communities(cliques[::-1])
    q = V.modularity(spark.createDataFrame(cliques, "a string, b string, weight double"), spark.createDataFrame(list(found.items()), "node string, community int")).first()[0]
    assert abs(q - (2 * (3 / 6.25 - (6.25 / 12.5) ** 2))) < 1e-9
    assert V.topological_order(["a", "b", "c"], {"a": {"b"}, "b": {"c"}}) == ["c", "b", "a"]
    assert V.topological_order(["a", "b"], {"a": {"b"}, "b": {"a"}}) == ["a", "b"]


def test_analysis(make):
    nodes, edges = make
    n = nodes(node_rows("m", "k", label="Module"), node_rows("m.f", "m.g", "k.h"), node_rows("m.T", label="TypeDef", kind="class", docstring="d"), node_rows("m.T.x", line_end=105), node_rows("m.deco", decorator_name="route"), node_rows("m.__init__"))
    e = edges(("m", "m.f", "DEFINES"), ("k", "k.h", "DEFINES"), ("m.T", "m.T.x", "DEFINES"), ("k.h", "m.T.x", "CALLS"), ("k", "m.f", "IMPORTS"), ("m", "k", "IMPORTS"))
    assert ids(A.dead_code(n, e)) == ["k.h", "m.g"]
    assert [(r.uid, r.span) for r in A.complexity(n, 1).collect()] == [("p:m.T.x", 104)]
    assert {(r.from_mod, r.to_mod, r.weight) for r in A.module_imports(n, e).collect()} == {("p:k", "p:m", 1), ("p:m", "p:k", 1)}
    hubs = {r.uid: r.total for r in A.hubs(e).collect()}
    assert hubs["p:m.T.x"] == 1 and "p:m.T.x" not in {r.uid for r in A.leaves(n, e).collect()}
    assert {r.label: r.percent for r in A.doc_coverage(n).collect()} == {"TypeDef": 100.0, "Callable": 0.0}
    assert {r.uid: r.instability for r in A.quality(n, e).collect()} == {"p:m": 0.5, "p:k": 0.5}
    assert A.mermaid(A.module_imports(n, e), "from_mod", "to_mod").startswith("graph LR") and "-->" in A.import_outline(A.module_imports(n, e))
    assert contract_violations(n, e).count() == 0
    assert {r.rule for r in contract_violations(n.unionByName(n.limit(1)), e.withColumn("to_uid", F.lit("p:zz"))).collect()} >= {"duplicate uid", "dangling end"}
    assert conform(n.select("uid", "label", "project_name"), NODE_SCHEMA).columns == NODE_SCHEMA.names


def test_lint(make):
    nodes, edges = make
    n = nodes(node_rows("a", "b", "c", label="Note"))
    e = edges(("a", "b", "LINKS_TO"), ("a", "gone", "LINKS_TO"))
    assert ids(A.dangling_links(e, n), "to_uid") == ["gone"] and ids(A.orphan_notes(n, e)) == ["c"]
    assert A.duplicate_ids(n.unionByName(n)).count() == 3
    listed, present = (n.select(F.col("name").alias("path")).where(c) for c in ("name <> 'c'", "name <> 'a'"))
    assert {tuple(r) for r in A.index_drift(listed, present).collect()} == {("a", "missing"), ("c", "unlisted")}


def test_resolution(spark, make):
    sites = spark.createDataFrame(
        [(1, "u1", "p", "f", "a.py", 1, "A", None, False, False), (2, "u2", "p", "f", "z.py", 2, "Z", None, False, False), (3, "u3", "p", "f", "a.py", 3, "A", None, True, False), (4, "u4", "p", "f", "q.py", 3, None, "Unknown", True, False), (5, "u5", "p", "f", "i.py", 1, None, None, False, False)],
        "site_id int, from_uid string, project_name string, name string, file_path string, line int, owner string, receiver string, has_receiver boolean, from_test boolean",
    )
    callables = spark.createDataFrame([("c1", "p", "f", "a.py", "A", False), ("c2", "p", "f", "b.py", "B", False), ("c3", "p", "f", "tests/t.py", None, False), ("c4", "p", "f", "c.py", "C", True)], "uid string, project_name string, name string, file_path string, owner string, is_abstract boolean")
    imports = spark.createDataFrame([("i.py", "c2")], "from_file string, to_uid string")
    got = {(r.site_id, r.to_uid): (r.strategy, r.candidate_count) for r in R.resolve_calls(sites, callables, imports, F.col("c.file_path").startswith("tests/")).collect()}
    assert got == {(1, "c1"): ("same_file", 1), (2, "c1"): ("project_wide", 2), (2, "c2"): ("project_wide", 2), (3, "c1"): ("sibling", 1), (5, "c2"): ("import", 1)}
    files = spark.createDataFrame([("m1", "src/a/x.py"), ("m2", "src/b/x.py"), ("m3", "src/b/y.py")], "uid string, file_path string")
    refs = spark.createDataFrame([(1, "x.py"), (2, "b/x.py"), (3, "src/a/x.py"), (4, "y.py"), (5, "no.py")], "ref_id int, path string")
    assert {(r.ref_id, r.uid) for r in R.resolve_paths(refs, files).collect()} == {(2, "m2"), (3, "m1"), (4, "m3")}
    keys = spark.createDataFrame([("ADR-1", "d1", 0), ("ADR-1", "d2", 1), ("ADR-2", "d1", 1), ("ADR-2", "d2", 1)], "key string, doc_uid string, rank int")
    cited = spark.createDataFrame([("e", "ADR-1"), ("e", "ADR-2")], "entity_uid string, key string")
    assert {tuple(r) for r in R.resolve_citations(cited, keys).collect()} == {("e", "ADR-1", "d1", 1.0), ("e", "ADR-2", None, None)}
    members = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "uid string, member string")
    proto = spark.createDataFrame([("P", "a"), ("P", "b"), ("P", "__init__")], "uid string, member string")
    assert [(r.from_uid, r.to_uid) for r in R.protocol_conformance(members, proto).collect()] == [("t", "P")]
    nodes, edges = make
    n = nodes(node_rows("T", "B", label="TypeDef", kind="class"), node_rows("T.x", "B.x", "T.y"), node_rows("TestB", label="TypeDef"))
    d = edges(("T", "T.x", "DEFINES"), ("B", "B.x", "DEFINES"), ("T", "T.y", "DEFINES"))
    assert [tuple(r) for r in R.overrides(edges(("T", "B", "INHERITS")), d, n).collect()] == [("p:T.x", "p:B.x", "OVERRIDES")]
    assert [tuple(r) for r in R.test_targets(n).collect()] == [("p:TestB", "p:B", "TESTS")]
    app = nodes(node_rows("w", label="Module", source="x = 1\n__all__ = ['get', \n 'Gone']"), node_rows("w.get", "w.hid"), node_rows("w.use", signature="(a=Depends(get), b: int = 1)"))
    assert [tuple(r) for r in R.injected(app).collect()] == [("p:w.get", "p:w.use", "INJECTED_INTO")]
    assert [tuple(r) for r in R.module_exports(app, edges(("w", "w.get", "DEFINES"), ("w", "w.hid", "DEFINES"))).collect()] == [("p:w", "p:w.get", "EXPORTS")]
    env, links = R.config_refs(spark.createDataFrame([("a", "p", "env", "HOME"), ("b", "q", "env", "HOME"), ("a", "p", "file", "x.json")], "from_uid string, project_name string, kind string, target string"))
    assert {tuple(r) for r in env.collect()} == {("env/HOME", "EnvVar", "_global", "HOME"), ("p:res/x.json", "ResourceFile", "p", "x.json")} and links.count() == 3
    anchors = spark.createDataFrame([(1, "n", "x.py#f"), (2, "n", "x.py"), (3, "n", "no.py")], "anchor_id int, note_uid string, anchor string")
    ents = nodes(node_rows("x", label="Module", content_hash="h"), node_rows("x.f", content_hash="g"))
    hit = R.resolve_anchors(anchors, ents).cache()
    assert {(r.anchor_id, r.to_uid) for r in hit.collect()} == {(1, "p:x.f"), (2, "p:x"), (3, None)}
    changed = ents.withColumn("content_hash", F.when(F.col("uid") == "p:x", "new").otherwise(F.col("content_hash")))
    assert {r.anchor_id for r in R.stale_anchors(hit.where("to_uid is not null"), changed).where("stale").collect()} == {2}


def test_change(make):
    nodes, edges = make
    old = nodes(node_rows("a", "b", "c", "d", content_hash="1", signature="s", docstring="d"))
    new = nodes(node_rows("a", content_hash="1", signature="s", docstring="d"), node_rows("b", content_hash="2", signature="s", docstring="e"), node_rows("c", content_hash="1", signature="s", docstring="d", line_start=9), node_rows("e", content_hash="1"))
    got = {r.uid[2:]: (r.change, r.significance) for r in D.classify(old, new).collect()}
    assert got == {"a": ("unchanged", None), "b": ("modified", "MODERATE"), "c": ("moved", None), "d": ("deleted", "HIGH"), "e": ("added", "HIGH")}
    merged = D.upsert(old, new, "uid")
    assert merged.count() == 5 and merged.where("uid = 'p:e'").first().signature is None and D.upsert(merged, new, "uid").count() == 5
    n = nodes(node_rows("a.f", "a.g", "b.h"))
    e = edges(("b.h", "a.f", "CALLS"), ("a.g", "b.h", "CALLS"), ("b.h", "a.g", "DEFINES"))
    kept, left = D.delete_files(n, e, "p", ["a.py"])
    assert ids(kept) == ["a.f", "b.h"] and [(r.from_uid, r.to_uid) for r in left.collect()] == [("p:b.h", "p:a.f")]
    assert D.index_mode(1, 10, True) == "delta" and D.index_mode(4, 10, True) == "full" and D.index_mode(0, 10, False) == "full"


def test_search(spark, make):
    nodes, _ = make
    n = nodes(node_rows("m.run", "m.run.inner", "m.rerun", "run"))
    assert [(r.uid[2:], r.score) for r in S.graph_search(n, "run").collect()] == [("m.run", 3.0), ("run", 3.0), ("m.rerun", 1.0), ("m.run.inner", 1.0)]
    fused = {r.uid: r.score for r in S.rank_fusion(spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", "y", 2)], "channel string, uid string, rank int")).collect()}
    assert abs(fused["x"] - (1 / 61 + 1 / 62)) < 1e-12 and abs(fused["y"] - 1 / 62) < 1e-12
    assert S.expand_scope("", ["a"]) is None and S.expand_scope("a*,z", ["ab", "b"], ("lib",)) == ["ab", "lib"] and S.expand_scope("zz", ["a"]) == []
    assert S.analyse_query("get_node")["graph"] == 2.0 and S.analyse_query("how does it work")["vector"] == 2.0
    hits = spark.createDataFrame([("Callable", "tests/a.py", "f"), ("Callable", "src/a.py", "f"), ("Callable", "x_pb2.py", "f"), ("Note", "src/n.md", "n"), ("Callable", "a.pyi", "f")], "label string, file_path string, name string")
    assert [r.file_path for r in S.filter_hits(hits, code_only=True, tests=False, stubs=False, generated=False).collect()] == ["src/a.py"]
    assert S.filter_hits(hits, include=["src/*"], exclude=["*.md"]).count() == 1
    assert S.pack_context([("caller", "a " * 30), ("target", "b " * 50)], 60) == [("target", "b " * 50)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "uid long, embedding array<float>")
    assert {(r.a, r.b) for r in S.similar_pairs(v, 0.95, 3).collect()} == {(1, 2), (1, 4), (2, 4)}
    assert [r.uid for r in S.vector_search(v, [1.0, 0.0], 2).collect()] == [1, 4]
