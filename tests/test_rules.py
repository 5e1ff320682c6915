"""Rules of the analyses and searches on small graphs, worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.operators import analysis as A
from graphloom.operators import delta as D
from graphloom.operators import resolve as R
from graphloom.operators import search as S
from graphloom.operators import traversal as V
from graphloom.plans.guard import check_sql, plan_search
from graphloom.sources.store import ConflictError, GraphStore
from graphloom.streaming import events as E

NODES = "uid string, label string, project_name string, name string, qualified_name string, file_path string, kind string, visibility string, docstring string, line_start int, line_end int"
EDGES = "from_uid string, to_uid string, rel_type string, weight double, confidence string, from_test boolean, line int"


@pytest.fixture(scope="module")
def make(spark):
    def nodes(**labels):
        rows = [(n, label, "p", n.split(".")[-1], n, n.split(".")[0] + ".py", "function" if label == "Callable" else "class", "public", None, 1, 5) for label, names in labels.items() for n in names.split()]
        return spark.createDataFrame(rows, NODES)

    def edges(*rows):
        return spark.createDataFrame([(*r, *([None] * (7 - len(r)))) for r in rows], EDGES)

    return nodes, edges


def test_directions(make):
    nodes, edges = make
    e = edges(("x", "y", "CALLS"), ("y", "z", "CALLS", 0.5, "ambiguous", True))
    near = lambda d, at="y": {r.uid: (r.min_depth, r.score, r.ambiguous_only, r.test_only) for r in V.blast_radius(e, at, d, 2).collect()}
    assert near("callers") == {"x": (1, 1.0, False, False)} and near("callees") == {"z": (1, 0.5, True, True)}
    assert near("both") == {**near("callers"), **near("callees")}
    assert {(r.uid, r.min_depth) for r in V.reach(e, "y", "both", 2).collect()} == {("x", 1), ("z", 1)}
    with pytest.raises(ValueError):
        V.blast_radius(e, "y", "sideways")
    n = nodes(Callable="x y z")
    with pytest.raises(V.NotFoundError):
        V.trace_path(e, "x", "gone", nodes=n)
    assert [r.to_uid for r in V.trace_path(e, "x", "z", nodes=n).orderBy("hop").collect()] == ["y", "z"]
    ranked = V.ranked_impact(V.blast_radius(e, "y", "both", 2), n, 1).collect()
    assert [(r.uid, r.affected_count) for r in ranked] == [("x", 2)]
    both = edges(("a", "b", "CALLS"), ("b", "a", "CALLS"))  # equally near over both sides: the callee's facts
    assert V.blast_radius(both, "a", "both", 1).first().min_depth == 1


def test_trace_prefers_weight_then_names(make):
    _, edges = make
    e = edges(("a", "m", "CALLS", 0.5), ("a", "n", "CALLS", 0.5), ("m", "z", "CALLS", 1.0), ("n", "z", "CALLS", 1.0), ("a", "o", "CALLS", 0.4), ("o", "z", "CALLS", 1.0))
    assert [r.from_uid for r in V.trace_path(e, "a", "z").orderBy("hop").collect()] == ["a", "m"]


def test_long_chain_of_cycles(spark):
    pairs = [(f"{i:03d}a", f"{i:03d}b") for i in range(60)] + [(f"{i:03d}b", f"{i:03d}a") for i in range(60)] + [(f"{i:03d}b", f"{i + 1:03d}a") for i in range(59)]
    for local in (0, V.LOCAL_EDGES):
        found = V.strongly_connected(spark.createDataFrame(pairs, "a string, b string"), local).collect()
        assert {(r.node, r.component) for r in found} == {(f"{i:03d}{x}", f"{i:03d}a") for i in range(60) for x in "ab"}
    rnd = random.Random(3)
    some = [(f"{rnd.randrange(40):02d}", f"{rnd.randrange(40):02d}") for _ in range(60)]
    df = spark.createDataFrame(some, "a string, b string")
    assert sorted(map(tuple, V.strongly_connected(df, 0).collect())) == sorted(map(tuple, V.strongly_connected(df).collect()))


def test_quality_rules(make):
    nodes, edges = make
    n = nodes(Module="a.x a.y b.z top test_m", Callable="a.x.f")
    e = edges(("a.x", "a.y", "IMPORTS"), ("a.y", "a.x", "IMPORTS"), ("a.x", "b.z", "IMPORTS"), ("top", "b.z", "IMPORTS"), ("test_m", "a.x", "IMPORTS"), ("a.x", "a.x.f", "DEFINES"))
    flags = {r.uid: r for r in A.quality(n, e).collect()}
    assert set(flags) == {"a.x", "a.y", "b.z", "top"} and flags["a.x"].fan_in == 1 and flags["b.z"].is_rigid and flags["top"].is_unstable
    assert A.quality(n, e, tests=True).count() == 5
    cycles = V.strongly_connected(A.module_imports(n, e).select(F.col("from_mod").alias("a"), F.col("to_mod").alias("b")))
    score = A.health_score(n, e, cycles).first()
    # two of four imports stay in their package; one cycle; one rigid and one unstable module; fans of 2 and 2
    assert (score.modularity_ratio, score.god, score.circular, score.tangled, score.extreme, score.max_fan_in, score.max_fan_out) == (0.5, 0, 1, 0, 2, 2, 2)
    assert score.score == round(50 * 0.25 + 100 * 0.2 + 85 * 0.2 + 100 * 0.15 + 100 * 0.1 + 70 * 0.1)
    worst = {r.uid: r.issues for r in A.worst_modules(A.quality(n, e), cycles.select(F.col("node").alias("uid"))).collect()}
    assert worst == {"a.x": 1, "a.y": 1, "b.z": 1, "top": 1}
    empty = A.health_score(n.where("false"), e.where("false"), cycles.where("false")).first()
    assert empty.modularity_ratio == 1.0 and empty.score == 100
    top = A.coupling(nodes(Module="s t"), A.module_imports(nodes(Module="s t"), edges(("s", "t", "IMPORTS"))))
    assert top.count() == 0  # both are in the empty package


def test_dead_code_rules(make):
    nodes, edges = make
    n = nodes(Callable="m.f m.__mangled m.__init__ m.live").unionByName(nodes(TypeDef="m.T").withColumn("kind", F.lit("table"))).unionByName(nodes(Callable="m.p").withColumn("kind", F.lit("property")))
    assert {r.uid for r in A.dead_code(n, edges(("m.f", "m.live", "REFERENCES"))).collect()} == {"m.f"}


def test_scalar_rules(spark):
    names = ["_x", "__x", "__x__", "x", "_"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.v for r in df.select("n", X.name_visibility(F.col("n")).alias("v")).collect()} == {"_x": "private", "__x": "private", "__x__": "public", "x": "public", "_": "private"}
    texts = ["a \n\n\n\nb", "a\n\nb\n", "a\r\n\r\nb", "a\r\rb"]
    hashes = {r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.file_hash(F.col("t"))).collect()}
    assert len(hashes) == 1
    paths = [("Tests\\a.py", "f", True), ("src/Test_A.py", "f", True), ("src/a.py", "TEST_f", True), ("src/a.py", None, False), ("contests/a.py", "f", False)]
    got = spark.createDataFrame(paths, "p string, n string, want boolean").select("want", X.is_test(F.col("p"), F.col("n")).alias("is")).collect()
    assert all(r.want == r["is"] for r in got)
    c = spark.createDataFrame([("f", "function", "public", ["b", "a"], None), ("f", "function", "public", ["a", "b"], "")], "name string, kind string, visibility string, tags array<string>, rationale string")
    assert c.select(X.content_hash(F.col("name"), F.col("kind"), F.col("visibility"), tags=F.col("tags"), rationale=F.col("rationale"))).distinct().count() == 1


def test_null_and_moved_values(spark):
    cols = "uid string, content_hash string, signature string, docstring string, line_start int, line_end int"
    old = spark.createDataFrame([("a", "1", "s", "d", 1, 5), ("b", "1", None, None, 1, 5), ("c", "1", "s", "d", 1, 5)], cols)
    new = spark.createDataFrame([("a", "1", "s", "d", 1, 6), ("b", "2", "", "d", 1, 5), ("c", "2", "s", "d", 1, 5)], cols)
    assert {r.uid: (r.change, r.significance) for r in D.classify(old, new).collect()} == {"a": ("moved", None), "b": ("modified", "MODERATE"), "c": ("modified", "HIGH")}
    merged = D.upsert(old, new.where("uid = 'a'").select("uid", F.lit(None).cast("string").alias("docstring")), "uid")
    row = merged.where("uid = 'a'").first()
    assert row.docstring is None and row.signature == "s"  # a null is a value, a column that is not given stays


def test_co_changes_of_large_commits(spark):
    rows = [(c, 1, f"f{i:03d}") for c in range(3) for i in range(150)] + [(9, 1, "f001"), (9, 1, "g")]
    got = D.co_changes(spark.createDataFrame([(c, str(a), f) for c, a, f in rows], "commit_id int, author string, file string")).collect()
    assert len(got) == 150 * 149 // 2 and all(r["count"] == 3 and r.file_a < r.file_b for r in got)


def test_get_node(make):
    nodes, _ = make
    n = nodes(Callable="m.run m.run.inner m.rerun tests.run lib.run", ExternalSymbol="ext.run")
    assert [r.uid for r in S.get_node(n, "run").orderBy("place").collect()] == ["m.run", "lib.run", "m.rerun", "m.run.inner", "tests.run", "ext.run"]
    assert [r.uid for r in S.get_node(n, "run", limit=2, offset=1).orderBy("place").collect()] == ["lib.run", "m.run"][::-1]
    assert S.get_node(n, "run", label="ExternalSymbol").count() == 1
    cut = S.detail_view(n.withColumn("docstring", F.lit("x" * 300)).withColumn("source", F.lit("s"))).first()
    assert len(cut.docstring) == 203 and "source" not in cut.asDict()


def test_weights_and_channels(spark, make):
    nodes, _ = make
    assert S.analyse_query("get_node function")["graph"] == 2.0 and S.analyse_query("plain words")["graph"] == 1.0 and S.analyse_query("Parser please")["graph"] == 2.0
    assert S.channel_weights("how does it work", explicit={"graph": 9.0}) == {"graph": 9.0, "vector": 2.0, "bm25": 1.0}
    assert S.channel_status(("graph", "vector"), None, None) == {"graph": "used", "bm25": "off", "vector": "unavailable"}
    n = nodes(Callable="m.alpha m.beta")
    v = n.select("uid", F.when(F.col("uid") == "m.beta", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    docs = n.select("uid", "label", F.col("name").alias("text"))
    found = S.hybrid_search(n, docs, "alpha", 2, v, [1.0, 0.0], weights={"graph": 0.1, "bm25": 0.1, "vector": 50.0}).collect()
    assert [r.uid for r in found] == ["m.beta", "m.alpha"] and set(found[1].ranks) == {"graph", "bm25", "vector"}
    scored = S.bm25_indexed(S.postings(docs), S.text_statistics(docs), "alpha").collect()
    assert [(r.uid, round(r.score, 9)) for r in scored] == [(r.uid, round(r.score, 9)) for r in S.bm25(docs, "alpha").collect()] and S.bm25_indexed(S.postings(docs), S.text_statistics(docs), "").count() == 0
    a, b, c = (S.hashed_vector(t) for t in ("read the table", "reads the tables", "unrelated words"))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, b) > dot(a, c) and abs(dot(a, a) - 1) < 1e-9 and S.hashed_vector("") == [0.0] * 64


def test_context_order(make):
    nodes, edges = make
    n = nodes(Callable="p.q.t p.q.c longer.name.c2 x.c3 tests.c4", Note="note", TypeDef="x.T")
    e = edges(*((c, "p.q.t", "CALLS") for c in ("p.q.c", "longer.name.c2", "x.c3", "tests.c4", "x.T")), ("note", "p.q.t", "DOCUMENTS"), ("x.T", "p.q.t", "DOCUMENTS"))
    got = S.expand_context(n, e, "p.q.t").orderBy("role", "place").collect()
    assert [r.uid for r in got if r.role == "caller"] == ["p.q.c", "x.c3", "longer.name.c2", "tests.c4"] and [r.uid for r in got if r.role == "doc"] == ["note"]


def test_communities_split():
    clique = lambda names, w=1.0: [(a, b, w) for i, a in enumerate(names) for b in names[i + 1 :]]
    # many cliques in a ring: plain modularity fuses neighbours, the second look takes them apart
    ring = [x for k in range(24) for x in clique([f"{k:02d}{c}" for c in "abc"])] + [(f"{k:02d}a", f"{(k + 1) % 24:02d}b", 1.0) for k in range(24)]
    whole, split = V.greedy_communities(ring, split=False), V.greedy_communities(ring)
    assert len(set(split.values())) > len(set(whole.values())) and all(split[f"{k:02d}a"] == split[f"{k:02d}c"] for k in range(24))
    assert V.greedy_communities(ring[::-1]) == split and V.greedy_communities([]) == {}


def test_summary_and_diagrams(make):
    nodes, edges = make
    n = nodes(Module="m k", TypeDef="m.T m.B", Callable="m.T.f k.g").withColumn("signature", F.lit("(x)")).withColumn("docstring", F.lit("says what"))
    e = edges(("m", "m.T", "DEFINES"), ("m", "m.B", "DEFINES"), ("m.T", "m.T.f", "DEFINES"), ("m.T", "m.B", "INHERITS"), ("k.g", "m.T.f", "CALLS"), ("k", "m", "IMPORTS"), ("m.T.f", "m.T.f", "CALLS"))
    assert {r.measure: r.value for r in A.module_summary(n, e, "m.py").collect()} == {"modules": 1, "entities": 3, "internal": 1, "fan_in": 2}
    full, names = A.summary_text(n, e, "m.py"), A.summary_text(n, e, "m.py", most=10)
    assert "says what" in full and "(x)" in full and "# fan_in\nk.g -CALLS-> m.T.f" in full and "(x)" not in names
    assert [(r.child, r.parent) for r in A.inheritance_diagram(n, e).collect()] == [("T", "B")]
    assert [(r.owner, r.name) for r in A.module_detail(n, e, "m.py").collect()] == [(None, "B"), (None, "T"), ("T", "f")]
    pairs = A.module_imports(n, e)
    assert A.within_budget(pairs, 1).count() == 0 and A.within_budget(pairs, 2).count() == 1
    assert A.truncation_notice(3, 3, "") is None and A.truncation_notice(3, 5, "raise it")["cut"] == 2
    assert [(r.uid, r.importers) for r in A.hub_modules(n, e).collect()] == [("m", 1)]


def test_links(spark, make):
    nodes, edges = make
    n = nodes(Callable="a.f b.f c.g", Note="h")
    refs = spark.createDataFrame([(1, "d", "p", "g", False), (2, "d", "p", "f", False), (3, "d", "p", "c.py", True), (4, "d", "p", "h", False)], "ref_id int, from_uid string, project_name string, target string, is_file boolean")
    refs = refs.withColumn("link_type", F.lit("mention")).withColumn("confidence", F.lit(0.4))
    assert {(r.from_uid, r.to_uid) for r in R.doc_links(refs, n).collect()} == {("d", "c.g")} and R.doc_links(refs, n).count() == 2
    found, left = R.replay(refs, lambda r: r.where("ref_id < 3"))
    assert found.count() == 2 and [r.ref_id for r in left.orderBy("ref_id").collect()] == [3, 4]
    d = edges(("T", "T.f", "DEFINES"), ("P", "P.f", "DEFINES"), ("P", "P.__init__", "DEFINES"), ("T", "T.__init__", "DEFINES"))
    members = R.protocol_members(edges(("T", "P", "IMPLEMENTS")), d, nodes(Callable="T.f P.f P.__init__ T.__init__"))
    assert [(r.from_uid, r.to_uid) for r in members.collect()] == [("T.f", "P.f")]


def test_store_writers(spark, tmp_path):
    root, cols = f"file://{tmp_path}/graph", "uid string, label string, project_name string, qualified_name string, file_path string, name string, content_hash string, docstring string"
    one, two = GraphStore(spark, root), GraphStore(spark, root)
    n = spark.createDataFrame([("p:m", "Module", "p", "m", "m.py", "m", "1", "said"), ("p:m.f", "Callable", "p", "m.f", "m.py", "f", "1", "said")], cols)
    one.upsert(n)
    with pytest.raises(ConflictError):
        two.upsert(n)
    two = GraphStore(spark, root)
    two.enrich(spark.createDataFrame([("p:m.f", {"seen": "yes"})], "uid string, props map<string,string>"))
    two.upsert(n.withColumn("docstring", F.lit(None).cast("string")).withColumn("content_hash", F.lit("2")))
    row = two.entity("p:m.f").first()
    assert row.docstring is None and row.props == {"seen": "yes"}
    assert dict((a, b) for a, b, _ in two.health()) == {"store": "ok", "index": "ok", "contract": "ok"} and "Callable" in two.schema()["node_labels"]
    assert [r.project_name for r in two.projects().collect()] == ["p"] and [r.uid for r in two.get_node("f").collect()][0] == "p:m.f"
    with pytest.raises(V.NotFoundError):
        two.impact("p:gone")
    with pytest.raises(ValueError):
        two.diagram("pie")
    assert two.diagram("module_detail", "m.py").startswith("graph LR") and "## m" in two.summary("m.py")


def test_guard_and_streams(spark):
    assert any("does not parse" in e for e in check_sql("SELECT a b c d FROM x LIMIT 1", spark)) and check_sql("SELECT 1 LIMIT 1", spark) == []
    assert plan_search("who calls f")["relationship"] == "CALLS" and plan_search("why so")["options"] == {"mode": "knowledge"} and plan_search("get_node")["tool"] == "get_node"
    changes = spark.createDataFrame([("a", "added", "HIGH"), ("b", "modified", "MODERATE"), ("c", "deleted", "HIGH"), ("d", "moved", None)], "uid string, change string, significance string")
    assert {r.uid for r in E.significant(changes).collect()} == {"a", "b"} and {r.uid for r in E.significant(changes, "HIGH").collect()} == {"a"}
    backlog = changes.select("uid").withColumn("tries", F.when(F.col("uid") == "a", 5).otherwise(1))
    now, gone = E.with_backlog(spark.createDataFrame([("n",)], "uid string"), backlog)
    assert {r.uid for r in now.collect()} == {"n", "b", "c", "d"} and [r.uid for r in gone.collect()] == ["a"]
