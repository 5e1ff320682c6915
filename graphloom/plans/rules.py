"""More registered queries: upserts and deletions, predicates, text facts, detectors, prefixes and spans, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.operators import analysis as A
from graphloom.operators import delta as D
from graphloom.operators import resolve as R
from graphloom.operators import search as S
from graphloom.plans.catalogue import query
from graphloom.sources import extract, files
from graphloom.sources.graph import Tables, calls, edges, nodes


def text(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


# ---------------------------------------------------------------- parameters, upsert, deletion


@query("SELECT uid, label FROM nodes JOIN (VALUES ('p:1'), ('o:7'), ('n:3'), ('gone')) v(u) ON uid = u")
def existing_uids(t):
    wanted = t.spark.createDataFrame([("p:1",), ("o:7",), ("n:3",), ("gone",)], "uid string")
    return nodes(t).select("uid", "label").join(F.broadcast(wanted), "uid", "left_semi")  # the parameters of one call


def _accounts(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    old = t.customer.where(k % 3 != 0).select(k.alias("uid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("docstring"), F.col("c_nationkey").alias("line"))
    new = t.customer.where(k % 4 != 0).select(k.alias("uid"), F.concat(F.col("c_name"), F.lit("!")).alias("name"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("docstring"))
    return old, new


_ACCOUNTS = """WITH o AS (SELECT c_custkey AS uid, c_name AS name, c_mktsegment AS docstring, c_nationkey AS line FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS uid, c_name || '!' AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS docstring FROM customer WHERE c_custkey % 4 <> 0)"""


@query(f"{_ACCOUNTS} SELECT coalesce(n.uid, o.uid) AS uid, CASE WHEN n.uid IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.uid IS NULL THEN o.docstring ELSE n.docstring END AS docstring, line FROM o FULL JOIN n ON o.uid = n.uid", graph=False)
def merge_upsert(t):
    return D.upsert(*_accounts(t), "uid")


@query(f"{_ACCOUNTS} SELECT uid, name, docstring FROM o UNION ALL SELECT uid, name, docstring FROM n WHERE uid NOT IN (SELECT uid FROM o)", graph=False)
def insert_missing(t):
    old, new = _accounts(t)
    return D.insert_missing(old.select("uid", "name", "docstring"), new, "uid")


_GONE = """, gone AS (SELECT uid FROM nodes WHERE project_name = 'ASIA' AND file_path IN ('ASIA/INDIA', 'ASIA/CHINA')),
held AS (SELECT DISTINCT to_uid AS uid FROM edges WHERE rel_type NOT IN ('DEFINES', 'DOCUMENTS') AND from_uid NOT IN (SELECT uid FROM gone) AND to_uid IN (SELECT uid FROM gone)),
removed AS (SELECT uid FROM gone WHERE uid NOT IN (SELECT uid FROM held))"""


def _after_deletion(t: Tables) -> tuple[DataFrame, DataFrame]:
    return D.delete_files(nodes(t), edges(t), "ASIA", ["ASIA/INDIA", "ASIA/CHINA"])


@query(f"{_GONE} SELECT label, count(*) AS n FROM nodes WHERE uid NOT IN (SELECT uid FROM removed) GROUP BY label")
def delete_files_nodes(t):
    return A.label_counts(_after_deletion(t)[0])


@query(f"{_GONE} SELECT rel_type, count(*) AS n FROM edges WHERE from_uid NOT IN (SELECT uid FROM gone) AND to_uid NOT IN (SELECT uid FROM removed) GROUP BY rel_type")
def delete_files_edges(t):
    return _after_deletion(t)[1].groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rel_type, count(*) AS n FROM edges JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid WHERE a.project_name <> 'ASIA' AND b.project_name <> 'ASIA' GROUP BY rel_type")
def delete_project_edges(t):
    return D.delete_project(nodes(t), edges(t), "ASIA")[1].groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS uid FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 0", graph=False)
def embedding_backlog(t):
    k = F.col("vec_id")
    n = t.embeddings.select(k.alias("uid"), F.when(k % 3 != 0, F.col("embedding")).alias("embedding"), F.when(k % 5 == 0, "old").otherwise(F.sha2(text("t", k), 256)).alias("embed_hash"))
    return D.embedding_backlog(n, text("t", F.col("uid"))).select("uid")


@query("SELECT DISTINCT 'h' || (doc_id % 300) AS text_hash FROM documents WHERE doc_id % 300 NOT IN (SELECT vec_id % 170 FROM embeddings)", graph=False)
def embedding_cache_misses(t):
    cached = t.embeddings.select(text("h", F.col("vec_id") % 170).alias("text_hash")).distinct()
    return D.uncached(t.documents.select(text("h", F.col("doc_id") % 300).alias("text_hash")), cached).select("text_hash")


# ---------------------------------------------------------------- predicates, JSON, text facts


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50", graph=False)
def json_property(t):
    return t.events.select("event_id", X.json_value(F.col("props"), "k").cast("long").alias("k")).where("k > 50")


_PATHS = "(SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'src/a/test_m.py' WHEN 1 THEN 'Tests\\x.py' WHEN 2 THEN 'lib/y.d.ts' WHEN 3 THEN 'gen/z_pb2.py' WHEN 4 THEN 'src/q.generated.ts' ELSE 'src/pkg/__init__.py' END AS path, 'm' || p_size AS name FROM part)"


def _paths(t: Tables) -> DataFrame:
    k, some = F.col("p_partkey"), ("src/a/test_m.py", "Tests\\x.py", "lib/y.d.ts", "gen/z_pb2.py", "src/q.generated.ts", "src/pkg/__init__.py")
    return t.part.select(k.alias("id"), F.element_at(F.array(*map(F.lit, some)), (k % 6 + 1).cast("int")).alias("path"), text("m", F.col("p_size")).alias("name"))


@query(f"SELECT id, id % 6 IN (0, 1) AS test, id % 6 = 2 AS stub, id % 6 IN (3, 4) AS generated, CASE id % 6 WHEN 5 THEN 'pkg' WHEN 0 THEN 'a.test_m' END AS module FROM {_PATHS}", graph=False)
def path_predicates(t):
    p, k = F.col("path"), F.col("id")
    return _paths(t).select("id", X.is_test(p, F.col("name")).alias("test"), X.is_stub(p).alias("stub"), X.is_generated(p).alias("generated"), F.when((k % 6).isin(0, 5), X.module_name(p)).alias("module"))


@query("SELECT uid FROM nodes WHERE starts_with(qualified_name, 'ASIA.') AND label = 'Callable' AND NOT (starts_with(name, 'test_') OR ends_with(name, '_test'))")
def qualified_test_filter(t):
    qn = F.when(F.col("qualified_name").startswith("ASIA."), F.col("qualified_name")).otherwise(F.concat(F.lit("tests."), F.col("qualified_name")))
    return nodes(t, ["Callable"]).where(~X.is_test_qualified(qn)).select("uid")


_NOTES = "(SELECT doc_id AS id, '# Title ' || doc_id || chr(10) || 'see [[Note ' || (doc_id % 9) || '|alias]] and [[Other#part]] #tag' || (doc_id % 5) || chr(10) || '## Part' || chr(10) || 'WHY: reason ' || doc_id AS text FROM documents)"


def _notes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(d.alias("id"), F.concat(text("# Title ", d), text("\nsee [[Note ", d % 9), text("|alias]] and [[Other#part]] #tag", d % 5), text("\n## Part\nWHY: reason ", d)).alias("text"))


@query(f"SELECT id, ['Note ' || (id % 9), 'Other'] AS links, ['tag' || (id % 5)] AS tags, ['1 Title ' || id, '2 Part'] AS headings, ['WHY: reason ' || id] AS rationale FROM {_NOTES}", graph=False)
def note_facts(t):
    c = F.col("text")
    trail = F.transform(X.headings(c), lambda h: F.concat_ws(" ", h["level"].cast("string"), h["title"]))
    return _notes(t).select("id", X.wikilinks(c).alias("links"), X.inline_tags(c).alias("tags"), trail.alias("headings"), X.rationale_markers(c).alias("rationale"))


@query("SELECT id, CASE id % 5 WHEN 0 THEN 'absolute' WHEN 1 THEN 'project_path' WHEN 2 THEN 'uid' ELSE 'path' END AS kind, id % 5 IN (3, 4) AS file FROM (SELECT p_partkey AS id FROM part)", graph=False)
def anchor_kinds(t):
    k = F.col("p_partkey")
    some = ("/x/y.py#f", "proj:a/b.py", "proj:a.b", "a/b.py#g", "data/x.json")
    a = F.element_at(F.array(*map(F.lit, some)), (k % 5 + 1).cast("int"))
    return t.part.select(k.alias("id"), X.anchor_kind(a).alias("kind"), X.is_resource_path(F.when(k % 5 == 3, "conf/b.yaml").otherwise(a)).alias("file"))


@query("SELECT uid, CASE label WHEN 'DocSection' THEN name || chr(10) || docstring WHEN 'Note' THEN name || chr(10) || 'a b' || chr(10) || docstring ELSE 'function ' || name || chr(10) || docstring || chr(10) || 'src' END AS text FROM (SELECT c_custkey AS uid, CASE c_custkey % 3 WHEN 0 THEN 'DocSection' WHEN 1 THEN 'Note' ELSE 'Callable' END AS label, c_name AS name, c_mktsegment AS docstring FROM customer)", graph=False)
def embed_texts(t):
    k, name, doc = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    label = F.when(k % 3 == 0, "DocSection").when(k % 3 == 1, "Note").otherwise("Callable")
    return t.customer.select(k.alias("uid"), X.embed_text(label, F.lit("function"), name, name, doc, F.array(F.lit("a"), F.lit("b")), F.lit("src")).alias("text"))


@query("SELECT project_name, count(*) AS n FROM nodes WHERE project_name IN ('ASIA', 'AFRICA', 'AMERICA') GROUP BY project_name")
def scoped_counts(t):
    known = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return S.in_projects(nodes(t), S.expand_scope("A*", known)).groupBy("project_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS uid, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) WHERE label = 3 AND vec_id % 2 = 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, uid LIMIT 10", graph=False)
def vector_scoped(t):
    q = [float(x) for x in t.embeddings.where("vec_id = 7").select("embedding").first()[0]]
    v = t.embeddings.select(F.col("vec_id").alias("uid"), "embedding", text("l", F.col("label")).alias("label"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("project_name"))
    return S.vector_search(v, q, 10, label="l3", projects=["even"]).withColumn("score", F.round("score", 5))


# ---------------------------------------------------------------- detectors


def _suite(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, text("item", F.floor(k / 2))).otherwise(text("test_item", F.floor(k / 3)))
    return t.part.select(text("p:", k).alias("uid"), F.lit("w").alias("project_name"), F.lit("Callable").alias("label"), name.alias("name"), F.concat(text("(a=Depends(item", k % 90), F.lit("), b: int = 1)")).alias("signature"))


_SUITE = "(SELECT 'p:' || p_partkey AS uid, CASE WHEN p_partkey % 2 = 0 THEN 'item' || (p_partkey // 2) ELSE 'test_item' || (p_partkey // 3) END AS name, 'item' || (p_partkey % 90) AS used FROM part)"


@query(f"SELECT a.uid AS from_uid, b.uid AS to_uid, 'TESTS' AS rel_type FROM {_SUITE} a JOIN {_SUITE} b ON a.name = 'test_' || b.name", graph=False)
def detect_tests(t):
    return R.test_targets(_suite(t))


@query(f"SELECT DISTINCT b.uid AS from_uid, a.uid AS to_uid, 'INJECTED_INTO' AS rel_type FROM {_SUITE} a JOIN {_SUITE} b ON a.used = b.name", graph=False)
def detect_injection(t):
    return R.injected(_suite(t))


@query("SELECT 's:' || s_suppkey AS from_uid, 'c:' || c_custkey AS to_uid, 'EXPORTS' AS rel_type FROM supplier JOIN customer ON c_custkey % 100 = s_suppkey % 100 WHERE c_custkey % 7 IN (s_suppkey % 7, (s_suppkey + 1) % 7)", graph=False)
def detect_exports(t):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    listed = F.concat(F.lit("x = 1\n__all__ = ['f"), (k % 7).cast("string"), F.lit("',\n  \"f"), ((k + 1) % 7).cast("string"), F.lit("\"]\n"))
    modules = t.supplier.select(text("s:", k).alias("uid"), F.lit("Module").alias("label"), F.lit("m").alias("name"), listed.alias("source"))
    members = t.customer.select(text("c:", c).alias("uid"), F.lit("Callable").alias("label"), text("f", c % 7).alias("name"), F.lit(None).cast("string").alias("source"))
    defines = t.supplier.join(t.customer, c % 100 == k % 100).select(text("s:", k).alias("from_uid"), text("c:", c).alias("to_uid"))
    return R.module_exports(modules.unionByName(members), defines)


# ---------------------------------------------------------------- spans, prefixes, manifests


@query("""WITH e AS (SELECT 'p:' || p_partkey AS uid, 'f' || (p_partkey % 80) AS file_path, CAST(p_partkey % 97 AS INTEGER) AS a, CAST(p_partkey % 97 + p_size AS INTEGER) AS b FROM part),
c AS (SELECT DISTINCT 'f' || (o_custkey % 80) AS file_path, CAST(o_orderkey % 140 AS INTEGER) AS line FROM orders)
SELECT uid, file_path, line FROM c JOIN e USING (file_path) WHERE line BETWEEN a AND b OR a = line + 1 QUALIFY row_number() OVER (PARTITION BY file_path, line ORDER BY (line BETWEEN a AND b), b - a, a DESC, uid) = 1""", graph=False)
def rationale_owners(t):
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    ents = t.part.select(text("p:", k).alias("uid"), text("f", k % 80).alias("file_path"), (k % 97).cast("int").alias("line_start"), (k % 97 + F.col("p_size")).cast("int").alias("line_end"))
    comments = t.orders.select(text("f", F.col("o_custkey") % 80).alias("file_path"), (o % 140).cast("int").alias("line"), F.lit("WHY: x").alias("text")).distinct()
    return extract.rationale_owners(ents, comments).select("uid", "file_path", "line")


@query("""WITH f AS (SELECT 'a' || (p_partkey % 6) || '/b' || (p_partkey % 11) || '/f' || p_partkey AS path FROM part), r AS (SELECT 'a' || n_nationkey AS root, 'top' || n_nationkey AS name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'a' || (n_nationkey % 6) || '/b' || n_nationkey, 'sub' || n_nationkey FROM nation WHERE n_nationkey < 9)
SELECT path, arg_max(name, length(root)) AS project_name FROM f LEFT JOIN r ON starts_with(path, root || '/') GROUP BY path""", graph=False)
def owning_projects(t):
    k, n = F.col("p_partkey"), F.col("n_nationkey")
    paths = t.part.select(F.concat(text("a", k % 6), text("/b", k % 11), text("/f", k)).alias("path"))
    top = t.nation.where(n < 5).select(text("a", n).alias("root"), text("top", n).alias("name"))
    return files.owning_project(paths, top.unionByName(t.nation.where(n < 9).select(F.concat(text("a", n % 6), text("/b", n)).alias("root"), text("sub", n).alias("name"))))


@query("""WITH d AS (SELECT DISTINCT 'lib' || (s_suppkey % 40) AS package, CASE WHEN s_suppkey % 40 < 25 THEN '1' ELSE CAST(s_suppkey % 3 AS VARCHAR) END AS version FROM supplier)
SELECT package, min(version) AS version FROM d GROUP BY package HAVING count(*) = 1""", graph=False)
def manifest_versions(t):
    k = F.col("s_suppkey")
    version = F.when(k % 40 < 25, "1").otherwise((k % 3).cast("string"))
    manifests = t.supplier.select(F.concat(text("m", k), F.lit("/package.json")).alias("path"), F.concat(text('{"dependencies": {"lib', k % 40), F.lit('": "'), version, F.lit('"}}')).alias("text"))
    return files.dependency_versions(manifests)


@query("SELECT path FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'src/f' WHEN 1 THEN 'build/f' WHEN 2 THEN 'src/.venv/f' ELSE 'x/y.min.json/../f' END || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.pyc' ELSE '.py' END AS path FROM part) WHERE path NOT LIKE 'build/%' AND path NOT LIKE 'src/.venv/%' AND path NOT LIKE '%.pyc' AND path NOT LIKE '%.min.json/%'", graph=False)
def default_excludes(t):
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "src/f").when(k % 4 == 1, "build/f").when(k % 4 == 2, "src/.venv/f").otherwise("x/y.min.json/../f")
    return files.not_ignored(t.part.select(F.concat(head, k.cast("string"), F.when(k % 5 == 0, ".pyc").otherwise(".py")).alias("path")), list(files.DEFAULT_EXCLUDES))


# ---------------------------------------------------------------- lint


@query("SELECT 'f' || p_partkey AS path, 'missing' AS problem FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0 UNION ALL SELECT 'f' || p_partkey, 'unlisted' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 <> 0", graph=False)
def index_drift(t):
    k = F.col("p_partkey")
    listed, present = (t.part.where(k % n == 0).select(text("f", k).alias("path")) for n in (3, 4))
    return A.index_drift(listed, present)


@query("SELECT count(*) AS n FROM calls WHERE to_uid NOT IN (SELECT uid FROM nodes WHERE starts_with(uid, 'p:') AND uid NOT LIKE '%7')")
def dangling_links(t):
    left = nodes(t, ["TypeDef"]).where("uid NOT LIKE '%7'")
    return A.dangling_links(calls(t).select("from_uid", "to_uid"), left).agg(F.count(F.lit(1)).alias("n"))
