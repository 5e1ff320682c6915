"""Every registered query of the graph engine, with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.operators import analysis as A
from graphloom.operators import delta as D
from graphloom.operators import resolve as R
from graphloom.operators import search as S
from graphloom.operators import traversal as V
from graphloom.plans.projection import on_graph
from graphloom.sources.graph import Tables, calls, contains, defines, edges, imports, inherits, nodes
from graphloom.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True, recursive: bool = False):
    """Registers a function of the tables under its name, with SQL over the tables or the projected graph."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = on_graph(sql, recursive) if graph else sql
        return f

    return register


# ---------------------------------------------------------------- structure, centrality


@query("SELECT label, kind, count(*) AS n FROM nodes GROUP BY label, kind")
def structure_counts(t):
    return A.structure_counts(nodes(t))


@query("SELECT label, count(*) AS n FROM nodes GROUP BY label")
def label_counts(t):
    return A.label_counts(nodes(t))


@query("SELECT from_uid AS uid, count(*) AS n FROM defines WHERE starts_with(from_uid, 'n:') GROUP BY from_uid ORDER BY n DESC, uid LIMIT 10")
def structure_largest_modules(t):
    return A.children(nodes(t, ["Module"]), defines(t), "Module", "DEFINES")


@query("SELECT from_uid AS uid, count(*) AS n FROM contains WHERE starts_with(to_uid, 'n:') GROUP BY from_uid ORDER BY n DESC, uid LIMIT 10")
def structure_packages(t):
    return A.children(nodes(t, ["Package", "Module"]), contains(t), "Package", "CONTAINS", "Module")


_HUB_EDGES = "(SELECT to_uid, rel_type FROM imports UNION ALL SELECT to_uid, rel_type FROM inherits UNION ALL SELECT to_uid, rel_type FROM calls)"


@query(f"SELECT to_uid AS uid, count(*) AS total, count(*) FILTER (rel_type = 'IMPORTS') AS imports, count(*) FILTER (rel_type = 'INHERITS') AS inherits, count(*) FILTER (rel_type = 'CALLS') AS calls FROM {_HUB_EDGES} GROUP BY to_uid ORDER BY total DESC, uid LIMIT 10")
def centrality_hubs(t):
    return A.hubs(edges(t, ["IMPORTS", "INHERITS", "CALLS"]))


@query(f"SELECT uid, label FROM nodes WHERE label IN ('TypeDef', 'Callable') AND NOT EXISTS (SELECT 1 FROM {_HUB_EDGES} e WHERE e.to_uid = uid)")
def centrality_leaves(t):
    return A.leaves(nodes(t, ["TypeDef", "Callable"]), edges(t, ["IMPORTS", "INHERITS", "CALLS"]))


@query("SELECT project_name, n.entities, n.files, coalesce(e.edges, 0) AS edges FROM (SELECT project_name, count(*) AS entities, count(DISTINCT file_path) AS files FROM nodes GROUP BY project_name) n LEFT JOIN (SELECT project_name, count(*) AS edges FROM edges JOIN nodes ON from_uid = uid GROUP BY project_name) e USING (project_name)")
def index_status(t):
    return A.index_status(nodes(t), edges(t))


# ---------------------------------------------------------------- dependencies, quality

_MODULE_IMPORTS = """, w AS (SELECT from_mod, to_mod, count(*) AS weight FROM (
  SELECT from_uid AS from_mod, to_uid AS to_mod FROM imports WHERE starts_with(to_uid, 'n:')
  UNION ALL SELECT i.from_uid, d.from_uid FROM imports i JOIN defines d ON d.to_uid = i.to_uid WHERE starts_with(d.from_uid, 'n:')) WHERE from_mod <> to_mod GROUP BY ALL)"""


def _module_graph(t):
    return nodes(t, ["Module"]), edges(t, ["IMPORTS", "DEFINES"])


@query(f"{_MODULE_IMPORTS} SELECT * FROM w")
def module_import_edges(t):
    return A.module_imports(*_module_graph(t))


@query(f"{_MODULE_IMPORTS} SELECT a.project_name AS from_pkg, b.project_name AS to_pkg, CAST(sum(weight) AS BIGINT) AS weight FROM w JOIN nodes a ON a.uid = from_mod JOIN nodes b ON b.uid = to_mod WHERE a.project_name <> b.project_name GROUP BY ALL")
def cross_package_coupling(t):
    n, e = _module_graph(t)
    return A.coupling(n, A.module_imports(n, e))


@query("SELECT 's:' || s_suppkey AS uid, count(DISTINCT from_uid) AS importers FROM supplier LEFT JOIN imports ON to_uid = 's:' || s_suppkey GROUP BY s_suppkey")
def external_dependency_counts(t):
    return A.external_counts(t.supplier.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("uid")), imports(t))


_QUALITY = f"""{_MODULE_IMPORTS}, q AS (SELECT uid, coalesce(d.n, 0) AS entities, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM nodes
  LEFT JOIN (SELECT from_uid, count(*) AS n FROM defines GROUP BY 1) d ON d.from_uid = uid LEFT JOIN (SELECT to_mod, count(*) AS n FROM w GROUP BY 1) i ON i.to_mod = uid
  LEFT JOIN (SELECT from_mod, count(*) AS n FROM w GROUP BY 1) o ON o.from_mod = uid WHERE label = 'Module'),
f AS (SELECT *, CASE WHEN fan_in + fan_out = 0 THEN 0.5::DOUBLE ELSE fan_out::DOUBLE / (fan_in + fan_out) END AS instability FROM q),
g AS (SELECT *, entities > 30 AS is_god, fan_in > 8 AND fan_out > 8 AS is_tangled, instability < 0.1 AS is_rigid, instability > 0.9 AS is_unstable FROM f)"""


@query(f"{_QUALITY} SELECT uid, entities, fan_in, fan_out, round(instability, 6) AS instability, is_god, is_tangled, is_rigid, is_unstable FROM g")
def quality_metrics(t):
    return A.quality(*_module_graph(t)).withColumn("instability", F.round("instability", 6))


_CYCLES = """, walk(a, b) AS (SELECT from_mod, to_mod FROM w UNION SELECT walk.a, w.to_mod FROM walk JOIN w ON w.from_mod = walk.b),
cyc AS (SELECT DISTINCT a AS uid FROM walk WHERE a = b)"""


def _cycles(n: DataFrame, e: DataFrame) -> DataFrame:
    return V.strongly_connected(A.module_imports(n, e).select(F.col("from_mod").alias("a"), F.col("to_mod").alias("b")))


@query(f"""{_QUALITY}{_CYCLES}, h AS (SELECT *, uid IN (SELECT uid FROM cyc) AS is_circular FROM g)
SELECT uid, is_god::INT + is_circular::INT + is_tangled::INT + is_rigid::INT + is_unstable::INT AS issues, entities FROM h
WHERE is_god OR is_circular OR is_tangled OR is_rigid OR is_unstable ORDER BY issues DESC, entities DESC, uid LIMIT 10""", recursive=True)
def worst_modules(t):
    n, e = _module_graph(t)
    return A.worst_modules(A.quality(n, e), _cycles(n, e).select(F.col("node").alias("uid")))


@query(f"""{_QUALITY}{_CYCLES},
i AS (SELECT coalesce(sum(CASE WHEN a.project_name = b.project_name THEN weight ELSE 0 END)::DOUBLE / sum(weight), 1.0)::DOUBLE AS ratio FROM w JOIN nodes a ON a.uid = from_mod JOIN nodes b ON b.uid = to_mod),
comp AS (SELECT x.a AS node, min(x.b) AS component FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1),
m AS (SELECT count(*) AS modules, CAST(sum(is_god::INT) AS BIGINT) AS god, CAST(sum(is_tangled::INT) AS BIGINT) AS tangled, CAST(sum(is_rigid::INT) + sum(is_unstable::INT) AS BIGINT) AS extreme,
  max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out, (SELECT count(DISTINCT component) FROM comp) AS circular FROM g),
p AS (SELECT *, CAST(round_even(ratio * 100, 0) AS INTEGER) AS s_modularity, greatest(0, 100 - god * 20) AS s_god_modules, greatest(0, 100 - circular * 15) AS s_circular_deps, greatest(0, 100 - tangled * 20) AS s_tangled,
  greatest(0, 100 - greatest(0, max_fan_in + max_fan_out - 10) * 5) AS s_coupling, greatest(0, 100 - extreme * 15) AS s_instability FROM m, i)
SELECT modules, round_even(ratio, 3) AS modularity_ratio, god, circular, tangled, extreme, max_fan_in, max_fan_out, s_modularity, s_god_modules, s_circular_deps, s_tangled, s_coupling, s_instability,
  CAST(round_even(s_modularity * 0.25::DOUBLE + s_god_modules * 0.2::DOUBLE + s_circular_deps * 0.2::DOUBLE + s_tangled * 0.15::DOUBLE + s_coupling * 0.1::DOUBLE + s_instability * 0.1::DOUBLE, 0) AS INTEGER) AS score FROM p""", recursive=True)
def health_score(t):
    n, e = _module_graph(t)
    return A.health_score(n, e, _cycles(n, e))


@query(f"{_MODULE_IMPORTS}{_CYCLES} SELECT x.a AS node, min(x.b) AS component FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1", recursive=True)
def import_cycles(t):
    return _cycles(*_module_graph(t))


@query(f"""SELECT uid, label FROM nodes WHERE label IN ('TypeDef', 'Callable') AND NOT starts_with(name, '__') AND kind IN ('class', 'interface', 'enum', 'method')
  AND NOT EXISTS (SELECT 1 FROM {_HUB_EDGES} e WHERE e.to_uid = uid)
  AND NOT EXISTS (SELECT 1 FROM defines d JOIN calls c ON c.to_uid = d.to_uid WHERE d.from_uid = uid)
  AND NOT EXISTS (SELECT 1 FROM defines d WHERE d.to_uid = uid AND starts_with(d.from_uid, 'o:'))""")
def dead_code(t):
    return A.dead_code(nodes(t, ["TypeDef", "Callable"]), edges(t))


@query("SELECT uid, line_end - line_start AS span FROM nodes WHERE label = 'Callable' ORDER BY span DESC, uid LIMIT 20")
def complexity_hotspots(t):
    return A.complexity(nodes(t, ["Callable"]))


@query("SELECT label, count(*) AS total, count(*) FILTER (coalesce(docstring, '') <> '') AS documented, round_even(100.0::DOUBLE * count(*) FILTER (coalesce(docstring, '') <> '') / count(*), 1) AS percent FROM nodes WHERE label IN ('TypeDef', 'Callable') GROUP BY label")
def doc_coverage(t):
    return A.doc_coverage(nodes(t, ["TypeDef", "Callable"]))


@query("SELECT visibility, count(*) AS n FROM nodes WHERE label IN ('TypeDef', 'Callable') GROUP BY visibility")
def visibility_distribution(t):
    return A.visibility_distribution(nodes(t, ["TypeDef", "Callable"]))


@query("SELECT uid, count(to_uid) AS members FROM nodes LEFT JOIN defines ON from_uid = uid WHERE kind = 'interface' GROUP BY uid")
def type_members(t):
    return A.members(nodes(t, ["TypeDef"]), defines(t), "interface")


@query("SELECT from_uid, to_uid, a.name AS child, b.name AS parent FROM inherits JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid ORDER BY from_uid, to_uid LIMIT 50")
def inheritance_list(t):
    return A.inheritance(nodes(t, ["TypeDef"]), inherits(t)).select("from_uid", "to_uid", "child", "parent")


@query("SELECT from_uid, to_uid, a.name AS parent, b.name AS child FROM contains JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid ORDER BY from_uid, to_uid LIMIT 100")
def package_diagram(t):
    return A.package_diagram(nodes(t, ["Project", "Package", "Module"]), contains(t))


_SUMMARY_PREFIX = "ASIA/"


@query(f"""SELECT measure, count(*) AS value FROM (
  SELECT CASE WHEN label = 'Module' THEN 'modules' ELSE 'entities' END AS measure FROM nodes WHERE starts_with(coalesce(file_path, ''), '{_SUMMARY_PREFIX}') AND label IN ('Module', 'TypeDef', 'Callable', 'Value')
  UNION ALL SELECT CASE WHEN starts_with(a.file_path, '{_SUMMARY_PREFIX}') AND starts_with(b.file_path, '{_SUMMARY_PREFIX}') THEN CASE WHEN rel_type <> 'IMPORTS' THEN 'internal' END
      WHEN starts_with(b.file_path, '{_SUMMARY_PREFIX}') THEN 'fan_in' WHEN starts_with(a.file_path, '{_SUMMARY_PREFIX}') THEN 'fan_out' END
    FROM edges JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid WHERE rel_type IN ('CALLS', 'INHERITS', 'IMPORTS') AND a.project_name = b.project_name AND from_uid <> to_uid) WHERE measure IS NOT NULL GROUP BY measure""")
def module_summary(t):
    return A.module_summary(nodes(t), edges(t), _SUMMARY_PREFIX)


@query("SELECT to_uid AS uid, count(*) AS importers FROM imports WHERE starts_with(to_uid, 'n:') GROUP BY to_uid ORDER BY importers DESC, uid LIMIT 10")
def centrality_modules(t):
    return A.hub_modules(nodes(t, ["Module"]), imports(t))


@query("""SELECT n.project_name, n.entities, coalesce(a.l, []) AS depends_on, coalesce(b.l, []) AS depended_by FROM (SELECT project_name, count(*) AS entities FROM nodes GROUP BY project_name) n
LEFT JOIN (SELECT x.project_name, list_sort(list(DISTINCT y.project_name)) AS l FROM imports JOIN nodes x ON x.uid = from_uid JOIN nodes y ON y.uid = to_uid WHERE x.project_name <> y.project_name GROUP BY 1) a USING (project_name)
LEFT JOIN (SELECT y.project_name, list_sort(list(DISTINCT x.project_name)) AS l FROM imports JOIN nodes x ON x.uid = from_uid JOIN nodes y ON y.uid = to_uid WHERE x.project_name <> y.project_name GROUP BY 1) b USING (project_name)""")
def project_list(t):
    return A.project_list(nodes(t), edges(t))


@query("""SELECT from_uid, to_uid, a.name AS child, b.name AS parent FROM inherits JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid WHERE starts_with(a.file_path, 'EUROPE/') ORDER BY from_uid, to_uid LIMIT 30""")
def inheritance_diagram(t):
    return A.inheritance_diagram(nodes(t), edges(t, ["INHERITS"]), "EUROPE/")


@query("""WITH m AS (SELECT uid FROM nodes WHERE label = 'Module' AND starts_with(file_path, 'ASIA/') ORDER BY qualified_name, uid LIMIT 1),
top AS (SELECT m.uid AS module, n.* FROM m JOIN defines ON from_uid = m.uid JOIN nodes n ON n.uid = to_uid)
SELECT * FROM (SELECT module, CAST(NULL AS VARCHAR) AS owner, name, label, kind, visibility FROM top ORDER BY line_start, uid LIMIT 30)
UNION ALL SELECT * FROM (SELECT module, top.name AS owner, n.name, n.label, n.kind, n.visibility FROM top JOIN defines ON from_uid = top.uid JOIN nodes n ON n.uid = to_uid WHERE top.label = 'TypeDef' AND n.label = 'Callable' ORDER BY owner, n.line_start, n.uid LIMIT 30)""".replace("WITH m AS", ", m AS", 1))
def module_detail_diagram(t):
    return A.module_detail(nodes(t), edges(t, ["DEFINES"]), "ASIA/")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type", graph=False)
def value_percentiles(t):
    return A.percentiles(t.events, "value", "event_type").select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


# ---------------------------------------------------------------- history

_COMMITS = "WITH c AS (SELECT DISTINCT o_orderkey AS commit_id, o_custkey AS author, epoch(o_orderdate)::BIGINT AS ts, 'p:' || l_partkey AS file FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_NOW = 1_000_000_000
_SIGNALS = f"{_COMMITS}, s AS (SELECT file, count(DISTINCT commit_id) AS commit_count, count(DISTINCT author) AS author_count, round_even(({_NOW} - max(ts)) / 86400.0::DOUBLE, 1) AS days_since_last_commit FROM c GROUP BY file)"


def commits(t: Tables) -> DataFrame:
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    o = t.orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), at.alias("ts"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("file")).distinct()
    return o.join(lines, "commit_id")


@query(f"{_SIGNALS} SELECT * FROM s", graph=False)
def file_signals(t):
    return D.file_signals(commits(t), _NOW)


@query(f"{_SIGNALS} SELECT * FROM s ORDER BY commit_count DESC, file LIMIT 20", graph=False)
def git_hotspots(t):
    return A.hotspots(D.file_signals(commits(t), _NOW))


@query(f"{_SIGNALS} SELECT * FROM s WHERE author_count <= 20 ORDER BY commit_count DESC, file LIMIT 20", graph=False)
def bus_factor(t):
    return A.bus_factor(D.file_signals(commits(t), _NOW), 20)


@query(f"{_COMMITS} SELECT a.file AS file_a, b.file AS file_b, count(*) AS count FROM c a JOIN c b USING (commit_id) WHERE a.file < b.file GROUP BY ALL HAVING count(*) >= 2", graph=False)
def co_change_pairs(t):
    return D.co_changes(commits(t), 2)


# ---------------------------------------------------------------- search


@query("SELECT uid, CASE WHEN name = 'order_7' THEN 3.0 WHEN ends_with(qualified_name, '.order_7') THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM nodes WHERE contains(qualified_name, 'order_7') OR contains(name, 'order_7') ORDER BY score DESC, uid LIMIT 20")
def graph_search(t):
    return S.graph_search(nodes(t), "order_7")


@query("SELECT uid, label, name FROM nodes WHERE uid = 'ASIA' OR name = 'ASIA' ORDER BY uid LIMIT 20")
def get_node_exact(t):
    return S.get_node_exact(nodes(t), "ASIA")


@query("SELECT uid, CASE WHEN ends_with(qualified_name, '.order_12') THEN 3 WHEN starts_with(qualified_name, 'order_12.') THEN 2 ELSE 1 END AS score FROM nodes WHERE contains(qualified_name, 'order_12') ORDER BY score DESC, uid LIMIT 20")
def get_node_partial(t):
    return S.get_node_partial(nodes(t), "order_12")


@query("SELECT uid, name FROM nodes WHERE label = 'TypeDef' AND file_path <> '' AND starts_with(file_path, 'EUROPE/') AND NOT (contains('/' || lower(file_path), '/tests/') OR starts_with(name, 'test_') OR ends_with(name, '_test')) ORDER BY uid LIMIT 50")
def scoped_production_types(t):
    n = nodes(t, ["TypeDef"]).where(F.col("file_path").startswith("EUROPE/") & (F.col("file_path") != ""))
    return n.where(~X.is_test(F.col("file_path"), F.col("name"))).select("uid", "name").orderBy("uid").limit(50)


_SEARCH = "the nation thing"
_TERMS = "('the', 'nation', 'thing')"
_BM25 = f"""WITH t AS (SELECT doc_id AS uid, lang AS label, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents),
st AS (SELECT label, count(*) AS n, avg(len(t)) AS avgdl FROM t GROUP BY label),
tf AS (SELECT uid, label, dl, term, count(*) AS tf FROM (SELECT uid, label, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN {_TERMS} GROUP BY ALL),
dfr AS (SELECT label, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT label, uid, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM tf JOIN dfr USING (label, term) JOIN st USING (label) GROUP BY label, uid)"""


def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("uid"), F.col("lang").alias("label"), "text")


def text_scores(t: Tables, query: str) -> DataFrame:
    """BM25 from postings and statistics that are built once."""
    stats = t.built("text-statistics", lambda t: S.text_statistics(corpus(t)))
    return S.bm25_indexed(t.built("postings", lambda t: S.postings(corpus(t)), "part"), stats, query)


@query(f"{_BM25} SELECT label, uid, round(score, 5) AS score FROM sc", graph=False)
def bm25_search(t):
    return text_scores(t, _SEARCH).withColumn("score", F.round("score", 5))


@query(f"{_BM25} SELECT label, uid, round(score, 5) AS score FROM sc", graph=False)
def bm25_scan(t):
    return S.bm25(corpus(t), _SEARCH).withColumn("score", F.round("score", 5))


_TEXT = f"""{_BM25}, rk AS (SELECT uid, row_number() OVER (PARTITION BY label ORDER BY score DESC, uid) AS rank FROM sc),
tx AS (SELECT uid, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk WHERE rank <= 20 GROUP BY uid ORDER BY score DESC, uid LIMIT 20)"""


@query(f"{_TEXT} SELECT uid, round(score, 6) AS score FROM tx", graph=False)
def text_search(t):
    return S.fused_labels(text_scores(t, _SEARCH)).withColumn("score", F.round("score", 6))


def _by_channel(e: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy(F.desc("score"), "user_id")
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 50").select(F.col("event_type").alias("channel"), F.col("user_id").alias("uid"), "rank")


@query("""WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY event_type, user_id)
SELECT user_id AS uid, round(sum(CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'error' THEN 0.5 ELSE 1.0 END::DOUBLE / (60 + rank)), 6) AS score FROM r WHERE rank <= 50 GROUP BY user_id""", graph=False)
def rrf_fusion(t):
    e = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("score"))
    return S.rank_fusion(_by_channel(e), weights={"purchase": 2.0, "error": 0.5}).select("uid", F.round("score", 6).alias("score"))


def _documents_as_nodes(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("uid"), F.lit("DocFile").alias("label"), F.concat_ws("/", "lang", "source").alias("file_path"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.concat_ws(".", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("qualified_name"),
        F.when(F.col("doc_id") % 3 == 0, "private").otherwise("public").alias("visibility"), F.col("lang").alias("project_name"),
    )


@query(_BM25 + """, rk AS (SELECT uid, row_number() OVER (PARTITION BY label ORDER BY score DESC, uid) AS rank FROM sc),
tx AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM (SELECT uid, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk WHERE rank <= 30 GROUP BY uid ORDER BY score DESC, uid LIMIT 30)),
fu AS (SELECT uid, 1.0::DOUBLE / (60 + rank) AS score FROM tx)
SELECT uid, round(boosted, 6) AS score FROM (SELECT uid, score * 0.7::DOUBLE * CASE WHEN uid % 3 = 0 THEN 0.88 ELSE 1.0 END::DOUBLE * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.92 END::DOUBLE AS boosted
FROM fu JOIN documents ON doc_id = uid) ORDER BY boosted DESC, uid LIMIT 10""", graph=False)
def hybrid_search(t):
    hits = S.hybrid_search(_documents_as_nodes(t), None, _SEARCH, 10, primary="en", scores=text_scores(t, _SEARCH))
    return hits.select("uid", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "uid")


_QVEC = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("uid"), "embedding")


def _query_vector(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 7").select("embedding").first()[0]]


@query(_BM25 + f""", rk AS (SELECT uid, row_number() OVER (PARTITION BY label ORDER BY score DESC, uid) AS rank FROM sc),
tx AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM (SELECT uid, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk WHERE rank <= 60 GROUP BY uid ORDER BY score DESC, uid LIMIT 60)),
vx AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM (SELECT vec_id AS uid, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, {_QVEC} ORDER BY score DESC, uid LIMIT 60)),
fu AS (SELECT uid, sum(w / (60 + rank)) AS score FROM (SELECT uid, rank, 1.5::DOUBLE AS w FROM tx UNION ALL SELECT uid, rank, 2.0::DOUBLE FROM vx) GROUP BY uid),
d AS (SELECT doc_id AS uid, lang, source, CASE WHEN doc_id % 7 = 0 THEN 'test_' ELSE 'doc_' END || doc_id AS name FROM documents)
SELECT uid, round(boosted, 6) AS score FROM (SELECT uid, score * 0.7::DOUBLE * CASE WHEN uid % 3 = 0 THEN 0.88 ELSE 1.0 END::DOUBLE AS boosted FROM fu JOIN d USING (uid) WHERE NOT starts_with(name, 'test_') AND lang <> 'de' AND source <> 'forum')
ORDER BY boosted DESC, uid LIMIT 20""", graph=False)
def hybrid_filtered(t):
    """Text and vector channels with explicit weights, and the chain of filters."""
    n = _documents_as_nodes(t).withColumn("name", F.concat(F.when(F.col("uid") % 7 == 0, "test_").otherwise("doc_"), F.col("uid").cast("string")))
    options = {"channels": ("bm25", "vector"), "weights": {"bm25": 1.5, "vector": 2.0}, "tests": False, "exclude": ["de/*", "forum"]}
    hits = S.hybrid_search(n, None, _SEARCH, 20, _vectors(t), _query_vector(t), scores=text_scores(t, _SEARCH), **options)
    return hits.select("uid", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "uid")


@query("""SELECT uid, kind FROM (SELECT p_partkey AS uid, CASE p_partkey % 3 WHEN 0 THEN 'Note' WHEN 1 THEN 'Callable' ELSE 'TypeDef' END AS kind,
  CASE p_size % 5 WHEN 0 THEN 'Tests' || chr(92) || 'a.py' WHEN 1 THEN 'src/x_pb2.py' WHEN 2 THEN 'src/y.PYI' WHEN 3 THEN 'src/Test_z.py' ELSE 'src/w.py' END AS path, CASE WHEN p_partkey % 11 = 0 THEN 'X_Test' ELSE p_name END AS name FROM part)
WHERE kind <> 'Note' AND path = 'src/w.py' AND name <> 'X_Test'""", graph=False)
def filter_chain(t):
    k = F.col("p_partkey")
    path = F.element_at(F.array(*(F.lit(x) for x in ("Tests\\a.py", "src/x_pb2.py", "src/y.PYI", "src/Test_z.py", "src/w.py"))), (F.col("p_size") % 5 + 1).cast("int"))
    hits = t.part.select(k.alias("uid"), F.element_at(F.array(F.lit("Note"), F.lit("Callable"), F.lit("TypeDef")), (k % 3 + 1).cast("int")).alias("label"), path.alias("file_path"), F.when(k % 11 == 0, "X_Test").otherwise(F.col("p_name")).alias("name"))
    return S.filter_hits(hits, code_only=True, tests=False, stubs=False, generated=False, include=["*.py", "*.pyi"]).select("uid", F.col("label").alias("kind"))


@query("""SELECT uid, match, row_number() OVER (ORDER BY visibility <> 'public', visibility, length(qualified_name), uid) AS place FROM (
  SELECT *, row_number() OVER (ORDER BY match DESC, uid) AS pos FROM (SELECT uid, qualified_name, visibility, CASE WHEN uid = 'order_1' OR name = 'order_1' THEN 4 WHEN ends_with(qualified_name, '.order_1') THEN 3
    WHEN starts_with(qualified_name, 'order_1.') THEN 2 ELSE 1 END AS match FROM nodes WHERE label = 'Callable' AND (contains(qualified_name, 'order_1') OR contains(name, 'order_1')))) WHERE pos > 5 AND pos <= 25""")
def get_node_page(t):
    return S.get_node(nodes(t), "order_1", limit=20, offset=5, label="Callable")


@query(f"SELECT vec_id AS uid, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS score FROM embeddings, {_QVEC} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, uid LIMIT 20", graph=False)
def vector_topk(t):
    return S.vector_search(_vectors(t), _query_vector(t)).withColumn("score", F.round("score", 5))


@query(f"SELECT vec_id AS uid, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS score FROM embeddings, {_QVEC} WHERE list_cosine_similarity(embedding::DOUBLE[], q) >= 0.2", graph=False)
def vector_threshold(t):
    return S.vector_search(_vectors(t), _query_vector(t), limit=None, threshold=0.2).withColumn("score", F.round("score", 5))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4", graph=False)
def similar_pairs(t):
    return S.similar_pairs(_vectors(t), 0.4).withColumn("score", F.round("score", 5))


@query("""SELECT uid, coalesce(r.n, 0) AS caller_count, coalesce(e.n, 0) AS callee_count, coalesce(r.names, []) AS callers, coalesce(e.names, []) AS callees
FROM (SELECT to_uid AS uid, count(DISTINCT from_uid) AS n, list_slice(list_sort(list(DISTINCT name)), 1, 5) AS names FROM calls JOIN nodes ON uid = from_uid GROUP BY to_uid) r
FULL JOIN (SELECT from_uid AS uid, count(DISTINCT to_uid) AS n, list_slice(list_sort(list(DISTINCT name)), 1, 5) AS names FROM calls JOIN nodes ON uid = to_uid GROUP BY from_uid) e USING (uid)""")
def call_stats(t):
    return S.call_stats(calls(t).select("from_uid", "to_uid"), nodes(t, ["TypeDef", "Callable"]))


# ---------------------------------------------------------------- traversal

_START = "p:1"
_BIPARTITE = ", g AS (SELECT from_uid AS src, to_uid AS dst FROM calls UNION ALL SELECT from_uid, to_uid FROM inherits)"


@query(f"{_BIPARTITE}, r(uid, d) AS (SELECT src, 1 FROM g WHERE dst = '{_START}' UNION SELECT src, d + 1 FROM r JOIN g ON dst = uid WHERE d < 2) SELECT uid, min(d) AS min_depth FROM r WHERE uid <> '{_START}' GROUP BY uid", recursive=True)
def callers_k(t):
    return V.reach(edges(t, ["CALLS", "INHERITS"]), _START, "callers", 2)


@query(f"{_BIPARTITE}, r(uid, d) AS (SELECT dst, 1 FROM g WHERE src = 'o:1' UNION SELECT dst, d + 1 FROM r JOIN g ON src = uid WHERE d < 3) SELECT uid, min(d) AS min_depth FROM r WHERE uid <> 'o:1' GROUP BY uid", recursive=True)
def callees_k(t):
    return V.reach(edges(t, ["CALLS", "INHERITS"]), "o:1", "callees", 3)


_BLAST = f""", g AS (SELECT from_uid AS src, to_uid AS dst, rel_type, weight, confidence, from_test, line FROM calls UNION ALL SELECT from_uid, to_uid, rel_type, 1.0::DOUBLE, NULL, NULL, NULL FROM inherits UNION ALL SELECT from_uid, to_uid, rel_type, 1.0::DOUBLE, NULL, NULL, NULL FROM imports),
r(uid, d, s, via) AS (SELECT src, 1, weight, rel_type FROM g WHERE dst = '{_START}' UNION SELECT src, d + 1, s * weight, via FROM r JOIN g ON dst = uid WHERE d < 3),
f(uid, d) AS (SELECT src, 1 FROM g WHERE dst = '{_START}' AND coalesce(confidence, 'resolved') = 'resolved' UNION SELECT src, d + 1 FROM f JOIN g ON dst = uid WHERE d < 3 AND coalesce(confidence, 'resolved') = 'resolved'),
p(uid, d) AS (SELECT src, 1 FROM g WHERE dst = '{_START}' AND NOT coalesce(from_test, false) UNION SELECT src, d + 1 FROM p JOIN g ON dst = uid WHERE d < 3 AND NOT coalesce(from_test, false)),
l AS (SELECT src AS uid, min(line) AS line FROM g WHERE dst = '{_START}' GROUP BY src)
SELECT r.uid, min(d) AS min_depth, round(max(s), 6) AS score, list_sort(list(DISTINCT via)) AS via, any_value(l.line) AS line, r.uid NOT IN (SELECT uid FROM f) AS ambiguous_only, r.uid NOT IN (SELECT uid FROM p) AS test_only
FROM r LEFT JOIN l USING (uid) WHERE r.uid <> '{_START}' GROUP BY r.uid"""


@query(_BLAST, recursive=True)
def blast_radius(t):
    out = V.blast_radius(edges(t, ["CALLS", "INHERITS", "IMPORTS"]), _START)
    return out.select("uid", "min_depth", F.round("score", 6).alias("score"), "via", "line", "ambiguous_only", "test_only")


_BOTH = """, g AS (SELECT from_uid AS src, to_uid AS dst, rel_type, weight, confidence, from_test, line FROM calls UNION ALL SELECT from_uid, to_uid, rel_type, 1.0::DOUBLE, NULL, NULL, NULL FROM defines),
e AS (SELECT 0 AS side, src, dst, rel_type, weight, coalesce(confidence, 'resolved') = 'resolved' AS firm, NOT coalesce(from_test, false) AS real, line FROM g
  UNION ALL SELECT 1, dst, src, rel_type, weight, coalesce(confidence, 'resolved') = 'resolved', NOT coalesce(from_test, false), line FROM g),
r(side, uid, d, s, via, firm, real, line) AS (SELECT side, dst, 1, weight, rel_type, firm, real, line FROM e WHERE src = 's:1'
  UNION SELECT r.side, dst, d + 1, s * weight, via, r.firm AND e.firm, r.real AND e.real, NULL FROM r JOIN e ON e.src = uid AND e.side = r.side WHERE d < 2),
z AS (SELECT side, uid, min(d) AS min_depth, max(s) AS score, list_sort(list(DISTINCT via)) AS via, min(line) AS line, NOT bool_or(firm) AS ambiguous_only, NOT bool_or(real) AS test_only FROM r WHERE uid <> 's:1' GROUP BY side, uid),
k AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY uid ORDER BY min_depth, side) = 1)"""


@query(f"{_BOTH} SELECT uid, min_depth, round(score, 6) AS score, via, line, ambiguous_only, test_only FROM k", recursive=True)
def blast_radius_both(t):
    out = V.blast_radius(edges(t, ["CALLS", "DEFINES"]), "s:1", "both", 2, ("CALLS", "DEFINES"))
    return out.select("uid", "min_depth", F.round("score", 6).alias("score"), "via", "line", "ambiguous_only", "test_only")


@query(f"{_BOTH} SELECT k.uid, min_depth, test_only, round(score, 6) AS score, (SELECT count(*) FROM k) AS affected_count FROM k JOIN nodes n ON n.uid = k.uid ORDER BY min_depth, test_only, k.score DESC, qualified_name, k.uid LIMIT 20", recursive=True)
def impact_ranked(t):
    out = V.blast_radius(edges(t, ["CALLS", "DEFINES"]), "s:1", "both", 2, ("CALLS", "DEFINES"))
    return V.ranked_impact(out, nodes(t)).select("uid", "min_depth", "test_only", F.round("score", 6).alias("score"), "affected_count")


_TRACE = ("n:1", "p:1")


@query(f""", g AS (SELECT from_uid AS src, to_uid AS dst, rel_type, 1.0::DOUBLE AS w FROM defines UNION ALL SELECT from_uid, to_uid, rel_type, weight FROM calls),
r(uid, s, path, hops) AS (SELECT '{_TRACE[0]}', 1.0::DOUBLE, ['{_TRACE[0]}'], []::STRUCT(from_uid VARCHAR, to_uid VARCHAR, rel_type VARCHAR, weight DOUBLE)[]
  UNION ALL SELECT dst, s * w, list_append(path, dst), list_append(hops, {{'from_uid': src, 'to_uid': dst, 'rel_type': g.rel_type, 'weight': w}}) FROM r JOIN g ON src = uid WHERE len(hops) < 3 AND NOT list_contains(path, dst)),
best AS (SELECT hops FROM r WHERE uid = '{_TRACE[1]}' ORDER BY len(hops), s DESC, path LIMIT 1)
SELECT CAST(i AS INTEGER) AS hop, hops[i].from_uid AS from_uid, hops[i].to_uid AS to_uid, hops[i].rel_type AS rel_type, round(hops[i].weight, 6) AS weight FROM (SELECT hops, unnest(generate_series(1, len(hops))) AS i FROM best)""", recursive=True)
def trace_path(t):
    e = edges(t, ["DEFINES", "CALLS"])
    return V.trace_path(e, *_TRACE, max_depth=3, types=("DEFINES", "CALLS")).select("hop", "from_uid", "to_uid", "rel_type", F.round("weight", 6).alias("weight"))


@query("""SELECT c.uid, coalesce(m1.uid, m2.uid, m3.uid) AS ancestor, CASE WHEN m1.uid IS NOT NULL THEN 1 WHEN m2.uid IS NOT NULL THEN 2 ELSE 3 END AS distance FROM nodes c
JOIN defines a ON a.to_uid = c.uid LEFT JOIN nodes m1 ON m1.uid = a.from_uid AND m1.label = 'Module' LEFT JOIN defines b ON b.to_uid = a.from_uid LEFT JOIN nodes m2 ON m2.uid = b.from_uid AND m2.label = 'Module'
LEFT JOIN defines d ON d.to_uid = b.from_uid LEFT JOIN nodes m3 ON m3.uid = d.from_uid AND m3.label = 'Module' WHERE coalesce(m1.uid, m2.uid, m3.uid) IS NOT NULL""")
def module_ancestor(t):
    return V.nearest_ancestor(nodes(t), defines(t))


_CALL_PAIRS = """, fw AS (SELECT a.file_path AS fa, b.file_path AS fb, sum(weight) AS weight FROM calls JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid WHERE a.file_path <> b.file_path GROUP BY ALL),
cw AS (SELECT least(x.uid, y.uid) AS a, greatest(x.uid, y.uid) AS b, sum(weight) AS weight FROM (
  SELECT x.uid AS ma, y.uid AS mb, weight FROM fw JOIN nodes x ON x.label = 'Module' AND x.file_path = fa JOIN nodes y ON y.label = 'Module' AND y.file_path = fb UNION ALL SELECT from_mod, to_mod, weight::DOUBLE FROM w) z JOIN nodes x ON x.uid = ma JOIN nodes y ON y.uid = mb GROUP BY ALL)"""


@query(f"{_MODULE_IMPORTS}{_CALL_PAIRS} SELECT a, b, round(weight, 4) AS weight FROM cw")
def community_weights(t):
    return A.community_weights(nodes(t), edges(t, ["CALLS", "IMPORTS", "DEFINES"])).withColumn("weight", F.round("weight", 4))


@query(f"""{_MODULE_IMPORTS}{_CALL_PAIRS}, e AS (SELECT cw.*, p.project_name AS ca, q.project_name AS cb FROM cw JOIN nodes p ON p.uid = a JOIN nodes q ON q.uid = b),
per AS (SELECT c, sum(weight) AS degree, sum(CASE WHEN same THEN weight ELSE 0 END) AS inside FROM (SELECT ca AS c, weight, ca = cb AS same FROM e UNION ALL SELECT cb, weight, false FROM e) GROUP BY c)
SELECT round(sum(inside / m - pow(degree / (2 * m), 2)), 5) AS q FROM per, (SELECT sum(weight) AS m FROM cw)""")
def modularity_q(t):
    n = nodes(t)
    groups = n.where("label = 'Module'").select(F.col("uid").alias("node"), F.col("project_name").alias("community"))
    return V.modularity(A.community_weights(n, edges(t, ["CALLS", "IMPORTS", "DEFINES"])), groups).select(F.round("q", 5).alias("q"))


@query()
def communities(t):
    return A.communities(nodes(t), edges(t, ["CALLS", "IMPORTS", "DEFINES"]))


@query(""", p AS (SELECT from_uid AS uid FROM defines WHERE to_uid = 'p:1'),
cr AS (SELECT n.uid, n.file_path, n.qualified_name FROM calls JOIN nodes n ON n.uid = from_uid WHERE to_uid = 'p:1' AND n.label = 'Callable')
SELECT 'target' AS role, 1 AS place, uid FROM nodes WHERE uid = 'p:1'
UNION ALL SELECT 'parent', 1, uid FROM p
UNION ALL SELECT 'sibling', CAST(row_number() OVER (ORDER BY uid) AS INTEGER), uid FROM (SELECT to_uid AS uid FROM defines JOIN p ON p.uid = from_uid WHERE to_uid <> 'p:1' ORDER BY to_uid LIMIT 5)
UNION ALL SELECT 'module', 1, from_uid FROM defines WHERE to_uid IN (SELECT uid FROM p)
UNION ALL SELECT 'caller', CAST(row_number() OVER (ORDER BY t, l, uid) AS INTEGER), uid FROM (SELECT uid, contains(lower(file_path), 'test') AS t, length(qualified_name) AS l FROM cr ORDER BY t, l, uid LIMIT 20)""")
def expand_context(t):
    return S.expand_context(nodes(t), edges(t, ["CALLS", "DEFINES"]), "p:1").withColumn("place", F.col("place").cast("int"))


# ---------------------------------------------------------------- resolution


@query("SELECT from_uid, to_uid, candidate_count, from_test, confidence, round(weight, 6) AS weight FROM calls")
def call_edge_weights(t):
    return calls(t).select("from_uid", "to_uid", "candidate_count", "from_test", "confidence", F.round("weight", 6).alias("weight"))


_SITES = """, s AS (SELECT 's:' || l_suppkey AS from_uid, 'p:' || l_partkey AS to_uid, CAST(l_quantity AS INTEGER) % 4 + 1 AS candidate_count, CASE WHEN l_linestatus = 'O' THEN 'unverified_wide' ELSE 'same_file' END AS strategy,
  l_returnflag = 'R' AS from_test, lpad(l_orderkey::VARCHAR, 12, '0') AS file_path, l_linenumber AS line FROM lineitem),
m AS (SELECT from_uid, to_uid, arg_min({'c': candidate_count, 's': strategy}, {'a': candidate_count, 'b': file_path, 'c': line, 'd': strategy}) AS b, bool_and(from_test) AS from_test, min(line) AS line, count(*) AS site_count FROM s GROUP BY ALL)"""


@query(f"""{_SITES} SELECT from_uid, to_uid, b.c AS candidate_count, b.s AS strategy, from_test, line, site_count, CASE WHEN b.c = 1 AND b.s <> 'unverified_wide' THEN 'resolved' ELSE 'ambiguous' END AS confidence,
round(greatest(1.0::DOUBLE / b.c * CASE WHEN b.s = 'unverified_wide' THEN 0.5 ELSE 1 END * CASE WHEN from_test THEN 0.25 ELSE 1 END, 1e-6), 6) AS weight FROM m""")
def call_edge_merge(t):
    line = t.lineitem.select(
        F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("from_uid"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("to_uid"),
        (F.col("l_quantity").cast("int") % 4 + 1).alias("candidate_count"), F.when(F.col("l_linestatus") == "O", "unverified_wide").otherwise("same_file").alias("strategy"),
        (F.col("l_returnflag") == "R").alias("from_test"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("file_path"), F.col("l_linenumber").alias("line"),
    )
    return R.merge_call_sites(line).withColumn("weight", F.round("weight", 6))


_TYPE_REFS = """, refs AS (SELECT o_orderkey AS ref_id, 'c:' || o_custkey AS from_uid, 'w' AS project_name, 'T' || (o_orderkey % 40) AS name, 'f' || (o_custkey % 60) AS file_path FROM orders),
types AS (SELECT 's:' || s_suppkey AS uid, 'w' AS project_name, 'T' || (s_suppkey % 60) AS name, 'f' || (s_suppkey % 60) AS file_path FROM supplier),
imp AS (SELECT DISTINCT 'f' || (c_custkey % 60) AS from_file, 's:' || (c_custkey % 97) AS to_uid FROM customer),
c AS (SELECT refs.*, t.uid AS to_uid, CASE WHEN i.to_uid IS NOT NULL THEN 1 WHEN refs.file_path = t.file_path THEN 2 ELSE 3 END AS rung FROM refs JOIN types t USING (project_name, name) LEFT JOIN imp i ON i.from_file = refs.file_path AND i.to_uid = t.uid),
b AS (SELECT *, min(rung) OVER (PARTITION BY ref_id) AS best FROM c), k AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n FROM b WHERE rung = best),
z AS (SELECT *, row_number() OVER (PARTITION BY from_uid, to_uid ORDER BY rung, ref_id) AS rn FROM k WHERE rung < 3 OR n = 1)"""


@query(f"{_TYPE_REFS} SELECT from_uid, to_uid, CASE rung WHEN 1 THEN 'import' WHEN 2 THEN 'same_file' ELSE 'project_unique' END AS strategy, CASE WHEN rung < 3 THEN 'resolved' ELSE 'ambiguous' END AS confidence, CASE WHEN rung < 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM z WHERE rn = 1")
def resolve_type_refs(t):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c = F.col
    refs = t.orders.select(c("o_orderkey").alias("ref_id"), text("c:", c("o_custkey")).alias("from_uid"), F.lit("w").alias("project_name"), text("T", c("o_orderkey") % 40).alias("name"), text("f", c("o_custkey") % 60).alias("file_path"))
    types = t.supplier.select(text("s:", c("s_suppkey")).alias("uid"), F.lit("w").alias("project_name"), text("T", c("s_suppkey") % 60).alias("name"), text("f", c("s_suppkey") % 60).alias("file_path"))
    imp = t.customer.select(text("f", c("c_custkey") % 60).alias("from_file"), text("s:", c("c_custkey") % 97).alias("to_uid"))
    return R.resolve_type_refs(refs, types, imp)


_CALL_SITES = """, sites AS (SELECT l_orderkey * 10 + l_linenumber AS site_id, 'o:' || l_orderkey AS from_uid, 'w' AS project_name, 'm' || (l_partkey % 50) AS name, 'f' || (l_suppkey % 30) AS file_path, l_linenumber AS line,
  'T' || (l_suppkey % 20) AS owner, CASE WHEN l_linenumber % 5 = 0 THEN 'T' || (l_partkey % 25) END AS receiver, l_linenumber % 5 IN (0, 1, 2) AS has_receiver, l_returnflag = 'R' AS from_test FROM lineitem),
cal AS (SELECT 'p:' || p_partkey AS uid, 'w' AS project_name, 'm' || (p_partkey % 70) AS name, CASE WHEN p_partkey % 6 = 0 THEN 'tests/f' ELSE 'f' END || (p_partkey % 30) AS file_path, 'T' || (p_partkey % 20) AS owner, p_size % 7 = 0 AS is_abstract FROM part),
imp AS (SELECT DISTINCT 'f' || (c_custkey % 30) AS from_file, 'p:' || c_custkey AS to_uid FROM customer),
a AS (SELECT s.*, c.uid AS to_uid, c.file_path AS to_file, c.owner AS to_owner, is_abstract, starts_with(c.file_path, 'tests/') AS to_test, i.to_uid IS NOT NULL AS imported FROM sites s JOIN cal c USING (project_name, name)
  LEFT JOIN imp i ON i.from_file = s.file_path AND i.to_uid = c.uid WHERE receiver IS NULL OR receiver IN (SELECT owner FROM cal)),
b AS (SELECT *, max((NOT to_test)::INT) OVER (PARTITION BY site_id) AS other FROM a), c2 AS (SELECT * FROM b WHERE from_test OR NOT to_test OR other = 0),
d AS (SELECT *, max((NOT is_abstract)::INT) OVER (PARTITION BY site_id) AS concrete FROM c2), e2 AS (SELECT *, CASE WHEN imported AND NOT has_receiver THEN 1 WHEN owner = to_owner AND receiver IS NULL AND has_receiver THEN 2 WHEN file_path = to_file AND NOT has_receiver THEN 3 WHEN receiver = to_owner THEN 4 ELSE 5 END AS rung FROM d WHERE NOT is_abstract OR concrete = 0),
f2 AS (SELECT *, min(rung) OVER (PARTITION BY site_id) AS best FROM e2), g2 AS (SELECT *, CAST(count(*) OVER (PARTITION BY site_id) AS INTEGER) AS candidate_count FROM f2 WHERE rung = best)"""


@query(f"""{_CALL_SITES} SELECT site_id, from_uid, to_uid, candidate_count, CASE rung WHEN 1 THEN 'import' WHEN 2 THEN 'sibling' WHEN 3 THEN 'same_file' WHEN 4 THEN 'receiver' ELSE
CASE WHEN has_receiver THEN CASE WHEN candidate_count = 1 THEN 'unverified_receiver' ELSE 'unverified_wide' END ELSE CASE WHEN candidate_count = 1 THEN 'project_unique' ELSE 'project_wide' END END END AS strategy, from_test, file_path, line FROM g2""")
def resolve_calls_core(t):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c = F.col
    sites = t.lineitem.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("site_id"), text("o:", c("l_orderkey")).alias("from_uid"), F.lit("w").alias("project_name"), text("m", c("l_partkey") % 50).alias("name"), text("f", c("l_suppkey") % 30).alias("file_path"),
        c("l_linenumber").alias("line"), text("T", c("l_suppkey") % 20).alias("owner"), F.when(c("l_linenumber") % 5 == 0, text("T", c("l_partkey") % 25)).alias("receiver"), (c("l_linenumber") % 5).isin(0, 1, 2).alias("has_receiver"), (c("l_returnflag") == "R").alias("from_test"),
    )
    callables = t.part.select(
        text("p:", c("p_partkey")).alias("uid"), F.lit("w").alias("project_name"), text("m", c("p_partkey") % 70).alias("name"), F.concat(F.when(c("p_partkey") % 6 == 0, "tests/f").otherwise("f"), (c("p_partkey") % 30).cast("string")).alias("file_path"),
        text("T", c("p_partkey") % 20).alias("owner"), (c("p_size") % 7 == 0).alias("is_abstract"),
    )
    imp = t.customer.select(text("f", c("c_custkey") % 30).alias("from_file"), text("p:", c("c_custkey")).alias("to_uid"))
    return R.resolve_calls(sites, callables, imp, F.col("c.file_path").startswith("tests/"))


@query("""WITH i AS (SELECT o_orderkey AS import_id, 'w' AS project_name, 'a' || (o_orderkey % 5) || '.b' || (o_orderkey % 11) || '.c' || (o_orderkey % 23) AS target FROM orders),
e AS (SELECT 'p:' || p_partkey AS uid, 'w' AS project_name, CASE p_partkey % 3 WHEN 0 THEN 'a' || (p_partkey % 4) WHEN 1 THEN 'a' || (p_partkey % 5) || '.b' || (p_partkey % 11) ELSE 'a' || (p_partkey % 5) || '.b' || (p_partkey % 11) || '.c' || (p_partkey % 23) END AS qualified_name FROM part),
u AS (SELECT min(uid) AS uid, project_name, qualified_name FROM e GROUP BY ALL),
h AS (SELECT import_id, arg_max(uid, length(qualified_name)) AS uid FROM i JOIN u USING (project_name) WHERE target = qualified_name OR starts_with(target, qualified_name || '.') GROUP BY import_id)
SELECT import_id, coalesce(uid, project_name || ':ext/' || split_part(target, '.', 1)) AS to_uid, uid IS NOT NULL AS internal, CASE WHEN uid IS NULL THEN split_part(target, '.', 1) END AS package FROM i LEFT JOIN h USING (import_id)""", graph=False)
def resolve_imports(t):
    text = lambda *p: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in p))
    o, k = F.col("o_orderkey"), F.col("p_partkey")
    refs = t.orders.select(o.alias("import_id"), F.lit("w").alias("project_name"), text("a", o % 5, ".b", o % 11, ".c", o % 23).alias("target"))
    qn = F.when(k % 3 == 0, text("a", k % 4)).when(k % 3 == 1, text("a", k % 5, ".b", k % 11)).otherwise(text("a", k % 5, ".b", k % 11, ".c", k % 23))
    e = t.part.select(text("p:", k).alias("uid"), F.lit("w").alias("project_name"), qn.alias("qualified_name")).groupBy("project_name", "qualified_name").agg(F.min("uid").alias("uid"))
    return R.resolve_imports(refs, e)


_CITED = """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'see ADR-' || (doc_id % 30) || ' and RFC ' || lpad((doc_id % 50)::VARCHAR, 4, '0') WHEN 1 THEN 'adr_' || (doc_id % 7) || ', ADR ' || (doc_id % 7) ELSE text END AS text FROM documents)"""


def _cited(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    text = lambda c: c.cast("string")
    return t.documents.select("doc_id", F.when(d % 4 == 0, F.concat(F.lit("see ADR-"), text(d % 30), F.lit(" and RFC "), F.lpad(text(d % 50), 4, "0"))).when(d % 4 == 1, F.concat(F.lit("adr_"), text(d % 7), F.lit(", ADR "), text(d % 7))).otherwise(F.col("text")).alias("text"))


_KEYS = f"(SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(upper(text), '\\b((?:ADR|RFC)[ \\-_#]?[0-9]{{1,6}})\\b', 1), lambda x: left(x, 3) || '-' || CAST(regexp_extract(x, '([0-9]+)$', 1) AS INTEGER)))) AS keys FROM {_CITED})"


@query(f"SELECT doc_id, array_to_string(keys, ' ') AS keys FROM {_KEYS} WHERE len(keys) > 0", graph=False)
def citation_keys(t):
    return _cited(t).select("doc_id", X.citation_keys(F.col("text")).alias("k")).where(F.size("k") > 0).select("doc_id", F.array_join("k", " ").alias("keys"))


@query(f"""WITH c AS (SELECT doc_id AS entity_uid, unnest(keys) AS key FROM {_KEYS}), k AS (SELECT DISTINCT 'ADR-' || (item_id % 25) AS key, item_id AS doc_uid, CAST(item_id % 3 AS INTEGER) AS rank FROM benchmark),
b AS (SELECT *, min(rank) OVER (PARTITION BY key) AS best FROM k), u AS (SELECT key, any_value(doc_uid) AS doc_uid, any_value(rank) AS rank FROM b WHERE rank = best GROUP BY key HAVING count(*) = 1)
SELECT entity_uid, key, doc_uid, CASE rank WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 END::DOUBLE AS doc_confidence FROM c LEFT JOIN u USING (key)""", graph=False)
def citation_resolution(t):
    c = _cited(t).select(F.col("doc_id").alias("entity_uid"), F.explode(X.citation_keys(F.col("text"))).alias("key"))
    i = F.col("item_id")
    keys = t.benchmark.select(F.concat(F.lit("ADR-"), (i % 25).cast("string")).alias("key"), i.alias("doc_uid"), (i % 3).cast("int").alias("rank"))
    return R.resolve_citations(c, keys)


@query("""WITH f AS (SELECT 'n:' || n_nationkey AS uid, 'src/' || r_name || '/' || n_name || '.py' AS file_path FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT c_custkey AS ref_id, CASE c_custkey % 3 WHEN 0 THEN n_name || '.py' WHEN 1 THEN 'src/' || r_name || '/' || n_name || '.py' ELSE 'missing/' || n_name END AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT ref_id, min(uid) AS uid FROM r JOIN f ON f.file_path = r.path OR ends_with(f.file_path, '/' || r.path) GROUP BY ref_id HAVING count(DISTINCT uid) = 1""", graph=False)
def resolve_paths(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("src/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit(".py"))
    files = n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("uid"), path.alias("file_path"))
    k = F.col("c_custkey")
    refs = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("ref_id"), F.when(k % 3 == 0, F.concat("n_name", F.lit(".py"))).when(k % 3 == 1, path).otherwise(F.concat(F.lit("missing/"), F.col("n_name"))).alias("path"))
    return R.resolve_paths(refs, files)


@query("SELECT DISTINCT a.project_name AS from_project, b.project_name AS to_project FROM imports JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid WHERE a.project_name <> b.project_name")
def depends_on(t):
    return R.depends_on(imports(t), nodes(t, ["Module", "TypeDef"]))


#: Protocols that parts are dealt to; many, so that some are small enough for a supplier to conform to.
PROTOCOLS = 997
_MEMBERS = f", m AS (SELECT DISTINCT 's:' || l_suppkey AS uid, 'm' || (l_partkey % 30) AS member FROM lineitem), p AS (SELECT DISTINCT 'b:' || (p_partkey % {PROTOCOLS}) AS uid, 'm' || (p_partkey % 30) AS member FROM part WHERE p_size <= 6)"


@query(f"""{_MEMBERS} SELECT from_uid, to_uid, 'IMPLEMENTS' AS rel_type, true AS inferred, 0.5::DOUBLE AS weight FROM (SELECT DISTINCT uid AS from_uid FROM m), (SELECT DISTINCT uid AS to_uid FROM p)
WHERE NOT EXISTS (SELECT member FROM p WHERE p.uid = to_uid EXCEPT SELECT member FROM m WHERE m.uid = from_uid)""")
def protocol_conformance(t):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    members = t.lineitem.select(text("s:", F.col("l_suppkey")).alias("uid"), text("m", F.col("l_partkey") % 30).alias("member"))
    protocols = t.part.where("p_size <= 6").select(text("b:", F.col("p_partkey") % PROTOCOLS).alias("uid"), text("m", F.col("p_partkey") % 30).alias("member"))
    return R.protocol_conformance(members, protocols)


@query("""SELECT a.to_uid AS from_uid, b.to_uid AS to_uid, CASE WHEN base % 2 = 0 THEN 'IMPLEMENTS' ELSE 'OVERRIDES' END AS rel_type
FROM (SELECT s_suppkey AS child, s_suppkey % 10 + 1 AS base FROM supplier WHERE s_suppkey > 10) i JOIN defines a ON a.from_uid = 's:' || child JOIN part x ON 'p:' || x.p_partkey = a.to_uid
JOIN defines b ON b.from_uid = 's:' || base JOIN part y ON 'p:' || y.p_partkey = b.to_uid AND y.p_brand = x.p_brand""")
def member_overrides(t):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("s_suppkey")
    base = t.supplier.where("s_suppkey > 10").select(text("s:", k).alias("from_uid"), text("s:", k % 10 + 1).alias("to_uid"))
    types = t.supplier.select(text("s:", k).alias("uid"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "interface").otherwise("class").alias("kind"))
    parts = t.part.select(text("p:", F.col("p_partkey")).alias("uid"), F.col("p_brand").alias("name"), F.lit("method").alias("kind"))
    return R.overrides(base, defines(t), types.unionByName(parts))


_TEXT = lambda p, c: F.concat(F.lit(p), c.cast("string"))


@query("""WITH r AS (SELECT o_orderkey AS ref_id, 'T' || (o_orderkey % 45) AS name, 'd' || (o_custkey % 6) || '/f' || (o_custkey % 18) AS file_path, 'n:' || (o_custkey % 25) AS fallback FROM orders),
y AS (SELECT 's:' || s_suppkey AS uid, 'T' || (s_suppkey % 40) AS name, 'd' || (s_suppkey % 6) || '/f' || (s_suppkey % 18) AS file_path FROM supplier),
c AS (SELECT r.*, y.uid, CASE WHEN y.uid IS NULL THEN 4 WHEN r.file_path = y.file_path THEN 1 WHEN split_part(r.file_path, '/', 1) = split_part(y.file_path, '/', 1) THEN 2 ELSE 3 END AS rung FROM r LEFT JOIN y USING (name)),
b AS (SELECT *, min(rung) OVER (PARTITION BY ref_id) AS best FROM c)
SELECT CASE WHEN count(*) = 1 AND min(rung) < 4 THEN min(uid) ELSE min(fallback) END AS from_uid, 'o:' || ref_id AS to_uid, 'DEFINES' AS rel_type FROM b WHERE rung = best GROUP BY ref_id""", graph=False)
def resolve_member_defines(t):
    c = F.col
    path = lambda k: F.concat(_TEXT("d", k % 6), _TEXT("/f", k % 18))
    refs = t.orders.select(c("o_orderkey").alias("ref_id"), _TEXT("o:", c("o_orderkey")).alias("member_uid"), F.lit("w").alias("project_name"), _TEXT("T", c("o_orderkey") % 45).alias("name"), path(c("o_custkey")).alias("file_path"), _TEXT("n:", c("o_custkey") % 25).alias("fallback_uid"))
    types = t.supplier.select(_TEXT("s:", c("s_suppkey")).alias("uid"), F.lit("w").alias("project_name"), _TEXT("T", c("s_suppkey") % 40).alias("name"), path(c("s_suppkey")).alias("file_path"))
    return R.resolve_members(refs, types)


@query("""SELECT 'c:' || c_custkey AS from_uid, coalesce((SELECT min('s:' || s_suppkey) FROM supplier WHERE 'B' || (s_suppkey % 30) = 'B' || (c_custkey % 60)), (SELECT min('x:' || n_nationkey) FROM nation WHERE 'B' || (n_nationkey + 25) = 'B' || (c_custkey % 60)),
  'w:ext/builtins.B' || (c_custkey % 60)) AS to_uid, 'INHERITS' AS rel_type FROM customer""", graph=False)
def resolve_inherits(t):
    c = F.col
    refs = t.customer.select(_TEXT("c:", c("c_custkey")).alias("from_uid"), F.lit("w").alias("project_name"), _TEXT("B", c("c_custkey") % 60).alias("name"))
    types = t.supplier.select(_TEXT("s:", c("s_suppkey")).alias("uid"), F.lit("w").alias("project_name"), _TEXT("B", c("s_suppkey") % 30).alias("name"))
    ext = t.nation.select(_TEXT("x:", c("n_nationkey")).alias("uid"), F.lit("w").alias("project_name"), _TEXT("B", c("n_nationkey") + 25).alias("name"))
    return R.resolve_inherits(refs, types, ext)


@query("""WITH e AS (SELECT 'p:' || p_partkey AS uid, CASE WHEN p_partkey % 4 = 0 THEN 'Module' ELSE 'Callable' END AS label, 'm' || p_partkey AS name, 'src/d' || (p_partkey // 4 % 300) || '/f' || (p_partkey // 4) || '.py' AS file_path, CASE WHEN p_size > 25 THEN 'h' ELSE 'g' END || p_partkey AS h FROM part),
a AS (SELECT o_orderkey AS anchor_id, 'f' || (o_orderkey % 700) || '.py' AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || (4 * (o_orderkey % 700) + o_orderkey % 5) END AS symbol FROM orders),
f AS (SELECT anchor_id, path, symbol, min(uid) AS fu, min(file_path) AS fp FROM a LEFT JOIN e ON label = 'Module' AND ends_with(file_path, '/' || path) GROUP BY anchor_id, path, symbol HAVING count(uid) <= 1),
g AS (SELECT anchor_id, CASE WHEN symbol IS NULL THEN fu ELSE (SELECT min(uid) FROM e WHERE label <> 'Module' AND e.file_path = fp AND e.name = symbol) END AS to_uid FROM f)
SELECT anchor_id, to_uid, e.h AS anchor_hash FROM g LEFT JOIN e ON e.uid = to_uid""", graph=False)
def resolve_anchors(t):
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    file = F.floor(k / 4)
    ents = t.part.select(
        _TEXT("p:", k).alias("uid"), F.when(k % 4 == 0, "Module").otherwise("Callable").alias("label"), _TEXT("m", k).alias("name"), F.concat(_TEXT("src/d", file % 300), _TEXT("/f", file), F.lit(".py")).alias("file_path"),
        F.concat(F.when(F.col("p_size") > 25, "h").otherwise("g"), k.cast("string")).alias("content_hash"),
    )
    path = F.concat(_TEXT("f", o % 700), F.lit(".py"))
    anchors = t.orders.select(o.alias("anchor_id"), F.lit("n").alias("note_uid"), F.when(o % 2 == 0, F.concat(path, F.lit("#"), _TEXT("m", 4 * (o % 700) + o % 5))).otherwise(path).alias("anchor"))
    return R.resolve_anchors(anchors, ents).select("anchor_id", "to_uid", "anchor_hash")


@query("""WITH l AS (SELECT o_orderkey AS from_uid, o_custkey % 90 AS k, o_orderstatus FROM orders)
SELECT from_uid, 'p:' || k AS to_uid, NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k AND p_size > 20) AS stale FROM l""", graph=False)
def stale_anchors(t):
    c = F.col
    links = t.orders.select(c("o_orderkey").alias("from_uid"), _TEXT("p:", c("o_custkey") % 90).alias("to_uid"), F.lit("big").alias("anchor_hash"))
    now = t.part.select(_TEXT("p:", c("p_partkey")).alias("uid"), F.when(c("p_size") > 20, "big").otherwise("small").alias("content_hash"))
    return R.stale_anchors(links, now).select("from_uid", "to_uid", "stale")


_CONFIG = "(SELECT 'o:' || o_orderkey AS from_uid, CASE WHEN o_custkey % 2 = 0 THEN 'q' ELSE 'w' END AS project_name, CASE WHEN o_orderkey % 3 = 0 THEN 'file' ELSE 'env' END AS kind, 'X' || (o_custkey % 31) AS target FROM orders)"


@query(f"SELECT DISTINCT CASE WHEN kind = 'env' THEN 'env/' || target ELSE project_name || ':res/' || target END AS uid, CASE WHEN kind = 'env' THEN 'EnvVar' ELSE 'ResourceFile' END AS label, CASE WHEN kind = 'env' THEN '_global' ELSE project_name END AS project_name, target AS name FROM {_CONFIG}", graph=False)
def config_nodes(t):
    return R.config_refs(_config(t))[0]


@query(f"SELECT DISTINCT from_uid, CASE WHEN kind = 'env' THEN 'env/' || target ELSE project_name || ':res/' || target END AS to_uid, CASE WHEN kind = 'env' THEN 'READS_ENV' ELSE 'REFERENCES_FILE' END AS rel_type FROM {_CONFIG}", graph=False)
def config_edges(t):
    return R.config_refs(_config(t))[1]


def _config(t: Tables) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(_TEXT("o:", o).alias("from_uid"), F.when(k % 2 == 0, "q").otherwise("w").alias("project_name"), F.when(o % 3 == 0, "file").otherwise("env").alias("kind"), _TEXT("X", k % 31).alias("target"))


@query("""SELECT DISTINCT 'o:' || o_orderkey AS from_uid, coalesce((SELECT 'pkg:' || min(r_regionkey) FROM region WHERE r_regionkey = o_custkey % 9), 'ext:' || (o_custkey % 9)) AS to_uid FROM orders""", graph=False)
def cross_project_imports(t):
    c = F.col
    e = t.orders.select(_TEXT("o:", c("o_orderkey")).alias("from_uid"), _TEXT("ext:", c("o_custkey") % 9).alias("to_uid"), F.lit("IMPORTS").alias("rel_type"))
    ext = t.customer.select(_TEXT("ext:", c("c_custkey") % 9).alias("uid"), _TEXT("top", c("c_custkey") % 9).alias("name")).distinct()
    packages = t.region.select(_TEXT("pkg:", c("r_regionkey")).alias("uid"), _TEXT("top", c("r_regionkey")).alias("name"))
    return R.cross_project_imports(e, ext, packages).select("from_uid", "to_uid")


@query("""WITH e AS (SELECT 'p:' || p_partkey AS uid, CASE WHEN p_partkey % 5 = 0 THEN 'Note' ELSE 'Callable' END AS label, 's' || (p_partkey % 1500) AS name, 'src/f' || (p_partkey % 1700) || '.py' AS file_path FROM part),
r AS (SELECT o_orderkey AS ref_id, o_orderkey % 2 = 0 AS is_file, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || (o_custkey % 1800) || '.py' ELSE 's' || (o_custkey % 1600) END AS target FROM orders)
SELECT 'd:' || ref_id AS from_uid, min(uid) AS to_uid, 'DOCUMENTS' AS rel_type, 'mention' AS link_type, 0.5::DOUBLE AS doc_confidence FROM r JOIN e ON label <> 'Note' AND CASE WHEN is_file THEN ends_with(file_path, '/' || target) ELSE name = target END GROUP BY ref_id HAVING count(*) = 1""", graph=False)
def doc_links(t):
    k, o, u = F.col("p_partkey"), F.col("o_orderkey"), F.col("o_custkey")
    ents = t.part.select(_TEXT("p:", k).alias("uid"), F.when(k % 5 == 0, "Note").otherwise("Callable").alias("label"), F.lit("w").alias("project_name"), _TEXT("s", k % 1500).alias("name"), F.concat(_TEXT("src/f", k % 1700), F.lit(".py")).alias("file_path"))
    refs = t.orders.select(o.alias("ref_id"), _TEXT("d:", o).alias("from_uid"), F.lit("w").alias("project_name"), F.when(o % 2 == 0, F.concat(_TEXT("f", u % 1800), F.lit(".py"))).otherwise(_TEXT("s", u % 1600)).alias("target"), (o % 2 == 0).alias("is_file"), F.lit("mention").alias("link_type"), F.lit(0.5).alias("confidence"))
    return R.doc_links(refs, ents)


@query("""WITH e AS (SELECT 'p:' || p_partkey AS uid, 'm' || (p_partkey % 200) AS name, 'f' || (p_partkey % 40) AS file_path FROM part), i AS (SELECT DISTINCT 'f' || (c_custkey % 40) AS from_file, 'p:' || c_custkey AS to_uid FROM customer),
c AS (SELECT 'o:' || o_orderkey AS from_uid, e.uid AS to_uid, CASE WHEN e.file_path = 'f' || (o_custkey % 40) THEN 1 WHEN i.to_uid IS NOT NULL THEN 2 END AS rung FROM orders JOIN e ON e.name = 'm' || (o_orderkey % 200) LEFT JOIN i ON i.from_file = 'f' || (o_custkey % 40) AND i.to_uid = e.uid)
SELECT from_uid, to_uid, 'REGISTERED_BY' AS rel_type FROM c WHERE rung IS NOT NULL QUALIFY rung = min(rung) OVER (PARTITION BY from_uid)""", graph=False)
def registered_by(t):
    k, o, u = F.col("p_partkey"), F.col("o_orderkey"), F.col("o_custkey")
    ents = t.part.select(_TEXT("p:", k).alias("uid"), F.lit("Callable").alias("label"), F.lit("w").alias("project_name"), _TEXT("m", k % 200).alias("name"), _TEXT("f", k % 40).alias("file_path"))
    refs = t.orders.select(_TEXT("o:", o).alias("from_uid"), F.lit("w").alias("project_name"), _TEXT("f", u % 40).alias("file_path"), _TEXT("m", o % 200).alias("name"))
    imp = t.customer.select(_TEXT("f", F.col("c_custkey") % 40).alias("from_file"), _TEXT("p:", F.col("c_custkey")).alias("to_uid"))
    return R.registered_by(refs, ents, imp)


@query("""SELECT a.to_uid AS from_uid, b.to_uid AS to_uid, 'IMPLEMENTS' AS rel_type, true AS inferred, 0.5::DOUBLE AS weight FROM (SELECT c_custkey AS x, c_custkey % 10 + 1 AS y FROM customer WHERE c_custkey > 10) i
JOIN defines a ON a.from_uid = 'c:' || x JOIN orders p ON 'o:' || p.o_orderkey = a.to_uid JOIN defines b ON b.from_uid = 'c:' || y JOIN orders q ON 'o:' || q.o_orderkey = b.to_uid AND q.o_orderpriority = p.o_orderpriority""")
def protocol_members(t):
    k = F.col("c_custkey")
    conforms = t.customer.where("c_custkey > 10").select(_TEXT("c:", k).alias("from_uid"), _TEXT("c:", k % 10 + 1).alias("to_uid"))
    named = t.orders.select(_TEXT("o:", F.col("o_orderkey")).alias("uid"), F.lit("Callable").alias("label"), F.col("o_orderpriority").alias("name"))
    return R.protocol_members(conforms, defines(t), named)


# ---------------------------------------------------------------- change

_SNAPSHOTS = """WITH o AS (SELECT o_orderkey AS uid, left(sha256(o_orderpriority), 16) AS content_hash, o_orderstatus AS signature, o_orderpriority AS docstring, 1 AS line_start, 9 AS line_end FROM orders WHERE o_orderkey % 10 <> 3),
n AS (SELECT o_orderkey AS uid, left(sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END), 16) AS content_hash, CASE WHEN o_orderkey % 14 = 0 THEN 'y' ELSE o_orderstatus END AS signature, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS docstring, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS line_start, CASE WHEN o_orderkey % 11 = 0 THEN 8 ELSE 9 END AS line_end FROM orders WHERE o_orderkey % 10 <> 4)"""


@query(f"""{_SNAPSHOTS}, j AS (SELECT coalesce(o.uid, n.uid) AS uid, o.uid AS ou, n.uid AS nu, o.* EXCLUDE (uid), n.content_hash AS ch, n.signature AS sg, n.docstring AS ds, n.line_start AS ls, n.line_end AS le FROM o FULL JOIN n ON o.uid = n.uid),
k AS (SELECT *, CASE WHEN ou IS NULL THEN 'added' WHEN nu IS NULL THEN 'deleted' WHEN content_hash <> ch THEN 'modified' WHEN line_start <> ls OR line_end <> le THEN 'moved' ELSE 'unchanged' END AS change FROM j)
SELECT uid, change, CASE WHEN change = 'modified' THEN CASE WHEN signature = sg AND docstring <> ds THEN 'MODERATE' ELSE 'HIGH' END WHEN change IN ('added', 'deleted') THEN 'HIGH' END AS significance FROM k""", graph=False)
def delta_classify(t):
    k, p, s = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    sha = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    changed = F.when(k % 7 == 0, "x").otherwise(p)
    old = t.orders.where(k % 10 != 3).select(k.alias("uid"), sha(p).alias("content_hash"), s.alias("signature"), p.alias("docstring"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"))
    new = t.orders.where(k % 10 != 4).select(k.alias("uid"), sha(changed).alias("content_hash"), F.when(k % 14 == 0, "y").otherwise(s).alias("signature"), changed.alias("docstring"), F.when(k % 5 == 0, 2).otherwise(1).alias("line_start"), F.when(k % 11 == 0, 8).otherwise(9).alias("line_end"))
    return D.classify(old, new)


@query("""SELECT uid, left(sha256(array_to_string(list_concat([name, coalesce(kind, ''), visibility, '(' || line_end || ')', coalesce(docstring, ''), CASE WHEN label < project_name THEN label || ',' || project_name ELSE project_name || ',' || label END, qualified_name, ''],
  CASE WHEN kind = 'enum' THEN ['rationale:' || name] ELSE [] END, CASE WHEN label = 'Module' THEN ['citations:ADR-1,RFC-2'] ELSE [] END), chr(0))), 16) AS hash FROM nodes""")
def content_hash(t):
    c = F.col
    hashed = X.content_hash(
        c("name"), c("kind"), c("visibility"), F.concat(F.lit("("), c("line_end").cast("string"), F.lit(")")), c("docstring"), F.array("project_name", "label"), c("qualified_name"),
        rationale=F.when(c("kind") == "enum", c("name")), citations=F.when(c("label") == "Module", F.array(F.lit("RFC-2"), F.lit("ADR-1"))),
    )
    return nodes(t).select("uid", hashed.alias("hash"))


_WRITTEN = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) || chr(10) WHEN 2 THEN replace(text, chr(10), chr(13)) || ' ' || chr(10) ELSE text || chr(10) || chr(10) || ' ' || chr(10) || 'x' END"


@query(f"""SELECT doc_id, left(sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), '[ \\t\\x0b\\x0c]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')), 16) AS hash
FROM (SELECT doc_id, {_WRITTEN} AS text FROM documents)""", graph=False)
def file_hash(t):
    d, text, n, r = F.col("doc_id"), F.col("text"), F.lit("\n"), F.lit("\r")
    written = F.when(d % 4 == 0, text).when(d % 4 == 1, F.concat(F.replace(text, n, F.lit("\r\n")), n)).when(d % 4 == 2, F.concat(F.replace(text, n, r), F.lit(" \n"))).otherwise(F.concat(text, F.lit("\n\n \nx")))
    return t.documents.select("doc_id", X.file_hash(written).alias("hash"))


@query("SELECT uid FROM nodes WHERE label IN ('TypeDef') AND uid NOT IN (SELECT to_uid FROM calls WHERE candidate_count = 1) AND starts_with(uid, 'p:')")
def orphan_references(t):
    parts = nodes(t, ["TypeDef"]).where(F.col("uid").startswith("p:"))
    kept = D.collect_orphans(parts, calls(t).where("candidate_count = 1"), ("TypeDef",)).select("uid")
    return parts.select("uid").join(kept, "uid", "left_anti")


# ---------------------------------------------------------------- events


@query("SELECT user_id, event_type, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY ALL", graph=False)
def events_dedup_latest(t):
    return E.latest_event(t.events, "user_id", "event_type").select("user_id", "event_type", "event_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", graph=False)
def events_tumbling(t):
    return E.tumbling(t.events, "1 hour", "event_type").withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(4) r(k) GROUP BY ALL", graph=False)
def events_sliding(t):
    return E.sliding(t.events, "1 hour", "15 minutes", "event_type").withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM g GROUP BY user_id, k""", graph=False)
def events_session(t):
    return E.sessions(t.events, "6 hours", "user_id")


@query("""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, coalesce(epoch(ts) - epoch(before) < 3600, false) AS deferred FROM l""", graph=False)
def events_cooldown(t):
    return E.cooled_down(t.events, "user_id", seconds=3600).select("event_id", "deferred")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS path, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT path, n, t AS a, t AS b, 1 AS burst FROM e WHERE n = 1 UNION ALL
  SELECT e.path, e.n, CASE WHEN e.t - b >= 3600 OR e.t - a >= 14400 THEN e.t ELSE a END, e.t, burst + CASE WHEN e.t - b >= 3600 OR e.t - a >= 14400 THEN 1 ELSE 0 END FROM r JOIN e ON e.path = r.path AND e.n = r.n + 1)
SELECT path, min(a)::DOUBLE AS first_event, max(b)::DOUBLE AS last_event, count(*) AS n FROM r GROUP BY path, burst""", graph=False)
def events_debounced(t):
    return E.debounced(t.events.withColumn("path", F.col("user_id").cast("string")), gap=3600.0, cap=14400.0)


# ---------------------------------------------------------------- text extraction


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages", graph=False)
def href_extract(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT name, CASE WHEN regexp_matches(name, '^__.+__$') THEN 'public' WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS visibility FROM (SELECT DISTINCT CASE o_custkey % 4 WHEN 0 THEN '__' WHEN 1 THEN '_' ELSE '' END || 'n' || (o_custkey % 50) || CASE o_custkey % 8 WHEN 0 THEN '__' ELSE '' END AS name FROM orders)", graph=False)
def name_visibility(t):
    k = F.col("o_custkey")
    name = F.concat(F.when(k % 4 == 0, "__").when(k % 4 == 1, "_").otherwise(""), F.lit("n"), (k % 50).cast("string"), F.when(k % 8 == 0, "__").otherwise(""))
    return t.orders.select(name.alias("name")).distinct().select("name", X.name_visibility(F.col("name")).alias("visibility"))


# ---------------------------------------------------------------- lint


@query("SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1", graph=False)
def duplicate_ids(t):
    return A.duplicate_ids(t.orders.select(F.col("o_custkey").alias("uid")))


@query("SELECT 'c:' || c_custkey AS uid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", graph=False)
def orphan_notes(t):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = t.orders.where("o_orderpriority = '1-URGENT'").select(text("o:", "o_orderkey").alias("from_uid"), text("c:", "o_custkey").alias("to_uid"))
    return A.orphan_notes(t.customer.select(text("c:", "c_custkey").alias("uid")), links)


@query("SELECT to_uid AS uid, count(DISTINCT project_name) AS projects FROM calls JOIN nodes ON uid = from_uid GROUP BY to_uid HAVING count(DISTINCT project_name) >= 2")
def promotion_candidates(t):
    return A.promotion_candidates(calls(t).select("from_uid", "to_uid"), nodes(t, ["Callable"]))


import graphloom.plans.rules  # noqa: E402, F401  registers the other queries
