"""The projection of ``sources.graph`` as SQL: common table expressions that oracles start with."""

from graphloom.sources.graph import IMPORT_QUANTILE

_BALANCE = "CASE WHEN {0} < 0 THEN 'private' WHEN {0} < 2500 THEN 'protected' WHEN {0} < 5000 THEN 'internal' ELSE 'public' END"

CTES = {
    "places": "SELECT n_nationkey, n_name, n_regionkey, r_name AS project_name, r_name || '/' || n_name AS file_path, r_name || '.' || n_name AS module_qn FROM nation JOIN region ON n_regionkey = r_regionkey",
    "home": "SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey",
    "per_order": "SELECT l_orderkey, count(*) AS n, bool_and(l_returnflag = 'R') AS from_test FROM lineitem GROUP BY l_orderkey",
    "nodes": f"""
SELECT 'r:' || r_regionkey AS uid, 'Project' AS label, r_name AS project_name, r_name AS qualified_name, '' AS file_path, r_name AS name, CAST(NULL AS VARCHAR) AS kind, 'public' AS visibility, CAST(NULL AS VARCHAR) AS docstring, 1 AS line_start, 1 AS line_end FROM region
UNION ALL SELECT 'pkg:' || r_regionkey, 'Package', r_name, r_name, r_name, r_name, NULL, 'public', NULL, 1, 1 FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'Module', project_name, module_qn, file_path, n_name, NULL, 'public', NULL, 1, 1 FROM places
UNION ALL SELECT 'c:' || c_custkey, 'TypeDef', project_name, module_qn || '.' || c_name, file_path, c_name, 'class', {_BALANCE.format("c_acctbal")}, CASE WHEN c_acctbal >= 1000 THEN c_mktsegment END, 1, 1 FROM customer JOIN places ON c_nationkey = n_nationkey
UNION ALL SELECT 's:' || s_suppkey, 'TypeDef', project_name, module_qn || '.' || s_name, file_path, s_name, 'interface', {_BALANCE.format("s_acctbal")}, NULL, 1, 1 FROM supplier JOIN places ON s_nationkey = n_nationkey
UNION ALL SELECT 'p:' || p_partkey, 'TypeDef', coalesce(h.project_name, ''), p_brand || '.' || p_name, coalesce(h.file_path, ''), p_name, 'enum', 'public', CASE WHEN p_size > 10 THEN p_type END, 1, 1
  FROM part LEFT JOIN (SELECT l_partkey, project_name, file_path FROM home JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey) h ON p_partkey = l_partkey
UNION ALL SELECT 'o:' || o_orderkey, 'Callable', project_name, module_qn || '.' || c_name || '.order_' || o_orderkey, file_path, 'order_' || o_orderkey, 'method', CASE WHEN o_orderstatus = 'F' THEN 'private' ELSE 'public' END, NULL, 1, CAST(coalesce(n, 1) AS INTEGER)
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey LEFT JOIN per_order ON o_orderkey = l_orderkey""",
    "contains": "SELECT 'r:' || r_regionkey AS from_uid, 'pkg:' || r_regionkey AS to_uid, 'CONTAINS' AS rel_type FROM region UNION ALL SELECT 'pkg:' || n_regionkey, 'n:' || n_nationkey, 'CONTAINS' FROM nation",
    "defines": "SELECT 'n:' || c_nationkey AS from_uid, 'c:' || c_custkey AS to_uid, 'DEFINES' AS rel_type FROM customer UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'DEFINES' FROM supplier "
    "UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'DEFINES' FROM orders UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'DEFINES' FROM home",
    "calls": """
SELECT 'o:' || l.l_orderkey AS from_uid, 'p:' || l_partkey AS to_uid, 'CALLS' AS rel_type, CAST(any_value(n) AS INTEGER) AS candidate_count, any_value(from_test) AS from_test, CAST(count(*) AS INTEGER) AS site_count, min(l_linenumber) AS line,
  CASE WHEN any_value(n) = 1 THEN 'resolved' ELSE 'ambiguous' END AS confidence, greatest(1.0 / any_value(n) * CASE WHEN any_value(from_test) THEN 0.25 ELSE 1.0 END, 1e-6::DOUBLE)::DOUBLE AS weight
FROM lineitem l JOIN per_order USING (l_orderkey) GROUP BY l.l_orderkey, l_partkey""",
    "trade": "SELECT c_nationkey, s_nationkey, s_suppkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL",
    "strong": f"SELECT c_nationkey, s_nationkey FROM (SELECT c_nationkey, s_nationkey, sum(n) AS w FROM trade GROUP BY ALL) QUALIFY w >= quantile_cont(w, {IMPORT_QUANTILE}) OVER ()",
    "imports": "SELECT 'n:' || c_nationkey AS from_uid, 'n:' || s_nationkey AS to_uid, 'IMPORTS' AS rel_type FROM strong UNION ALL SELECT 'n:' || c_nationkey, 's:' || s_suppkey, 'IMPORTS' FROM trade JOIN strong USING (c_nationkey, s_nationkey)",
    "inherits": "SELECT 'p:' || p_partkey AS from_uid, 'p:' || base AS to_uid, 'INHERITS' AS rel_type FROM part JOIN (SELECT p_brand, min(p_partkey) AS base FROM part GROUP BY p_brand) USING (p_brand) WHERE base <> p_partkey",
    "edges": "SELECT from_uid, to_uid, rel_type FROM contains UNION ALL SELECT from_uid, to_uid, rel_type FROM defines UNION ALL SELECT from_uid, to_uid, rel_type FROM calls UNION ALL SELECT from_uid, to_uid, rel_type FROM imports UNION ALL SELECT from_uid, to_uid, rel_type FROM inherits",
}


def on_graph(sql: str, recursive: bool = False) -> str:
    """``sql`` (a SELECT, or CTEs that start with a comma and a SELECT) after the projection's CTEs."""
    head = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{sql}"
