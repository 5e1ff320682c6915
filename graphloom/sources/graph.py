"""Projection of the relational tables onto nodes and edges.

Regions are projects and packages, nations modules, customers, suppliers and parts types, orders callables. Nodes and
edges are built once per folder and session, as tables in the shared folder that are partitioned by label and by
relationship type; a query reads the partitions and columns that it names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import cut_lineage

#: Modules import each other where their trade is among the strongest: from this quantile of all pairs of modules on.
IMPORT_QUANTILE = 0.9

_BUILT: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """The tables of one folder, read on demand, and what is built of them once a session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def built(self, name: str, build: Callable[[Tables], DataFrame], *partition: str) -> DataFrame:
        """The table that ``build`` makes, written to the shared folder on first use."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _BUILT:
            _BUILT[key] = cut_lineage(build(self), f"index-{name}", *partition)
        return _BUILT[key]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def uid(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def places(t: Tables) -> DataFrame:
    """Nations with the project and path of everything inside; 25 rows whatever the scale."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "n_regionkey", F.col("r_name").alias("project_name"), F.concat_ws("/", "r_name", "n_name").alias("file_path"), F.concat_ws(".", "r_name", "n_name").alias("module_qn")
    )


def home_supplier(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))


_NODE = ["uid", "label", "project_name", "qualified_name", "file_path", "name", "kind", "visibility", "docstring", "line_start", "line_end"]


def _nodes(df: DataFrame, label: str, uid_: Column, name: Column, qn: Column, path: Column, kind: Column | None = None, visibility: Column | None = None, docstring: Column | None = None, lines: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        uid_.alias("uid"), F.lit(label).alias("label"), F.col("project_name"), qn.alias("qualified_name"), path.alias("file_path"), name.alias("name"),
        (kind if kind is not None else null).cast("string").alias("kind"), (visibility if visibility is not None else F.lit("public")).alias("visibility"),
        (docstring if docstring is not None else null).cast("string").alias("docstring"), F.lit(1).alias("line_start"), (lines if lines is not None else F.lit(1)).cast("int").alias("line_end"),
    )


def by_balance(balance: str) -> Column:
    return F.when(F.col(balance) < 0, "private").when(F.col(balance) < 2500, "protected").when(F.col(balance) < 5000, "internal").otherwise("public")


LABELS = ("Project", "Package", "Module", "TypeDef", "Callable")


def nodes(t: Tables, labels: Iterable[str] = LABELS) -> DataFrame:
    """uid, label, project_name, qualified_name, file_path, name, kind, visibility, docstring, line_start, line_end."""
    out = t.built("nodes", project_nodes, "label")
    return out if set(labels) == set(LABELS) else out.where(F.col("label").isin(*labels))


def project_nodes(t: Tables, labels: Iterable[str] = LABELS) -> DataFrame:
    """The nodes of some labels, built from the tables."""
    c, parts = F.col, []
    region = t.region.withColumn("project_name", c("r_name"))
    at = F.broadcast(places(t))  # 25 rows
    if "Project" in labels:
        parts.append(_nodes(region, "Project", uid("r", "r_regionkey"), c("r_name"), c("r_name"), F.lit("")))
    if "Package" in labels:
        parts.append(_nodes(region, "Package", uid("pkg", "r_regionkey"), c("r_name"), c("r_name"), c("r_name")))
    if "Module" in labels:
        parts.append(_nodes(at, "Module", uid("n", "n_nationkey"), c("n_name"), c("module_qn"), c("file_path")))
    if "TypeDef" in labels:
        cust = t.customer.join(at, c("c_nationkey") == c("n_nationkey"))
        parts.append(_nodes(cust, "TypeDef", uid("c", "c_custkey"), c("c_name"), F.concat_ws(".", "module_qn", "c_name"), c("file_path"), F.lit("class"), by_balance("c_acctbal"), F.when(c("c_acctbal") >= 1000, c("c_mktsegment"))))
        supp = t.supplier.join(at, c("s_nationkey") == c("n_nationkey"))
        parts.append(_nodes(supp, "TypeDef", uid("s", "s_suppkey"), c("s_name"), F.concat_ws(".", "module_qn", "s_name"), c("file_path"), F.lit("interface"), by_balance("s_acctbal")))
        homes = home_supplier(t).join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(at, c("s_nationkey") == c("n_nationkey")).select("l_partkey", "project_name", "file_path")
        part = t.part.join(homes, c("p_partkey") == c("l_partkey"), "left").withColumn("project_name", F.coalesce("project_name", F.lit("")))
        parts.append(_nodes(part, "TypeDef", uid("p", "p_partkey"), c("p_name"), F.concat_ws(".", "p_brand", "p_name"), F.coalesce("file_path", F.lit("")), F.lit("enum"), docstring=F.when(c("p_size") > 10, c("p_type"))))
    if "Callable" in labels:
        lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
        orders = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(at, c("c_nationkey") == c("n_nationkey")).join(lines, c("o_orderkey") == c("l_orderkey"), "left")
        name = F.concat(F.lit("order_"), c("o_orderkey").cast("string"))
        parts.append(_nodes(orders, "Callable", uid("o", "o_orderkey"), name, F.concat_ws(".", "module_qn", "c_name", name), c("file_path"), F.lit("method"), F.when(c("o_orderstatus") == "F", "private").otherwise("public"), lines=F.coalesce("n", F.lit(1))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(df: DataFrame, kind: str, a: Column, b: Column) -> DataFrame:
    return df.select(a.alias("from_uid"), b.alias("to_uid"), F.lit(kind).alias("rel_type"))


def project_calls(t: Tables) -> DataFrame:
    """order -> part with the facts of a call edge; weight by the rule of ``call_weight``."""
    from graphloom.operators.resolve import call_weight

    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("candidate_count"), F.bool_and(F.col("l_returnflag") == "R").alias("from_test"))
    pairs = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).cast("int").alias("site_count"), F.min("l_linenumber").cast("int").alias("line"))
    out = pairs.join(per_order, "l_orderkey").select(
        uid("o", "l_orderkey").alias("from_uid"), uid("p", "l_partkey").alias("to_uid"), F.lit("CALLS").alias("rel_type"), "candidate_count", "from_test", "site_count", "line",
        F.when(F.col("candidate_count") == 1, "resolved").otherwise("ambiguous").alias("confidence"),
    )
    return out.withColumn("weight", call_weight(F.col("candidate_count"), F.lit(False), F.col("from_test")))


def project_contains(t: Tables) -> DataFrame:
    return _edges(t.region, "CONTAINS", uid("r", "r_regionkey"), uid("pkg", "r_regionkey")).unionByName(_edges(t.nation, "CONTAINS", uid("pkg", "n_regionkey"), uid("n", "n_nationkey")))


def project_defines(t: Tables) -> DataFrame:
    return (
        _edges(t.customer, "DEFINES", uid("n", "c_nationkey"), uid("c", "c_custkey"))
        .unionByName(_edges(t.supplier, "DEFINES", uid("n", "s_nationkey"), uid("s", "s_suppkey")))
        .unionByName(_edges(t.orders, "DEFINES", uid("c", "o_custkey"), uid("o", "o_orderkey")))
        .unionByName(_edges(home_supplier(t), "DEFINES", uid("s", "l_suppkey"), uid("p", "l_partkey")))
    )


def trade(t: Tables) -> DataFrame:
    """(customer nation, supplier, supplier nation) of every line that crosses nations."""
    c = F.col
    return (
        t.orders.select("o_orderkey", "o_custkey")
        .join(t.lineitem.select("l_orderkey", "l_suppkey"), c("o_orderkey") == c("l_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
        .where("c_nationkey <> s_nationkey").select("c_nationkey", "s_nationkey", "s_suppkey")
    )


def project_imports(t: Tables, quantile: float = IMPORT_QUANTILE) -> DataFrame:
    """Module -> Module where the trade is in the upper quantile of all pairs, and Module -> supplier for those nations."""
    lines = t.built("trade", lambda t: trade(t).groupBy("c_nationkey", "s_nationkey", "s_suppkey").agg(F.count(F.lit(1)).alias("n")))
    pairs = lines.groupBy("c_nationkey", "s_nationkey").agg(F.sum("n").alias("w"))
    # one number, over at most 25 x 25 pairs
    strong = pairs.crossJoin(F.broadcast(pairs.agg(F.percentile("w", quantile).alias("least")))).where("w >= least").drop("least")
    direct = _edges(strong, "IMPORTS", uid("n", "c_nationkey"), uid("n", "s_nationkey"))
    return direct.unionByName(_edges(lines.join(F.broadcast(strong), ["c_nationkey", "s_nationkey"]), "IMPORTS", uid("n", "c_nationkey"), uid("s", "s_suppkey")))


def project_inherits(t: Tables) -> DataFrame:
    base = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("base"))
    return _edges(t.part.join(base, "p_brand").where("base <> p_partkey"), "INHERITS", uid("p", "p_partkey"), uid("p", "base"))


BUILDERS = {"CONTAINS": project_contains, "DEFINES": project_defines, "CALLS": project_calls, "IMPORTS": project_imports, "INHERITS": project_inherits}
FACTS = ["candidate_count", "from_test", "site_count", "line", "confidence", "weight"]


def project_edges(t: Tables) -> DataFrame:
    out = BUILDERS["CALLS"](t)
    for kind in ("CONTAINS", "DEFINES", "IMPORTS", "INHERITS"):
        out = out.unionByName(BUILDERS[kind](t), allowMissingColumns=True)
    return out.select("from_uid", "to_uid", "rel_type", *FACTS)


def edges(t: Tables, types: Iterable[str] = tuple(BUILDERS)) -> DataFrame:
    """from_uid, to_uid, rel_type and the facts of calls."""
    out = t.built("edges", project_edges, "rel_type")
    return out if set(types) == set(BUILDERS) else out.where(F.col("rel_type").isin(*types))


def calls(t: Tables) -> DataFrame:
    return edges(t, ["CALLS"])


def _plain(t: Tables, kind: str) -> DataFrame:
    return edges(t, [kind]).select("from_uid", "to_uid", "rel_type")


def contains(t: Tables) -> DataFrame:
    return _plain(t, "CONTAINS")


def defines(t: Tables) -> DataFrame:
    return _plain(t, "DEFINES")


def imports(t: Tables) -> DataFrame:
    return _plain(t, "IMPORTS")


def inherits(t: Tables) -> DataFrame:
    return _plain(t, "INHERITS")
