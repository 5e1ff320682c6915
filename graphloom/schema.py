"""The property-graph model: two tables, a fixed vocabulary, open properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary of labels, relationship types, kinds and visibilities.
LABELS = (
    "Project", "Package", "Module", "TypeDef", "Callable", "Value", "DocFile", "DocSection", "Note",
    "ExternalPackage", "ExternalSymbol", "EnvVar", "ResourceFile", "SchemaVersion",
)
REL_TYPES = (
    "CONTAINS", "DEFINES", "INHERITS", "IMPLEMENTS", "CALLS", "REFERENCES", "IMPORTS", "USES_TYPE", "OVERRIDES",
    "READS_ENV", "REFERENCES_FILE", "DEPENDS_ON", "DOCUMENTS", "SIMILAR_TO", "EXPORTS", "HANDLES_ROUTE",
    "HANDLES_EVENT", "REGISTERED_BY", "INJECTED_INTO", "TESTS", "HANDLES_COMMAND", "LINKS_TO", "DERIVED_FROM",
    "SUPERSEDES", "CO_CHANGES_WITH",
)
TYPE_KINDS = ("class", "struct", "interface", "trait", "enum", "union", "type_alias", "protocol", "record", "data_type", "typeclass", "annotation")
CALLABLE_KINDS = ("function", "method", "constructor", "destructor", "static_method", "class_method", "property", "closure")
VALUE_KINDS = ("variable", "constant", "field", "enum_member")
VISIBILITIES = ("public", "protected", "internal", "private")
CODE_LABELS = ("Module", "TypeDef", "Callable", "Value")
GLOBAL_PROJECT = "_global"

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(required: str, fields: dict[str, T.DataType]) -> T.StructType:
    need = required.split()
    return T.StructType([T.StructField(n, fields.get(n, _S), False) for n in need] + [T.StructField(n, t) for n, t in fields.items() if n not in need])


NODE_SCHEMA = _struct(
    "uid label project_name",
    {
        "qualified_name": _S, "file_path": _S, "name": _S, "kind": _S, "visibility": _S, "docstring": _S, "signature": _S, "source": _S,
        "tags": T.ArrayType(_S), "header_path": _S, "header_level": _I, "line_start": _I, "line_end": _I, "content_hash": _S,
        "rationale": _S, "citations": T.ArrayType(_S), "package": _S, "version": _S, "is_stub": _B, "decorator_name": _S,
        "file_hash": _S, "embed_hash": _S, "embedding": T.ArrayType(T.FloatType()), "git_commit_count": _L, "git_author_count": _L,
        "git_days_since_last_commit": _D, "props": T.MapType(_S, _S),
    },
)
EDGE_SCHEMA = _struct(
    "from_uid to_uid rel_type",
    {
        "confidence": _S, "strategy": _S, "weight": _D, "candidate_count": _I, "from_test": _B, "line": _I, "site_count": _I,
        "type_only": _B, "inferred": _B, "link_type": _S, "doc_confidence": _D, "citation": _S, "anchor_hash": _S, "stale": _B,
        "count": _L, "props": T.MapType(_S, _S),
    },
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are null, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def given(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` that ``df`` has, as the types that they have there."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns))


def schema_info() -> dict[str, object]:
    """The vocabulary and the columns, for a caller who writes queries."""
    return {
        "node_labels": LABELS, "relationship_types": REL_TYPES, "kinds": {"TypeDef": TYPE_KINDS, "Callable": CALLABLE_KINDS, "Value": VALUE_KINDS}, "visibilities": VISIBILITIES,
        "node_columns": {f.name: f.dataType.simpleString() for f in NODE_SCHEMA}, "edge_columns": {f.name: f.dataType.simpleString() for f in EDGE_SCHEMA}, "uid_format": "project_name:qualified_name",
    }


def contract_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, key, n) of every broken rule: uid unique and present, edge key unique, ends present, known vocabulary."""
    def rule(name: str, df: DataFrame, key) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), key.cast("string").alias("key"), F.lit(1).cast("long").alias("n"))

    def repeated(name: str, df: DataFrame, *key: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("rule"), F.concat_ws("|", *key).alias("key"), "n")

    ends = edges.select(F.explode(F.array("from_uid", "to_uid")).alias("uid")).distinct()
    return (
        repeated("duplicate uid", nodes, "uid")
        .unionByName(rule("missing uid or project", nodes.where("uid IS NULL OR project_name IS NULL"), F.col("label")))
        .unionByName(rule("unknown label", nodes.where(~F.col("label").isin(*LABELS)), F.col("uid")))
        .unionByName(rule("unknown relationship", edges.where(~F.col("rel_type").isin(*REL_TYPES)), F.col("rel_type")))
        .unionByName(repeated("duplicate edge", edges, "from_uid", "to_uid", "rel_type"))
        .unionByName(rule("dangling end", ends.join(nodes.select("uid"), "uid", "left_anti"), F.col("uid")))
    )
