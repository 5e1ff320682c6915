"""From files to a stored graph: extraction, names, resolution, detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.operators import resolve
from graphloom.scratch import cut_lineage
from graphloom.sources import extract, files
from graphloom.sources.store import GraphStore

# What decorators and bases give a type without writing it.
SYNTHESISED = {
    "dataclass": ("dataclasses", ("__init__", "__repr__", "__eq__")),
    "dataclasses.dataclass": ("dataclasses", ("__init__", "__repr__", "__eq__")),
    "attr.s": ("attrs", ("__init__", "__repr__", "__eq__", "__hash__")),
    "attr.define": ("attrs", ("__init__", "__repr__", "__eq__")),
    "attr.attrs": ("attrs", ("__init__", "__repr__", "__eq__", "__hash__")),
    "BaseModel": ("pydantic", ("__init__", "__repr__", "__eq__", "__hash__")),
}


def synthesised(types: DataFrame) -> DataFrame:
    """(uid, props) of types whose decorators (or, failing that, bases) make methods. ``types``: uid, tags (decorators), bases (arrays)."""
    known = F.create_map(*(x for k, (framework, methods) in SYNTHESISED.items() for x in (F.lit(k), F.struct(F.lit(framework).alias("f"), F.array(*map(F.lit, methods)).alias("m")))))
    named = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.regexp_replace(F.regexp_replace(t, r"^(?:decorator:)?@?", ""), r"\(.*$", ""))
    by_tag = F.filter(F.transform(named, lambda t: F.when(t != "BaseModel", known[t])), lambda x: x.isNotNull())
    by_base = F.filter(F.transform(F.coalesce("bases", F.array().cast("array<string>")), lambda b: F.when(b == "BaseModel", known[b])), lambda x: x.isNotNull())
    hit = F.coalesce(F.get(by_tag, F.lit(0)), F.get(by_base, F.lit(0)))
    out = types.select("uid", hit.alias("x")).where("x IS NOT NULL")
    return out.select("uid", F.create_map(F.lit("synthesis_framework"), F.col("x.f"), F.lit("synthesized_methods"), F.array_join("x.m", ",")).alias("props"))


#: Detectors run over a snapshot after it is written: each gives new edges (from_uid, to_uid, rel_type) of nodes and edges.
DETECTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "test_mapping": lambda n, e: resolve.test_targets(n),
    "class_overrides": lambda n, e: resolve.overrides(e.where("rel_type = 'INHERITS'"), e.where("rel_type = 'DEFINES'"), n),
    "di_injection": lambda n, e: resolve.injected(n),
    "module_exports": lambda n, e: resolve.module_exports(n, e.where("rel_type = 'DEFINES'")),
}


def register_detector(name: str, detect: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    DETECTORS[name] = detect


def run_detectors(store: GraphStore, *names: str) -> None:
    """Add what the detectors (all of them, unless named) find."""
    for name in names or tuple(DETECTORS):
        store.add_edges(DETECTORS[name](store.nodes, store.edges))


def index_files(store: GraphStore, found: DataFrame, project: str, max_bytes: int = extract.MAX_BYTES) -> DataFrame:
    """Write the entities and relationships of files to the store; gives the classification of their entities. ``found``: path, text."""
    names = F.udf(extract.suffix_of, "string")  # one short path a file
    module = F.when(F.col("path").rlike(r"\.pyi?$"), X.module_name(F.col("path"))).otherwise(F.col("path"))
    sources = found.select(module.alias("name"), names("path").alias("suffix"), "text", "path")
    rows = cut_lineage(extract.extracted(sources, max_bytes).join(sources.select(F.col("name").alias("file"), "path"), "file"), "extracted")
    uid = lambda c: F.concat(F.lit(f"{project}:"), F.col(c))
    nodes = rows.where("label <> ''").dropDuplicates(["entity"]).select(
        uid("entity").alias("uid"), "label", F.lit(project).alias("project_name"), F.col("entity").alias("qualified_name"), "name", "kind", F.col("path").alias("file_path"),
        X.name_visibility(F.col("name")).alias("visibility"), "docstring", "signature", "line_start", "line_end",
        X.content_hash(F.col("name"), F.col("kind"), X.name_visibility(F.col("name")), F.col("signature"), F.col("docstring")).alias("content_hash"),
    )
    known = nodes.select(F.col("uid").alias("to_uid"))
    rels = rows.where("rel_type <> ''").select(uid("entity").alias("from_uid"), "rel_type", "target", "line_start", "path", F.col("kind").alias("link_type"))
    inner = rels.where("rel_type IN ('DEFINES', 'CONTAINS')").withColumn("to_uid", uid("target")).join(known, "to_uid", "left_semi")
    last = X.last_part(F.col("target"), ".")
    named = nodes.select(F.col("name").alias("last"), F.col("uid").alias("to_uid"), F.col("label").alias("to_label"), F.col("file_path").alias("to_path"))
    fits = F.expr("CASE rel_type WHEN 'CALLS' THEN to_label = 'Callable' WHEN 'INHERITS' THEN to_label = 'TypeDef' WHEN 'IMPLEMENTS' THEN to_label = 'TypeDef' WHEN 'USES_TYPE' THEN to_label = 'TypeDef' ELSE to_label NOT IN ('DocFile', 'DocSection') END")
    open_ = rels.where("rel_type IN ('CALLS', 'INHERITS', 'IMPLEMENTS', 'USES_TYPE', 'REFERENCES')").withColumn("last", last).withColumn("ref", F.xxhash64("from_uid", "rel_type", "target"))
    pairs = open_.join(named, "last").where(fits).where("from_uid <> to_uid").dropDuplicates(["ref", "to_uid"])
    best = resolve.best_rung(pairs.withColumn("rung", F.when(F.col("path") == F.col("to_path"), 1).otherwise(2)), "ref")
    best = best.where("rel_type = 'CALLS' OR candidate_count = 1")
    sure = F.when(F.col("candidate_count") == 1, "resolved").otherwise("ambiguous")
    linked = best.select("from_uid", "to_uid", "rel_type", F.col("line_start").alias("line"), "candidate_count", sure.alias("confidence"), resolve.call_weight(F.col("candidate_count"), F.lit(False), X.is_test(F.col("path"), F.lit(""))).alias("weight"))
    edges = inner.select("from_uid", "to_uid", "rel_type").distinct().unionByName(linked.dropDuplicates(["from_uid", "to_uid", "rel_type"]), allowMissingColumns=True)
    sureness = F.create_map(*(F.lit(x) for kv in extract.LINK_CONFIDENCE.items() for x in kv))
    mentions = rels.where(F.col("link_type").isin(*extract.LINK_CONFIDENCE)).where("rel_type = 'DOCUMENTS'").select(
        F.xxhash64("from_uid", "target").alias("ref_id"), "from_uid", F.lit(project).alias("project_name"), (F.col("link_type") == "file_ref").alias("is_file"), "link_type", sureness[F.col("link_type")].alias("confidence"),
        F.when(F.col("link_type") == "file_ref", F.col("target")).otherwise(last).alias("target"),
    )
    docs = resolve.doc_links(mentions.where(F.length("target") >= extract.LEAST_NAME).dropDuplicates(["ref_id"]), nodes)
    edges = edges.unionByName(docs.dropDuplicates(["from_uid", "to_uid"]), allowMissingColumns=True)
    changes = store.upsert(nodes, edges)
    imports = rels.where("rel_type = 'IMPORTS'").select(F.xxhash64("from_uid", "target").alias("import_id"), F.lit(project).alias("project_name"), F.col("target"), "from_uid").distinct()
    store.link_imports(imports)
    store.merge_project(project, file_count=found.count())
    return changes


def index_folder(store: GraphStore, root: str, project: str, **options) -> DataFrame:
    """Scan a folder and index every file that some parser knows."""
    return index_files(store, files.scan(store.spark, root, **options), project)
