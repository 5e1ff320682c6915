"""A graph kept as snapshots: two Parquet tables, partitioned by label and relationship type.

Every change writes a new snapshot beside the old one and then names it in ``CURRENT``; readers keep the one
they opened. A writer whose snapshot is no longer the current one gets a ``ConflictError`` and nothing is lost. The columns
that an update has replace what was there, null values too; the others keep their values.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis, delta, resolve, search, traversal
from graphloom.schema import EDGE_SCHEMA, GLOBAL_PROJECT, NODE_SCHEMA, conform, contract_violations, given, schema_info
from graphloom.scratch import cut_lineage

EDGE_KEY = ("from_uid", "to_uid", "rel_type")
TEXT_COLUMNS = ("name", "qualified_name", "docstring", "signature", "source")


class ConflictError(RuntimeError):
    """Another writer has changed the store since it was opened."""


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._open()

    # ---------------------------------------------------------------- snapshots

    def _path(self, name: str):
        at = self._fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _current(self) -> str | None:
        fs, at = self._path("CURRENT")
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0] if fs.exists(at) else None

    def _open(self) -> None:
        self.version = self._current()
        if self.version:
            self.nodes = self.spark.read.schema(NODE_SCHEMA).parquet(f"{self.root}/{self.version}/nodes")
            self.edges = self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.root}/{self.version}/edges")
        else:
            self.nodes = self.spark.createDataFrame([], NODE_SCHEMA)
            self.edges = self.spark.createDataFrame([], EDGE_SCHEMA)

    def commit(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Write a snapshot and make it the current one. Writers take turns by a lease: a file that only one can create."""
        name = uuid.uuid4().hex
        conform(self.nodes if nodes is None else nodes, NODE_SCHEMA).write.partitionBy("label").parquet(f"{self.root}/{name}/nodes")
        conform(self.edges if edges is None else edges, EDGE_SCHEMA).write.partitionBy("rel_type").parquet(f"{self.root}/{name}/edges")
        with self.lease():
            if self._current() != self.version:
                raise ConflictError(f"{self.root} has changed since it was opened; open it again")
            fs, at = self._path("CURRENT")
            out = fs.create(at, True)
            out.write(bytearray(name.encode()))
            out.close()
        self._open()

    @contextlib.contextmanager
    def lease(self, seconds: float = 120.0, wait: float = 30.0):
        """Hold the writers' lease. One older than ``seconds`` belongs to a writer that is gone."""
        fs, at = self._path("LEASE")
        until = time.time() + wait
        while not fs.createNewFile(at):
            if time.time() * 1000 - fs.getFileStatus(at).getModificationTime() > seconds * 1000:
                fs.delete(at, False)
            elif time.time() > until:
                raise ConflictError(f"{self.root} is being written")
            time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(at, False)

    # ---------------------------------------------------------------- entities

    def upsert(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """Upsert entities of whole files and their relationships; gives the classification of every entity of those files.

        Relationships of the entities are written anew, but for those that another file's scan made: DEFINES into other files and citations."""
        new = conform(nodes, NODE_SCHEMA)
        files = new.select("project_name", "file_path").distinct()
        before = self.nodes.join(files, ["project_name", "file_path"], "left_semi")
        found = cut_lineage(delta.classify(before, new), "changes")
        gone = found.where("change = 'deleted'").select("uid")
        kept, all_edges = self.nodes.join(gone, "uid", "left_anti"), delta.drop_dangling(self.edges, gone)
        if edges is not None:
            own = all_edges.join(new.select(F.col("uid").alias("from_uid")), "from_uid", "left_semi")
            local = own.join(new.select(F.col("uid").alias("to_uid")), "to_uid", "left_semi")
            foreign = own.join(new.select(F.col("uid").alias("to_uid")), "to_uid", "left_anti")
            old = local.unionByName(foreign.where("rel_type <> 'DEFINES'")).where("NOT (rel_type = 'DOCUMENTS' AND citation IS NOT NULL)")
            all_edges = all_edges.join(old.select(*EDGE_KEY), list(EDGE_KEY), "left_anti")
            all_edges = delta.upsert(all_edges, given(edges, EDGE_SCHEMA), *EDGE_KEY)
        self.commit(delta.upsert(kept, given(nodes, NODE_SCHEMA), "uid"), all_edges)
        return found

    def delete_files(self, project: str, paths: list[str]) -> None:
        self.commit(*delta.delete_files(self.nodes, self.edges, project, paths))

    def delete_project(self, project: str) -> None:
        self.commit(*delta.delete_project(self.nodes, self.edges, project))

    def merge_project(self, project: str, **metadata) -> None:
        """The project's node with its metadata merged over what it has."""
        old = self.nodes.where((F.col("uid") == project) & (F.col("label") == "Project")).select("props").first()
        props = {**((old and old["props"]) or {}), **{k: str(v) for k, v in metadata.items()}}
        row = self.spark.createDataFrame([(project, "Project", project, project, props)], "uid string, label string, project_name string, name string, props map<string,string>")
        self.commit(delta.upsert(self.nodes, given(row, NODE_SCHEMA), "uid"))

    def merge_packages(self, project: str, packages: list[tuple[str, str]]) -> None:
        """(dotted name, path) of packages, with CONTAINS from each package's parent or the project."""
        known = {q for q, _ in packages}
        rows = [(f"{project}:{q}", "Package", project, q.rsplit(".", 1)[-1], q, p) for q, p in packages]
        parent = lambda q: f"{project}:{q.rpartition('.')[0]}" if q.rpartition(".")[0] in known else project
        n = self.spark.createDataFrame(rows, "uid string, label string, project_name string, name string, qualified_name string, file_path string")
        e = self.spark.createDataFrame([(parent(q), f"{project}:{q}", "CONTAINS") for q, _ in packages], "from_uid string, to_uid string, rel_type string")
        self.commit(delta.upsert(self.nodes, given(n, NODE_SCHEMA), "uid"), delta.insert_missing(self.edges, conform(e, EDGE_SCHEMA), *EDGE_KEY))

    def set_columns(self, values: DataFrame) -> None:
        """Set columns of existing nodes by uid: file hashes, embeddings, commit signals, versions."""
        both = self.nodes.join(values.select(F.col("uid").alias("_u"), *(F.col(c).alias(f"_{c}") for c in values.columns if c != "uid")), F.col("uid") == F.col("_u"), "left")
        self.commit(both.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in values.columns and c != "uid" else F.col(c) for c in NODE_SCHEMA.names)))

    def enrich(self, values: DataFrame) -> None:
        """Merge ``props`` (map) of entities by uid."""
        v = values.select(F.col("uid").alias("_u"), F.col("props").alias("_p"))
        empty = F.create_map().cast("map<string,string>")
        keep = F.map_filter(F.coalesce("props", empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("_p", empty)), k))
        both = self.nodes.join(v, F.col("uid") == F.col("_u"), "left")
        self.commit(both.withColumn("props", F.map_concat(keep, F.coalesce("_p", empty))).drop("_u", "_p"))

    def add_edges(self, edges: DataFrame) -> None:
        self.commit(edges=delta.upsert(self.edges, given(edges, EDGE_SCHEMA), *EDGE_KEY))

    def write_co_changes(self, pairs: DataFrame, project: str) -> None:
        """CO_CHANGES_WITH edges between modules from pairs of files. ``pairs``: file_a, file_b, count."""
        m = self.nodes.where((F.col("project_name") == project) & (F.col("label") == "Module")).select("uid", "file_path")
        a, b = (m.select(F.col("uid").alias(f"{s}_uid"), F.col("file_path").alias(f"file_{x}")) for s, x in (("from", "a"), ("to", "b")))
        self.add_edges(pairs.join(a, "file_a").join(b, "file_b").select("from_uid", "to_uid", F.lit("CO_CHANGES_WITH").alias("rel_type"), "count"))

    def collect_garbage(self) -> None:
        self.commit(delta.collect_orphans(self.nodes, self.edges))

    # ---------------------------------------------------------------- resolution

    def link_imports(self, imports: DataFrame) -> None:
        """IMPORTS edges of unresolved imports (import_id, project_name, target, from_uid); stubs of what is not in the project."""
        known = self.nodes.where("qualified_name IS NOT NULL AND label NOT IN ('ExternalPackage', 'ExternalSymbol')").select("uid", "project_name", "qualified_name")
        hit = resolve.resolve_imports(imports.select("import_id", "project_name", "target"), known)
        all_ = imports.join(hit, "import_id")
        stubs = all_.where("NOT internal").select(F.col("to_uid").alias("uid"), F.lit("ExternalPackage").alias("label"), "project_name", F.col("package").alias("name"), "package")
        edges = all_.select("from_uid", "to_uid", F.lit("IMPORTS").alias("rel_type")).distinct()
        self.commit(delta.insert_missing(self.nodes, conform(stubs, NODE_SCHEMA), "uid"), delta.upsert(self.edges, given(edges, EDGE_SCHEMA), *EDGE_KEY))

    def link_values(self, refs: DataFrame) -> None:
        """REFERENCES edges by name (from_uid, project_name, file_path, name): the same file, else what the file imports."""
        n = self.nodes.where("label IN ('Value', 'Callable', 'TypeDef')").select("project_name", "name", F.col("uid").alias("to_uid"), F.col("file_path").alias("to_file"))
        of = self.nodes.select(F.col("uid").alias("from_uid"), "file_path")
        scope = self.edges.where("rel_type = 'IMPORTS'").join(of, "from_uid").select("file_path", "to_uid").distinct().withColumn("imported", F.lit(True))
        pairs = refs.join(n, ["project_name", "name"]).join(scope, ["file_path", "to_uid"], "left").withColumn("ref", F.xxhash64("from_uid", "name"))
        pairs = pairs.withColumn("rung", F.when(F.col("file_path") == F.col("to_file"), 1).when(F.col("imported"), 2)).where("rung IS NOT NULL")
        self.add_edges(resolve.best_rung(pairs, "ref").select("from_uid", "to_uid", F.lit("REFERENCES").alias("rel_type")).distinct())

    def set_package_versions(self, versions: DataFrame) -> None:
        ext = self.nodes.where("label = 'ExternalPackage'").select("uid", F.lower("name").alias("package"))
        self.set_columns(ext.join(versions.select("package", "version"), "package").select("uid", "version"))

    def link_projects(self) -> None:
        """Rewire external stubs of sibling projects, drop stubs that are left alone, add DEPENDS_ON."""
        external = self.nodes.where("label = 'ExternalPackage'").select("uid", "name")
        packages = self.nodes.where("label = 'Package' AND NOT contains(coalesce(qualified_name, ''), '.')").select("uid", "name")
        edges = resolve.cross_project_imports(self.edges, external, packages)
        lonely = external.select("uid").join(edges.select(F.col("to_uid").alias("uid")), "uid", "left_anti")
        nodes = self.nodes.join(lonely, "uid", "left_anti")
        pairs = resolve.depends_on(edges, nodes).select(F.col("from_project").alias("from_uid"), F.col("to_project").alias("to_uid"), F.lit("DEPENDS_ON").alias("rel_type"))
        self.commit(nodes, delta.upsert(edges, given(pairs, EDGE_SCHEMA), *EDGE_KEY))

    # ---------------------------------------------------------------- reading

    def entity(self, uid: str) -> DataFrame:
        return self.nodes.where(F.col("uid") == uid)

    def existing(self, uids: DataFrame) -> DataFrame:
        return self.nodes.select("uid").join(uids.select("uid"), "uid", "left_semi")

    def file_hashes(self, project: str, paths: list[str]) -> DataFrame:
        return self.nodes.where((F.col("project_name") == project) & F.col("file_path").isin(*paths) & F.col("file_hash").isNotNull()).select("file_path", "file_hash")

    def neighbours(self, uid: str, rel_type: str, outgoing: bool = True, limit: int = 100) -> DataFrame:
        own, other = ("from_uid", "to_uid") if outgoing else ("to_uid", "from_uid")
        ids = self.edges.where((F.col("rel_type") == rel_type) & (F.col(own) == uid)).select(F.col(other).alias("uid")).distinct()
        return self.nodes.join(ids, "uid", "left_semi").orderBy("uid").limit(limit)

    def documents(self) -> DataFrame:
        """(uid, label, text) that text search reads."""
        lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in ("tags", "citations")]
        return self.nodes.select("uid", "label", F.concat_ws(" ", *TEXT_COLUMNS, "rationale", *lists).alias("text"))

    def search(self, query: str, limit: int = 10, scope: str = "", vector: list[float] | None = None, **options) -> DataFrame:
        known = [r[0] for r in self.nodes.where("label = 'Project'").select("project_name").distinct().limit(10_000).collect()] if scope else []
        projects = search.expand_scope(scope, known)
        nodes = search.in_projects(self.nodes, projects)
        docs = self.documents().join(nodes.select("uid"), "uid", "left_semi") if projects is not None else self.documents()
        vectors = search.in_projects(self.nodes, projects, with_global=False).select("uid", "embedding") if vector else None
        return search.hybrid_search(nodes, docs, query, limit, vectors, vector, **options)

    def context(self, uid: str, **options) -> DataFrame:
        return search.expand_context(self.nodes, self.edges, uid, **options)

    def get_node(self, name: str, **options) -> DataFrame:
        return search.get_node(self.nodes, name, **options)

    def trace(self, a: str, b: str, **options) -> DataFrame:
        """The path's hops; ``NotFoundError`` if an end is not in the graph."""
        return traversal.trace_path(self.edges, a, b, nodes=self.nodes, **options)

    def impact(self, uid: str, limit: int = 20, tests: bool = True, **options) -> DataFrame:
        """What a change of ``uid`` reaches, ranked; ``NotFoundError`` if it is not in the graph."""
        traversal.require(self.nodes, uid)
        return traversal.ranked_impact(traversal.blast_radius(self.edges, uid, **options), self.nodes, limit, tests)

    def projects(self) -> DataFrame:
        return analysis.project_list(self.nodes, self.edges)

    def schema(self) -> dict[str, object]:
        return schema_info()

    def health(self) -> list[tuple[str, str, str]]:
        """(check, ok / warn / fail, message) of the store: whether it can be read, holds an index, and keeps its contract."""
        out = [("store", "ok" if self.version else "warn", self.version or "nothing has been written")]
        entities = self.nodes.count()
        out.append(("index", "ok" if entities else "warn", f"{entities} entities"))
        broken = contract_violations(self.nodes, self.edges).groupBy("rule").agg(F.sum("n").alias("n")).collect()
        out.append(("contract", "fail" if broken else "ok", ", ".join(f"{r['rule']}: {r['n']}" for r in broken)))
        return out

    def summary(self, prefix: str, **options) -> str:
        return analysis.summary_text(self.nodes, self.edges, prefix, **options)

    def diagram(self, kind: str, prefix: str = "", limit: int = 30) -> str:
        """A Mermaid chart: packages, imports (an outline beyond 25 modules), inheritance or module_detail."""
        n, e = self.nodes, self.edges
        if kind == "imports":
            return analysis.import_outline(analysis.within_budget(analysis.module_imports(n.where(F.coalesce("file_path", F.lit("")).startswith(prefix)), e), limit))
        table = {
            "packages": lambda: (analysis.package_diagram(n, e, limit), "parent", "child"), "inheritance": lambda: (analysis.inheritance_diagram(n, e, prefix, limit), "parent", "child"),
            "module_detail": lambda: (analysis.module_detail(n, e, prefix, limit).withColumn("owner", F.coalesce("owner", "module")), "owner", "name"),
        }
        if kind not in table:
            raise ValueError(f"unknown diagram {kind!r}; known: imports, {', '.join(table)}")
        return analysis.mermaid(*table[kind](), limit)

    def analyse(self, name: str, **options) -> DataFrame:
        """One of the analyses by name."""
        n, e = self.nodes, self.edges
        table: dict[str, Callable[[], DataFrame]] = {
            "structure": lambda: analysis.structure_counts(n), "centrality": lambda: analysis.hubs(e, **options), "leaves": lambda: analysis.leaves(n, e),
            "dependencies": lambda: analysis.module_imports(n, e), "patterns": lambda: analysis.inheritance(n, e, **options), "quality": lambda: analysis.quality(n, e),
            "dead_code": lambda: analysis.dead_code(n, e), "complexity": lambda: analysis.complexity(n, **options), "communities": lambda: analysis.communities(n, e),
            "git_signals": lambda: n.where("git_commit_count IS NOT NULL").select("uid", "git_commit_count", "git_author_count", "git_days_since_last_commit").orderBy(F.desc("git_commit_count"), "uid"),
            "module_summary": lambda: analysis.module_summary(n, e, **options),
        }
        if name not in table:
            raise ValueError(f"unknown analysis {name!r}; known: {', '.join(sorted(table))}")
        return table[name]()

    def status(self) -> DataFrame:
        return analysis.index_status(self.nodes, self.edges)

    def lint(self, similar: float = 0.92) -> DataFrame:
        """(problem, uid) of notes: duplicate ids, dangling links, orphans, notes linked from several projects, anchors whose target has changed,
        notes in the inbox, and notes whose vectors are ``similar`` to another one's."""
        notes, links = self.nodes.where("label = 'Note'"), self.edges.where("rel_type IN ('LINKS_TO', 'DERIVED_FROM', 'SUPERSEDES', 'DOCUMENTS')")
        parts = {
            "duplicate": analysis.duplicate_ids(notes).select("uid"), "dangling": analysis.dangling_links(links, self.nodes).select(F.col("to_uid").alias("uid")),
            "orphan": analysis.orphan_notes(notes, links), "promote": analysis.promotion_candidates(links, self.nodes.where(F.col("project_name") != GLOBAL_PROJECT)).join(notes.select("uid"), "uid", "left_semi").select("uid"),
            "broken_anchor": analysis.broken_anchors(self.edges), "inbox": analysis.inbox_notes(notes), "similar": self._similar(notes, similar),
        }
        return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("problem"), "uid") for k, df in parts.items()])

    def _similar(self, notes: DataFrame, least: float) -> DataFrame:
        ids = notes.where("embedding IS NOT NULL").select(F.xxhash64("uid").alias("id"), "uid", "embedding")
        pairs = search.similar_pairs(ids.select(F.col("id").alias("uid"), "embedding"), least)
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(ids, "id").select("uid")
