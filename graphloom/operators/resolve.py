"""Resolution: unresolved names become weighted edges by ladders of joins.

A ladder ranks every candidate by the first rung it satisfies and keeps the best rung; how many
candidates share it decides whether the edge is resolved or ambiguous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import cut_lineage

LEAST_WEIGHT = 1e-6
UNVERIFIED = ("unverified_receiver", "unverified_wide")


def call_weight(candidates: Column, unverified: Column, from_test: Column) -> Column:
    """Evidence of a call edge: shared by its candidates, halved if unverified, quartered from a test."""
    w = F.lit(1.0) / F.greatest(candidates, F.lit(1)) * F.when(unverified, 0.5).otherwise(1.0) * F.when(from_test, 0.25).otherwise(1.0)
    return F.greatest(w, F.lit(LEAST_WEIGHT))


def merge_call_sites(sites: DataFrame) -> DataFrame:
    """One edge per pair: the facts of the site with fewest candidates (then file, line), from_test only if
    all are, the first line, the number of sites. Sites: from_uid, to_uid, candidate_count, strategy, from_test, file_path, line."""
    best = F.min_by(F.struct("candidate_count", "strategy"), F.struct("candidate_count", "file_path", "line", "strategy"))
    out = sites.groupBy("from_uid", "to_uid").agg(best.alias("b"), F.bool_and("from_test").alias("from_test"), F.min("line").alias("line"), F.count(F.lit(1)).alias("site_count"))
    out = out.select("from_uid", "to_uid", "b.candidate_count", "b.strategy", "from_test", "line", "site_count")
    unverified = F.col("strategy").isin(*UNVERIFIED)
    return out.withColumn("confidence", F.when((F.col("candidate_count") == 1) & ~unverified, "resolved").otherwise("ambiguous")).withColumn("weight", call_weight(F.col("candidate_count"), unverified, F.col("from_test")))


def best_rung(candidates: DataFrame, key: str, rung: str = "rung") -> DataFrame:
    """The candidates on each key's best rung, with their number as candidate_count."""
    w = Window.partitionBy(key)
    return candidates.withColumn("_best", F.min(rung).over(w)).where(F.col(rung) == F.col("_best")).drop("_best").withColumn("candidate_count", F.count(F.lit(1)).over(w).cast("int"))


#: Rows of a table of facts that is broadcast (counted first); candidates in one array; arrays that a join holds of one cell; pairs of one cell, and of one
#: task, as long as there are no more than TASKS of them: the driver keeps facts of every task, so beyond that cells and tasks grow instead.
SMALL, BLOCK, PART, CELL, TASK, TASKS = 20_000, 4096, 64, 1 << 20, 1 << 22, 2048


def lookup(facts: DataFrame, label: str) -> DataFrame:
    """``facts`` kept as a table, and broadcast if it turns out small: what is looked up there need not be shuffled."""
    kept = cut_lineage(facts, label)
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def expand(rows: DataFrame, candidates: DataFrame, key: list[str], label: str, *same: str) -> DataFrame:
    """Every row with the ``to_uid`` of every candidate of its key, and the candidate's columns ``same``.

    Only where a pair leaves as a result: candidates travel in arrays. A key with many of both is cut into a grid of cells, shares of its rows
    by parts of its candidates, each in a task's reach: no task meets a whole common name. A row travels once for each part and a candidate once for
    each share, as few as a cell's size allows; tasks, and the cells beyond one a key, are bounded, so neither the driver nor scratch grows with the
    pairs. Cells are dealt by numbers: of a key with a constant column Spark would drop that from the join and deal everything anew.
    """
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_r")).join(candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")), key)
    n = cut_lineage(n.withColumn("_key", F.monotonically_increasing_id()), f"{label}-shape")
    pairs, keys = n.agg(F.coalesce(F.sum(F.col("_r").cast("decimal(19)") * F.col("_c")), F.lit(0)), F.count(F.lit(1))).first()
    tasks = min(TASKS, int(pairs) // TASK)
    cells = F.ceil(F.col("_r").cast("double") * F.col("_c") / max(CELL, int(pairs) // (2 * TASKS)))
    blocks = F.ceil(F.col("_c") / BLOCK)
    # a row is some eight times as wide as a candidate: parts and shares that move the fewest bytes
    parts = F.greatest(F.round(F.sqrt(cells * F.col("_c") / F.col("_r") / 8)).cast("long"), F.ceil(blocks / PART), F.ceil(cells / F.col("_r")))
    n = n.select(*key, "_key", "_r", blocks.alias("_blocks"), cells.alias("_cells"), F.least(parts, blocks).alias("_parts"))
    n = n.select(*key, "_key", "_blocks", "_parts", F.least(F.col("_r"), F.ceil(F.col("_cells") / F.col("_parts"))).alias("_shares"))
    n = F.broadcast(n) if keys <= SMALL else n
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = candidates.join(n, key).withColumn("_block", F.pmod(F.xxhash64("to_uid"), "_blocks")).withColumn("_part", F.pmod("_block", "_parts"))
    a = a.groupBy("_key", *same, "_part", "_block", "_shares").agg(F.collect_list("to_uid").alias("_uids")).withColumn("_share", numbers("_shares")).drop("_shares", "_block")
    r = rows.join(n, key).withColumn("_share", F.pmod(F.xxhash64(*rows.columns), "_shares")).withColumn("_part", numbers("_parts")).drop("_shares", "_parts", "_blocks")
    at = ["_key", "_share", "_part"]
    if tasks > 1:
        r, a = r.repartition(tasks, *at), a.repartition(tasks, *at)
    return r.join(a, at).select(*rows.columns, *same, F.explode("_uids").alias("to_uid"))


def resolve_calls(sites: DataFrame, callables: DataFrame, imports: DataFrame, is_test: Column) -> DataFrame:
    """Call sites to callables of the same project by name.

    ``sites``: site_id, from_uid, project_name, name, file_path, line, owner (type that encloses the caller), receiver (declared type
    of the receiver, or null), has_receiver. ``callables``: uid, project_name, name, file_path, owner, is_abstract. ``imports``: from_file, to_uid.
    Rungs: 1 import, 2 sibling in the owner, 3 same file, 4 declared receiver, 5 project. Abstract candidates go
    if a concrete one is left, test candidates if the caller is no test and another is left. A site with a receiver whose
    type is unknown matches on its name alone: unverified.

    What goes, the rung and the number of candidates are decided from counts of the candidates of a name, and of a name in
    a file or an owner: a site meets candidates only on its rung, where each of them is an edge.
    """
    key = ["project_name", "name"]
    c = callables.alias("c").select(*(F.col(f"c.{k}") for k in key), F.col("c.uid").alias("to_uid"), F.col("c.file_path").alias("to_file"), F.col("c.owner").alias("to_owner"), F.coalesce("c.is_abstract", F.lit(True)).alias("is_abstract"), F.coalesce(is_test, F.lit(True)).alias("to_test"))
    linked = imports.select(F.col("from_file").alias("file_path"), "to_uid").distinct()
    by_file, by_owner = c.withColumnRenamed("to_file", "file_path"), c.withColumnRenamed("to_owner", "owner")
    rungs = [  # strategy, the sites it is open to, keys, candidates
        ("import", "NOT has_receiver", [*key, "file_path"], linked.join(c, "to_uid")),
        ("sibling", "has_receiver AND receiver IS NULL", [*key, "owner"], by_owner),
        ("same_file", "NOT has_receiver", [*key, "file_path"], by_file),
        ("receiver", "receiver IS NOT NULL", [*key, "receiver"], c.withColumnRenamed("to_owner", "receiver")),
        ("project", "TRUE", key, c),
    ]
    n = lambda condition: F.count(F.when(condition, 1))
    firm, real = ~F.col("is_abstract"), ~F.col("to_test")

    def facts(on: list[str], of: DataFrame, label: str) -> DataFrame:
        return lookup(of.groupBy(*on).agg(n(F.lit(True)).alias("n_all"), n(real).alias("n_real"), n(firm).alias("n_firm"), n(firm & real).alias("n_firm_real")), f"calls-{label}-facts")

    chosen = F.when(F.col("firm"), F.when(F.col("all"), F.col("n_firm")).otherwise(F.col("n_firm_real"))).otherwise(F.when(F.col("all"), F.col("n_all")).otherwise(F.col("n_real")))
    held = ["n_all", "n_real", "n_firm", "n_firm_real"]
    known = callables.select(F.col("owner").alias("receiver")).where("receiver IS NOT NULL").distinct()
    open_ = sites.where("receiver IS NULL").unionByName(sites.join(known, "receiver", "left_semi").select(*sites.columns))
    w = Window.partitionBy("site_id")
    open_ = open_.join(facts(key, c, "project"), key).withColumn("all", F.col("from_test") | (F.max("n_real").over(w) == 0))
    open_ = open_.withColumn("firm", F.max(F.when(F.col("all"), F.col("n_firm")).otherwise(F.col("n_firm_real"))).over(w) > 0)
    open_ = open_.withColumn("_project", chosen).drop(*held)
    for strategy, condition, on, of in rungs[:-1]:
        open_ = open_.join(facts(on, of, strategy), on, "left").withColumn(f"_{strategy}", F.when(F.expr(condition), F.coalesce(chosen, F.lit(0))).otherwise(0)).drop(*held)
    for strategy, *_ in rungs:
        open_ = open_.withColumn(f"_{strategy}", F.sum(f"_{strategy}").over(w).cast("int"))
    first = lambda value: F.coalesce(*(F.when(F.col(f"_{r[0]}") > 0, value(r[0])) for r in rungs))
    open_ = open_.withColumn("rung", first(F.lit)).withColumn("candidate_count", first(lambda r: F.col(f"_{r}"))).where("rung IS NOT NULL").drop(*(f"_{r[0]}" for r in rungs))
    open_ = cut_lineage(open_, "calls-sites")
    one = F.col("candidate_count") == 1
    last = F.when(F.col("has_receiver"), F.when(one, "unverified_receiver").otherwise("unverified_wide")).otherwise(F.when(one, "project_unique").otherwise("project_wide"))
    cols = ["site_id", "from_uid", "to_uid", "candidate_count", "strategy", "from_test", "file_path", "line"]
    either = F.explode(F.array(F.lit(False), F.lit(True)))
    out = []
    for strategy, condition, on, of in rungs:
        s = open_.where(F.col("rung") == strategy).where(condition).withColumn("is_abstract", either).withColumn("to_test", either).where("(all OR NOT to_test) AND (NOT is_abstract OR NOT firm)")
        carried = dict.fromkeys(["site_id", "from_uid", "candidate_count", "has_receiver", "from_test", "file_path", "line", *on, "is_abstract", "to_test"])
        hit = expand(s.select(*carried), of, [*on, "is_abstract", "to_test"], f"calls-{strategy}")
        out.append(hit.withColumn("strategy", last if strategy == "project" else F.lit(strategy)).select(*cols))
    return reduce(DataFrame.unionByName, out)


def resolve_type_refs(refs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Type references by import (weight 1), same file (1), or a name unique in the project (0.5, ambiguous).
    ``refs``: ref_id, from_uid, project_name, name, file_path. ``types``: uid, project_name, name, file_path. ``imports``: from_file, to_uid."""
    key = ["project_name", "name"]
    t = types.select(*key, "file_path", F.col("uid").alias("to_uid"))
    linked = imports.select(F.col("from_file").alias("file_path"), "to_uid").distinct()
    rungs = [([*key, "file_path"], linked.join(t.drop("file_path"), "to_uid")), ([*key, "file_path"], t), (key, t)]
    r, w = refs.select("ref_id", "from_uid", *key, "file_path"), Window.partitionBy("ref_id")
    for i, (on, of) in enumerate(rungs, 1):
        n = lookup(of.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_{i}")), f"types-facts-{i}")
        r = r.join(n, on, "left")
    for i in (1, 2, 3):
        r = r.withColumn(f"_{i}", F.coalesce(F.sum(f"_{i}").over(w), F.lit(0)))
    r = r.withColumn("rung", F.when(F.col("_1") > 0, 1).when(F.col("_2") > 0, 2).when(F.col("_3") == 1, 3)).where("rung IS NOT NULL")
    r = cut_lineage(r.select("from_uid", *key, "file_path", "rung").distinct(), "types-refs")
    out = [expand(r.where(F.col("rung") == i), of, on, f"types-{i}").select("from_uid", "to_uid", "rung") for i, (on, of) in enumerate(rungs, 1)]
    best = reduce(DataFrame.unionByName, out).groupBy("from_uid", "to_uid").agg(F.min("rung").alias("rung"))
    return best.select(
        "from_uid", "to_uid", F.element_at(F.array(F.lit("import"), F.lit("same_file"), F.lit("project_unique")), F.col("rung")).alias("strategy"),
        F.when(F.col("rung") < 3, "resolved").otherwise("ambiguous").alias("confidence"), F.when(F.col("rung") < 3, 1.0).otherwise(0.5).alias("weight"),
    )


def resolve_members(refs: DataFrame, types: DataFrame) -> DataFrame:
    """Owner of members by type name: same file, same folder, unique in the project, else the member's module (``fallback_uid``).
    More than one on a rung: the module. ``refs``: ref_id, member_uid, project_name, name, file_path, fallback_uid."""
    key = ["project_name", "name"]
    folder = F.regexp_replace("file_path", "[^/]*$", "").alias("folder")
    t, r = types.where("uid IS NOT NULL").select(*key, "uid", "file_path", folder), refs.select("*", folder)
    for i, on in enumerate(([*key, "file_path"], [*key, "folder"], key), 1):
        n = t.groupBy(*on).agg(F.struct(F.lit(i).alias("rung"), F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid")).alias(f"_{i}"))
        r = r.join(lookup(n, f"members-facts-{i}"), on, "left")
    r = r.withColumn("best", F.coalesce("_1", "_2", "_3"))
    r = r.withColumn("rung", F.coalesce("best.rung", F.lit(4))).withColumn("_best", F.min("rung").over(Window.partitionBy("ref_id"))).where("rung = _best")
    r = r.groupBy("ref_id").agg(F.sum("best.n").alias("n"), F.min("best.uid").alias("uid"), F.min("fallback_uid").alias("fallback_uid"), F.min("member_uid").alias("to_uid"))
    return r.select(F.when(F.col("n") == 1, F.col("uid")).otherwise(F.col("fallback_uid")).alias("from_uid"), "to_uid", F.lit("DEFINES").alias("rel_type"))


def dotted_prefixes(c: Column) -> Column:
    """All dotted prefixes of a name, the name itself included."""
    parts = F.split(c, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def resolve_imports(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(import_id, to_uid, internal, package): the longest dotted prefix that is an entity of the project, else a stub of the
    top package. ``imports``: import_id, project_name, target. ``entities``: uid, project_name, qualified_name."""
    p = imports.select("import_id", "project_name", "target", F.explode(dotted_prefixes(F.col("target"))).alias("qualified_name"))
    hit = p.join(entities, ["project_name", "qualified_name"]).groupBy("import_id").agg(F.max_by("uid", F.length("qualified_name")).alias("uid"))
    top = F.substring_index("target", ".", 1)
    stub = F.concat(F.col("project_name"), F.lit(":ext/"), top)
    return imports.join(hit, "import_id", "left").select("import_id", F.coalesce("uid", stub).alias("to_uid"), F.col("uid").isNotNull().alias("internal"), F.when(F.col("uid").isNull(), top).alias("package"))


def resolve_inherits(refs: DataFrame, types: DataFrame, externals: DataFrame) -> DataFrame:
    """Base types by name: a type of the project, an external symbol, else a minted builtin.
    ``refs``: from_uid, project_name, name. Ties go to the smallest uid."""
    own = types.groupBy("project_name", "name").agg(F.min("uid").alias("own"))
    ext = externals.groupBy("project_name", "name").agg(F.min("uid").alias("ext"))
    minted = F.concat(F.col("project_name"), F.lit(":ext/builtins."), F.col("name"))
    return refs.join(own, ["project_name", "name"], "left").join(ext, ["project_name", "name"], "left").select("from_uid", F.coalesce("own", "ext", minted).alias("to_uid"), F.lit("INHERITS").alias("rel_type"))


def unique_match(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value, and that value."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path that start at a path part: a suffix join becomes an equi-join."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))


def resolve_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, uid): the file of that exact path, else the only one whose path ends with it.
    ``refs``: ref_id, path. ``files``: uid, file_path."""
    exact = unique_match(refs.join(files, F.col("path") == F.col("file_path")).select("ref_id", "uid"), "ref_id", "uid")
    ends = files.select("uid", F.explode(path_suffixes(F.col("file_path"))).alias("path"))
    suffix = unique_match(refs.join(exact, "ref_id", "left_anti").join(ends, "path").select("ref_id", "uid"), "ref_id", "uid")
    return exact.unionByName(suffix)


def resolve_anchors(anchors: DataFrame, entities: DataFrame) -> DataFrame:
    """Note anchors ``path`` or ``path#symbol`` to entities: unique path or suffix, then the symbol in that file.
    ``anchors``: anchor_id, note_uid, anchor. ``entities``: uid, label, name, file_path, content_hash. to_uid is null if unresolved."""
    a = anchors.select("anchor_id", "note_uid", F.substring_index("anchor", "#", 1).alias("path"), F.when(F.col("anchor").contains("#"), F.substring_index("anchor", "#", -1)).alias("symbol"))
    files = entities.where("label IN ('Module', 'DocFile')").select("uid", "file_path")
    at = resolve_paths(a.select(F.col("anchor_id").alias("ref_id"), "path"), files).join(files, "uid").select(F.col("ref_id").alias("anchor_id"), F.col("uid").alias("file_uid"), "file_path")
    inside = entities.where("label NOT IN ('Module', 'DocFile')").groupBy("file_path", F.col("name").alias("symbol")).agg(F.min("uid").alias("symbol_uid"))
    hashes = entities.select(F.col("uid").alias("to_uid"), F.col("content_hash").alias("anchor_hash"))
    out = a.join(at, "anchor_id", "left").join(inside, ["file_path", "symbol"], "left")
    return out.withColumn("to_uid", F.when(F.col("symbol").isNull(), F.col("file_uid")).otherwise(F.col("symbol_uid"))).select("anchor_id", "note_uid", "to_uid").join(hashes, "to_uid", "left")


def stale_anchors(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links with ``stale`` set where the target's content has changed since."""
    now = entities.select(F.col("uid").alias("to_uid"), "content_hash")
    return links.join(now, "to_uid", "left").withColumn("stale", ~F.col("anchor_hash").eqNullSafe(F.col("content_hash"))).drop("content_hash")


def resolve_citations(citations: DataFrame, keys: DataFrame) -> DataFrame:
    """(entity_uid, key, doc_uid, doc_confidence): the document on the best rank of a key; a tie resolves nothing.
    ``citations``: entity_uid, key. ``keys``: key, doc_uid, rank (0 file name, 1 title, 2 first heading)."""
    w = Window.partitionBy("key")
    best = keys.dropDuplicates(["key", "doc_uid", "rank"]).withColumn("_b", F.min("rank").over(w)).where("rank = _b").withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1")
    conf = F.element_at(F.array(F.lit(1.0), F.lit(0.9), F.lit(0.8)), F.col("rank") + 1)
    return citations.join(best.select("key", "doc_uid", conf.alias("doc_confidence")), "key", "left").select("entity_uid", "key", "doc_uid", "doc_confidence")


def protocol_conformance(members: DataFrame, protocols: DataFrame) -> DataFrame:
    """(from_uid, to_uid): types whose members include every member of a protocol, inferred, weight 0.5.

    ``members``: uid, member; ``protocols``: uid, member. Counting shared members instead of pairing types: a
    type conforms if it shares as many as the protocol has."""
    need = protocols.select(F.col("uid").alias("to_uid"), "member").where(~F.col("member").rlike("^__.*__$")).distinct()
    size = need.groupBy("to_uid").agg(F.count(F.lit(1)).alias("size"))
    own = members.select(F.col("uid").alias("from_uid"), "member").distinct()
    shared = own.join(need, "member").where("from_uid <> to_uid").groupBy("from_uid", "to_uid").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(size, "to_uid").where("shared = size").select("from_uid", "to_uid", F.lit("IMPLEMENTS").alias("rel_type"), F.lit(True).alias("inferred"), F.lit(0.5).alias("weight"))


def overrides(inherits: DataFrame, defines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members that a base type also defines: OVERRIDES, or IMPLEMENTS if the base is a protocol or abstract (kind interface, protocol)."""
    n = nodes.select("uid", "name", "kind")
    own = defines.join(n, F.col("to_uid") == F.col("uid")).select(F.col("from_uid").alias("type_uid"), F.col("to_uid").alias("member"), "name")
    base = own.select(F.col("type_uid").alias("base_uid"), F.col("member").alias("base_member"), "name")
    kinds = n.select(F.col("uid").alias("base_uid"), F.col("kind").alias("base_kind"))
    pairs = inherits.select(F.col("from_uid").alias("type_uid"), F.col("to_uid").alias("base_uid")).join(own, "type_uid").join(base, ["base_uid", "name"]).join(kinds, "base_uid", "left")
    return pairs.select(F.col("member").alias("from_uid"), F.col("base_member").alias("to_uid"), F.when(F.col("base_kind").isin("interface", "protocol"), "IMPLEMENTS").otherwise("OVERRIDES").alias("rel_type"))


def test_targets(nodes: DataFrame) -> DataFrame:
    """TESTS edges by name: ``TestX`` to type X, ``test_x`` to callable x, of one project."""
    subject = F.when(F.col("label") == "TypeDef", F.regexp_extract("name", "^Test(.+)$", 1)).when(F.col("label") == "Callable", F.regexp_extract("name", "^test_(.+)$", 1))
    t = nodes.select("project_name", "label", subject.alias("name"), F.col("uid").alias("from_uid")).where("name <> ''")
    return t.join(nodes.select("project_name", "label", "name", F.col("uid").alias("to_uid")), ["project_name", "label", "name"]).select("from_uid", "to_uid", F.lit("TESTS").alias("rel_type"))


def depends_on(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct project pairs between which an IMPORTS edge runs."""
    n = nodes.select("uid", "project_name")
    a, b = n.select(F.col("uid").alias("from_uid"), F.col("project_name").alias("from_project")), n.select(F.col("uid").alias("to_uid"), F.col("project_name").alias("to_project"))
    return edges.where("rel_type = 'IMPORTS'").join(a, "from_uid").join(b, "to_uid").where("from_project <> to_project").select("from_project", "to_project").distinct()


def cross_project_imports(edges: DataFrame, externals: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges with external stubs of a sibling project rewired to that project's package.
    ``externals``: uid, name. ``packages``: uid, name."""
    real = externals.join(packages.groupBy("name").agg(F.min("uid").alias("real")), "name").select(F.col("uid").alias("to_uid"), "real")
    return edges.join(real, "to_uid", "left").withColumn("to_uid", F.coalesce("real", "to_uid")).drop("real").dropDuplicates(["from_uid", "to_uid", "rel_type"])


def config_refs(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of environment variables (global) and resource files (per project); names only, never values.
    ``refs``: from_uid, project_name, kind (env, file), target."""
    to = F.when(F.col("kind") == "env", F.concat(F.lit("env/"), F.col("target"))).otherwise(F.concat(F.col("project_name"), F.lit(":res/"), F.col("target")))
    r = refs.withColumn("to_uid", to)
    label = F.when(F.col("kind") == "env", "EnvVar").otherwise("ResourceFile")
    project = F.when(F.col("kind") == "env", "_global").otherwise(F.col("project_name"))
    nodes = r.select(F.col("to_uid").alias("uid"), label.alias("label"), project.alias("project_name"), F.col("target").alias("name")).distinct()
    kind = F.when(F.col("kind") == "env", "READS_ENV").otherwise("REFERENCES_FILE")
    return nodes, r.select("from_uid", "to_uid", kind.alias("rel_type")).distinct()


def injected(nodes: DataFrame) -> DataFrame:
    """(from_uid, to_uid): callables named in ``Depends(...)`` of another callable's signature, of one project."""
    used = nodes.where("label = 'Callable'").select("project_name", F.col("uid").alias("to_uid"), F.explode(F.regexp_extract_all("signature", F.lit(r"Depends\(\s*([A-Za-z_]\w*)"), F.lit(1))).alias("name"))
    found = nodes.where("label IN ('Callable', 'TypeDef')").select("project_name", "name", F.col("uid").alias("from_uid"))
    return used.join(found, ["project_name", "name"]).select("from_uid", "to_uid", F.lit("INJECTED_INTO").alias("rel_type")).distinct()


def module_exports(nodes: DataFrame, defines: DataFrame) -> DataFrame:
    """(from_uid, to_uid): entities of a module that its ``__all__`` names. Modules carry their ``source``."""
    listed = F.regexp_extract("source", r"(?s)__all__\s*(?::[^=]+)?=\s*[\[(](.*?)[\])]", 1)
    names = nodes.where("label = 'Module'").select(F.col("uid").alias("from_uid"), F.explode(F.regexp_extract_all(listed, F.lit("[\"']([A-Za-z_]\\w*)[\"']"), F.lit(1))).alias("name"))
    own = defines.select("from_uid", "to_uid").join(nodes.select(F.col("uid").alias("to_uid"), "name"), "to_uid")
    return names.join(own, ["from_uid", "name"]).select("from_uid", "to_uid", F.lit("EXPORTS").alias("rel_type")).distinct()


def doc_links(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """DOCUMENTS edges of mentions in documents: a symbol by its exact name, a file by the end of its path; only where one entity alone
    fits. ``refs``: ref_id, from_uid, project_name, target, is_file, link_type, confidence. ``entities``: uid, label, project_name, name, file_path; notes and
    sections are no targets."""
    e = entities.where("label NOT IN ('Note', 'DocSection')").where("uid IS NOT NULL")
    by_name = e.select("project_name", F.lit(False).alias("is_file"), F.col("name").alias("target"), "uid")
    by_path = e.where("file_path IS NOT NULL").select("project_name", F.lit(True).alias("is_file"), F.explode(path_suffixes(F.col("file_path"))).alias("target"), "uid")
    # one entity alone fits all mentions of a ref_id where the least and the greatest uid are one
    key = ["project_name", "is_file", "target"]
    fits = by_name.unionByName(by_path).groupBy(*key).agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    w = Window.partitionBy("ref_id")
    hit = refs.where("ref_id IS NOT NULL").join(lookup(fits, "doc-links-facts"), key, "left").withColumn("lo", F.min("lo").over(w)).withColumn("hi", F.max("hi").over(w)).where("lo = hi")
    return hit.select("from_uid", F.col("lo").alias("to_uid"), F.lit("DOCUMENTS").alias("rel_type"), "link_type", F.col("confidence").alias("doc_confidence"))


def registered_by(refs: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """REGISTERED_BY edges from a handler to what registers it: a callable or value of the same file, else one that the file imports.
    ``refs``: from_uid, project_name, file_path, name. ``entities``: uid, label, project_name, name, file_path. ``imports``: from_file, to_uid."""
    key, named = ["project_name", "name", "file_path"], Window.partitionBy("from_uid", "name")
    e = entities.where("label IN ('Callable', 'Value', 'TypeDef')").select(*key, F.col("uid").alias("to_uid")).where("to_uid IS NOT NULL")
    e = e.withColumn("single", F.count(F.lit(1)).over(Window.partitionBy("to_uid")) == 1)
    linked = imports.select(F.col("from_file").alias("file_path"), "to_uid").distinct().join(e.drop("file_path"), "to_uid").select(*e.columns)
    r = refs.where("from_uid IS NOT NULL").select("from_uid", *key)
    for i, of in ((1, e), (2, linked)):
        n = of.groupBy(*key).agg(F.min("to_uid").alias("_lo"), F.max("to_uid").alias("_hi"))
        other = F.coalesce((F.col("_lo") != F.col("from_uid")) | (F.col("_hi") != F.col("from_uid")), F.lit(False))
        r = r.join(lookup(n, f"registered-facts-{i}"), key, "left").withColumn(f"_{i}", other).drop("_lo", "_hi")
    r = r.where("_1 OR _2").withColumn("_same", F.max("_1").over(named)).withColumn("once", F.count(F.lit(1)).over(named) == 1)
    r = cut_lineage(r.where("_1 OR NOT _same").select("from_uid", *key, "once", F.when(F.col("_1"), 1).otherwise(2).alias("rung")), "registered-refs")
    hits = [expand(r.where(F.col("rung") == i), of, key, f"registered-{i}", "single") for i, of in ((1, e), (2, linked))]
    hits = reduce(DataFrame.unionByName, hits).where("from_uid <> to_uid")
    # a pair can come twice only by a handler that names one thing in several rows, or by an entity with several rows
    unique = F.col("once") & F.col("single")
    pairs = hits.where(unique).select("from_uid", "to_uid").unionByName(hits.where(~unique).select("from_uid", "to_uid").distinct())
    return pairs.select("from_uid", "to_uid", F.lit("REGISTERED_BY").alias("rel_type"))


def protocol_members(conforms: DataFrame, defines: DataFrame, nodes: DataFrame) -> DataFrame:
    """IMPLEMENTS edges between the members of types and of the protocols that they conform to, by name, inferred, weight 0.5."""
    own = defines.select(F.col("from_uid").alias("type"), F.col("to_uid").alias("uid")).join(nodes.where("label = 'Callable'").select("uid", "name"), "uid")
    a = own.select(F.col("type").alias("from_type"), F.col("uid").alias("from_uid"), "name")
    b = own.select(F.col("type").alias("to_type"), F.col("uid").alias("to_uid"), "name").where(~F.col("name").rlike("^__.*__$"))
    pairs = conforms.select(F.col("from_uid").alias("from_type"), F.col("to_uid").alias("to_type")).join(a, "from_type").join(b, ["to_type", "name"])
    return pairs.select("from_uid", "to_uid", F.lit("IMPLEMENTS").alias("rel_type"), F.lit(True).alias("inferred"), F.lit(0.5).alias("weight"))


def replay(unresolved: DataFrame, resolve, key: str = "ref_id") -> tuple[DataFrame, DataFrame]:
    """(edges, still unresolved) of references that earlier batches left open, tried again. ``resolve``: a function of the references that gives
    rows with their ``key``."""
    found = resolve(unresolved)
    return found, unresolved.join(found.select(key).distinct(), key, "left_anti")
