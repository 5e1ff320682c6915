"""Repository-style analyses over nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import is_test, last_part
from graphloom.schema import CALLABLE_KINDS, TYPE_KINDS

# Limits of the quality flags; the health score's weights, what a finding of each kind takes off, and how much coupling is free.
GOD_MODULE, TANGLED_FAN, RIGID, UNSTABLE = 30, 8, 0.1, 0.9
HEALTH_WEIGHTS = {"modularity": 0.25, "god_modules": 0.20, "circular_deps": 0.20, "tangled": 0.15, "coupling": 0.10, "instability": 0.10}
GOD_COST, CYCLE_COST, TANGLE_COST, FAN_COST, EXTREME_COST, FREE_FAN = 20, 15, 20, 5, 15, 10
HUB_TYPES = ("IMPORTS", "INHERITS", "CALLS")
LIVE_TYPES = ("CALLS", "USES_TYPE", "IMPORTS", "INHERITS", "IMPLEMENTS", "OVERRIDES", "REFERENCES")


def structure_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


def children(nodes: DataFrame, edges: DataFrame, label: str, rel_type: str, child_label: str | None = None, limit: int = 10) -> DataFrame:
    """(uid, n) of the nodes of ``label`` with most children over ``rel_type``."""
    e = edges.where(F.col("rel_type") == rel_type)
    if child_label:
        e = e.join(nodes.where(F.col("label") == child_label).select(F.col("uid").alias("to_uid")), "to_uid", "left_semi")
    counts = e.groupBy(F.col("from_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(nodes.where(F.col("label") == label).select("uid"), "uid", "left_semi").orderBy(F.desc("n"), "uid").limit(limit)


def hubs(edges: DataFrame, limit: int = 10) -> DataFrame:
    """(uid, total, imports, inherits, calls) by in-degree, counted in one pass."""
    e = edges.where(F.col("rel_type").isin(*HUB_TYPES))
    per = [F.sum(F.when(F.col("rel_type") == t, 1).otherwise(0)).alias(t.lower()) for t in HUB_TYPES]
    return e.groupBy(F.col("to_uid").alias("uid")).agg(F.count(F.lit(1)).alias("total"), *per).orderBy(F.desc("total"), "uid").limit(limit)


def hub_modules(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(uid, importers): the modules that most entities import."""
    e = edges.where("rel_type = 'IMPORTS'").groupBy(F.col("to_uid").alias("uid")).agg(F.count(F.lit(1)).alias("importers"))
    return e.join(nodes.where("label = 'Module'").select("uid"), "uid", "left_semi").orderBy(F.desc("importers"), "uid").limit(limit)


def leaves(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ("TypeDef", "Callable")) -> DataFrame:
    """Code nodes that no hub edge reaches."""
    reached = edges.where(F.col("rel_type").isin(*HUB_TYPES)).select(F.col("to_uid").alias("uid"))
    return nodes.where(F.col("label").isin(*labels)).select("uid", "label").join(reached, "uid", "left_anti")


def module_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_mod, to_mod, weight): imports between modules, direct or of an entity (two levels deep) that the other module defines."""
    mods = nodes.where("label = 'Module'").select("uid")
    imports = edges.where("rel_type = 'IMPORTS'").select("from_uid", "to_uid").join(mods.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi")
    direct = imports.join(mods.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi").select(F.col("from_uid").alias("from_mod"), F.col("to_uid").alias("to_mod"))
    owner = edges.where("rel_type = 'DEFINES'").select(F.col("from_uid").alias("to_mod"), "to_uid").join(mods.withColumnRenamed("uid", "to_mod"), "to_mod", "left_semi")
    indirect = imports.join(owner, "to_uid").select(F.col("from_uid").alias("from_mod"), "to_mod")
    return direct.unionByName(indirect).where("from_mod <> to_mod").groupBy("from_mod", "to_mod").agg(F.count(F.lit(1)).alias("weight"))


def package_of(qn: Column) -> Column:
    """The dotted parent; empty at the top."""
    return F.when(qn.contains("."), F.regexp_replace(qn, r"\.[^.]*$", "")).otherwise("")


def coupling(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(from_pkg, to_pkg, weight) between different packages."""
    names = nodes.select("uid", package_of(F.col("qualified_name")).alias("pkg"))
    a, b = names.select(F.col("uid").alias("from_mod"), F.col("pkg").alias("from_pkg")), names.select(F.col("uid").alias("to_mod"), F.col("pkg").alias("to_pkg"))
    return weights.join(a, "from_mod").join(b, "to_mod").where("from_pkg <> to_pkg").groupBy("from_pkg", "to_pkg").agg(F.sum("weight").alias("weight"))


def external_counts(externals: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, importers): distinct importers of each external package, none included."""
    e = edges.where("rel_type = 'IMPORTS'").select(F.col("to_uid").alias("uid"), "from_uid")
    return externals.select("uid").join(e, "uid", "left").groupBy("uid").agg(F.count_distinct("from_uid").alias("importers"))


def production_modules(nodes: DataFrame) -> DataFrame:
    """Modules that are no tests, by path or by the last part of their name."""
    qn = F.coalesce("qualified_name", "name", F.lit(""))
    return nodes.where("label = 'Module'").where(~is_test(F.coalesce("file_path", F.lit("")), last_part(qn, ".")))


def _between(weights: DataFrame, modules: DataFrame) -> DataFrame:
    for end in ("from_mod", "to_mod"):
        weights = weights.join(modules.select(F.col("uid").alias(end)), end, "left_semi")
    return weights


def quality(nodes: DataFrame, edges: DataFrame, tests: bool = False) -> DataFrame:
    """uid, entities, fan_in, fan_out, instability, is_god, is_tangled, is_rigid, is_unstable of every module; test modules and their imports
    go first, unless ``tests``."""
    mods = (nodes.where("label = 'Module'") if tests else production_modules(nodes)).select("uid")
    entities = edges.where("rel_type = 'DEFINES'").groupBy(F.col("from_uid").alias("uid")).agg(F.count(F.lit(1)).alias("entities"))
    w = _between(module_imports(nodes, edges), mods)
    out_ = w.groupBy(F.col("from_mod").alias("uid")).agg(F.count(F.lit(1)).alias("fan_out"))
    in_ = w.groupBy(F.col("to_mod").alias("uid")).agg(F.count(F.lit(1)).alias("fan_in"))
    m = mods.join(entities, "uid", "left").join(in_, "uid", "left").join(out_, "uid", "left").fillna(0, ["entities", "fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    m = m.withColumn("instability", F.when(total == 0, F.lit(0.5)).otherwise(F.col("fan_out") / total))
    return m.select(
        "*", (F.col("entities") > GOD_MODULE).alias("is_god"), ((F.col("fan_in") > TANGLED_FAN) & (F.col("fan_out") > TANGLED_FAN)).alias("is_tangled"),
        (F.col("instability") < RIGID).alias("is_rigid"), (F.col("instability") > UNSTABLE).alias("is_unstable"),
    )


def worst_modules(flags: DataFrame, cyclic: DataFrame, limit: int = 10) -> DataFrame:
    """(uid, issues, entities): modules with most flags, a place on an import cycle among them. ``cyclic``: uid."""
    on = cyclic.select("uid").distinct().withColumn("is_circular", F.lit(True))
    flags = flags.join(on, "uid", "left").fillna(False, ["is_circular"])
    issues = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in ("is_god", "is_circular", "is_tangled", "is_rigid", "is_unstable")])
    return flags.select("uid", issues.alias("issues"), "entities").where("issues > 0").orderBy(F.desc("issues"), F.desc("entities"), "uid").limit(limit)


def health_score(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, tests: bool = False) -> DataFrame:
    """One row: the score of 100, the share of imports inside a package, what was counted and the parts of the score.

    Every god module, cycle, tangled module and module of extreme instability takes a fixed amount off its part, and so does each
    module that the largest fan-in and fan-out have beyond ten. ``cycles``: (node, component) of modules on import cycles."""
    flags = quality(nodes, edges, tests)
    mods = flags.select("uid")
    names = nodes.select("uid", package_of(F.coalesce("qualified_name", F.lit(""))).alias("pkg"))
    w = _between(module_imports(nodes, edges), mods)
    both = w.join(names.select(F.col("uid").alias("from_mod"), F.col("pkg").alias("a")), "from_mod").join(names.select(F.col("uid").alias("to_mod"), F.col("pkg").alias("b")), "to_mod")
    ratio = both.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0)) / F.sum("weight"), F.lit(1.0)).alias("modularity_ratio"))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    found = flags.agg(
        F.count(F.lit(1)).alias("modules"), n("is_god").alias("god"), n("is_tangled").alias("tangled"), (n("is_rigid") + n("is_unstable")).alias("extreme"),
        F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"), F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out"),
    )
    whole = cycles.join(mods.withColumnRenamed("uid", "node"), "node", "left").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    circular = whole.agg(F.count(F.lit(1)).alias("circular"))
    less = lambda c, cost: F.greatest(F.lit(0), 100 - F.col(c) * cost)
    # three one-row aggregates
    out = found.crossJoin(F.broadcast(ratio)).crossJoin(F.broadcast(circular)).select(
        "modules", F.bround("modularity_ratio", 3).alias("modularity_ratio"), "god", "circular", "tangled", "extreme", "max_fan_in", "max_fan_out",
        F.bround(F.col("modularity_ratio") * 100).cast("int").alias("s_modularity"), less("god", GOD_COST).alias("s_god_modules"), less("circular", CYCLE_COST).alias("s_circular_deps"),
        less("tangled", TANGLE_COST).alias("s_tangled"), F.greatest(F.lit(0), 100 - F.greatest(F.lit(0), F.col("max_fan_in") + F.col("max_fan_out") - FREE_FAN) * FAN_COST).alias("s_coupling"),
        less("extreme", EXTREME_COST).alias("s_instability"),
    )
    total = reduce(lambda a, b: a + b, [F.col(f"s_{k}") * v for k, v in HEALTH_WEIGHTS.items()])
    return out.withColumn("score", F.bround(total).cast("int"))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, label): types and callables that nothing reaches, that have no called member, are not nested in a callable, are not
    registered, override nothing and carry no decorator. Names that start with two underscores, properties, and kinds that
    are not code (tables, resources, stages) are never reported; an unknown kind counts as code."""
    code = nodes.where(F.col("label").isin("TypeDef", "Callable") & ~F.coalesce(F.col("name"), F.lit("")).startswith("__"))
    if "decorator_name" in nodes.columns:
        code = code.where("decorator_name IS NULL")
    if "kind" in nodes.columns:
        code = code.where(F.col("kind").isNull() | F.col("kind").isin(*(k for k in (*TYPE_KINDS, *CALLABLE_KINDS) if k != "property")))
    reached = edges.where(F.col("rel_type").isin(*LIVE_TYPES)).select(F.col("to_uid").alias("uid")).distinct()
    defines = edges.where("rel_type = 'DEFINES'").select("from_uid", "to_uid")
    member_called = defines.join(edges.where("rel_type = 'CALLS'").select("to_uid").distinct(), "to_uid", "left_semi").select(F.col("from_uid").alias("uid")).distinct()
    nested = defines.join(nodes.where("label = 'Callable'").select(F.col("uid").alias("from_uid")), "from_uid", "left_semi").select(F.col("to_uid").alias("uid"))
    bound = edges.where(F.col("rel_type").isin("REGISTERED_BY", "OVERRIDES", "IMPLEMENTS")).select(F.col("from_uid").alias("uid")).distinct()
    out = code.select("uid", "label")
    for alive in (reached, member_called, nested, bound):
        out = out.join(alive, "uid", "left_anti")
    return out


def complexity(nodes: DataFrame, limit: int = 20) -> DataFrame:
    return nodes.where("label = 'Callable'").select("uid", (F.col("line_end") - F.col("line_start")).alias("span")).orderBy(F.desc("span"), "uid").limit(limit)


def doc_coverage(nodes: DataFrame) -> DataFrame:
    """(label, total, documented, percent) by label, percent rounded half to even."""
    has = F.sum(F.when(F.coalesce(F.col("docstring"), F.lit("")) != "", 1).otherwise(0))
    out = nodes.where(F.col("label").isin("TypeDef", "Callable")).groupBy("label").agg(F.count(F.lit(1)).alias("total"), has.alias("documented"))
    return out.withColumn("percent", F.bround(100.0 * F.col("documented") / F.col("total"), 1))


def visibility_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin("TypeDef", "Callable")).groupBy("visibility").agg(F.count(F.lit(1)).alias("n"))


def inheritance(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    n = nodes.select("uid", "name")
    e = edges.where("rel_type = 'INHERITS'").select("from_uid", "to_uid")
    return e.join(n.select(F.col("uid").alias("from_uid"), F.col("name").alias("child")), "from_uid").join(n.select(F.col("uid").alias("to_uid"), F.col("name").alias("parent")), "to_uid").orderBy("from_uid", "to_uid").limit(limit)


def handlers(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(from_uid, name, rel_type, target) of entities that handle a route, an event or a command."""
    n = nodes.select("uid", "name")
    e = edges.where(F.col("rel_type").isin("HANDLES_ROUTE", "HANDLES_EVENT", "HANDLES_COMMAND")).select("from_uid", "to_uid", "rel_type")
    return e.join(n.toDF("from_uid", "name"), "from_uid").join(n.toDF("to_uid", "target"), "to_uid").select("from_uid", "name", "rel_type", "target").orderBy("rel_type", "from_uid", "to_uid").limit(limit)


def members(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(uid, members): members of the types of a kind, none included."""
    d = edges.where("rel_type = 'DEFINES'").select(F.col("from_uid").alias("uid"), "to_uid")
    return nodes.where(F.col("kind") == kind).select("uid").join(d, "uid", "left").groupBy("uid").agg(F.count("to_uid").alias("members"))


def hotspots(signals: DataFrame, limit: int = 20) -> DataFrame:
    return signals.orderBy(F.desc("commit_count"), "file").limit(limit)


def bus_factor(signals: DataFrame, authors: int = 1, limit: int = 20) -> DataFrame:
    return signals.where(F.col("author_count") <= authors).orderBy(F.desc("commit_count"), "file").limit(limit)


def community_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight) between modules: weights of calls between their files and counts of imports, undirected."""
    at = nodes.select("uid", "file_path")
    mods = nodes.where("label = 'Module'").select(F.col("uid").alias("mod"), "file_path")
    calls = edges.where("rel_type = 'CALLS'").select("from_uid", "to_uid", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    files = calls.join(at.select(F.col("uid").alias("from_uid"), F.col("file_path").alias("fa")), "from_uid").join(at.select(F.col("uid").alias("to_uid"), F.col("file_path").alias("fb")), "to_uid")
    files = files.where("fa <> fb").groupBy("fa", "fb").agg(F.sum("weight").alias("weight"))
    by_file = files.join(mods.select(F.col("mod").alias("ma"), F.col("file_path").alias("fa")), "fa").join(mods.select(F.col("mod").alias("mb"), F.col("file_path").alias("fb")), "fb").select("ma", "mb", "weight")
    imports = module_imports(nodes, edges).select(F.col("from_mod").alias("ma"), F.col("to_mod").alias("mb"), F.col("weight").cast("double").alias("weight"))
    return by_file.unionByName(imports).groupBy(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(F.sum("weight").alias("weight"))


#: Module pairs that the driver-side clustering takes at most; a repository has far fewer.
MAX_MODULE_PAIRS = 200_000


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community, size) by greedy modularity; modules alone are left out. The sums are distributed; the
    module graph, of checked size, is clustered on the driver."""
    from graphloom.operators.traversal import greedy_communities

    pairs = community_weights(nodes, edges).orderBy("a", "b").limit(MAX_MODULE_PAIRS + 1).collect()
    if len(pairs) > MAX_MODULE_PAIRS:
        raise ValueError(f"more than {MAX_MODULE_PAIRS} module pairs; cluster packages instead")
    found = greedy_communities([(r["a"], r["b"], round(r["weight"], 9)) for r in pairs])
    df = nodes.sparkSession.createDataFrame(sorted(found.items()), "node string, community int")
    sizes = df.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return df.join(sizes, "community").select("node", "community", "size")


# Relationships inside a scope, and those that cross its boundary.
INNER_TYPES = ("CALLS", "INHERITS", "IMPLEMENTS", "USES_TYPE", "OVERRIDES")
BOUNDARY_TYPES = (*INNER_TYPES, "IMPORTS")


def _scoped_edges(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """from_uid, to_uid, rel_type, measure (internal, fan_in, fan_out) of the edges with an end under a path, both in one project."""
    inside = F.coalesce(F.col("file_path"), F.lit("")).startswith(prefix)
    n = nodes.select("uid", "project_name", inside.alias("in"))
    e = edges.where(F.col("rel_type").isin(*BOUNDARY_TYPES)).where("from_uid <> to_uid").select("from_uid", "to_uid", "rel_type")
    e = e.join(n.toDF("from_uid", "pa", "a"), "from_uid").join(n.toDF("to_uid", "pb", "b"), "to_uid").where("pa = pb AND (a OR b)")
    measure = F.when(F.col("a") & F.col("b"), "internal").when(F.col("b"), "fan_in").otherwise("fan_out")
    return e.select("from_uid", "to_uid", "rel_type", measure.alias("measure")).where("measure <> 'internal' OR rel_type <> 'IMPORTS'")


def module_summary(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """(measure, value) of all that lies under a path: modules, entities, internal edges, edges in and out, linked documents."""
    scope = nodes.where(F.coalesce(F.col("file_path"), F.lit("")).startswith(prefix)).select("uid", "label")
    one = F.count(F.lit(1)).alias("value")
    size = scope.where(F.col("label").isin("Module", "TypeDef", "Callable", "Value")).groupBy(F.when(F.col("label") == "Module", "modules").otherwise("entities").alias("measure")).agg(one)
    docs = edges.where("rel_type = 'DOCUMENTS'").join(scope.select(F.col("uid").alias("to_uid")), "to_uid", "left_semi").groupBy(F.lit("docs").alias("measure")).agg(one)
    return size.unionByName(_scoped_edges(nodes, edges, prefix).groupBy("measure").agg(one)).unionByName(docs)


#: Characters that a rendered summary may have before it gives less detail.
SUMMARY_CHARS = 60_000


def summary_text(nodes: DataFrame, edges: DataFrame, prefix: str, limit: int = 100, most: int = SUMMARY_CHARS) -> str:
    """The skeleton and the boundary of a path as text: with signatures and docstrings, else with signatures, else names alone, the first of
    these that has at most ``most`` characters. ``limit`` counts tenths of the entities and thirds of the edges shown."""
    cols = [c if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in ("qualified_name", "kind", "label", "file_path", "signature", "docstring", "line_start", "line_end")]
    scope = nodes.where(F.coalesce(F.col("file_path"), F.lit("")).startswith(prefix) & F.col("label").isin("Module", "TypeDef", "Callable", "Value"))
    rows = scope.select(*cols).orderBy("file_path", F.col("label") != "Module", "line_start", "qualified_name").limit(10 * limit).collect()
    names = nodes.select("uid", "qualified_name")
    e = _scoped_edges(nodes, edges, prefix).join(names.toDF("from_uid", "a"), "from_uid").join(names.toDF("to_uid", "b"), "to_uid")
    links = e.select("measure", "rel_type", "a", "b").orderBy("measure", "rel_type", "a", "b").limit(9 * limit).collect()

    def render(tier: int) -> str:
        out = []
        for r in rows:
            span = f" ({r['line_start']}-{r['line_end']})" if tier and r["line_start"] else ""
            out.append(f"{'## ' if r['label'] == 'Module' else '- '}{r['qualified_name']}{(r['signature'] or '') if tier else ''}{span}")
            if tier == 2 and r["docstring"]:
                out.append("    " + " ".join(r["docstring"].split()))
        for title in ("internal", "fan_in", "fan_out"):
            out += [f"# {title}", *(f"{x['a']} -{x['rel_type']}-> {x['b']}" for x in [x for x in links if x["measure"] == title][: 3 * limit])]
        return "\n".join(out)

    texts = [render(tier) for tier in (2, 1, 0)]
    return next((t for t in texts if len(t) <= most), texts[-1])


def package_diagram(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    n = nodes.select("uid", "name")
    e = edges.where("rel_type = 'CONTAINS'").select("from_uid", "to_uid")
    return e.join(n.select(F.col("uid").alias("from_uid"), F.col("name").alias("parent")), "from_uid").join(n.select(F.col("uid").alias("to_uid"), F.col("name").alias("child")), "to_uid").select("from_uid", "to_uid", "parent", "child").orderBy("from_uid", "to_uid").limit(limit)


def inheritance_diagram(nodes: DataFrame, edges: DataFrame, prefix: str = "", limit: int = 30) -> DataFrame:
    """(child, parent) by name of INHERITS edges whose child lies under a path."""
    n = nodes.select("uid", "name")
    inside = nodes.where(F.coalesce(F.col("file_path"), F.lit("")).startswith(prefix)).select(F.col("uid").alias("from_uid"))
    e = edges.where("rel_type = 'INHERITS'").select("from_uid", "to_uid").join(inside, "from_uid", "left_semi")
    return e.join(n.toDF("from_uid", "child"), "from_uid").join(n.toDF("to_uid", "parent"), "to_uid").select("from_uid", "to_uid", "child", "parent").orderBy("from_uid", "to_uid").limit(limit)


def module_detail(nodes: DataFrame, edges: DataFrame, prefix: str, limit: int = 30) -> DataFrame:
    """(module, owner, name, label, kind, visibility): what the first module under a path defines, and the members of its types."""
    module = nodes.where((F.col("label") == "Module") & F.coalesce(F.col("file_path"), F.lit("")).startswith(prefix)).orderBy("qualified_name", "uid").limit(1).select(F.col("uid").alias("module"))
    d = edges.where("rel_type = 'DEFINES'").select(F.col("from_uid").alias("above"), F.col("to_uid").alias("uid"))
    n = nodes.select("uid", "name", "label", "kind", "visibility", "line_start")
    top = module.join(d, F.col("module") == F.col("above")).join(n, "uid")
    types = top.where("label = 'TypeDef'").select("module", F.col("uid").alias("above"), F.col("name").alias("owner"))
    inner = types.join(d, "above").join(n.where("label = 'Callable'"), "uid")
    cols = ["module", "owner", "name", "label", "kind", "visibility"]
    first = top.withColumn("owner", F.lit(None).cast("string")).orderBy("line_start", "uid").limit(limit).select(*cols)
    return first.unionByName(inner.orderBy("owner", "line_start", "uid").limit(limit).select(*cols))


def within_budget(pairs: DataFrame, budget: int = 30) -> DataFrame:
    """The pairs among the ``budget`` modules that most weight meets at. ``pairs``: from_mod, to_mod, weight."""
    ends = pairs.select(F.explode(F.array("from_mod", "to_mod")).alias("m"), "weight").groupBy("m").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "m").limit(budget).select("m")
    kept = F.broadcast(ends)  # at most ``budget`` rows
    return pairs.join(kept, F.col("from_mod") == F.col("m"), "left_semi").join(kept, F.col("to_mod") == F.col("m"), "left_semi")


def truncation_notice(shown: int, total: int, remedy: str) -> dict | None:
    """What a caller is told about rows that were left out; None if there are none."""
    return None if shown >= total else {"shown": shown, "total": total, "cut": total - shown, "remedy": remedy}


def mermaid(pairs: DataFrame, a: str, b: str, limit: int = 100) -> str:
    """A flow chart of at most ``limit`` pairs, rendered on the driver."""
    rows = pairs.select(a, b).orderBy(a, b).limit(limit).collect()
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in r}))}
    return "\n".join(["graph LR", *(f'  {i}["{n}"]' for n, i in ids.items()), *(f"  {ids[r[0]]} --> {ids[r[1]]}" for r in rows)])


def import_outline(pairs: DataFrame, limit: int = 25) -> str:
    """The import graph as a chart, or, beyond ``limit`` modules, as an outline by module."""
    rows = pairs.select("from_mod", "to_mod", "weight").orderBy(F.desc("weight"), "from_mod", "to_mod").limit(limit * limit).collect()
    names = sorted({x for r in rows for x in r[:2]})
    if len(names) <= limit:
        return mermaid(pairs, "from_mod", "to_mod", limit * limit)
    return "\n".join(f"{n}: " + ", ".join(f"{r['to_mod']} ({r['weight']})" for r in rows if r["from_mod"] == n) for n in names if any(r["from_mod"] == n for r in rows))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def index_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_name, entities, files, edges) of every project."""
    n = nodes.groupBy("project_name").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("file_path").alias("files"))
    e = edges.join(nodes.select(F.col("uid").alias("from_uid"), "project_name"), "from_uid").groupBy("project_name").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "project_name", "left").fillna(0, ["edges"])


def project_list(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_name, entities, depends_on, depended_by) of every project."""
    from graphloom.operators.resolve import depends_on

    n = nodes.groupBy("project_name").agg(F.count(F.lit(1)).alias("entities"))
    pairs = depends_on(edges.where("rel_type = 'IMPORTS'"), nodes)
    none = F.array().cast("array<string>")
    to = pairs.groupBy(F.col("from_project").alias("project_name")).agg(F.sort_array(F.collect_set("to_project")).alias("depends_on"))
    by = pairs.groupBy(F.col("to_project").alias("project_name")).agg(F.sort_array(F.collect_set("from_project")).alias("depended_by"))
    out = n.join(to, "project_name", "left").join(by, "project_name", "left")
    return out.select("project_name", "entities", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_by", none).alias("depended_by"))


def percentiles(df: DataFrame, column: str, *by: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Interpolated percentiles of a column, p50 and so on, by group."""
    return df.groupBy(*by).agg(*(F.percentile(column, p).alias(f"p{round(p * 100)}") for p in at))


# ---------------------------------------------------------------- vault lint


def duplicate_ids(notes: DataFrame, key: str = "uid") -> DataFrame:
    return notes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return links.join(nodes.select(F.col("uid").alias("to_uid")), "to_uid", "left_anti")


def orphan_notes(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes with no link in or out."""
    ends = links.select(F.explode(F.array("from_uid", "to_uid")).alias("uid"))
    return notes.select("uid").join(ends, "uid", "left_anti")


def broken_anchors(links: DataFrame) -> DataFrame:
    """uid of notes with an anchor whose target has changed since."""
    return links.where("rel_type = 'DOCUMENTS' AND stale").select(F.col("from_uid").alias("uid")).distinct()


def inbox_notes(notes: DataFrame, folder: str = "inbox/") -> DataFrame:
    path = F.concat(F.lit("/"), F.lower(F.coalesce("file_path", F.lit(""))))
    return notes.where(path.contains("/" + folder)).select("uid")


def promotion_candidates(links: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(uid, projects): notes that entities of at least ``least`` projects link to."""
    p = nodes.select(F.col("uid").alias("from_uid"), "project_name")
    return links.join(p, "from_uid").groupBy(F.col("to_uid").alias("uid")).agg(F.count_distinct("project_name").alias("projects")).where(F.col("projects") >= least)


def index_drift(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, problem): listed in an index and missing, or present and not listed."""
    a, b = listed.select("path").distinct(), present.select("path").distinct()
    return a.join(b, "path", "left_anti").select("path", F.lit("missing").alias("problem")).unionByName(b.join(a, "path", "left_anti").select("path", F.lit("unlisted").alias("problem")))
