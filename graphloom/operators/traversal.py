"""Bounded traversals as level-synchronous frontier joins.

Each level joins the frontier with the edges and keeps one row per node, so the work of a level is
bounded by nodes and edges and not by the number of paths. Weights are at most 1, so the best product over paths of
a length is found by keeping the best per node and level.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import cut_lineage

# Relationship types that an impact and a path follow by default.
IMPACT_TYPES = ("CALLS", "REFERENCES", "IMPORTS", "INHERITS", "IMPLEMENTS", "USES_TYPE", "OVERRIDES", "INJECTED_INTO")
TRACE_TYPES = ("CALLS", "IMPORTS", "USES_TYPE")
DIRECTIONS = ("callers", "callees", "both")
MAX_DEPTH = 10


class NotFoundError(LookupError):
    """An endpoint is not in the graph."""


def clamp_depth(depth: int, most: int = MAX_DEPTH) -> int:
    return max(1, min(depth, most))


def require(nodes: DataFrame, *uids: str) -> None:
    """Raise ``NotFoundError`` for the first uid that no node has."""
    known = {r["uid"] for r in nodes.where(F.col("uid").isin(*uids)).select("uid").distinct().collect()}
    for uid in uids:
        if uid not in known:
            raise NotFoundError(f"node not found: {uid}")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (src, dst, ...) in the direction of travel: "callees" follows them, "callers" goes against them."""
    if direction not in DIRECTIONS[:2]:
        raise ValueError(f"direction {direction!r}: one of {', '.join(DIRECTIONS)}")
    names = {"src": "from_uid", "dst": "to_uid"} if direction == "callees" else {"src": "to_uid", "dst": "from_uid"}
    rest = [c for c in edges.columns if c not in ("from_uid", "to_uid")]
    return edges.select(*(F.col(v).alias(k) for k, v in names.items()), *rest)


def reach(edges: DataFrame, start: str, direction: str, max_depth: int) -> DataFrame:
    """(uid, min_depth) of nodes within ``max_depth`` hops of ``start``, without it; "both": over either direction, never mixed."""
    if direction == "both":
        both = reach(edges, start, "callees", max_depth).unionByName(reach(edges, start, "callers", max_depth))
        return both.groupBy("uid").agg(F.min("min_depth").alias("min_depth"))
    e = directed(edges, direction).select("src", "dst")
    spark = edges.sparkSession
    seen = frontier = spark.range(1).select(F.lit(start).alias("uid"), F.lit(0).alias("min_depth"))
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, F.col("uid") == F.col("src")).select(F.col("dst").alias("uid")).distinct().join(seen.select("uid"), "uid", "left_anti")
        frontier = cut_lineage(step.withColumn("min_depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("min_depth > 0")


def impact(edges: DataFrame, start: str, direction: str, max_depth: int) -> DataFrame:
    """uid, min_depth, score, via, line, ambiguous_only, test_only of what walks of at most ``max_depth`` hops reach in one direction.

    One frontier carries all facts: a node's row of a level holds its best product of weights, the types of first hops, and whether
    resolved edges alone and production edges alone reach it at that length. The start may be passed through; it is not reported.
    """
    firm = F.col("confidence").isNull() | (F.col("confidence") == "resolved")
    real = ~F.coalesce("from_test", F.lit(False))
    e = directed(edges, direction).select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w"), "rel_type", "line", firm.alias("e_firm"), real.alias("e_real"))
    none = F.lit(None).cast("int")
    level = edges.sparkSession.range(1).select(F.lit(start).alias("uid"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("via"), F.lit(True).alias("firm"), F.lit(True).alias("real"))
    levels = []
    for depth in range(1, max_depth + 1):
        via = F.array(F.col("rel_type")) if depth == 1 else F.col("via")
        step = level.join(e, F.col("uid") == F.col("src")).select(
            F.col("dst").alias("uid"), (F.col("score") * F.col("w")).alias("score"), via.alias("via"),
            (F.col("firm") & F.col("e_firm")).alias("firm"), (F.col("real") & F.col("e_real")).alias("real"), (F.col("line") if depth == 1 else none).alias("line"),
        )
        step = step.groupBy("uid").agg(
            F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("via")))).alias("via"),
            F.bool_or("firm").alias("firm"), F.bool_or("real").alias("real"), F.min("line").alias("line"),
        )
        step = cut_lineage(step, "level") if depth < max_depth else step
        levels.append(step.withColumn("depth", F.lit(depth)))
        level = step
    out = reduce(DataFrame.unionByName, levels).where(F.col("uid") != start)
    return out.groupBy("uid").agg(
        F.min("depth").alias("min_depth"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via"),
        F.min("line").alias("line"), (~F.bool_or("firm")).alias("ambiguous_only"), (~F.bool_or("real")).alias("test_only"),
    )


def blast_radius(edges: DataFrame, start: str, direction: str = "callers", max_depth: int = 3, types: tuple[str, ...] = IMPACT_TYPES) -> DataFrame:
    """uid, min_depth, score, via, line (depth 1), ambiguous_only, test_only of every node that a change of ``start`` reaches.

    ambiguous_only: not reached over resolved edges alone (a missing confidence counts as resolved); test_only: not
    reached over production edges alone. "both": what either direction reaches, with the facts of the nearer one, of callees where both
    are equally near.
    """
    max_depth = clamp_depth(max_depth)
    e = edges.where(F.col("rel_type").isin(*types))
    if direction != "both":
        return impact(e, start, direction, max_depth)
    out = impact(e, start, "callees", max_depth).withColumn("side", F.lit(0)).unionByName(impact(e, start, "callers", max_depth).withColumn("side", F.lit(1)))
    rest = [c for c in out.columns if c not in ("uid", "side")]
    return out.groupBy("uid").agg(F.min_by(F.struct(*rest), F.struct("min_depth", "side")).alias("x")).select("uid", "x.*")


def impact_order() -> list[Column]:
    """Nearest first, production before test, then the likeliest, then by name."""
    return [F.col("min_depth"), F.col("test_only"), F.desc("score"), F.coalesce("qualified_name", F.lit("")), F.col("uid")]


def ranked_impact(affected: DataFrame, nodes: DataFrame, limit: int = 20, tests: bool = True) -> DataFrame:
    """The first ``limit`` affected entities, with name, qualified name, label and path, and ``affected_count``, how many there are.
    ``tests=False`` leaves entities out that are tests by path or name."""
    from graphloom.functions.expressions import is_test

    out = affected.join(nodes.select("uid", "label", "name", "qualified_name", "file_path"), "uid")
    if not tests:
        out = out.where(~is_test(F.coalesce("file_path", F.lit("")), F.coalesce("name", F.lit(""))))
    count = out.agg(F.count(F.lit(1)).alias("affected_count"))
    return out.orderBy(*impact_order()).limit(limit).crossJoin(F.broadcast(count)).orderBy(*impact_order())


def neighbours_within(edges: DataFrame, start: str, direction: str, depth: int, nodes: DataFrame | None = None) -> DataFrame:
    """(uid, min_depth) over CALLS; with ``nodes`` restricted to callables."""
    out = reach(edges.where("rel_type = 'CALLS'"), start, direction, depth)
    return out.join(nodes.where("label = 'Callable'").select("uid"), "uid", "left_semi") if nodes is not None else out


def trace_path(edges: DataFrame, start: str, end: str, max_depth: int = 6, types: tuple[str, ...] = TRACE_TYPES, nodes: DataFrame | None = None) -> DataFrame:
    """(hop, from_uid, to_uid, rel_type, weight) of the shortest path, and the facts that the edges have; of equally short ones that with the
    greatest product of weights, then the smallest nodes. Empty if there is none, or if start is end. With ``nodes``
    a missing end raises ``NotFoundError``.

    A level keeps one edge into every node that is new: the path is walked back from its end.
    """
    spark = edges.sparkSession
    if nodes is not None:
        require(nodes, start, end)
    facts = [c for c in edges.columns if c not in ("from_uid", "to_uid", "rel_type", "weight")]
    e = edges.where(F.col("rel_type").isin(*types)).select(F.col("from_uid").alias("src"), F.col("to_uid").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("w"), "rel_type", *facts)
    levels: list[DataFrame] = []
    level = spark.range(1).select(F.lit(start).alias("uid"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    seen = level.select("uid")
    found = start == end
    while not found and len(levels) < max_depth:
        step = level.join(e, F.col("uid") == F.col("src")).join(seen.withColumnRenamed("uid", "_s"), F.col("dst") == F.col("_s"), "left_anti")
        step = step.withColumn("total", F.col("score") * F.col("w"))
        # among equal products the path with the smallest nodes: its last but one node ranks first, then the edge
        best = F.min_by(F.struct("src", "rel_type", "w", "total", *facts), F.struct((-F.col("total")).alias("t"), "rank", "rel_type"))
        step = step.groupBy("dst").agg(best.alias("b"), F.min_by("rank", F.struct((-F.col("total")).alias("t"), "rank")).alias("above"))
        step = step.select(F.col("dst").alias("uid"), F.col("b.total").alias("score"), "above", "b.src", "b.rel_type", "b.w", *(f"b.{c}" for c in facts))
        # the rank of a node's path: by the path before it, then by the node
        step = cut_lineage(step, "trace")
        levels.append(step)
        if not step.take(1):
            break
        found = bool(step.where(F.col("uid") == end).take(1))
        seen = seen.unionByName(step.select("uid"))
        level = step.select("uid", "score", F.struct("above", "uid").alias("rank"))
    hops, at = [], end
    if found:
        for depth in range(len(levels), 0, -1):
            row = levels[depth - 1].where(F.col("uid") == at).first()
            hops.append((depth, row["src"], at, row["rel_type"], row["w"], *(row[c] for c in facts)))
            at = row["src"]
    kinds = "".join(f", {c} {edges.schema[c].dataType.simpleString()}" for c in facts)
    return spark.createDataFrame(hops[::-1], f"hop int, from_uid string, to_uid string, rel_type string, weight double{kinds}")


def nearest_ancestor(nodes: DataFrame, edges: DataFrame, label: str = "Module", hops: int = 3) -> DataFrame:
    """(uid, ancestor, distance): the nearest node of ``label`` over at most ``hops`` DEFINES edges."""
    up = edges.where("rel_type = 'DEFINES'").select(F.col("to_uid").alias("at"), F.col("from_uid").alias("parent"))
    wanted = nodes.where(F.col("label") == label).select(F.col("uid").alias("parent"), F.lit(True).alias("hit"))
    level, out = nodes.select("uid", F.col("uid").alias("at")), None
    for distance in range(1, hops + 1):
        level = level.join(up, "at").select("uid", F.col("parent").alias("at"), "parent").join(wanted, "parent", "left").select("uid", "at", "hit")
        part = level.where("hit").select("uid", F.col("at").alias("ancestor"), F.lit(distance).alias("distance"))
        out = part if out is None else out.unionByName(part)
        level = level.where("hit IS NULL").select("uid", "at")
    w = Window.partitionBy("uid").orderBy("distance", "ancestor")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Edges of a graph (of modules, projects) whose cycles are found on the driver: counted first, larger ones stay distributed.
LOCAL_EDGES = 50_000


def _finished(nodes: list[str], after: dict[str, list[str]], seen: set[str]) -> list[str]:
    """Nodes reached from ``nodes``, each after all that it reaches."""
    out = []
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(after.get(start, ())))]
        while path:
            node, rest = path[-1]
            step = next((n for n in rest if n not in seen), None)
            if step is None:
                out.append(path.pop()[0])
            else:
                seen.add(step)
                path.append((step, iter(after.get(step, ()))))
    return out


def components_of(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(node, component) of the nodes on a cycle of a small graph: two passes, over the edges and against them."""
    after, before = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
        before[b].append(a)
    order, seen, out = _finished(sorted(after), after, set()), set(), []
    for node in reversed(order):
        group = _finished([node], before, seen)
        out += [(n, min(group)) for n in group] if len(group) > 1 else []
    return out


def strongly_connected(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of nodes on a cycle; component is its smallest node. ``edges``: a, b. Up to ``local`` edges are solved on the driver.

    Every round spreads the smallest label forward and backward. Nodes whose two labels are one node are that
    node's component. Only edges between nodes of equal labels can lie on a cycle, so a round also cuts the graph into
    all its pieces, and rounds go on until no edge is left: none is dropped for their number.
    """
    e = cut_lineage(edges.where("a <> b").select("a", "b").distinct(), "scc")
    parts, n = [], e.count()
    if n <= local:
        return edges.sparkSession.createDataFrame(sorted(components_of([(r["a"], r["b"]) for r in e.collect()])), "node string, component string")
    while True:
        left = e.count()
        while left:  # only nodes with edges both ways can lie on a cycle
            e = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            e = cut_lineage(e.select("a", "b"), "scc")
            n, left = left, e.count()
            if left == n:
                break
        if not left:
            break
        label = _spread(e)
        back = _spread(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = cut_lineage(label.join(back.withColumnRenamed("label", "back"), "node"), "scc-labels")
        parts.append(cut_lineage(both.where("label = back").select("node", F.col("label").alias("component")), "scc-part"))
        rest = both.where("label <> back").select("node", F.struct("label", "back").alias("x"))
        e = e.join(rest.toDF("a", "xa"), "a").join(rest.toDF("b", "xb"), "b").where("xa = xb").select("a", "b")
        e = cut_lineage(e, "scc")
    if not parts:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    return reduce(DataFrame.unionByName, parts)


def _spread(e: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which each node can be reached, itself included. A step also takes the label of
    the label, so a chain of any length is done in a number of steps that grows with its logarithm."""
    label = cut_lineage(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "label")
    while True:
        step = label.unionByName(e.join(label, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label"))
        step = step.groupBy("node").agg(F.min("label").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = cut_lineage(step.join(jump, "label").select("node", F.col("above").alias("label")), "label")
        if not new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").take(1):
            return new
        label = new


def modularity(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """Newman's Q of a partition. ``weights``: a, b, weight (undirected, each pair once). ``groups``: node, community."""
    g = groups
    e = weights.join(g.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(g.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight", (F.col("ca") == F.col("cb")).alias("same")), F.struct(F.col("cb").alias("c"), "weight", F.lit(False).alias("same")))).alias("x"))
    per = ends.groupBy("x.c").agg(F.sum("x.weight").alias("degree"), F.sum(F.when(F.col("x.same"), F.col("x.weight")).otherwise(0.0)).alias("inside"))
    total = weights.agg(F.sum("weight").alias("m"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("q"))


# A community is split where its parts have this modularity among themselves, so many times at most; gains below
# the last one are none.
SPLIT_MODULARITY, SPLIT_DEPTH, NO_GAIN = 0.12, 6, 1e-12


def _merged(weight: dict[str, dict[str, float]]) -> list[list[str]]:
    """Agglomerative modularity clustering: the best merge first, ties to the smallest pair of names (a community goes by its smallest
    member's). ``weight``: symmetric. A heap holds the gains; entries of changed pairs are skipped."""
    near = {a: dict(x) for a, x in weight.items()}
    degree = {n: sum(x.values()) for n, x in near.items()}
    members, whole = {n: [n] for n in near}, sum(degree.values())
    if not whole:
        return [[n] for n in sorted(near)]
    gain = lambda a, b: 2 * (near[a][b] / whole - degree[a] * degree[b] / whole**2)
    heap = [(-gain(a, b), a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        top, a, b = heapq.heappop(heap)
        if a not in near or b not in near[a] or abs(gain(a, b) + top) > NO_GAIN / 4:
            continue
        if -top <= NO_GAIN:
            break
        ties = [(top, a, b)]  # gains that differ by rounding alone
        while heap and heap[0][0] <= top + NO_GAIN:
            x = heapq.heappop(heap)
            if x[1] in near and x[2] in near[x[1]] and abs(gain(x[1], x[2]) + x[0]) <= NO_GAIN / 4:
                ties.append(x)
        a, b = min(x[1:] for x in ties)
        for x in ties:
            if x[1:] != (a, b):
                heapq.heappush(heap, x)
        for c, w in near.pop(b).items():
            near[c].pop(b)
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + w
        degree[a] += degree.pop(b)
        members[a] += members.pop(b)
        for c in near[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(x, y), x, y))
    return [sorted(x) for x in members.values()]


def _q(groups: list[list[str]], weight: dict[str, dict[str, float]]) -> float:
    whole = sum(sum(x.values()) for x in weight.values())
    of = {n: i for i, g in enumerate(groups) for n in g}
    inside, degree = [0.0] * len(groups), [0.0] * len(groups)
    for a, x in weight.items():
        for b, w in x.items():
            degree[of[a]] += w
            inside[of[a]] += w if of[a] == of[b] else 0.0
    return sum(i / whole - (d / whole) ** 2 for i, d in zip(inside, degree, strict=True)) if whole else 0.0


def _refined(weight: dict[str, dict[str, float]], depth: int = 0) -> list[list[str]]:
    out = []
    for group in _merged(weight):
        parts = [group]
        if depth < SPLIT_DEPTH and len(group) > 2:
            inside = {a: {b: w for b, w in weight[a].items() if b in set(group)} for a in group}
            parts = _merged(inside)
            parts = _refined(inside, depth + 1) if len(parts) > 1 and _q(parts, inside) >= SPLIT_MODULARITY else [group]
        out += parts
    return out


def greedy_communities(pairs: list[tuple[str, str, float]], split: bool = True) -> dict[str, int]:
    """Modularity clustering of a small graph on the driver, each community clustered again where that shows parts. Numbers go by size, then
    by the smallest name."""
    weight: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in pairs:
        if a != b:
            weight[a][b] += w
            weight[b][a] += w
    found = sorted(_refined(weight) if split else _merged(weight), key=lambda x: (-len(x), x[0]))
    return {n: i for i, x in enumerate(found) for n in x}


def topological_order(names: list[str], needs: dict[str, set[str]]) -> list[str]:
    """Names after all that they need; where a cycle is left, the given order."""
    known = set(names)
    open_ = {n: (needs.get(n, set()) - {n}) & known for n in names}
    wanted = defaultdict(list)
    for n, x in open_.items():
        for other in x:
            wanted[other].append(n)
    count, out = {n: len(x) for n, x in open_.items()}, []
    place = {n: i for i, n in enumerate(names)}
    ready = [n for n in names if not count[n]]
    while ready:
        out += ready
        freed = []
        for n in ready:
            for other in wanted[n]:
                count[other] -= 1
                if not count[other]:
                    freed.append(other)
        ready = sorted(freed, key=place.__getitem__)
    return out + [n for n in names if count[n]]
