"""Search: name cascade, BM25, vectors, rank fusion, filters, boosts and context."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import LABEL_BOOSTS, SECONDARY_PROJECT_BOOST, is_generated, is_stub, is_test, last_part, matches_any_glob, normal_path, visibility_boost
from graphloom.schema import GLOBAL_PROJECT

RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75


def in_projects(nodes: DataFrame, projects: list[str] | None, with_global: bool = True) -> DataFrame:
    """Rows of the projects (None: all; an empty list: none)."""
    if projects is None:
        return nodes
    return nodes.where(F.col("project_name").isin(*projects, *([GLOBAL_PROJECT] if with_global else []))) if projects else nodes.where(F.lit(False))


def expand_scope(scope: str, known: list[str], always: tuple[str, ...] = ()) -> list[str] | None:
    """Projects named by a comma list with globs. '' is no filter; what matches nothing selects nothing."""
    wanted = [s.strip() for s in scope.split(",") if s.strip()]
    if not wanted:
        return None
    found = [p for p in known if any(fnmatch.fnmatchcase(p, w) for w in wanted)]
    return found + [a for a in always if a not in found] if found else []


def graph_search(nodes: DataFrame, query: str, limit: int = 20, projects: list[str] | None = None, label: str | None = None) -> DataFrame:
    """(uid, score): name equal 3, qualified name ends with ``.query`` 2, name or qualified name contains it 1; one scan."""
    n = in_projects(nodes, projects)
    if label:
        n = n.where(F.col("label") == label)
    score = F.when(F.col("name") == query, 3.0).when(F.col("qualified_name").endswith("." + query), 2.0).when(F.col("qualified_name").contains(query) | F.col("name").contains(query), 1.0)
    return n.select("uid", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "uid").limit(limit)


def get_node_exact(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return nodes.where((F.col("uid") == name) | (F.col("name") == name)).select("uid", "label", "name").orderBy("uid").limit(limit)


def get_node_partial(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    score = F.when(F.col("qualified_name").endswith("." + name), 3).when(F.col("qualified_name").startswith(name + "."), 2).when(F.col("qualified_name").contains(name), 1)
    return nodes.select("uid", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "uid").limit(limit)


# The order of visibilities.
VISIBILITY_RANK = {"public": 0, "protected": 1, "internal": 2, "private": 3}


def node_order() -> list[Column]:
    """Order of nodes that a name finds: externals last, paths that say test last, by visibility, shorter names first, then by uid."""
    rank = reduce(lambda out, kv: F.when(F.col("visibility") == kv[0], kv[1]).otherwise(out), VISIBILITY_RANK.items(), F.lit(0))
    return [
        F.col("label").isin("ExternalPackage", "ExternalSymbol"), F.lower(F.coalesce("file_path", F.lit(""))).contains("test"), rank,
        F.length(F.coalesce("qualified_name", F.lit(""))), F.col("uid"),
    ]


def get_node(nodes: DataFrame, name: str, limit: int = 20, offset: int = 0, label: str | None = None, tests: bool = True) -> DataFrame:
    """(uid, match, place): a page of the nodes that a name finds, in the page's order.

    Exact matches (uid or name, match 4) come before partial ones: a qualified name that ends with the name (3), starts with it (2), or a name
    that contains it (1). ``tests=False`` leaves tests out of the partial matches only. The page is cut by match, then by uid, and ordered by
    ``node_order``."""
    qn = F.coalesce("qualified_name", F.lit(""))
    match = (
        F.when((F.col("uid") == name) | (F.col("name") == name), 4).when(qn.endswith("." + name), 3).when(qn.startswith(name + "."), 2)
        .when(qn.contains(name) | F.coalesce("name", F.lit("")).contains(name), 1)
    )
    n = nodes.where(F.col("label") == label) if label else nodes
    hits = n.withColumn("match", match).where("match IS NOT NULL")
    if not tests:
        hits = hits.where((F.col("match") == 4) | ~is_test(F.coalesce("file_path", F.lit("")), F.coalesce("name", F.lit(""))))
    page = hits.orderBy(F.desc("match"), "uid").limit(offset + limit).withColumn("_at", F.row_number().over(Window.orderBy(F.desc("match"), "uid"))).where(F.col("_at") > offset)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*node_order()))).select("uid", "match", "place")


# Characters of a docstring in a summary.
DOCSTRING_CHARS = 200


def detail_view(nodes: DataFrame, detail: str = "summary") -> DataFrame:
    """Columns that a caller is shown: a summary without the source and with cut docstrings, or all ("full")."""
    if detail == "full":
        return nodes
    if detail != "summary":
        raise ValueError(f"detail {detail!r}: summary or full")
    cut = F.when(F.length("docstring") > DOCSTRING_CHARS, F.concat(F.substring("docstring", 1, DOCSTRING_CHARS), F.lit("..."))).otherwise(F.col("docstring"))
    return nodes.select(*(cut.alias("docstring") if c == "docstring" else F.col(c) for c in nodes.columns if c not in ("source", "embedding")))


def sanitise(query: str) -> str:
    return re.sub(r'[(){}\[\]^":]', " ", query).strip()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


#: Parts that postings are dealt to by term: a query reads those of its terms. A large corpus takes more of them.
TERM_PARTS = 64


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def postings(docs: DataFrame, parts: int = TERM_PARTS) -> DataFrame:
    """part, term, label, uid, tf, dl of every term of every document: write it partitioned by ``part``; rows come sorted by term. ``docs``: uid, label, text.

    Tasks are balanced by size, so the part of a word that stands in every document is written by many of them."""
    t = docs.select("uid", "label", tokens(F.col("text")).alias("t")).select("uid", "label", F.size("t").alias("dl"), F.explode("t").alias("term"))
    tf = t.groupBy("uid", "label", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.select(_part(F.col("term"), parts).alias("part"), "term", "label", "uid", "tf", "dl").hint("rebalance", "part").sortWithinPartitions("part", "term")


def text_statistics(docs: DataFrame) -> DataFrame:
    """(label, n, avgdl): documents of a label and their mean length."""
    return docs.select("label", F.size(tokens(F.col("text"))).alias("dl")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9_]+", sanitise(query).lower())))


def bm25_indexed(index: DataFrame, stats: DataFrame, query: str, k1: float = BM25_K1, b: float = BM25_B, parts: int = TERM_PARTS) -> DataFrame:
    """(label, uid, score) of documents that hold a term of the query, from ``postings`` (with as many ``parts``) and ``text_statistics`` that
    are kept as tables."""
    terms = query_terms(query)
    # constants, which Catalyst folds: only the partitions of these terms are read
    wanted = [(F.col("part") == _part(F.lit(t), parts)) & (F.col("term") == t) for t in terms]
    tf = index.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))
    return _scored(tf, stats, k1, b)


def _scored(tf: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("label", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # one row per label and term: a handful, whatever the corpus
    return tf.join(F.broadcast(df), ["label", "term"]).join(F.broadcast(stats), "label").groupBy("label", "uid").agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, query: str, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(label, uid, score) of documents that hold a term of the query. ``docs``: uid, label, text; statistics per label.

    For a corpus without an index: a text is tokenised once, and one narrow row per text and found term is made."""
    terms = query_terms(query)
    t = docs.select("uid", "label", tokens(F.col("text")).alias("t")).select("uid", "label", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(*terms) if terms else F.lit(False)).alias("t"))
    stats = t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = t.where(F.size("t") > 0).select("uid", "label", "dl", F.explode("t").alias("term")).groupBy("uid", "label", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _scored(tf, stats, k1, b)


def rank_fusion(ranked: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """(uid, score, ranks): sum of weight / (k + rank) over channels. ``ranked``: channel, uid, rank (from 1)."""
    w = reduce(lambda out, kv: F.when(F.col("channel") == kv[0], float(kv[1])).otherwise(out), (weights or {}).items(), F.lit(1.0))
    ranks = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank"))))
    return ranked.groupBy("uid").agg(F.sum(w / (k + F.col("rank"))).alias("score"), ranks.alias("ranks"))


def ranked(df: DataFrame, channel: str, limit: int, *partition: str) -> DataFrame:
    """(channel, uid, rank) of the best rows by score; ties by uid. With ``partition`` ranks count within it."""
    top = df if partition else df.orderBy(F.desc("score"), "uid").limit(limit)
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(channel))
    return top.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "uid"))).where(F.col("rank") <= limit).select(F.lit(channel).alias("channel"), "uid", "rank")


def fused_labels(scores: DataFrame, limit: int = 20) -> DataFrame:
    """(uid, score): scores of different labels do not compare, so the ranks within each label are fused."""
    return rank_fusion(ranked(scores, "bm25", limit, "label")).select("uid", "score").orderBy(F.desc("score"), "uid").limit(limit)


def text_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return fused_labels(bm25(docs, query), limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(vectors: DataFrame, query: list[float], limit: int | None = 20, threshold: float | None = None, label: str | None = None, projects: list[str] | None = None) -> DataFrame:
    """(uid, score): exact cosine ranking; without a limit all rows, unordered. ``vectors``: uid, embedding, and label and project_name to
    filter by."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = in_projects(vectors, projects, with_global=False)
    if label:
        v = v.where(F.col("label") == label)
    out = v.where("embedding IS NOT NULL").select("uid", cosine(F.col("embedding"), q).alias("score"))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out if limit is None else out.orderBy(F.desc("score"), "uid").limit(limit)


#: Vectors of a block, about: a cell compares two blocks as one matrix product of at most this many squared.
BLOCK_VECTORS = 2048


def similar_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """(a, b, score) of pairs with cosine at least ``threshold``, exactly, as a block join.

    Vectors are dealt to ``blocks`` blocks (by their number: about 2,048 in each); a task compares two blocks as one matrix product, so a pair
    is a row only if it is similar. ``vectors``: uid (long), embedding."""
    import numpy as np
    import pandas as pd

    some = vectors.where("embedding IS NOT NULL")
    blocks = blocks or max(1, -(-some.count() // BLOCK_VECTORS))
    v = some.select("uid", F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    dealt = v.select("uid", "e", "block", cell.alias("c")).select("uid", "e", "block", "c.i", "c.j").distinct()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a, b = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        none = pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64", "score": "float64"})
        if a.empty or b.empty:
            return none
        x, y = (np.stack(p["e"].to_numpy()) for p in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        out = [none]
        for at in range(0, len(x), 512):  # some rows of scores at a time
            s = x[at : at + 512] @ y.T
            p, q = np.nonzero(s >= threshold)
            ua, ub = a["uid"].to_numpy()[at + p], b["uid"].to_numpy()[q]
            keep = ua < ub if i == j else np.ones(len(ua), bool)
            out.append(pd.DataFrame({"a": np.minimum(ua, ub)[keep], "b": np.maximum(ua, ub)[keep], "score": s[p, q][keep]}))
        return pd.concat(out)

    return dealt.groupBy("i", "j").applyInPandas(compare, "a long, b long, score double")


def hashed_vector(text: str, dims: int = 64) -> list[float]:
    """A vector of a text without a model: signed hashes of its words and of their three-letter parts, at unit length. The
    stand-in for an embedding provider, which any function of this shape may replace."""
    import hashlib

    out = [0.0] * dims
    for word in re.findall(r"[a-z0-9_]+", text.lower()):
        for part in {word, *(f"#{word}#"[i : i + 3] for i in range(len(word)))}:
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
            out[h % dims] += 1.0 if h >> 63 else -1.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


# The shapes of a name.
PASCAL_CASE = re.compile(r"^[A-Z][a-zA-Z0-9]+$")
SNAKE_CASE = re.compile(r"^[a-z][a-z0-9_]+$")
DOTTED = re.compile(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$")
DEFAULT_WEIGHTS = {"graph": 1.0, "vector": 1.0, "bm25": 1.0}


def analyse_query(query: str) -> dict[str, float]:
    """Channel weights by the query's shape: a name (or two words, one of which is clearly one), a phrase, or neither."""
    whole, words = query.strip(), query.split()
    named = any(shape.match(whole) for shape in (PASCAL_CASE, SNAKE_CASE, DOTTED))
    if not named and len(words) <= 2:
        named = any(PASCAL_CASE.match(w) or DOTTED.match(w) or "_" in w and SNAKE_CASE.match(w) for w in words)
    if named:
        return {"graph": 2.0, "vector": 0.5, "bm25": 1.5}
    return {"graph": 0.5, "vector": 2.0, "bm25": 1.0} if len(words) >= 3 else {"graph": 1.0, "vector": 1.0, "bm25": 1.0}


def channel_weights(query: str, defaults: dict[str, float] | None = None, explicit: dict[str, float] | None = None) -> dict[str, float]:
    """Default weights times those of the query's shape; an explicit weight stands for itself."""
    base = defaults or DEFAULT_WEIGHTS
    out = {**base, **{c: base.get(c, 1.0) * w for c, w in analyse_query(query).items()}}
    return {**out, **(explicit or {})}


DOC_LABELS = ("DocFile", "DocSection", "Note")


def _matches(path: Column, globs: list[str]) -> Column:
    """Globs on a file's name; one with a slash is meant for the whole path."""
    low = [g.lower() for g in globs]
    named, whole = [g for g in low if "/" not in g], [g for g in low if "/" in g]
    return matches_any_glob(last_part(path, "/"), named) | matches_any_glob(path, whole)


def filter_records(records: DataFrame, tests: bool = True, stubs: bool = True, generated: bool = True) -> DataFrame:
    """Records of a single channel (file_path, name beside others) without tests, stubs or generated files."""
    path, name = F.coalesce("file_path", F.lit("")), F.coalesce("name", F.lit(""))
    for kept, condition in ((tests, is_test(path, name)), (stubs, is_stub(path)), (generated, is_generated(path))):
        if not kept:
            records = records.where(~condition)
    return records


def filter_hits(hits: DataFrame, code_only: bool = False, tests: bool = True, stubs: bool = True, generated: bool = True, exclude: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """Filters after fusion: no documents (``code_only``), tests, stubs and generated files, then globs that exclude, then globs of which one
    must match. ``hits``: label, file_path, name beside others."""
    if code_only:
        hits = hits.where(~F.col("label").isin(*DOC_LABELS))
    hits = filter_records(hits, tests, stubs, generated)
    path = normal_path(F.col("file_path"))
    if exclude:
        hits = hits.where(~_matches(path, exclude))
    return hits.where(_matches(path, include)) if include else hits


def boosted(hits: DataFrame, label_boosts: dict[str, float] | None = None, primary: str | None = None) -> Column:
    label = reduce(lambda out, kv: F.when(F.col("label") == kv[0], float(kv[1])).otherwise(out), (label_boosts or {}).items(), F.lit(1.0))
    home = F.when(F.col("project_name") == primary, 1.0).otherwise(SECONDARY_PROJECT_BOOST) if primary else F.lit(1.0)
    return F.col("score") * visibility_boost(F.col("visibility")) * label * home


CHANNELS = ("graph", "bm25", "vector")


def channel_status(channels: tuple[str, ...], vectors: DataFrame | None, query_vector: list[float] | None) -> dict[str, str]:
    """What becomes of each channel: used, off, or unavailable (vector search without vectors or a query vector)."""
    ready = vectors is not None and query_vector is not None
    return {c: "off" if c not in channels else "unavailable" if c == "vector" and not ready else "used" for c in CHANNELS}


def hybrid_search(
    nodes: DataFrame, docs: DataFrame | None, query: str, limit: int = 10, vectors: DataFrame | None = None, query_vector: list[float] | None = None, primary: str | None = None, mode: str = "blended",
    channels: tuple[str, ...] = CHANNELS, weights: dict[str, float] | None = None, scores: DataFrame | None = None, **filters,
) -> DataFrame:
    """(uid, score, ranks): the name, text and (with a vector) vector channels, three times ``limit`` of each, fused, filtered, boosted by
    visibility, label (``mode``: code, blended, knowledge) and project. ``weights`` override those of the query's shape; ``scores``: the BM25
    scores of an index, instead of ``docs``."""
    status = channel_status(channels, vectors, query_vector)
    found = {}
    if status["graph"] == "used":
        found["graph"] = graph_search(nodes, query, 3 * limit)
    if status["bm25"] == "used":
        found["bm25"] = fused_labels(scores, 3 * limit) if scores is not None else text_search(docs, query, 3 * limit)
    if status["vector"] == "used":
        found["vector"] = vector_search(vectors, query_vector, 3 * limit)
    if not found:
        raise ValueError(f"no channel can be used: {status}")
    fused = rank_fusion(reduce(DataFrame.unionByName, [ranked(df, c, 3 * limit) for c, df in found.items()]), weights=channel_weights(query, explicit=weights))
    hits = filter_hits(fused.join(nodes.select("uid", "label", "file_path", "name", "visibility", "project_name"), "uid"), **filters)
    return hits.withColumn("score", boosted(hits, LABEL_BOOSTS[mode], primary)).select("uid", "score", "ranks").orderBy(F.desc("score"), "uid").limit(limit)


def call_stats(calls: DataFrame, nodes: DataFrame, top: int = 5) -> DataFrame:
    """(uid, caller_count, callee_count, callers, callees): distinct ends and the first names of each. Names are ranked before they are
    collected, so an entity with any number of callers gathers ``top`` of them."""
    names = nodes.select(F.col("uid").alias("o"), "name")

    def side(own: str, other: str, word: str) -> DataFrame:
        e = calls.select(F.col(own).alias("uid"), F.col(other).alias("o")).distinct().join(names, "o")
        named = e.groupBy("uid", "name").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("uid")
        ranked_ = named.withColumn("place", F.row_number().over(w.orderBy("name"))).withColumn("total", F.sum("n").over(w))
        first = ranked_.where(F.col("place") <= top).groupBy("uid").agg(F.first("total").alias(f"{word}_count"), F.sort_array(F.collect_list("name")).alias(f"{word}s"))
        return first

    out = side("to_uid", "from_uid", "caller").join(side("from_uid", "to_uid", "callee"), "uid", "full")
    none = F.array().cast("array<string>")
    return out.select("uid", *(F.coalesce(f"{w}_count", F.lit(0)).alias(f"{w}_count") for w in ("caller", "callee")), *(F.coalesce(f"{w}s", none).alias(f"{w}s") for w in ("caller", "callee")))


def caller_order(target: str) -> list[Column]:
    """Order of callers of a qualified name: those of its package, then no tests, then short names."""
    package = target.rpartition(".")[0]
    qn = F.coalesce("qualified_name", F.lit(""))
    same = (F.when(qn.contains("."), F.regexp_replace(qn, r"\.[^.]*$", "")).otherwise("") == package) if package else F.lit(False)
    return [~same, F.lower(F.coalesce("file_path", F.lit(""))).contains("test"), F.length(qn), F.col("uid")]


def expand_context(nodes: DataFrame, edges: DataFrame, start: str, siblings: int = 5, depth: int = 1, limit: int = 20) -> DataFrame:
    """(role, place, uid): target, parent, siblings, module, callers, callees and documents of an entity, each role in order.

    Callers and callees are callables within ``depth`` (at most 3) calls; callers of the target's package come first. Documents come by confidence."""
    from graphloom.operators.traversal import neighbours_within

    depth = max(1, min(depth, 3))
    d = edges.where("rel_type = 'DEFINES'")
    target = nodes.where(F.col("uid") == start)
    row = target.select("qualified_name").first()
    parent = d.where(F.col("to_uid") == start).select(F.col("from_uid").alias("uid"))
    family = d.join(parent.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").where(F.col("to_uid") != start).select(F.col("to_uid").alias("uid"))
    linked = edges.where((F.col("rel_type") == "DOCUMENTS") & (F.col("to_uid") == start))
    trust = F.coalesce(F.col("doc_confidence"), F.lit(0.0)) if "doc_confidence" in edges.columns else F.lit(0.0)
    docs = linked.select(F.col("from_uid").alias("uid"), trust.alias("trust")).join(nodes.where("label IN ('DocFile', 'DocSection', 'Note')").select("uid"), "uid", "left_semi")

    def placed(role: str, df: DataFrame, most: int, *order: Column | str) -> DataFrame:
        top = df.orderBy(*order).limit(most)
        return top.select(F.lit(role).alias("role"), F.row_number().over(Window.orderBy(*order)).alias("place"), "uid")

    facts = nodes.select("uid", "qualified_name", "file_path")
    near = {c: neighbours_within(edges, start, c, depth, nodes).join(facts, "uid") for c in ("callers", "callees")}
    parts = [
        placed("target", target.select("uid"), 1, "uid"), placed("parent", parent, 1, "uid"), placed("sibling", family, siblings, "uid"), placed("module", _module_of(nodes, edges, start), 1, "uid"),
        placed("caller", near["callers"], limit, *caller_order((row and row["qualified_name"]) or "")), placed("callee", near["callees"], limit, "min_depth", "uid"), placed("doc", docs, limit, F.desc("trust"), "uid"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _module_of(nodes: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    from graphloom.operators.traversal import reach

    above = reach(edges.where("rel_type = 'DEFINES'"), start, "callers", 3)
    return above.join(nodes.where("label = 'Module'").select("uid"), "uid", "left_semi").orderBy("min_depth", "uid").limit(1).select("uid")


def pack_context(parts: list[tuple[str, str]], budget: int, useful: int = 20) -> list[tuple[str, str]]:
    """(role, text) pieces in order of priority while they fit; one that does not is cut at a line if a useful rest of it fits."""
    order = ("target", "parent", "callee", "caller", "doc", "sibling", "module")
    out, left = [], budget
    for role, text in sorted(parts, key=lambda p: order.index(p[0])):
        n = len(text.split())
        if n <= left:
            out.append((role, text))
            left -= n
        elif left >= useful:
            kept: list[str] = []
            for line in text.split("\n"):
                if sum(len(x.split()) for x in kept) + len(line.split()) > left:
                    break
                kept.append(line)
            if sum(len(x.split()) for x in kept) >= useful:
                out.append((role, "\n".join(kept)))
                left -= sum(len(x.split()) for x in kept)
    return out
