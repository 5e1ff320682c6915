"""Incremental change: classification, upsert and deletion of graph snapshots, and file-history signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of changed files from which a full rebuild is cheaper.
FULL_SHARE = 0.3


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """uid, change (added, deleted, modified, moved, unchanged), significance of every entity of either snapshot.

    Columns of both: uid, content_hash, signature, docstring, line_start, line_end. A modified entity is MODERATE if its docstring changed
    and its signature did not, else HIGH (a missing one is empty); equal content at other lines is moved."""
    o = old.select("uid", *(F.col(c).alias(f"old_{c}") for c in ("content_hash", "signature", "docstring", "line_start", "line_end")), F.lit(True).alias("_old"))
    n = new.select("uid", "content_hash", "signature", "docstring", "line_start", "line_end", F.lit(True).alias("_new"))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"old_{c}"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")) == F.coalesce(F.col(f"old_{c}"), F.lit(""))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(~same("content_hash"), "modified")
        .when(~(same("line_start") & same("line_end")), "moved").otherwise("unchanged")
    )
    docs_only = text("signature") & ~text("docstring")
    out = o.join(n, "uid", "full").withColumn("change", change)
    return out.select("uid", "change", F.when(F.col("change") == "modified", F.when(docs_only, "MODERATE").otherwise("HIGH")).when(F.col("change").isin("added", "deleted"), "HIGH").alias("significance"))


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` over ``table``: new keys are added. Of equal keys the columns that ``rows`` has replace what was there, null values too;
    columns that it lacks stay."""
    t, r = table.alias("t"), rows.withColumn("_new", F.lit(True)).alias("r")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    given = F.col("r._new").isNotNull()
    value = lambda c: F.when(given, F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")) if c in rows.columns else F.col(f"t.{c}")
    return t.join(r, on, "full").select(*(value(c).alias(c) for c in table.columns))


def insert_missing(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    new = rows.select(*table.columns).dropDuplicates(list(key))
    return table.unionByName(new.join(table.select(*key), list(key), "left_anti"))


def delete_files(nodes: DataFrame, edges: DataFrame, project: str, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The snapshot without the entities of some files. A node that an edge from another file still refers to stays
    (DEFINES, anchors and citations do not hold it); edges from the files go, edges to removed nodes too."""
    gone = nodes.where((F.col("project_name") == project) & F.col("file_path").isin(*paths)).select("uid")
    from_outside = edges.where("rel_type <> 'DEFINES' AND rel_type <> 'DOCUMENTS'").join(gone.withColumnRenamed("uid", "from_uid"), "from_uid", "left_anti")
    held = from_outside.join(gone.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi").select(F.col("to_uid").alias("uid")).distinct()
    removed = gone.join(held, "uid", "left_anti")
    kept = edges.join(gone.withColumnRenamed("uid", "from_uid"), "from_uid", "left_anti").join(removed.withColumnRenamed("uid", "to_uid"), "to_uid", "left_anti")
    return nodes.join(removed, "uid", "left_anti"), kept


def delete_project(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    gone = nodes.where(F.col("project_name") == project).select("uid")
    return nodes.where(F.col("project_name") != project), drop_dangling(edges, gone)


def drop_dangling(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("from_uid", "to_uid"):
        edges = edges.join(gone.withColumnRenamed("uid", end), end, "left_anti")
    return edges


def collect_orphans(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ("EnvVar", "ResourceFile")) -> DataFrame:
    """The nodes without reference-counted ones that no edge reaches."""
    orphans = nodes.where(F.col("label").isin(*labels)).join(edges.select(F.col("to_uid").alias("uid")), "uid", "left_anti").select("uid")
    return nodes.join(orphans, "uid", "left_anti")


def index_mode(changed: int, total: int, has_stored_hash: bool) -> str:
    return "full" if not has_stored_hash or not total or changed / total > FULL_SHARE else "delta"


def embedding_backlog(nodes: DataFrame, text: Column) -> DataFrame:
    """(uid, text, text_hash) of entities whose embedding is missing or belongs to another text."""
    out = nodes.withColumn("text", text).withColumn("text_hash", F.sha2("text", 256))
    return out.where("embedding IS NULL OR NOT (embed_hash <=> text_hash)").select("uid", "text", "text_hash")


def uncached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose hash is not in a content-addressed table of vectors."""
    return texts.dropDuplicates(["text_hash"]).join(cache.select("text_hash"), "text_hash", "left_anti")


def file_signals(commits: DataFrame, now: float) -> DataFrame:
    """file, commit_count, author_count, days_since_last_commit. ``commits``: commit_id, author, ts (epoch seconds), file."""
    days = F.bround((F.lit(float(now)) - F.max("ts")) / 86400, 1)
    return commits.groupBy("file").agg(F.count_distinct("commit_id").alias("commit_count"), F.count_distinct("author").alias("author_count"), days.alias("days_since_last_commit"))


#: Files of a commit that are paired with as many others by one task.
PAIR_BLOCK = 64


def co_changes(commits: DataFrame, least: int = 3) -> DataFrame:
    """(file_a, file_b, count) of files that changed together in at least ``least`` commits.

    Files that changed in fewer commits can be in no such pair and go first. A commit's files are dealt to blocks and its pairs of blocks
    to tasks, so one commit that touches very many files is many small joins."""
    c = commits.select("commit_id", "file").distinct()
    often = c.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("file")
    c = c.join(often, "file", "left_semi")
    blocks = c.groupBy("commit_id").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    c = c.join(blocks, "commit_id").withColumn("block", F.pmod(F.xxhash64("file"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = c.select("commit_id", F.col("file").alias("file_a"), "block", F.explode(others).alias("other"))
    b = c.select("commit_id", F.col("file").alias("file_b"), F.explode(others).alias("block"), F.col("block").alias("other"))
    return a.join(b, ["commit_id", "block", "other"]).where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
