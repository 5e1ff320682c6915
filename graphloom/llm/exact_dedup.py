"""Operator 1, exact dedup: an extendible-hash index kept in shared files.

Main path: DataFrame functions only.

1. One pass over the texts writes small index entries (hash, SHA-256, length, id) to the shared
   folder; no text is shuffled. Entries of equal hash and SHA-256 are folded to one, map-side first.
2. The directory starts with one slot. While a bucket (a hash prefix) holds more than ``capacity`` folded
   entries it is split, and the directory doubles when the bucket is as deep as the directory. Only counts by
   prefix reach the driver, and the capacity grows with the number of entries, so the directory stays small.
3. Each bucket has one owner task, to which its entries are sent by number: the owner of a key range sorts it and
   chains the entries of one hash.
4. Hashes with more than one document are confirmed byte by byte by the same owners: the normalised texts of a chain
   are folded in salted groups first, so that a text with a billion copies reaches its owner a few times only, and
   the owner compares what is left. Unique hashes never move their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, few_tasks, stored, table

#: Folded entries that a bucket may hold before it is split.
CAPACITY = 50_000
#: Buckets that the directory is meant to have at most: beyond it the capacity grows with the number of entries.
BUCKETS = 1 << 15
#: Bits by which prefixes are counted at once.
STEP = 6
#: Groups in which the copies of one text are folded before they go to its owner.
SALTS = 16
#: Repeated hashes (8 bytes each) that may be broadcast; beyond it the hashes are shuffle-joined.
BROADCAST_HASHES = 1_000_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def grow(count: Callable[[int, list[tuple[int, int]]], dict[int, int]], capacity: int, step: int = STEP) -> list[tuple[int, int]]:
    """Leaves (prefix, depth) of the directory in key order.

    ``count(depth, overfull)``: entries by prefix of ``depth`` bits below some prefixes (prefix, depth). A leaf over
    ``capacity`` is split in two until none is left, or its entries share the whole 64-bit hash.
    """
    todo, done, depth, before = [(0, 0)], [], 0, 0
    sums = [count(0, todo)]  # entries by prefix, of every depth from ``before`` on
    while todo:
        deep = []
        while todo:
            prefix, bits = todo.pop()
            if sums[bits - before].get(prefix, 0) <= capacity or bits == 64:
                done.append((prefix, bits))
            elif bits == depth:
                deep.append((prefix, bits))
            else:
                todo += [(prefix * 2, bits + 1), (prefix * 2 + 1, bits + 1)]
        if deep:
            before, depth = depth + 1, min(64, depth + step)
            sums = [count(depth, deep)]
            while len(sums) <= depth - before:
                above: dict[int, int] = {}
                for prefix, n in sums[0].items():
                    above[prefix >> 1] = above.get(prefix >> 1, 0) + n
                sums.insert(0, above)
            todo = [(prefix * 2 + x, bits + 1) for prefix, bits in deep for x in (0, 1)]
    return sorted(done, key=lambda leaf: leaf[0] << (64 - leaf[1]))


def slots(leaves: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """(global depth, at least 1; bucket of every slot): buckets are numbered in key order."""
    depth = max(1, *(bits for _, bits in leaves))
    return depth, [number for number, (_, bits) in enumerate(leaves) for _ in range(1 << (depth - bits))]


def _prefix(h: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - depth) if depth else F.lit(0).cast("long")


def _directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int, int]:
    """(slot, bucket) of the directory over folded entries, its depth and the number of buckets."""

    def count(depth: int, below: list[tuple[int, int]]) -> dict[int, int]:
        if len(below) <= 64 and depth:
            keep = F.lit(False)
            for prefix, bits in below:
                keep = keep | (_prefix("h", bits) == prefix)
            rows = entries.where(keep)
        else:
            rows = entries
        wanted = {prefix for prefix, _ in below}
        back = depth - below[0][1]
        found = rows.groupBy(_prefix("h", depth).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()
        counts = {r["p"] % (1 << 64): r["c"] for r in found}
        return {p: c for p, c in counts.items() if p >> back in wanted}

    total = entries.count()
    depth, of = slots(grow(count, max(capacity, -(-total // BUCKETS))))
    listed = F.split(F.lit(",".join(map(str, of))), ",").cast("array<int>")
    return entries.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "bucket")), depth, of[-1] + 1


def _best(n: Column, doc_id: Column) -> Column:
    """Sorts first what stays of a group: most code points, then the smallest id, null last."""
    return F.struct((-n).alias("n"), doc_id.isNull().alias("none"), doc_id.alias("id"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical without ASCII white space; of a group the row with most code
    points stays, then the smallest id. Null text counts as empty; empty texts form one group.
    Rows with the same id and the same text count each and are kept or dropped together. A null
    id sorts after every other id. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    base = few_tasks(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = base.withColumn("norm", normalised(F.col("text"))).withColumn("h", F.xxhash64("norm"))
    entries = stored(hashed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.char_length("text").alias("n")), "index-entries")
    folded = stored(entries.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("c")), "index-folded")
    directory, depth, buckets = _directory(folded, capacity)

    def owned(rows: DataFrame) -> DataFrame:
        """``rows`` (with a hash ``h``) at the task that owns their bucket."""
        # the directory has a bounded number of slots
        return rows.join(F.broadcast(directory), _prefix("h", depth) == F.col("slot")).drop("slot").repartitionById(buckets, F.col("bucket"))

    # an owner's chains: entries with one hash
    repeated = stored(owned(folded).groupBy("bucket", "h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "index-repeated")
    n = repeated.count()
    suspects = hashed.join(F.broadcast(repeated) if n <= BROADCAST_HASHES else repeated, "h", "left_semi")

    # the bytes decide: copies are folded in salted groups, and the owners compare what is left of a chain
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    chained = suspects.groupBy("h", "norm", salt.alias("salt")).agg(F.count(F.lit(1)).alias("c"), F.min(_best(F.char_length("text"), F.col("doc_id"))).alias("best"))
    classes = stored(
        owned(chained).groupBy("bucket", "h", "norm").agg(F.sum("c").alias("group_size"), F.min("best").alias("best"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("best.id").alias("keep_id"), "group_size"),
        "index-classes",
    )
    discard(folded)
    discard(repeated)
    return few_tasks(
        entries.join(classes, ["h", "sha"], "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .select(
            "doc_id", "keep_id",
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with all columns, whatever their names. Texts move only if more ids are
    dropped than may be broadcast."""
    found = stored(exact_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("dropped_id"), F.unhex("text_sha256").alias("dropped_sha")), "exact-dropped")
    n = found.count()
    same = docs[id_col].cast("long").eqNullSafe(found["dropped_id"]) & (F.unhex(F.sha2(normalised(docs[text_col]), 256)) == found["dropped_sha"])
    return docs.join(F.broadcast(found) if n <= BROADCAST_HASHES // 8 else found, same, "left_anti")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
