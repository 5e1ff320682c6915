"""Operator 2, line dedup: two Bloom filters, then exact confirmation of suspected repeats.

1. Every task hashes its lines into a filter of once-seen and a filter of twice-seen hashes; the
   slices are merged by independent tasks (once AND once of two tasks gives twice).
2. Only lines whose hash is in the merged twice-seen filter are shuffled, with their key, for an
   exact count of documents and the choice of the first one.
3. A document's text is shuffled only if a line of it is dropped (a filter of document ids
   routes it; a false positive costs a shuffled row, never a wrong result).

The filters have a fixed size bound. On inputs beyond it they saturate: more lines are
suspected and shuffled, none is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bloom_has, bloom_pair, bloom_shape, few_tasks, id_filter, merged_filter, mix64, releasing, slices, stored, table

#: Bits of each broadcast filter at most (32 MB).
MAX_BITS = 1 << 28
MIN_KEY = 10
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str) -> list[bytes]:
    """The UTF-8 key of each line: stripped of ASCII white space, A-Z lower-cased."""
    return [x.strip(_SPACE) for x in text.encode().lower().split(b"\n")]


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _line_hashes(text: str, least: int) -> dict[bytes, int]:
    h = xxhash.xxh3_64_intdigest
    return {k: h(k) for k in set(line_keys(text)) if _long(k, least)}


def kept_row(text: str, dropped: set[bytes]) -> tuple[int, int, str]:
    """(lines, lines dropped, SHA-256 of the rest) when all lines with a key of ``dropped`` go."""
    if not dropped:
        return text.count("\n") + 1, 0, hashlib.sha256(text.encode()).hexdigest()
    lines = text.encode().split(b"\n")
    kept = [x for x, key in zip(lines, line_keys(text), strict=True) if key not in dropped]
    return len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
_OUT_SQL = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row.

    Null text counts as empty (one empty line). A key found in two documents stays in the
    smallest id only, where all its lines stay. Rows with equal ids count as one document for
    that choice and each give a row; a null id counts as larger than any other. An empty table gives
    an empty result; other columns are ignored.
    """
    last = (1 << 63) - 1
    base = few_tasks(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.withColumn("k", F.coalesce("doc_id", F.lit(last)))
    sc = docs.sparkSession.sparkContext
    n_lines = base.agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits, probes = bloom_shape(n_lines, 16, max_bits)

    @releasing
    def build(batches):
        def hashes():
            for b in slices(batches):
                out: list[int] = []
                for t in b.column(0).to_pylist():
                    out += _line_hashes(t, min_key).values()
                yield np.array(out, np.uint64)

        yield from bloom_pair(hashes(), bits, probes)

    twice = sc.broadcast(merged_filter(base.select("text").mapInArrow(build, "slice int, once binary, twice binary"), bits, "twice"))
    found = pa.schema([("doc", pa.int64()), ("key", pa.binary())])

    @releasing
    def suspects(batches):
        for b in slices(batches):
            docs_, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_key = _line_hashes(text, min_key)
                if by_key:
                    names = list(by_key)
                    hit = bloom_has(twice.value, np.array(list(by_key.values()), np.uint64), probes)
                    maybe = [names[i] for i in np.flatnonzero(hit)]
                    docs_ += [doc] * len(maybe)
                    keys += maybe
            yield pa.record_batch([docs_, keys], schema=found)

    seen = stored(keyed.select("k", "text").mapInArrow(suspects, "doc long, key binary"), "line-suspects")
    # as a table, so that the join below is one of two plain scans, whose hot keys adaptive execution splits
    first = stored(seen.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first"), "line-firsts")
    drops = stored(seen.join(first, "key").where("doc > first").groupBy("doc").agg(F.collect_set("key").alias("keys")), "line-drops")
    bits_, k_ = id_filter(drops.select("doc"), drops.count(), max_bits)
    hit_docs = sc.broadcast(bits_)

    @releasing
    def untouched(batches):
        for b in slices(batches):
            keep = ~bloom_has(hit_docs.value, mix64(b.column("k").to_numpy(zero_copy_only=False)), k_)
            if keep.any():
                part = b.filter(pa.array(keep))
                rows = [kept_row(t, set()) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]], schema=_OUT)

    @releasing
    def maybe_touched(batches):
        for b in slices(batches):
            hit = bloom_has(hit_docs.value, mix64(b.column("k").to_numpy(zero_copy_only=False)), k_)
            if hit.any():
                yield b.filter(pa.array(hit))

    @releasing
    def finish(batches):
        for b in slices(batches):
            rows = [kept_row(t, set(x or ())) for t, x in zip(b.column("text").to_pylist(), b.column("keys").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]], schema=_OUT)

    moved = keyed.select("doc_id", "k", "text").mapInArrow(maybe_touched, "doc_id long, k long, text string")
    joined = moved.join(drops, moved.k == drops.doc, "left").select("doc_id", "text", "keys")
    return few_tasks(keyed.select("doc_id", "k", "text").mapInArrow(untouched, _OUT_SQL).unionByName(joined.mapInArrow(finish, _OUT_SQL)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT l.*, f.first IS NOT NULL AND doc_id > f.first AS dropped FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
