"""Operator 6, suffix-array dedup: remove bytes covered by a 100-byte string that also starts earlier.

Every 100-byte window belongs to one anchor: the 32-byte gram inside it with the smallest hash. Equal windows have
equal anchors at equal places, so windows are compared only among occurrences of one anchor, and an
occurrence stands for all the neighbouring windows that belong to it (its context).

1. Two Bloom filters find anchors that may occur twice; only those leave the scan (hash, context hash,
   place; no text).
2. Occurrences with one context are equal in all their windows: the first keeps them, folded
   map-side, so a passage of any number of documents is one row per map task.
3. Anchors with several contexts need their bytes. Their windows are sorted as suffixes by a merge sort over the bytes
   themselves; neighbours are compared whole, and the smallest place of a run of equals is the first. The windows of an
   anchor with very many contexts are dealt to several tasks by their hash: equal windows meet in one of them.
4. Texts are shuffled only for documents that lose bytes (routed by a filter of their ids).

All filters have a fixed size; beyond it they let more rows through and miss none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bloom_has, bloom_pair, bloom_shape, discard, few_tasks, forget_shuffles, id_filter, in_blocks, merged_filter, mix64, releasing, slices, stored, table

LENGTH = 100
GRAM = 32
MAX_BITS = 1 << 28
#: Bytes hashed together, few enough for their arrays to stay in a processor's cache; a text over four times that is cut into overlapping blocks.
BLOCK = 1 << 16
_BASE = 0xD1342543DE82EF95
_TABLE = mix64(np.arange(1, 257, dtype=np.int64))


class PrefixHashes:
    """Polynomial hashes of all prefixes of some bytes: the hash of any substring in O(1)."""

    _forth = _back = np.zeros(0, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if len(PrefixHashes._forth) < n:
            size = 1 << int(n).bit_length()
            PrefixHashes._forth, PrefixHashes._back = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[raw] * self._forth[: n - 1], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """The hash of each substring of ``width`` bytes."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self._back[: len(out)]
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self._back[start]


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest value (leftmost on ties of the upper 40 bits) of each window of ``w``."""
    n = len(v)
    low = np.full(n + (-n % w), ~np.uint64(0), np.uint64)
    np.bitwise_and(v, ~np.uint64(0xFFFFFF), out=low[:n])
    low[:n] |= np.arange(n, dtype=np.uint64)
    m, span = n - w + 1, 1
    while span * 2 <= w:  # minima of windows twice as wide, until two of them cover a window
        np.minimum(low[:-span], low[span:], out=low[:-span])
        span *= 2
    return (np.minimum(low[:m], low[w - span : w - span + m]) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Arrays over all anchors of some texts: text number, place of the anchor in its text, first
    and last start of its windows, gram hash, context hash; and the joined bytes with each text's begin."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(sizes)]
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), raw, begin
    sums = PrefixHashes(raw)
    grams = sums.every(gram)
    best = sliding_argmin(grams * np.uint64(_BASE), length - gram + 1)
    whole = np.ones(len(best), bool)  # windows that lie in one text
    for end in begin[1:-1].tolist():
        whole[max(0, end - length + 1) : end] = False
    ok = np.flatnonzero(whole)
    if not len(ok):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), raw, begin
    anchor = best[ok]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)])
    a, lo, hi = anchor[new], ok[new], ok[np.r_[new[1:] - 1, len(ok) - 1]]
    of = np.searchsorted(begin, lo, "right") - 1
    shape = ((a - lo) << 8 | (hi - lo)).astype(np.uint64)
    context = mix64(sums.of(lo, hi + length) ^ (shape * np.uint64(_BASE)))
    return of, a - begin[of], lo - begin[of], hi - begin[of], grams[a], context, raw, begin


def text_blocks(rows, length: int, gram: int):
    """(keys, texts, offset of each text's part) in blocks; long texts in parts that overlap so that every
    window, with all grams its anchor is chosen among, lies whole in one part."""
    for block in in_blocks(rows, BLOCK, size=lambda r: len(r[-1])):
        if len(block) == 1 and len(block[0][-1]) > 4 * BLOCK:
            text = block[0][-1]
            for at in range(0, len(text), BLOCK):
                yield [block[0][:-1]], [text[at : at + BLOCK + length - 1]], at
        else:
            yield [r[:-1] for r in block], [r[-1] for r in block], 0


def _rows(b: pa.RecordBatch):
    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        raw = text.encode()
        yield doc, xxhash.xxh3_64_intdigest(raw) - (1 << 63), raw


class Contexts:
    """Sorts the windows of contexts as suffixes and tells which are not the first of their kind."""

    def __init__(self, contexts: list[bytes], length: int):
        self.raw = np.frombuffer(b"".join(contexts), np.uint8)
        self.begin = np.r_[0, np.cumsum([len(c) for c in contexts])]
        self.length = length

    def keys(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A row of bytes for each suffix: the number of its segment (``segment`` ascending), then its ``length`` bytes, then zeros up to whole words."""
        n = len(at)
        out = np.zeros((n, 4 + self.length + (-4 - self.length) % 8), np.uint8)
        if n:
            starts = np.ndarray(len(self.raw) - self.length + 1, f"V{self.length}", self.raw, strides=(1,))
            out[:, :4] = np.cumsum(np.r_[0, segment[1:] != segment[:-1]]).astype(">u4").view(np.uint8).reshape(n, 4)
            out[:, 4 : 4 + self.length] = starts[at].view(np.uint8).reshape(n, self.length)
        return out

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of suffixes within segments (``segment`` ascending): a stable merge sort by their bytes."""
        return self._order(self.keys(at, segment))

    @staticmethod
    def _order(keys: np.ndarray) -> np.ndarray:
        return np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")

    def repeats(self, at: np.ndarray, segment: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which suffixes equal one of smaller ``rank`` in their segment."""
        keys = self.keys(at, segment)
        order = self._order(keys)
        words = keys.view(np.uint64)[order]
        equal = (words[1:] == words[:-1]).all(axis=1)
        run = np.cumsum(np.r_[True, ~equal]) - 1 if len(order) else np.zeros(0, np.int64)
        least = np.full(int(run.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, run, rank[order])
        out = np.zeros(len(at), bool)
        out[order] = rank[order] > least[run]
        return out


#: Windows sorted together.
_SORTED = 1 << 18
#: Contexts of an anchor that one task holds, about: the windows of an anchor with more of them are dealt to more tasks.
CONTEXTS = 8192
_MASK = pa.schema([("h", pa.int64()), ("context", pa.int64()), ("mask", pa.binary())])


def dealt(sums: PrefixHashes, starts: np.ndarray, length: int, parts: np.ndarray) -> np.ndarray:
    """The part of each window that starts at ``starts``, of so many parts."""
    return (mix64(sums.of(starts, starts + length)) % parts.astype(np.uint64)).astype(np.int64)


def _masks(rows: list[tuple], length: int):
    """rows: (h, context, before, bytes, place, part, parts) of whole parts of anchor groups; place sorts by first occurrence."""
    rows.sort(key=lambda r: (r[0], r[5], r[4]))
    c = Contexts([r[3] for r in rows], length)
    count = np.array([len(r[3]) - length + 1 for r in rows])
    who = np.repeat(np.arange(len(rows)), count)
    i = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    group = np.cumsum([0] + [(x[0], x[5]) != (y[0], y[5]) for x, y in zip(rows, rows[1:], strict=False)])
    offset = np.array([r[2] for r in rows])[who] - i  # bytes from the window's start to the anchor
    segment = group[who] * 256 + offset
    dup = np.zeros(len(who), bool)
    part, parts = (np.array([r[k] for r in rows], np.int64)[who] for k in (5, 6))
    own = parts == 1
    other = np.flatnonzero(~own)
    if len(other):
        own[other] = dealt(PrefixHashes(c.raw), c.begin[who[other]] + i[other], length, parts[other]) == part[other]
    own = np.flatnonzero(own)
    by = own[np.argsort(segment[own], kind="stable")]
    edges = np.r_[0, np.flatnonzero(np.diff(segment[by])) + 1, len(by)]
    lo = 0
    while lo < len(edges) - 1:  # whole segments, about _SORTED windows at a time
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + _SORTED, "right")) - 1)
        some = by[edges[lo] : edges[hi]]
        dup[some] = c.repeats(c.begin[who[some]] + i[some], segment[some], who[some])
        lo = hi
    ends = np.cumsum(count)
    keep = [j for j in range(len(rows)) if dup[ends[j] - count[j] : ends[j]].any()]
    return pa.record_batch([[rows[j][0] for j in keep], [rows[j][1] for j in keep], [np.packbits(dup[ends[j] - count[j] : ends[j]]).tobytes() for j in keep]], schema=_MASK)


def removal(raw: bytes, first: np.ndarray, last: np.ndarray, masks: dict[int, bytes], length: int = LENGTH) -> tuple[int, int, str]:
    """(bytes removed, maximal removed runs, SHA-256 of the rest). Marks are ranges of window starts; of mark number i only those in ``masks[i]``, if there."""
    if not len(first):
        return 0, 0, hashlib.sha256(raw).hexdigest()
    if masks:
        whole = np.ones(len(first), bool)
        whole[list(masks)] = False
        some = [int(first[i]) + np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), count=int(last[i] - first[i]) + 1)) for i, m in masks.items()]
        first, last = (np.concatenate([x[whole], *some]) for x in (first, last))
    step = np.bincount(first, minlength=len(raw) + 1) - np.bincount(last + length, minlength=len(raw) + 1)
    covered = np.cumsum(step[:-1]) > 0
    spans = int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(covered[0])
    kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
    return len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, contexts_together: int = CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null counts as empty. "Earlier" is by id, then (rows that share an id) by a hash of the text, then by place; equal
    rows are one document and give a row each; a null id is larger than any other. An
    empty table gives an empty result; other columns are ignored.
    """
    last = (1 << 63) - 1
    gram = min(GRAM, length)
    base = few_tasks(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.select("doc_id", F.coalesce("doc_id", F.lit(last)).alias("k"), "text")
    spark = docs.sparkSession
    sc = spark.sparkContext
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, probes = bloom_shape(size * 2 // (length - gram + 2), 12, max_bits)

    @releasing
    def build(batches):
        def hashes():  # a hash twice in one array counts as seen twice, as it must here
            for b in slices(batches):
                for _, texts, _ in text_blocks(_rows(b), length, gram):
                    yield mix64(anchors(texts, length, gram)[4])

        yield from bloom_pair(hashes(), bits, probes)

    twice = sc.broadcast(merged_filter(keyed.select("k", "text").mapInArrow(build, "slice int, once binary, twice binary"), bits, "twice"))
    forget_shuffles(spark)
    found_sql = "h long, context long, k long, tag long, place long, first long, last long"

    @releasing
    def found(batches):
        for b in slices(batches):
            for keys, texts, shift in text_blocks(_rows(b), length, gram):
                of, a, lo, hi, h, context, _, _ = anchors(texts, length, gram)
                hit = bloom_has(twice.value, mix64(h), probes)
                if hit.any():
                    of, a, lo, hi, h, context = (x[hit] for x in (of, a, lo, hi, h, context))
                    ks, tags = np.array([x[0] for x in keys], np.int64), np.array([x[1] for x in keys], np.int64)
                    yield pa.record_batch([h.view(np.int64), context.view(np.int64), ks[of], tags[of], a + shift, lo + shift, hi + shift], names=["h", "context", "k", "tag", "place", "first", "last"])

    seen = stored(keyed.select("k", "text").mapInArrow(found, found_sql), "substring-anchors")
    classes = stored(seen.groupBy("h", "context").agg(F.min(F.struct("k", "tag", "place")).alias("at"), F.count(F.lit(1)).alias("n")), "substring-contexts")
    forget_shuffles(spark)
    mixed = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / contexts_together).cast("int").alias("parts"))
    mixed = stored(mixed, "substring-mixed")
    mixed_bits, mixed_probes = id_filter(mixed.select("h"), mixed.count(), max_bits)
    mixed_set = sc.broadcast(mixed_bits)

    @releasing
    def contexts(batches):
        for b in slices(batches):
            for _, texts, _ in text_blocks(_rows(b), length, gram):
                of, a, lo, hi, h, context, raw, begin = anchors(texts, length, gram)
                hit = np.flatnonzero(bloom_has(mixed_set.value, mix64(h), mixed_probes))
                if len(hit):
                    _, pick = np.unique(context[hit], return_index=True)
                    hit = hit[pick]
                    s, e = (begin[of[hit]] + lo[hit]).tolist(), (begin[of[hit]] + hi[hit] + length).tolist()
                    whole = raw.tobytes()
                    yield pa.record_batch(
                        [h[hit].view(np.int64), context[hit].view(np.int64), (a - lo)[hit], pa.array([whole[x:y] for x, y in zip(s, e, strict=True)], pa.binary())],
                        names=["h", "context", "before", "bytes"],
                    )

    texts = keyed.select("k", "text").mapInArrow(contexts, "h long, context long, before long, bytes binary")
    texts = texts.groupBy("h", "context").agg(F.min("before").alias("before"), F.min("bytes").alias("bytes"))
    to_sort = texts.join(mixed, "h").join(classes.select("h", "context", "at"), ["h", "context"])

    @releasing
    def deal(batches):
        """Contexts of crowded anchors, once for every part that one of their windows belongs to."""
        for b in slices(batches):
            rows = list(zip(b.column("bytes").to_pylist(), b.column("parts").to_pylist(), strict=True))
            take, part = [], []
            for at, (raw, parts) in enumerate(rows):
                every = np.zeros(1, np.int64)
                if parts > 1:
                    n = len(raw) - length + 1
                    every = np.unique(dealt(PrefixHashes(np.frombuffer(raw, np.uint8)), np.arange(n), length, np.full(n, parts)))
                take += [at] * len(every)
                part += every.tolist()
            out = b.take(pa.array(take, pa.int64()))
            yield pa.record_batch([*out.columns, pa.array(part, pa.int64())], names=[*b.schema.names, "part"])

    @releasing
    def masks(batches):
        held: list[tuple] = []
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4)), ((x["k"], x["tag"], x["place"]) for x in b.column(4).to_pylist()), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True))
            held += rows
            key = lambda r: (r[0], r[5])
            if len(held) >= 4096 and key(held[0]) != key(held[-1]):
                cut = next(i for i in range(len(held) - 1, -1, -1) if key(held[i]) != key(held[-1])) + 1
                yield _masks(held[:cut], length)
                held = held[cut:]
        if held:
            yield _masks(held, length)

    @releasing
    def joined_masks(batches):
        for b in batches:
            out = [np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in found]).tobytes() for found in b.column("masks").to_pylist()]
            yield pa.record_batch([b.column("h"), b.column("context"), pa.array(out, pa.binary())], schema=_MASK)

    cols = ["h", "context", "before", "bytes", "at", "part", "parts"]
    few = to_sort.where("parts = 1").withColumn("part", F.lit(0).cast("long")).select(*cols).repartition("h")
    crowded = to_sort.where("parts > 1").select("h", "context", "before", "bytes", "at", "parts")
    mask = few.sortWithinPartitions("h", "part").mapInArrow(masks, "h long, context long, mask binary")
    if mixed.where("parts > 1").take(1):
        schema = "h long, context long, before long, bytes binary, at struct<k:long,tag:long,place:long>, parts int, part long"
        split = crowded.mapInArrow(deal, schema).select(*cols).repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(masks, "h long, context long, mask binary")
        mask = mask.unionByName(split.groupBy("h", "context").agg(F.collect_list("mask").alias("masks")).mapInArrow(joined_masks, "h long, context long, mask binary"))
    mask = stored(mask, "substring-masks")
    discard(mixed)
    forget_shuffles(spark)
    # as a table, so that the join with all occurrences is one of two plain scans, whose hot keys adaptive execution splits
    firsts = stored(classes.join(mask, ["h", "context"], "left").where("n > 1 OR mask IS NOT NULL").select("h", "context", "at", "mask"), "substring-firsts")
    discard(classes)
    discard(mask)
    forget_shuffles(spark)
    marked = seen.join(firsts, ["h", "context"]).withColumn("is_first", F.col("at") == F.struct("k", "tag", "place")).where("NOT is_first OR mask IS NOT NULL")
    marks = stored(
        marked.select("k", "tag", F.struct("first", "last", F.when(F.col("is_first"), F.col("mask")).alias("mask")).alias("m")).groupBy("k", "tag").agg(F.collect_list("m").alias("marks")),
        "substring-marks",
    )
    discard(seen)
    discard(firsts)
    forget_shuffles(spark)
    bits_, k_ = id_filter(marks.select("k").distinct(), marks.count(), max_bits)
    hit_docs = sc.broadcast(bits_)

    @releasing
    def untouched(batches):
        for b in slices(batches):
            miss = ~bloom_has(hit_docs.value, mix64(b.column("k").to_numpy(zero_copy_only=False)), k_)
            if miss.any():
                part = b.filter(pa.array(miss))
                raw = [t.encode() for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), [len(r) for r in raw], [0] * len(raw), [0] * len(raw), [hashlib.sha256(r).hexdigest() for r in raw]], schema=_OUT)

    @releasing
    def maybe(batches):
        for b in slices(batches):
            hit = bloom_has(hit_docs.value, mix64(b.column("k").to_numpy(zero_copy_only=False)), k_)
            if hit.any():
                part = b.filter(pa.array(hit))
                tags = [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("k"), pa.array(tags, pa.int64()), part.column("text")], names=["doc_id", "k", "tag", "text"])

    @releasing
    def finish(batches):
        for b in slices(batches):
            rows, marks_ = [], b.column("marks")
            sizes = marks_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first, last, mask = marks_.flatten().flatten()
            first, last = first.to_numpy(), last.to_numpy()
            masked = np.flatnonzero(mask.is_valid().to_numpy(zero_copy_only=False))
            found_masks = mask.take(pa.array(masked)).to_pylist()
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(masked, np.r_[0, ends])
            for i, text in enumerate(b.column("text").to_pylist()):
                raw, s, e = text.encode(), int(ends[i] - sizes[i]), int(ends[i])
                own = dict(zip((masked[cuts[i] : cuts[i + 1]] - s).tolist(), found_masks[cuts[i] : cuts[i + 1]], strict=True))
                rows.append((len(raw), *removal(raw, first[s:e], last[s:e], own, length)))
            yield pa.record_batch([b.column("doc_id"), *(list(c) for c in zip(*rows, strict=True))] if rows else [b.column("doc_id"), [], [], [], []], schema=_OUT)

    moved = keyed.mapInArrow(maybe, "doc_id long, k long, tag long, text string").join(marks, ["k", "tag"], "left").select("doc_id", "text", "marks")
    return few_tasks(keyed.mapInArrow(untouched, _OUT_SQL).unionByName(moved.mapInArrow(finish, _OUT_SQL)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
