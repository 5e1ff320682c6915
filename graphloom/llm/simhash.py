"""Operator 4, SimHash near-dedup with pigeonring filtering.

1. Each text becomes a 64-bit fingerprint; only distinct fingerprints go on, so any number of
   copies is one row.
2. A fingerprint is cut into a ring of m segments. If two fingerprints differ in at most tau bits, then some segment
   starts a chain whose cumulative differences over its first 1, 2, ... segments stay within 1, 2, ... times
   tau / m (the pigeonring principle). Chains of l < m segments are the index: for every start, and every choice of the
   segments in which the budgets leave room for a difference, the rest of the chain is a join key.
3. Pairs that share a key are pruned by their chain: those over a budget at any of its lengths are dropped
   before the full Hamming check.
4. Inside a key's group a search visits each fingerprint once against those not reached yet and emits
   links that span the group; pairs are never emitted. A group of more than ``HOT`` fingerprints is not
   held: its members go on to a finer index, whose chains fix so many bits that a group is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import connected_components, few_tasks, mix64, releasing, slices, stored, table, with_ids, without_ids

TAU = 3
SEED = 42


def shingles(text: str, width: int) -> list[bytes]:
    """Space-joined shingles in order, repeats included; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in shingles(text, width)], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bit set if it is set in over half of the hashes; 0 of none. In blocks: memory is bounded."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        block = np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += block.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of the m segments of 64 bits."""
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def budgets(m: int, length: int, tau: int) -> list[int]:
    """Differences that the first 1, 2, ... ``length`` segments of a viable chain may have."""
    return [(n * tau) // m for n in range(1, length + 1)]


def ring_ok(x: np.ndarray, m: int, tau: int, length: int) -> np.ndarray:
    """Which differences (XORs) have a start on the ring whose chain of ``length`` segments is within budget at each of its lengths."""
    d = np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in segments(m)])
    found = np.zeros(x.shape, bool)
    for start in range(m):
        ok, run = np.ones(x.shape, bool), np.zeros(x.shape, np.uint8)
        for at, most in enumerate(budgets(m, length, tau)):
            run = run + d[(start + at) % m]
            ok &= run <= most
        found |= ok
    return found


def ring_near(x: np.ndarray, m: int, tau: int, length: int) -> np.ndarray:
    """Full Hamming check of the differences with a viable chain of ``length`` < ``m`` segments."""
    out = np.zeros(x.shape, bool)
    i = np.flatnonzero(ring_ok(x, m, tau, length))
    out[i] = np.bitwise_count(x[i]) <= tau
    return out


def loose_sets(m: int, length: int, tau: int) -> list[tuple[int, ...]]:
    """Choices of the segments of a chain that may differ: as many as the whole chain's budget, not before the budgets
    leave room for them. The differing segments of every viable chain are part of one of them."""
    allowed = budgets(m, length, tau)
    return [c for c in combinations(range(length), allowed[-1]) if all(sum(x <= n for x in c) <= allowed[n] for n in range(length))]


@dataclass(frozen=True)
class Ring:
    """An index over chains: the keys (start, choice) of ``length`` segments each, as bit masks."""

    m: int
    length: int
    tau: int

    @property
    def chains(self) -> list[tuple[int, list[int]]]:
        """(bits that must be equal, bits of the chain's first 1, 2, ... segments) of every key."""
        mask = [((1 << w) - 1) << s for s, w in segments(self.m)]
        out = []
        for start in range(self.m):
            chain = [mask[(start + n) % self.m] for n in range(self.length)]
            prefix = [sum(chain[: n + 1]) for n in range(self.length)]
            out += [(sum(x for n, x in enumerate(chain) if n not in loose), prefix) for loose in loose_sets(self.m, self.length, self.tau)]
        return out

    @property
    def bits(self) -> int:
        """Bits that every key fixes at least."""
        return min(fixed.bit_count() for fixed, _ in self.chains)

    def prefixes(self) -> np.ndarray:
        return np.array([prefix for _, prefix in self.chains], np.uint64)


def ring_for(n: int, tau: int = TAU) -> Ring:
    """The ring with fewest keys whose chains fix 2 bits more than are needed to tell ``n`` fingerprints apart, or the finest one."""
    rings = [Ring(m, length, tau) for m in range(tau + 1, 3 * tau + 1) for length in range(1, m)]
    enough = [r for r in rings if r.bits >= np.log2(max(n, 2)) + 2]
    return min(enough, key=lambda r: (len(r.chains), -r.bits)) if enough else finest_ring(tau)


def finest_ring(tau: int = TAU) -> Ring:
    """The ring whose keys fix most bits: at tau 3 all but 22, so no group has more than 2 ** 22 fingerprints."""
    return max((Ring(3 * tau, length, tau) for length in range(1, 3 * tau)), key=lambda r: (r.bits, -len(r.chains)))


def viable(x: np.ndarray, prefix: np.ndarray, allowed: list[int], tau: int) -> np.ndarray:
    """Which differences are within every budget of their key's chain, and then within ``tau`` bits. ``prefix``: for each difference
    (or for all) the bits of the chain's first 1, 2, ... segments."""
    i = np.arange(len(x))
    for n, most in enumerate(allowed):
        i = i[np.bitwise_count(x[i] & (prefix[n] if prefix.ndim == 1 else prefix[i, n])) <= most]
    out = np.zeros(len(x), bool)
    out[i] = np.bitwise_count(x[i]) <= tau
    return out


def spanning_links(fp: np.ndarray, prefix: np.ndarray, allowed: list[int], tau: int) -> list[tuple[int, int]]:
    """Links (indexes) that connect all fingerprints of a key's group that are connected over viable chains."""
    left, links = np.arange(len(fp)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            hit = viable(fp[left] ^ fp[at], prefix, allowed, tau)
            if hit.any():
                reached = left[hit].tolist()
                links += [(at, r) for r in reached]
                front += reached
                left = left[~hit]
    return links


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_of_sorted(batches, ring: Ring, hot: int | None):
    """Rows (key number, key, fingerprint) sorted by key: groups are taken from the stream, small ones are compared all at once. Of a
    group over ``hot`` nothing is held: its fingerprints are given back as (fingerprint, null)."""
    prefix, allowed = ring.prefixes(), budgets(ring.m, ring.length, ring.tau)
    keep, passing = [np.zeros(0, np.int64)] * 3, None

    def groups(c, k, f):
        u = f.view(np.uint64)
        at = np.r_[0, np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1, len(c)]
        size = np.diff(at)
        a, b = [], []
        for g in range(2, min(9, int(size.max(initial=0)) + 1)):  # groups of 2 to 8: vectors over all of them
            start = at[:-1][size == g]
            for i, j in combinations(range(g), 2):
                hit = viable(u[start + i] ^ u[start + j], prefix[c[start]], allowed, ring.tau)
                a.append(f[start[hit] + i])
                b.append(f[start[hit] + j])
        deferred = []
        for s, n in zip(at[:-1][size > 8], size[size > 8], strict=True):
            if hot is not None and n > hot:
                deferred.append(f[s : s + n])
                continue
            for i, j in spanning_links(u[s : s + n], prefix[c[s]], allowed, ring.tau):
                a.append(f[s + i : s + i + 1])
                b.append(f[s + j : s + j + 1])
        yield pa.record_batch([np.concatenate(a or [f[:0]]), np.concatenate(b or [f[:0]])], schema=_LINK)
        for f in deferred:
            yield pa.record_batch([f, pa.nulls(len(f), pa.int64())], schema=_LINK)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if passing is not None:  # the rest of a hot group
            n = int(np.argmin(np.r_[(cols[0] == passing[0]) & (cols[1] == passing[1]), False]))
            yield pa.record_batch([cols[2][:n], pa.nulls(n, pa.int64())], schema=_LINK)
            cols = [x[n:] for x in cols]
            if not len(cols[0]):
                continue
            passing = None
        cols = [np.concatenate([x, y]) for x, y in zip(keep, cols, strict=True)]
        c, k, f = cols
        if not len(c):
            continue
        change = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield from groups(c[:cut], k[:cut], f[:cut])
        keep = [x[cut:] for x in cols]
        if hot is not None and len(keep[0]) > hot:
            passing = (keep[0][0], keep[1][0])
            yield pa.record_batch([keep[2], pa.nulls(len(keep[2]), pa.int64())], schema=_LINK)
            keep = [x[:0] for x in keep]
    if len(keep[0]):
        yield from groups(*keep)


#: Fingerprints of a key's group that one task holds and searches; larger groups go on to the finest ring.
HOT = 1 << 14


def _ring_links(fps: DataFrame, ring: Ring, hot: int | None) -> DataFrame:
    keys = []
    for number, (fixed, _) in enumerate(ring.chains):
        signed = fixed - (1 << 64) if fixed >> 63 else fixed
        keys.append(F.struct(F.lit(number).cast("long").alias("c"), F.col("fp").bitwiseAND(F.lit(signed)).alias("k")))
    rows = fps.select(F.explode(F.array(*keys)).alias("x"), "fp").select("x.c", "x.k", "fp")
    return rows.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(releasing(lambda it: _links_of_sorted(it, ring, hot)), "a long, b long")


def fingerprint_links(fps: DataFrame, n: int, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long): connected as the fingerprints within ``tau`` bits are.

    A pair within ``tau`` bits has a viable chain, so it shares that chain's key and passes its budgets."""
    found = stored(_ring_links(fps, ring_for(n, tau), hot), "fingerprint-links")
    links, crowded = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    return links.unionByName(_ring_links(crowded, finest_ring(tau), None)) if crowded.take(1) else links


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @releasing
    def run(batches):
        for b in slices(batches):
            fp = np.array([simhash(shingle_hashes(t or "", width)) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), fp], schema=_FP)

    return few_tasks(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fp long")


def simhash_components(docs: DataFrame, width: int = 3, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows give a row
    each. Null ids are ignored when the smallest is taken; a component of null ids alone has a null
    component_id. An empty table gives an empty result; other columns are ignored.
    """
    fp = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    links = fingerprint_links(classes.select("fp"), classes.count(), tau)
    parts = connected_components(links)
    named = stored(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "fingerprint-parts")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return few_tasks(fp.join(by_fp, "fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similarity of shingle sets

#: Parts of a shingle set that are looked up, and shingles that a part is made for at least.
PARTS, PART_SIZE = 24, 3
#: Sets of at most so many shingles are looked up by single rare shingles: beyond, there are 24 parts.
SMALL = 108
#: Sets of so few shingles have fingerprints that tell too little; all their candidates are compared.
SPARSE = 32
#: Hashes that a text's sample of its shingle set holds: the smallest ones; exact for smaller sets. An estimate from
#: samples decides beyond ``CLEAR`` (eight standard errors) of the similarity asked for only.
SAMPLE, CLEAR = 4096, 0.05
#: Hashes that a slice of a whole set holds on average.
SLICE_HASHES = 1024
#: Bits that fingerprints of similar texts may differ in: five deviations over the mean at 0.8.
LOOSE_TAU, LOOSE_SEGMENTS, LOOSE_CHAIN = 24, 8, 5
#: Rows of a candidate group that are compared with as many others at once.
BLOCK_ROWS = 2048
#: Bins of a sketch: the smallest hash of each, as a byte. Sketches prune pairs that are this many deviations under the similarity asked for.
BINS, DEVIATIONS = 128, 5


def part_keys(h: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(part, hash) of the looked-up parts of a set of distinct shingle hashes.

    A shingle belongs to part ``hash mod 2 ** level``; the level follows from the set's size, and a size near
    a border uses both levels, so sets within ``similarity`` of each other share one. Parts without a
    difference are equal. Sets of at most ``SMALL`` shingles have too few parts for that and get none.
    """
    if len(h) <= SMALL:
        return []
    x = np.log2(max(len(h) / PART_SIZE, 1))
    slack = -np.log2(similarity) / 2 + 0.01
    out = []
    for level in {max(0, int(np.floor(x - slack))), max(0, int(np.floor(x + slack)))}:
        part = (h & np.uint64((1 << level) - 1)).astype(np.int64)
        few = part < PARTS
        value, count = np.zeros(PARTS, np.uint64), np.bincount(part[few], minlength=PARTS)
        np.add.at(value, part[few], mix64(h[few]))
        out += [(level * PARTS + int(i), int(value[i].view(np.int64))) for i in np.flatnonzero(count)]
    return out


def sketch(h: np.ndarray) -> bytes:
    """A byte for the smallest hash of each bin of a sorted set, 0 for an empty one."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(h >> np.uint64(57), return_index=True)
    out[bins.astype(np.int64)] = (mix64(h[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def sketches_reach(one: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the share of equal bins, of those that are filled in either sketch, is in reach of a similarity."""
    filled = ((others > 0) | (one > 0)).sum(axis=1)
    equal = ((others == one) & (one > 0)).sum(axis=1)
    return equal >= filled * similarity - DEVIATIONS * np.sqrt(filled * similarity * (1 - similarity))


_PARTS = pa.list_(pa.struct([("part", pa.int32()), ("value", pa.int64())]))
_SIG = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("sample", pa.binary()), ("parts", _PARTS), ("small", pa.list_(pa.int64()))])
_SIG_SQL = "doc_id long, fp long, n long, sketch binary, sample binary, parts array<struct<part:int,value:long>>, small array<long>"


def prefix_keys(sig: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, part -2, value): of each set in ``small`` the first n - ceil(similarity * n) + 1 shingles, rarest first, that
    another set has too. Two sets within ``similarity`` share one of these, whatever their size."""
    rows = sig.select("doc_id", F.size("small").alias("n"), F.explode("small").alias("value"))
    often = stored(rows.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-often")
    ranked = rows.join(often, "value").groupBy("doc_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "value"))).alias("x"))
    # shingles of one set alone come first, and need no key
    keep = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1 - (F.col("n") - F.size("x"))
    return ranked.where(keep > 0).select("doc_id", F.explode(F.slice("x", F.lit(1), keep)).alias("x")).select("doc_id", F.lit(-2).alias("part"), "x.value")


def sample_similarity(a: bytes, b: bytes, n_a: int, n_b: int) -> float:
    """Jaccard similarity of two shingle sets from their samples: exact if both hold the whole set."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) and not len(y):
        return 1.0
    both = np.union1d(x, y)
    if n_a > SAMPLE or n_b > SAMPLE:
        both = both[:SAMPLE]
    shared = np.intersect1d(x, y)
    return float(np.isin(shared, both).sum() / max(1, len(both)))


def whole_sets_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """``sample_similarity`` of samples that hold the whole sets."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def similar_pairs(pairs: DataFrame, sig: DataFrame, base: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar to ``similarity`` or more."""

    @releasing
    def verify(batches):
        for b in slices(batches, 500):
            a, c, x, y, n, m = (b.column(i).to_pylist() for i in range(6))
            like = np.array([sample_similarity(*v) for v in zip(x, y, n, m, strict=True)])
            slack = np.where(np.maximum(n, m) > SAMPLE, CLEAR, 0.0)
            out = pa.record_batch([a, c, np.maximum(n, m).astype(np.int64), like >= similarity + slack], names=["a", "b", "n", "sure"])
            yield out.filter(pa.array(like >= similarity - slack, pa.bool_()))

    # only the samples of texts that are in a pair are shuffled
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = with_ids(sig.select("doc_id", "n", "sample"), ids, "doc_id")
    left, right = (wanted.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "sample"))) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sample_a", "sample_b", "n_a", "n_b")
    found = stored(both.mapInArrow(verify, "a long, b long, n long, sure boolean"), "near-verified")
    sure, open_ = found.where("sure").select("a", "b"), found.where("NOT sure")
    most = open_.agg(F.max("n")).first()[0]
    return sure if most is None else sure.unionByName(whole_similar(open_.select("a", "b").distinct(), base, most, width, similarity))


def whole_similar(pairs: DataFrame, base: DataFrame, most: int, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets of 64-bit hashes, of at most ``most``, are similar to ``similarity`` or more. Sets are cut
    in slices by their hashes' first bits, so that no row grows with its text."""
    bits = max(1, int(np.ceil(np.log2(most / SLICE_HASHES))))

    @releasing
    def run(batches):
        for b in slices(batches, 20):
            for i, key, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                h = np.unique(shingle_hashes(t or "", width))
                part, at = np.unique(h >> np.uint64(64 - bits), return_index=True)
                hashes = [x.tobytes() for x in np.split(h, at[1:])] if len(h) else []
                yield pa.record_batch([pa.array([x] * len(part), pa.int64()) for x in (i, key, len(h))] + [pa.array(part.astype(np.int64)), pa.array(hashes, pa.binary())], names=["doc_id", "key", "n", "slice", "hashes"])

    @releasing
    def common(batches):
        for b in batches:
            n = [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(b.column(6), b.column(7), strict=True)]
            yield pa.record_batch([*(b.column(c) for c in range(6)), pa.array(n, pa.int64())], names=["a", "b", "key_a", "key_b", "n_a", "n_b", "shared"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = with_ids(base, ids, "doc_id").toDF("doc_id", "text").select("doc_id", F.xxhash64("text"), "text")
    cut = stored(texts.mapInArrow(run, "doc_id long, key long, n long, slice long, hashes binary"), "near-slices").dropDuplicates(["doc_id", "key", "slice"])
    left, right = (cut.select(F.col("doc_id").alias(c), "slice", *(F.col(x).alias(f"{x}_{c}") for x in ("key", "n", "hashes"))) for c in "ab")
    both = pairs.join(left, "a").join(right, ["b", "slice"]).select("a", "b", "key_a", "key_b", "n_a", "n_b", "hashes_a", "hashes_b")
    shared = both.mapInArrow(common, "a long, b long, key_a long, key_b long, n_a long, n_b long, shared long")
    total = shared.groupBy("a", "b", "key_a", "key_b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return total.where(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")) >= similarity).select("a", "b").distinct()


_JUDGED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("sure", pa.bool_())])


def _unlinked_of_sorted(batches, similarity: float):
    """Rows (part, value, lo, hi, block, doc_id, fp, root, n, sketch, sample) sorted by the first four: links between rows of a group, one of block
    ``lo`` and one of ``hi``, with different roots, and with sizes, fingerprints and sketches in reach. A link between two roots
    unites them for the rest of the group, so links span a group and are no more than its rows. Pairs of texts beyond ``SAMPLE`` shingles
    that the samples do not decide are given as not sure. The ring lets all of these through."""

    def links(cols, sketches, samples):
        lo, hi, block, doc, fp, root, n = cols[2:]
        at = np.r_[0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols[:4]], axis=0)) + 1, len(doc)]
        found: list[tuple[int, int, int, bool]] = []

        def look(one, other, up):
            size = np.minimum(n[other], n[one])
            open_ = (root[other] != root[one]) & (size >= similarity * np.maximum(n[other], n[one]) - 1e-6)
            hit = other[open_ & ((size <= SPARSE) | (np.bitwise_count((fp[other] ^ fp[one]).view(np.uint64)) <= LOOSE_TAU))]
            if not len(hit):
                return
            hit = hit[(np.minimum(n[hit], n[one]) <= SPARSE) | sketches_reach(sketches[one], sketches[hit], similarity)]

            def top(r):
                while r in up:
                    r = up[r]
                return r

            mine, x = int(root[one]), np.frombuffer(samples[one], np.uint32)
            for j, theirs in zip(hit.tolist(), root[hit].tolist(), strict=True):
                p, q = top(mine), top(theirs)
                if p == q:
                    continue
                most = int(max(n[one], n[j]))
                whole = most <= SAMPLE
                like = whole_sets_similarity(x, np.frombuffer(samples[j], np.uint32)) if whole else sample_similarity(samples[one], samples[j], int(n[one]), int(n[j]))
                if like >= similarity + (0.0 if whole else CLEAR):
                    up[max(p, q)] = min(p, q)
                    found.append((min(doc[one], doc[j]), max(doc[one], doc[j]), most, True))
                elif not whole and like >= similarity - CLEAR:
                    found.append((min(doc[one], doc[j]), max(doc[one], doc[j]), most, False))

        for s, e in zip(at, at[1:], strict=False):
            # rows of the commonest root differ in root from the others only: the others are compared with all
            roots, counts = np.unique(root[s:e], return_counts=True)
            common, up = roots[np.argmax(counts)], {}
            x = s + np.flatnonzero(block[s:e] == lo[s])
            if lo[s] == hi[s]:
                rest, most = x[root[x] != common], x[root[x] == common]
                for k, one in enumerate(rest):
                    look(one, np.r_[most, rest[k + 1 :]], up)
            else:
                y = s + np.flatnonzero(block[s:e] == hi[s])
                most = x[root[x] == common]
                for one in x[root[x] != common]:
                    look(one, y, up)
                for one in y[root[y] != common]:
                    look(one, most, up)
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.record_batch([pa.array([int(v) for v in c], pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.bool_())], schema=_JUDGED)

    keep, held, kept_samples = [np.zeros(0, np.int64)] * 9, np.zeros((0, BINS), np.uint8), []
    for batch in batches:
        cols = [np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(keep)]
        held = np.concatenate([held, np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint8).reshape(-1, BINS)])
        kept_samples += batch.column(10).to_pylist()
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols[:4]], axis=0)) if len(cols[0]) else []
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield links([x[:cut] for x in cols], held[:cut], kept_samples[:cut])
        keep, held, kept_samples = [x[cut:] for x in cols], held[cut:], kept_samples[cut:]
    if len(keep[0]):
        yield links(keep, held, kept_samples)


def more_links(shared: DataFrame, sig: DataFrame, parts: DataFrame, base: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between rows that share a part and are in different components of ``parts`` (node, root). Groups of one component are
    done; of the others blocks of rows are compared with blocks, each pair of blocks on its own."""
    rooted = shared.select("part", "value", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rooted = stored(rooted, "near-rooted")
    left = rooted.groupBy("part", "value").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count(F.lit(1)).alias("c")).where("first != last")
    blocks = F.ceil(F.col("c") / BLOCK_ROWS).cast("long")
    rows = rooted.join(left.select("part", "value", blocks.alias("blocks")), ["part", "value"]).join(sig.select("doc_id", "fp", "n", "sketch", "sample"), "doc_id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(F.col("part").cast("long"), "value", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "fp", "root", "n", "sketch", "sample")
    group = ["part", "value", "lo", "hi"]
    judged = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(releasing(lambda it: _unlinked_of_sorted(it, similarity)), "a long, b long, n long, sure boolean")
    judged = stored(judged, "near-unlinked")
    sure, open_ = judged.where("sure").select("a", "b").distinct(), judged.where("NOT sure")
    most = open_.agg(F.max("n")).first()[0]
    return sure if most is None else sure.unionByName(whole_similar(open_.select("a", "b").distinct(), base, most, width, similarity))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id of every document that is like another one: the components of documents whose sets of
    ``width``-word shingles are similar to ``similarity`` or more, and the smallest id of each.

    A 64-bit fingerprint cannot be indexed at the distance that belongs to 0.8, so candidates share a part of
    the shingle set instead; the ring of the fingerprint's segments prunes them before the sets are compared. In
    each group of candidates all are compared with its hub, the text with most shared parts, and with its
    smallest id; then all pairs of a group that this has not connected are. Null ids take no part; texts without a word are alike.
    """

    @releasing
    def run(batches):
        for b in slices(batches, 500):
            rows = []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t or "", width))
                sample = np.sort(np.unique((mix64(h) >> np.uint64(32)).astype(np.uint32)))[:SAMPLE]
                small = h.view(np.int64).tolist() if len(h) * similarity <= SMALL else []
                rows.append((np.uint64(simhash(h)).view(np.int64), len(h), sketch(h), sample.tobytes(), [{"part": p, "value": v} for p, v in (part_keys(h, similarity) if len(h) else [(-1, 0)])], small))
            yield pa.record_batch([b.column(0), *(list(c) for c in zip(*rows, strict=True))] if rows else [b.column(0), *[[]] * 6], schema=_SIG)

    base = few_tasks(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_col).where("doc_id IS NOT NULL")
    sig = stored(base.mapInArrow(run, _SIG_SQL), "near-signatures")
    keys = sig.select("doc_id", F.explode("parts").alias("x")).select("doc_id", "x.part", "x.value").unionByName(prefix_keys(sig, similarity))
    shared = stored(keys.join(keys.groupBy("part", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), ["part", "value"]), "near-shared")
    score = shared.groupBy("doc_id").agg(F.sum("c").alias("score"))
    scored = shared.select("doc_id", "part", "value").join(score, "doc_id")
    hubs = scored.groupBy("part", "value").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("hub"), F.min("doc_id").alias("least"))
    pairs = scored.join(hubs, ["part", "value"]).select(F.explode(F.array_distinct(F.array(-F.col("hub.d"), "least"))).alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct()
    left, right = (sig.select(F.col("doc_id").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    pruned = pairs.join(left, "a").join(right, "b")

    @releasing
    def ring(batches):
        for b in batches:
            x = (b.column(2).to_numpy() ^ b.column(3).to_numpy()).view(np.uint64)
            yield b.filter(pa.array(ring_near(x, LOOSE_SEGMENTS, LOOSE_TAU, LOOSE_CHAIN) | (b.column(4).to_numpy() <= SPARSE)))

    pruned = pruned.select("a", "b", "fp_a", "fp_b", F.least("n_a", "n_b").alias("n"))
    pruned = stored(pruned.mapInArrow(ring, "a long, b long, fp_a long, fp_b long, n long").select("a", "b"), "near-pairs")

    links = similar_pairs(pruned, sig, base, width, similarity)
    parts = stored(connected_components(links), "near-parts")
    more = more_links(shared, sig, parts, base, width, similarity)
    known = parts.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected_components(known.unionByName(more)).select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, and all others, with all columns."""
    found = near_duplicates(docs, width, similarity, id_col, text_col)
    return without_ids(docs, stored(found.where("doc_id != keep_id").select("doc_id"), "near-dropped"), id_col)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
