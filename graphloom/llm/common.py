"""Helpers that the training-data operators share: scratch tables, Bloom filters, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local sessions without ``spark.checkpoint.dir`` (tests) write here.
LOCAL_SCRATCH = "/tmp/checkpoints"

#: ASCII white space as SQL and Java regular expressions write it.
WS = r"[\x20\x09-\x0D]"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/graphloom-{label}-{uuid.uuid4().hex}"


def few_tasks(df: DataFrame, task_bytes: int = 1 << 26) -> DataFrame:
    """``df`` without needlessly many tasks: as many as its input has blocks of ``task_bytes``, and at least four a core.

    Small splits are then read together, so neither tasks nor the files they write become tiny; a
    large input keeps its splits.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # beyond: not known
    return df.coalesce(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism, size // task_bytes))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends in durable files,
    so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    few_tasks(df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that no later plan reads."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the driver drop the plans that have run: Spark deletes shuffle files when the plan behind them is collected, which
    otherwise waits until the driver's heap fills, while the files of all stages pile up. For use after a ``stored`` table."""
    gc.collect()  # Python's handles of plans
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch: documents are long, and Spark's 10,000 rows of them stand in memory on both sides of the pipe.
#: Fewer rows keep the buffers small that the JVM's pools and the workers hold on to.
BATCH_ROWS, _DEFAULT_ROWS = 250, "10000"


def ship(spark: SparkSession) -> None:
    """Give the package's sources to the executors, once a session: workers import it by name. Batches get ``BATCH_ROWS`` rows where
    the session does not say otherwise."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not getattr(sc, "_graphloom_shipped", False):
        sc._graphloom_shipped = True
        root = Path(__file__).resolve().parent.parent
        at = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_blocks(items, most: int = 1 << 20, size=len):
    """Runs of items of about ``most`` characters; a longer one stands alone."""
    block, n = [], 0
    for x in items:
        if block and n + size(x) > most:
            yield block
            block, n = [], 0
        block.append(x)
        n += size(x)
    if block:
        yield block


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


#: Functions that empty what operators keep in a worker between their tasks (compiled vocabularies, tables), by name.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str):
    """A cache of one value in each worker, which goes when the worker runs a task of an operator that does not keep it."""

    def decorate(f):
        cached = functools.lru_cache(1)(f)
        _KEPT[name] = cached.cache_clear
        return cached

    return decorate


def releasing(f=None, *, keep: str | None = None):
    """A task's map function that gives freed memory back to the system when it ends: Spark keeps its workers for
    later tasks, and what one stage has used would stand beside what the next one uses. Other operators' caches go first."""
    if f is None:
        return functools.partial(releasing, keep=keep)

    @functools.wraps(f)
    def run(batches, *args, **kwargs):
        drop_caches(keep)
        map_large_blocks()
        try:
            yield from f(batches, *args, **kwargs)
        finally:
            release_memory()

    return run


def drop_caches(keep: str | None) -> None:
    for name, clear in _KEPT.items():
        if name != keep:
            clear()


@functools.lru_cache(1)
def map_large_blocks() -> None:
    """Have the C library map blocks from 1 MB on. Left alone it raises that bound with every larger block that is freed, and arrays then
    come from a heap that keeps up to twice the bound and every gap below a block still in use."""
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        libc = ctypes.CDLL("libc.so.6")
        for parameter, value in ((-3, 1 << 20), (-1, 1 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(parameter, value)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---------------------------------------------------------------- Bloom filters


def bloom_shape(n: int, bits_per_key: int, max_bits: int) -> tuple[int, int]:
    """(bits, probes): a power of two of bits, never over ``max_bits``. Beyond the bound the
    filter saturates and lets more keys through; no key is ever missed."""
    want = max(1 << 16, n * bits_per_key)
    bits = min(max_bits, 1 << (want - 1).bit_length())
    return bits, max(1, min(4, round(0.69 * bits / max(1, n))))


def bloom_slots(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k slots of each 64-bit hash, as an array of shape (k, n)."""
    h = h.astype(np.uint64, copy=False)
    step = (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(k, dtype=np.uint64)[:, None]
    return ((h[None, :] + i * step[None, :]) & np.uint64(bits - 1)).astype(np.int64)


def bloom_has(filter_: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    bits = len(filter_) * 8
    slots = bloom_slots(h, bits, k)
    return ((filter_[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=0)


def bloom_add(filter_: np.ndarray, h: np.ndarray, k: int) -> None:
    slots = bloom_slots(h, len(filter_) * 8, k).ravel()
    np.bitwise_or.at(filter_, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))


#: Bytes of one slice of a filter; slices are merged by independent tasks.
SLICE = 1 << 16
_SLICES = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def bloom_pair(hashes: Iterator[np.ndarray], bits: int, k: int) -> Iterator[pa.RecordBatch]:
    """One task's filters of once-seen and twice-seen hashes, as compressed non-empty slices.
    Each array holds a hash at most once per document."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for h in hashes:
        if len(h):
            u, n = np.unique(h, return_counts=True)
            again = (n > 1) | bloom_has(once, u, k)
            if again.any():
                bloom_add(twice, u[again], k)
            bloom_add(once, u, k)
    for i in range(0, len(once), SLICE):
        a, b = once[i : i + SLICE], twice[i : i + SLICE]
        if a.any():
            yield pa.record_batch([[i // SLICE], [zlib.compress(a.tobytes(), 1)], [zlib.compress(b.tobytes(), 1)]], schema=_SLICES)


def _merge_slices(pdf):
    import pandas as pd

    once = twice = None
    for a, b in zip(pdf["once"], pdf["twice"], strict=True):
        a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def merged_filter(slices: DataFrame, bits: int, which: str) -> np.ndarray:
    """The filter of all tasks, on the driver: ``bits`` / 8 bytes, a bound fixed beforehand."""
    out = np.zeros(bits // 8, np.uint8)
    merged = slices.groupBy("slice").applyInPandas(_merge_slices, "slice int, once binary, twice binary")
    for row in merged.select("slice", which).toLocalIterator():
        part = np.frombuffer(zlib.decompress(row[1]), np.uint8)
        out[row[0] * SLICE : row[0] * SLICE + len(part)] = part
    return out


def id_filter(ids: DataFrame, n: int, max_bits: int) -> tuple[np.ndarray, int]:
    """Bloom filter of the single long column of ``ids`` (``n`` rows)."""
    bits, k = bloom_shape(n, 12, max_bits)

    @releasing
    def build(batches):
        yield from bloom_pair((mix64(b.column(0).to_numpy(zero_copy_only=False)) for b in batches), bits, k)

    return merged_filter(ids.mapInArrow(build, "slice int, once binary, twice binary"), bits, "once"), k


def _routes(docs: DataFrame, ids: DataFrame, id_col: str, max_bits: int):
    """(rows that may have an id of the single long column of ``ids``, rows that have none), by a Bloom filter of fixed size."""
    bits, k = id_filter(ids, ids.count(), max_bits)
    known = docs.sparkSession.sparkContext.broadcast(bits)
    at = docs.columns.index(id_col)

    def route(hits: bool):
        @releasing
        def run(batches):
            for b in batches:
                ids_ = b.column(at).cast(pa.int64())
                hit = bloom_has(known.value, mix64(ids_.fill_null(0).to_numpy(zero_copy_only=False)), k) & ids_.is_valid().to_numpy(zero_copy_only=False)
                keep = hit if hits else ~hit
                if keep.any():
                    yield b.filter(pa.array(keep))

        return run

    return docs.mapInArrow(route(True), docs.schema), docs.mapInArrow(route(False), docs.schema)


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``; what a filter rules out is not shuffled."""
    maybe, _ = _routes(docs, ids, id_col, max_bits)
    return maybe.alias("d").join(ids.toDF("id").alias("i"), F.col(f"d.{id_col}") == F.col("i.id"), "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids``; only rows that a filter suspects are shuffled. Null ids pass."""
    maybe, surely = _routes(docs, ids, id_col, max_bits)
    kept = maybe.alias("d").join(ids.toDF("id").alias("i"), F.col(f"d.{id_col}") == F.col("i.id"), "left_anti")
    return few_tasks(surely.unionByName(kept))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over int64/uint64 values."""
    z = x.astype(np.int64, copy=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges``: columns a, b (long). Alternates large-star and small-star steps, each a pair of
    shuffles over the edge list, with every round's edges kept as a shared table. Nothing but a
    count and a checksum of a round comes to the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e, mark = stored(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.min("v")).first()
        if now[0] == 0 or tuple(now) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), e
        discard(old)
