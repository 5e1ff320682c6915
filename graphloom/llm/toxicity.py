"""Operator 10, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows (parameter ``sample``): document counts of hashed n-grams by
class give the log-count ratios, the ``features`` n-grams that speak most for toxicity are kept, and logistic
regression is fitted over presence times ratio. Scoring reads every whole text, without a
shuffle; the model is a table of fixed size.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import few_tasks, release_memory, releasing, slices, table

SIZES = (3, 4, 5, 6, 7)
BITS = 20
#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of the id.
SAMPLE = 12_000
FEATURES = 10_000
THRESHOLD = 0.3
_WHITE = re.compile(rb"[\x00-\x20]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_blocks(text: str, most: int = 1 << 18):
    """Hashed n-grams of the lower-cased UTF-8 bytes, white space folded, in blocks of bounded size."""
    raw = np.frombuffer(_WHITE.sub(b" ", b" " + text.lower().encode() + b" "), np.uint8)
    for at in range(0, len(raw), most):
        b = raw[at : at + most + SIZES[-1] - 1].astype(np.uint64) + np.uint64(1)
        h = b.copy()
        for n in range(2, SIZES[-1] + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * _STEP + b[n - 1 :]
            if n in SIZES:
                x = h[:most]
                x = (x ^ (x >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
                yield (x >> np.uint64(64 - BITS)).astype(np.int32)


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct features of a text; only those marked in ``wanted`` if it is given."""
    found = [x if wanted is None else x[wanted[x]] for x in ngram_blocks(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.used = self.weights != 0

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[present(text, self.used)].sum())
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


_COUNTS = pa.schema([("part", pa.int32()), ("pos", pa.binary()), ("neg", pa.binary())])
_PART = 1 << 14


@releasing
def _count(batches):
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for b in slices(batches):
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            (pos if y else neg)[present(text)] += 1
    for i in range(0, 1 << BITS, _PART):
        p, n = pos[i : i + _PART], neg[i : i + _PART]
        if p.any() or n.any():
            yield pa.record_batch([[i // _PART], [zlib.compress(p.tobytes(), 1)], [zlib.compress(n.tobytes(), 1)]], schema=_COUNTS)


def _add_counts(pdf):
    import pandas as pd

    out = [sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in pdf[c]) for c in ("pos", "neg")]
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "pos": [out[0].tobytes()], "neg": [out[1].tobytes()]})


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float = 3e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of presence features scaled by ``ratio``; full-batch Adam with fixed steps."""
    if not len(y):
        return np.zeros(len(ratio)), -30.0
    cols = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = ratio[cols]
    w, bias = np.zeros(len(ratio)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, x * w[cols], len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.r_[np.bincount(cols, x * err[at], len(ratio)) + l2 * w / 10, err.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        bias -= step[-1]
    return w * ratio, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The model of labelled rows outside the held-out fold.

    Null ids and labels are not learned from; an id with several labels counts as toxic if
    one is; a table without usable labels gives a model that scores all texts the same.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    ids = chosen.collect()  # at most ``sample`` pairs of numbers
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r[0], r[1]) for r in ids], "doc_id long, y int")
    rows = few_tasks(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")

    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in rows.mapInArrow(_count, "part int, pos binary, neg binary").groupBy("part").applyInPandas(_add_counts, "part int, pos binary, neg binary").toLocalIterator():
        pos[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["pos"], np.int64)
        neg[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["neg"], np.int64)
    n_pos, n_neg = max(1, sum(r[1] for r in ids)), max(1, sum(1 - r[1] for r in ids))
    ratio = np.log(((pos + 1) / (n_pos + 2)) / ((neg + 1) / (n_neg + 2)))
    gain = np.where(pos >= 3, np.maximum(0, ratio) * np.sqrt(pos), 0)  # frequent and telling
    top = np.sort(np.argsort(-gain, kind="stable")[:features])
    top = top[gain[top] > 0]
    place = np.full(1 << BITS, -1, np.int32)
    place[top] = np.arange(len(top))
    wanted = spark.sparkContext.broadcast(place >= 0)

    @releasing
    def sparse(batches):
        for b in slices(batches):
            found = [present(t, wanted.value).tobytes() for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(found, pa.binary()), b.column(1)], names=["x", "y"])

    got = rows.mapInArrow(sparse, "x binary, y int").collect()  # kept features of at most ``sample`` rows
    got.sort()
    x = [place[np.frombuffer(r["x"], np.int32)] for r in got]
    w, bias = fit_logistic(x, np.array([r["y"] for r in got], float), ratio[top])
    weights = np.zeros(1 << BITS, np.float32)
    weights[top] = w
    del pos, neg, ratio, gain, got, x
    release_memory()
    return ToxicityModel(weights, bias)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts get the score of a text without features. Repeated rows and null ids give a row each (a
    null id is not held out); an empty table gives an empty result; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches):
        for b in slices(batches):
            yield pa.record_batch([b.column(0), [known.value.score(t or "") for t in b.column(1).to_pylist()]], schema=_OUT)

    scored = few_tasks(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose whole text scores below ``threshold``, with all columns and without a shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @releasing
    def run(batches):
        for b in slices(batches):
            keep = [known.value.score(t or "") < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return few_tasks(docs).mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
