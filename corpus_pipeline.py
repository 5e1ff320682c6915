"""A training-data pipeline over ``documents``: five stages, each a table of what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import discard, ship, stored, table
from graphloom.llm.decontaminate import without_contaminated
from graphloom.llm.exact_dedup import without_duplicates
from graphloom.llm.pieces import encode_decode
from graphloom.llm.simhash import without_near_duplicates
from graphloom.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles similar to 0.8 or more."""
    ship(spark)
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with a digest of their decoding."""
    import public_tokenizers

    ship(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; every stage before is kept as a table until the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
