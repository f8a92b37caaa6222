"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Every stage takes null text as empty, reads texts whole whatever their length, keeps
all columns of its input (further ones too, whatever their names) but for the last,
and gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waygraph.llm import exact_dedup, mixing, near_dedup, packing, quality
from waygraph.plans.stages import materialise, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; equal texts stay or go together, ids and other columns do not matter."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, exactly one row of each text, also when ids repeat; null ids rank lowest."""
    return exact_dedup.drop_exact(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest id, exactly one row of each class, also when ids repeat; rows with null ids all stay."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it; null is a source, rows alike share what is taken of them, texts without words go."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens; repeated rows are packed as often as they occur, null ids too."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The classifier, the sampling and the packing are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
