"""Corpus pipeline: toxic documents go, one document of each near-duplicate class stays, repeated passages are cut, sources are mixed, sequences packed.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``docs``. No SQL twin exists: models, signatures and the
packing are not SQL expressible; stages are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvloom.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from kvloom.llm.common import cut, table

ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of toxicity. The model learns from the labels of the whole table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document of the least id."""
    return near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of passages that stand elsewhere too."""
    return suffix_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix."""
    return mixing.ordered(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences, which follow the mix: positions depend on the rows only, so they are found again."""
    return packing.pack(docs, order=mixing.positions(docs))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("suffix_dedup", repeated_passages), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
