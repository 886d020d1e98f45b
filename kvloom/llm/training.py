"""Labelled rows for the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import cut, learns, texts_of


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of about ``most`` labelled rows at most, none held out: a hash of the id picks them, alike at every size.

    The picked labels are a bounded table, so they are broadcast and the documents stay where they are.
    """
    known = labels.filter(learns() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = known.count()
    if n > most:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < F.lit((most << 63) // n))
    plain = texts_of(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return cut(plain.join(F.broadcast(known), "doc_id").select("text", F.col("label").cast("int").alias("label")), "labelled")
