"""Links between objects, and the comparison of two stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions import clocks
from kvloom.operators import folds


def fetch(inputs: DataFrame, objects: DataFrame) -> DataFrame:
    """Inputs (bucket, key, ...) with their objects' columns; nulls where nothing is found. Duplicates stay."""
    return inputs.join(objects, ["bucket", "key"], "left")


def links(objects: DataFrame) -> DataFrame:
    """Edges (bucket, key, to_bucket, to_key, tag): of each object's siblings the distinct links, sorted."""
    every = F.array_sort(F.array_distinct(F.flatten(F.transform("siblings", lambda s: s["links"]))))
    each = objects.select("bucket", "key", F.explode(every).alias("l"))
    return each.select("bucket", "key", F.col("l.bucket").alias("to_bucket"), F.col("l.key").alias("to_key"), F.col("l.tag").alias("tag"))


def follow(edges: DataFrame, at: DataFrame, bucket: str = "_", tag: str = "_") -> DataFrame:
    """One step from (bucket, key) along links of a bucket and tag, ``_`` for any: (bucket, key, tag)."""
    step = edges
    if bucket != "_":
        step = step.filter(F.col("to_bucket") == bucket)
    if tag != "_":
        step = step.filter(F.col("tag") == tag)
    return step.join(at.select("bucket", "key"), ["bucket", "key"], "left_semi").select(F.col("to_bucket").alias("bucket"), F.col("to_key").alias("key"), "tag")


def walk(edges: DataFrame, objects: DataFrame, start: DataFrame, steps: Sequence[tuple[str, str, bool | None]]) -> list[DataFrame]:
    """Results of the kept steps (bucket, tag, keep), each the distinct objects reached that exist; the last is kept unless told otherwise."""
    out, at = [], start
    for i, (bucket, tag, keep) in enumerate(steps):
        at = follow(edges, at, bucket, tag).select("bucket", "key")  # what does not exist has no links to follow
        if keep or (keep is None and i == len(steps) - 1):
            out.append(objects.select("bucket", "key").join(at, ["bucket", "key"], "left_semi"))
    return out


def repair_side(source: Column, sink: Column) -> Column:
    """Which side to repair, from two clocks, null where the key is missing: null where they are equal."""
    return F.when(source.isNotNull() & sink.isNotNull() & clocks.equal(source, sink), F.lit(None)).when(sink.isNotNull() & (source.isNull() | clocks.dominates(sink, source)), "sink_repair").otherwise("source_repair")


def compare(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(bucket, key, action) of keys whose clocks differ. ``source_repair`` sends the local object; ``sink_repair`` fetches the remote one."""
    a = local.select("bucket", "key", F.col("clock").alias("ca"))
    b = remote.select("bucket", "key", F.col("clock").alias("cb"))
    return a.join(b, ["bucket", "key"], "full_outer").select("bucket", "key", repair_side(F.col("ca"), F.col("cb")).alias("action")).filter("action is not null")


def exchange(local: DataFrame, remote: DataFrame, scope: folds.Scope) -> DataFrame:
    """(bucket, key, action) by comparing hash trees first, then clocks of keys in differing segments only: a row a segment is joined, not a row a key."""
    differ = folds.tree_diff(folds.tree(local, scope), folds.tree(remote, scope))
    some = lambda k: folds.scoped(k, scope).withColumn("segment", folds.segment_of(scope)).join(F.broadcast(differ) if folds.SEGMENTS[scope.tree_size] <= 1 << 16 else differ, "segment", "left_semi")
    return compare(some(local), some(remote))


def repair_summary(repairs: DataFrame) -> DataFrame:
    """(bucket, repairs, low, high) of repairs (bucket, last_mod)."""
    return repairs.groupBy("bucket").agg(F.count("*").alias("repairs"), F.min("last_mod").alias("low"), F.max("last_mod").alias("high"))
