"""Sharding by sampled splitters: shards of near equal bytes.

Rows are ordered by a hash of their text, so equal texts stand together. A sample of rows, drawn in proportion to their size, gives the boundaries of
many small ranges; exact sizes of the ranges follow from one aggregation. A text whose copies weigh more than a twentieth of a shard overfills its
range: its rows are subdivided by a hash of their id. A lighter text of very many rows stays whole, but its rows are counted in parts. Each group of equal texts goes, whole unless it was subdivided, to the shard in which the
middle of its bytes falls, so shards differ by a twentieth at most where single texts are small against a shard. No step gathers more than one
range's narrow rows in a task, and the driver holds one number a range.

Defined results: a null text has no bytes, size 8 and the checksum of an empty text; rows equal in id and text may swap slots; an empty table gives an
empty result; only the named id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.llm.common import cut

SHARDS = 24
WHOLE = 1 / 20
#: Ranges a shard at least, rows a range about, sampled keys a range, ranges in all at most.
RANGES, ROWS_EACH, SAMPLES, MOST = 64, 100_000, 8, 200_000


def shards(docs: DataFrame, n: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body, F.crc32(body)).alias("_key")), "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(1)), F.count("*")).first()
    ranges = min(MOST, n * max(RANGES, -(-count // (n * ROWS_EACH))))
    each = total / (ranges * SAMPLES)
    sample = rows.filter(F.rand(20_11) < F.col("size") / F.lit(each)).select("_key", "size").toPandas()
    sample = sample.sort_values(["_key", "size"])
    reached = np.cumsum(np.maximum(sample["size"].to_numpy(np.float64), each))
    keys = sample["_key"].to_numpy(np.int64)
    at = np.searchsorted(reached, np.arange(1, ranges) * (reached[-1] / ranges if len(reached) else 1))
    bounds = np.unique(keys[np.minimum(at, len(keys) - 1)]) if len(keys) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), "right").astype(np.int32))

    placed = cut(rows.withColumn("_range", range_of("_key")), "ranges")
    # overfull ranges: the texts that weigh most in them are subdivided; there are at most 20 n of these
    whole = max(1.0, WHOLE * total / n)
    over = (F.col("bytes") > F.lit(whole)) | (F.col("n") > ROWS_EACH)
    by_range = placed.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter(over).select("_range")
    heavy = placed.join(F.broadcast(by_range), "_range").groupBy("_range", "_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter(over)
    parts = F.greatest(F.lit(2), F.ceil(F.col("bytes") / F.lit(total / ranges)), F.ceil(F.col("n") / ROWS_EACH)).cast("long")
    heavy = cut(heavy.select("_key", parts.alias("_parts"), (F.col("bytes") > F.lit(whole)).alias("_divided")), "heavy")  # a row a hundred thousand rows at most, and 20 n
    placed = placed.join(F.broadcast(heavy), "_key", "left")
    # a heavy text cuts its range: what is below it, its own parts, what is above it
    split = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("_parts")) + 1).otherwise(F.lit(0))
    cuts = np.array(sorted(r["_key"] for r in heavy.collect()), np.int64)

    @F.pandas_udf("int")
    def cut_of(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        return pd.Series((np.searchsorted(cuts, k, "left") + np.searchsorted(cuts, k, "right")).astype(np.int32))

    placed = placed.withColumn("_cell", F.struct("_range", cut_of("_key").alias("c"), split.cast("long").alias("s")))
    within = W.partitionBy("_cell").orderBy("_key", "doc_id", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = placed.groupBy("_cell").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    table = sorted((tuple(r["_cell"]), r["b"], r["n"]) for r in cells.collect())  # a row a range and heavy part
    starts_b = np.concatenate([[0], np.cumsum([b for _, b, _ in table])]).tolist()
    starts_n = np.concatenate([[0], np.cumsum([k for _, _, k in table])]).tolist()
    group: dict[tuple[int, int], list[int]] = {}  # where a heavy text begins and what it weighs
    for i, ((r, c, _), b, _) in enumerate(table):
        group.setdefault((r, c), [starts_b[i], 0])[1] += b
    offsets = spark.createDataFrame([(*c, starts_b[i], starts_n[i], *group[c[:2]]) for i, (c, _, _) in enumerate(table)], "_range int, c int, s long, _b long, _n long, _gb long, _gw long")
    placed = placed.withColumn("_run", F.sum("size").over(within)).withColumn("_nth", F.row_number().over(within))
    same = W.partitionBy("_cell", "_key")
    alone = F.col("_divided")
    begin = F.when(alone, F.col("_run") - F.col("size")).otherwise(F.min(F.col("_run") - F.col("size")).over(same))
    weight = F.when(alone, F.col("size")).otherwise(F.sum("size").over(same))
    placed = placed.withColumn("_middle", begin + weight / 2).select("*", "_cell.c", "_cell.s")
    out = placed.join(F.broadcast(offsets), ["_range", "c", "s"])
    middle = F.when(F.col("_divided") == F.lit(False), F.col("_gb") + F.col("_gw") / 2).otherwise(F.col("_b") + F.col("_middle"))
    out = out.withColumn("shard", F.least(F.lit(n - 1), F.floor(middle * F.lit(n) / F.lit(total))).cast("int")).withColumn("_place", F.col("_n") + F.col("_nth") - 1)
    out = cut(out.select("doc_id", "size", "text_crc32", "shard", "_place"), "shards")
    first = out.groupBy("shard").agg(F.min("_place").alias("_first"))
    out = out.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
