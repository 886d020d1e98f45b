"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of their id, make one stream of bytes, cut into blocks of equal size, the slots' size. In the ideal mix all
sources flow at once, each at its weight's share of those that still have bytes; when a source runs dry, the others go on with their shares scaled up.
A block is released in the slot in which the ideal mix begins it and due at the end of that in which it is complete; the released block that is due
first goes next. No slot stays empty, no document is dropped or repeated, and at any slot, whatever the length, a source is less than one block from the
ideal mix of the weights as they are given (but for rounding of times, under 1e-6 slots). The driver holds a few numbers a block, some 480,000 blocks at
30 GB; slots go to the rows as a table, joined by source and block.

Defined results: documents without a source (null) are a source of their own; a null text has no bytes; an empty source has no blocks; rows equal in
id, source and text may swap places; an empty table gives an empty result; columns with the names of outputs are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import cut, ranked

BLOCK_BYTES = 1 << 16
#: Sources without a target have the least target's share, divided by this.
PERIOD = 1000


def spread(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, np.ndarray]:
    """Each source's slots, block by block."""
    names = sorted((s for s, n in blocks.items() if n > 0), key=lambda s: (s is None, s or ""))
    if not names:
        return {}
    n, w = np.array([blocks[s] for s in names], np.int64), np.array([weights[s] for s in names], float)
    w /= w.sum()
    # a source is dry at n / w of its own time; the slot of a time is what all sources have sent by then
    dry = np.argsort(n / w, kind="stable")
    ends, sent = (n / w)[dry], np.concatenate([[0], np.cumsum(n[dry])])
    flow = np.concatenate([np.cumsum(w[dry][::-1])[::-1], [0.0]])
    which = np.repeat(np.arange(len(n)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def slot(i: np.ndarray) -> np.ndarray:
        time = i / w[which]
        k = np.searchsorted(ends, time, "left")
        exact = sent[k] + time * flow[k]
        near = np.rint(exact)
        return np.where(np.abs(exact - near) < 1e-6, near, exact)

    release, due = np.floor(slot(nth)).astype(np.int64), np.ceil(slot(nth + 1)).astype(np.int64)
    order = np.lexsort((which, due, release))
    out = np.zeros(len(order), np.int64)
    ready: list[tuple[int, int]] = []
    waiting, at = list(zip(release[order].tolist(), due[order].tolist(), order.tolist())), 0
    for t in range(len(waiting)):
        while at < len(waiting) and (waiting[at][0] <= t or not ready):
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        out[heapq.heappop(ready)[1]] = t
    return dict(zip(names, np.split(out, np.cumsum(n)[:-1])))


def schedule(shares: dict[str, int]) -> dict[str, np.ndarray]:
    """Each source's slots in one period of sum(shares) slots."""
    return spread(shares, shares)


def plan(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, list[tuple]]:
    """For each source its one phase: (first block, blocks, share, first slot, period length, slots in the period)."""
    total = sum(n for n in blocks.values() if n > 0)
    return {s: [(0, len(x), len(x), 0, total, x)] for s, x in spread(blocks, weights).items()}


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, source, size, block, slot, rank): a source's documents in the order of rank; all documents in the order of (slot, source, rank).

    ``weights``: target share of each source; by default the square root of its bytes, so that large sources do not drown small ones.
    """
    body = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), body.alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text")), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("b")).toArrow()  # a row a source
    totals = dict(zip(found["source"].to_pylist(), found["b"].to_pylist()))
    wanted = {s: float(b + 1) ** 0.5 for s, b in totals.items()} if weights is None else {s: float(weights.get(s, 0)) for s in totals}
    least = min((w for w in wanted.values() if w > 0), default=1.0)
    wanted = {s: w if w > 0 else least / PERIOD for s, w in wanted.items()}  # sources without a target trickle in
    slots = spread({s: b // block_bytes + 1 for s, b in totals.items()}, wanted)
    sizes = [len(x) for x in slots.values()]
    names = pa.array(list(slots), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    nth = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]])
    table = pa.table({"_source": names, "_block": pa.array(nth, pa.int64()), "slot": pa.array(np.concatenate([np.zeros(0, np.int64), *slots.values()]), pa.int64())})
    plans = cut(rows.sparkSession.createDataFrame(table, "_source string, _block long, slot long"), "plan")
    placed = ranked(rows, ["source"], F.xxhash64("doc_id", F.lit(7)), [F.col("doc_id"), F.col("_text")], "size").withColumn("block", F.expr(f"before div {block_bytes}"))
    out = placed.join(plans, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    return out.select("doc_id", "source", "size", "block", "slot", "rank")


def positions(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, source, slot, rank): a row for each id and source; documents stand in the order of (slot, source, rank)."""
    return mixed(docs, weights, block_bytes=block_bytes).groupBy("doc_id", "source").agg(F.min("slot").alias("slot"), F.min("rank").alias("rank"))


def ordered(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, sorted into the order of the mix; rows equal in id, source and text stand side by side."""
    slots = positions(docs, weights)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["source"].cast("string").alias("name"))
    out = keyed.join(slots, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("name").eqNullSafe(F.col("source")))
    return out.orderBy("slot", F.col("name").asc_nulls_last(), "rank").select("row.*")
