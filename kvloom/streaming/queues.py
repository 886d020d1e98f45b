"""Replication and job queues, and their streaming form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.functions import clocks, scalars

#: Priorities of queue entries, highest first served.
REAL_TIME, FULL_SYNC, FOLD = 3, 2, 1
KINDS = ("any", "bucketname", "bucketprefix", "buckettype", "block_rtq")


@dataclass(frozen=True)
class QueueDefinition:
    name: str
    kind: str
    value: str | None = None
    suspended: bool = False


def parse_definitions(text: str) -> list[QueueDefinition]:
    """``name:kind[.value]`` between bars; what is malformed is left out."""
    out = []
    for part in text.split("|"):
        name, colon, rule = part.partition(":")
        kind, dot, value = rule.partition(".")
        bare = kind in ("any", "block_rtq") and not dot
        if colon and name and (bare or (kind in KINDS and kind not in ("any", "block_rtq") and dot and value)):
            out.append(QueueDefinition(name, kind, value or None))
    return out


def accepts(q: QueueDefinition, bucket: Column, bucket_type: Column, priority: Column | None = None) -> Column:
    """Whether a queue takes an entry. A name matches typed and untyped buckets; a blocking queue takes nothing in real time."""
    if q.suspended:
        return F.lit(False)
    if q.kind == "bucketname":
        return bucket == q.value
    if q.kind == "bucketprefix":
        return bucket.startswith(q.value)
    if q.kind == "buckettype":
        return F.coalesce(bucket_type == q.value, F.lit(False))
    if q.kind == "block_rtq":
        return F.lit(True) if priority is None else priority != REAL_TIME
    return F.lit(True)


def routed(entries: DataFrame, queues: Sequence[QueueDefinition]) -> DataFrame:
    """A row for each queue that takes an entry, with its ``queue``; works on streams."""
    names = F.filter(F.array(*[F.when(accepts(q, F.col("bucket"), F.col("bucket_type"), F.col("priority")), q.name) for q in queues]), lambda n: n.isNotNull())
    return entries.withColumn("queue", F.explode(names))


def drained(entries: DataFrame, n: int, key: Sequence[str] = ("queue",)) -> DataFrame:
    """The first ``n`` entries of each queue: high priorities first, each in order of arrival."""
    first = W.partitionBy(*key).orderBy(F.desc("priority"), "seq")
    return entries.withColumn("position", F.row_number().over(first)).filter(F.col("position") <= n)


def limited(entries: DataFrame, object_limit: int, queue_limit: int) -> DataFrame:
    """Entries by arrival: past the object limit a reference goes in place of the value; past the queue's limit those in real time are dropped.

    Only where the limits fall is looked up, in the first entries of each queue and priority; no queue is sorted or gathered as a whole.
    """
    held = _upto(_upto(entries, object_limit, "_objects"), queue_limit, "_queue")
    held = held.filter((F.col("seq") <= F.col("_queue")) | (F.col("priority") != REAL_TIME) | F.col("_queue").isNull())
    past = F.coalesce(F.col("seq") > F.col("_objects"), F.lit(False))
    return held.withColumn("to_fetch", past).withColumn("value", F.when(~past, F.col("value"))).drop("_objects", "_queue")


def _upto(entries: DataFrame, limit: int, name: str) -> DataFrame:
    """With ``name``: the seq of the ``limit``-th entry of a queue and priority, null where it has no more than these. Partitions send ``limit`` rows each."""
    first = W.partitionBy("queue", "priority").orderBy("seq")
    at = entries.select("queue", "priority", "seq").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit + 1)
    at = at.groupBy("queue", "priority").agg(F.max(F.when(F.col("_n") <= limit, F.col("seq"))).alias(name), F.max("_n").alias("_n")).filter(F.col("_n") > limit).drop("_n")
    return entries.join(F.broadcast(at), ["queue", "priority"], "left")


def overflowed(entries: DataFrame, limit: int) -> DataFrame:
    """Entries with ``on_disk``: those that arrived after a queue and priority had ``limit`` in memory."""
    return _upto(entries, limit, "_held").withColumn("on_disk", F.coalesce(F.col("seq") > F.col("_held"), F.lit(False))).drop("_held")


def pushed(keys: DataFrame, queue: str, priority: int = FULL_SYNC, start: int = 0) -> DataFrame:
    """Entries that put a list of (bucket_type, bucket, key, clock) on a queue, references without values, in order of the keys."""
    nth = F.row_number().over(W.orderBy("bucket_type", "bucket", "key"))  # a pushed list is one request's
    return keys.select("bucket_type", "bucket", "key", (nth + F.lit(start)).cast("bigint").alias("seq"), F.lit(priority).alias("priority"), F.lit(queue).alias("queue"), F.lit(True).alias("to_fetch"))


def popped(entries: DataFrame, queue: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The next ``n`` entries of a queue, and the queue without them."""
    mine = entries.filter(F.col("queue") == queue)
    first = mine.orderBy(F.desc("priority"), "seq").limit(n)
    return first, entries.join(F.broadcast(first.select("queue", "priority", "seq")), ["queue", "priority", "seq"], "left_anti")


def pulled(queued: DataFrame, objects: DataFrame) -> DataFrame:
    """Entries as a sink's workers apply them: references get the object stored now, and drop out where there is none."""
    whole = queued.filter(~F.col("to_fetch"))
    wanted = queued.filter("to_fetch").drop("value").join(objects.select("bucket", "key", "value"), ["bucket", "key"])
    return whole.unionByName(wanted.select(*whole.columns))


def lengths(entries: DataFrame) -> DataFrame:
    return entries.groupBy("queue", "priority").agg(F.count("*").alias("length"))


def newest_wins(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A table after a batch of changes: of each key the greatest (ts, value)."""
    rows = state.unionByName(changes.select(*state.columns))
    best = F.max_by(F.struct(*[c for c in state.columns if c not in ("bucket", "key")]), F.struct("ts", "value"))
    return rows.groupBy("bucket", "key").agg(best.alias("b")).select("bucket", "key", "b.*").select(*state.columns)


def sink(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands each micro-batch to ``apply(batch, id)``, which must bear to see a batch again."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def distinct_buckets(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each bucket once over the life of a stream."""
    return (stream if watermark is None else stream.withWatermark("ts", watermark)).dropDuplicates(["bucket"])


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    return stream.groupBy(column).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ full synchronisation

WORK = {"all": None, "day": 86_400, "hour": 3_600}


def work_range(item: str, now: int, last_range: tuple[int, int] | None = None) -> tuple[int, int] | None:
    """Modification times that a work item looks at: none for all and for no check."""
    if item == "range":
        return last_range
    return None if WORK.get(item) is None else (now - WORK[item], now)


def auto_check(has_range: bool, succeeded: bool, in_window: bool, drop_next: bool, peer: str = "disabled") -> str:
    """Which check comes next."""
    if has_range or succeeded:
        return "range"
    if drop_next and peer == "disabled":
        return "no"
    return "all" if in_window else "day"


def next_check(has_range: Column, succeeded: Column, in_window: Column, drop_next: Column, peer: Column) -> Column:
    """``auto_check`` over columns."""
    return F.when(has_range | succeeded, "range").when(drop_next & (peer == "disabled"), "no").when(in_window, "all").otherwise("day")


def narrowed(summary: DataFrame, target: int) -> DataFrame:
    """``next_range`` of a table (bucket, repairs, low, high): one row or none."""
    all_ = summary.agg(F.sum("repairs").alias("repairs"), F.count("*").alias("n"), F.min("bucket").alias("one"), F.min("low").alias("low"), F.max("high").alias("high"))
    return all_.filter(F.col("repairs") > target).select(F.when(F.col("n") == 1, F.col("one")).otherwise("all").alias("bucket"), "low", "high")


def repair_filter(repairs: DataFrame, most: int, key_range: bool = False) -> DataFrame:
    """(kind, bucket, low_key, high_key, low, high): the filter of the next exchange, from repairs (bucket, key, last_mod).

    The bucket with most repairs, if these are over two thirds of ``most``; else all buckets, if all repairs are over a third; else nothing. Times are
    epoch seconds, a second wider on both sides.
    """
    seconds = scalars.epoch(F.col("last_mod"))
    by = repairs.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low_key"), F.max("key").alias("high_key"), F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    top = F.max(F.struct("n", "bucket", "low_key", "high_key", "low", "high"))
    found = by.agg(top.alias("top"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    third = most // 3
    own = F.col("top.n") > 2 * third
    none = F.lit(None).cast("string")
    rows = found.filter(own | (F.col("n") > third))
    keys = [F.when(own, F.col(f"top.{c}")).otherwise(none).alias(c) if key_range else none.alias(c) for c in ("low_key", "high_key")]
    return rows.select(F.when(own, "bucket").otherwise("modtime").alias("kind"), F.when(own, F.col("top.bucket")).alias("bucket"), *keys, (F.when(own, F.col("top.low")).otherwise(F.col("low")) - 1).alias("low"), (F.when(own, F.col("top.high")).otherwise(F.col("high")) + 1).alias("high"))


def in_window(hour: Column, low: int, high: int) -> Column:
    """Whether full checks may run at an hour; a window may pass midnight."""
    return (hour >= low) & (hour <= high) if low <= high else (hour >= low) | (hour <= high)


def next_range(summary: list[tuple[str, int, object, object]], target: int, full: bool = True) -> dict | None:
    """The range that the next check is narrowed to, from (bucket, repairs, low, high): only past ``target`` repairs."""
    total = sum(n for _, n, _, _ in summary)
    if total == 0:
        return {"suppress": True} if full else None
    if total <= target:
        return None
    return {"bucket": summary[0][0] if len(summary) == 1 else "all", "low": min(x[2] for x in summary), "high": max(x[3] for x in summary)}


def analyse_repairs(counts: list[tuple[str, int]], most: int) -> tuple[str, str | None]:
    """Where a tree's repairs come from: one bucket with over two thirds of the most, else a span of time past one third, else nowhere."""
    third = most // 3
    if not counts:
        return "none", None
    bucket, n = max(counts, key=lambda c: (c[1], c[0]))
    if n > 2 * third:
        return "bucket", bucket
    return ("modtime", None) if sum(c for _, c in counts) > third else ("none", None)


def slices(items: dict[str, int], seconds: int = 86_400, slot: int = 0, slots: int = 1) -> list[tuple[int, str]]:
    """(start, item) of a day's work: items of each kind spread evenly over equal slots.

    Nodes that share the work start at different times of a slot: the ``slot``-th of ``slots``.
    """
    total = sum(items.values())
    if not total:
        return []
    due = sorted(((2 * i + 1) / (2 * n), name) for name, n in items.items() for i in range(n))
    return [(round((k + slot / slots) * seconds / total), name) for k, (_, name) in enumerate(due)]


# ------------------------------------------------------------------ job queues and change feeds

def erasable(queued: DataFrame, objects: DataFrame) -> DataFrame:
    """Queued erases (bucket, key, clock text) that may go ahead: the object's clock is still the one seen."""
    now = objects.select("bucket", "key", clocks.text(F.col("clock")).alias("clock"))
    return queued.join(now, ["bucket", "key", "clock"], "left_semi")


def redo(queued: DataFrame, done: DataFrame) -> DataFrame:
    """What is left of a queue after those done, in order."""
    return queued.join(done.select("bucket", "key"), ["bucket", "key"], "left_anti")


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket, key, change) between two versions of a store: put, update or delete."""
    a = before.select("bucket", "key", clocks.text(F.col("clock")).alias("ca"))
    b = after.select("bucket", "key", clocks.text(F.col("clock")).alias("cb"))
    change = F.when(F.col("ca").isNull(), "put").when(F.col("cb").isNull(), "delete").when(F.col("ca") != F.col("cb"), "update")
    return a.join(b, ["bucket", "key"], "full_outer").select("bucket", "key", change.alias("change")).filter("change is not null")


def metrics(events: DataFrame, by: Sequence[str], value: str, every: str | None = None) -> DataFrame:
    """Count, mean, median, 95th and 99th percentile and maximum, by groups and spans of time."""
    keys = [*by, *([F.window("ts", every).alias("window")] if every else [])]
    at = lambda q: F.percentile(value, F.lit(q))
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("highest"))
