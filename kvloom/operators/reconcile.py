"""Conflict resolution: dominated replicas, sibling merges, writes in order, quorum decisions.

Replicas are rows (bucket, key, clock, siblings); a key has as many as the replication factor, so gathering one key's is bounded.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.functions import clocks

NAME = ["bucket", "key"]


def content_key(s: Column) -> Column:
    """Sorts contents: the latest first, of equal times the live before the deleted, then by value."""
    time = F.coalesce(F.unix_micros(s["last_mod"]), F.lit(-(1 << 62)))
    return F.struct((-time).alias("a"), s["deleted"].alias("b"), s["value"].alias("c"))


def most_recent(siblings: Column) -> Column:
    """The content that a bucket without siblings keeps."""
    return F.element_at(F.array_sort(F.transform(siblings, lambda s: F.struct(content_key(s).alias("k"), s["value"].alias("value"), s["last_mod"].alias("last_mod"), s["deleted"].alias("deleted")))), 1)


def undominated(replicas: Column) -> Column:
    """Of an array of structs with ``clock``, those that no other strictly dominates."""
    return F.filter(replicas, lambda x: ~F.exists(replicas, lambda y: clocks.dominates(y["clock"], x["clock"])))


def remove_dominated(replicas: DataFrame, key: list[str] = NAME) -> DataFrame:
    """Rows of ``replicas`` whose clock no other replica of the key dominates."""
    rest = [c for c in replicas.columns if c not in key]
    held = replicas.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("r")).withColumn("r", undominated(F.col("r")))
    return held.select(*key, F.inline("r"))


def merged_siblings(arrays: Column) -> Column:
    """Sorted, distinct union of siblings that carry no events of their own."""
    return F.array_sort(F.array_distinct(F.flatten(arrays)))


def reconcile(replicas: DataFrame, allow_mult: bool = True, key: list[str] = NAME) -> DataFrame:
    """One row a key: merged clock, and siblings of the replicas that matter, by value; or the most recent alone.

    ``replicas``: key, clock, and value, last_mod, deleted of one content.
    """
    held = replicas.groupBy(*key).agg(F.collect_list(F.struct("clock", "value", "last_mod", "deleted")).alias("r"))
    live = held.withColumn("r", undominated(F.col("r")))
    empty = F.create_map().cast("map<string,bigint>")
    clock = F.aggregate("r", empty, lambda a, x: clocks.merged(a, x["clock"]))
    contents = F.array_distinct(F.transform("r", lambda x: F.struct(x["value"].alias("value"), x["last_mod"].alias("last_mod"), x["deleted"].alias("deleted"))))
    live = live.select(*key, clock.alias("clock"), contents.alias("siblings"))
    if allow_mult:
        return live.withColumn("siblings", F.array_sort("siblings"))
    best = most_recent(F.col("siblings"))
    return live.withColumn("_b", best).select(*key, "clock", F.col("_b.value").alias("value"), F.col("_b.last_mod").alias("last_mod"), F.col("_b.deleted").alias("deleted"))


def newest(rows: DataFrame, key: list[str], last_mod: str, deleted: str, content: str) -> DataFrame:
    """The row a key that the order of contents puts first; partitions cut a key down before its rows meet."""
    first = W.partitionBy(*key).orderBy(F.desc_nulls_last(last_mod), F.asc(deleted), F.asc(content))
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def write_once(rows: DataFrame, key: list[str], body: str) -> DataFrame:
    """Of conflicting immutable values the one of the smaller SHA-1."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.sha1(body)).alias("b")).select(*key, "b.*")


def dotted(replicas: DataFrame, key: list[str] = NAME, syntactic: bool = False) -> DataFrame:
    """Merge replicas whose siblings have events: (key, clock, siblings) from rows (key, clock, siblings array<struct<value,actor,counter>>).

    A sibling stays if every replica holds its event or has not seen it; one that several hold stays once. ``syntactic``: dominated replicas do not count.
    """
    held = replicas.groupBy(*key).agg(F.collect_list(F.struct("clock", "siblings")).alias("r"))
    held = held.withColumn("r", undominated(F.col("r"))) if syntactic else held
    zero = F.lit(0).cast("bigint")

    def stays(s: Column) -> Column:
        holds = lambda x: F.exists(x["siblings"], lambda y: (y["actor"] == s["actor"]) & (y["counter"] == s["counter"]))
        return F.forall("r", lambda x: holds(x) | (F.coalesce(F.try_element_at(x["clock"], s["actor"]), zero) < s["counter"]))

    every = F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda x: x["siblings"]))))
    clock = F.aggregate("r", F.create_map().cast("map<string,bigint>"), lambda a, x: clocks.merged(a, x["clock"]))
    return held.select(*key, clock.alias("clock"), F.filter(every, stays).alias("siblings"))


# ------------------------------------------------------------------ siblings with events (dots), and writes in order

def _seen(clock: dict, dot: tuple[str, int]) -> bool:
    return clock.get(dot[0], 0) >= dot[1]


def merge_dotted(a: tuple[dict, list[dict]], b: tuple[dict, list[dict]]) -> tuple[dict, list[dict]]:
    """Merge two objects (clock, siblings with ``dot``): a sibling goes if the other side saw its event and holds it no more."""
    (clock_a, sib_a), (clock_b, sib_b) = a, b
    dots_a, dots_b = ({tuple(s["dot"]) for s in x if s.get("dot")} for x in (sib_a, sib_b))
    kept = []
    for siblings, clock, others in ((sib_a, clock_b, dots_b), (sib_b, clock_a, dots_a)):
        for s in siblings:
            dot = tuple(s["dot"]) if s.get("dot") else None
            if dot is None or not _seen(clock, dot) or dot in others:
                kept.append(s)
    unique = {json.dumps(s, sort_keys=True, default=str): s for s in kept}
    clock = {k: max(clock_a.get(k, 0), clock_b.get(k, 0)) for k in {*clock_a, *clock_b}}
    return clock, [unique[k] for k in sorted(unique)]


def _descends(a: dict, b: dict) -> bool:
    return all(a.get(k, 0) >= n for k, n in b.items())


def syntactic_merge(a: tuple[dict, list[dict]], b: tuple[dict, list[dict]]) -> tuple[dict, list[dict]]:
    """The descendant where one saw all of the other, else the merge."""
    if _descends(a[0], b[0]) and not _descends(b[0], a[0]):
        return a
    if _descends(b[0], a[0]) and not _descends(a[0], b[0]):
        return b
    return merge_dotted(a, b)


def apply_puts(puts: DataFrame, last_write_wins: bool = False, allow_mult: bool = True) -> DataFrame:
    """Objects after writes (bucket, key, seq, actor, context map, value) in the order of seq: (bucket, key, clock, values).

    A write whose context has seen the stored object replaces it, else it becomes a sibling; each write is an event of its actor. One key's writes are
    a sequence, so they meet in one task; keys are spread.
    """
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        state: tuple[dict, list[dict]] = ({}, [])
        for r in rows.itertuples():
            context = {} if r.context is None else dict(r.context)
            if last_write_wins:  # the new object's own clock moves on, whatever is stored
                n = context.get(r.actor, 0) + 1
                state = (context | {r.actor: n}, [{"value": r.value, "dot": (r.actor, n)}])
                continue
            n = max(state[0].get(r.actor, 0), context.get(r.actor, 0)) + 1
            frontier = {k: max(state[0].get(k, 0), context.get(k, 0)) for k in {*state[0], *context}} | {r.actor: n}
            kept = [] if _descends(context, state[0]) else [s for s in state[1] if not _seen(context, s["dot"])]
            state = (frontier, [*kept, {"value": r.value, "dot": (r.actor, n)}])
            if not allow_mult:
                state = (state[0], state[1][-1:])
        clock = ",".join(f"{k}={v}" for k, v in sorted(state[0].items()))
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "key": [rows["key"].iloc[0]], "clock": [clock], "vals": [",".join(sorted(str(s["value"]) for s in state[1]))]})

    return puts.groupBy("bucket", "key").applyInPandas(one, "bucket string, key string, clock string, vals string")


def put(stored: DataFrame, incoming: DataFrame, allow_mult: bool = True, last_write_wins: bool = False) -> DataFrame:
    """A batch of whole objects written over a table: rows (bucket, key, clock, value, last_mod, deleted)."""
    if last_write_wins:
        return stored.join(incoming.select(*NAME), NAME, "left_anti").unionByName(incoming)
    return reconcile(stored.unionByName(incoming), allow_mult)


# ------------------------------------------------------------------ quorums

def get_decision(replies: DataFrame, n: int = 3, r: int = 2, pr: int = 0, notfound_ok: bool = True, basic_quorum: bool = False, node_confirms: int = 0, deleted_clock: bool = False) -> DataFrame:
    """(request, outcome) from all replies (request, status in ok/tombstone/notfound/error, primary; also clock, node) to each request.

    With enough replies the objects are merged by clock before the outcome is told: ok where a live object is left, deleted (if its clock was asked for)
    or notfound where only tombstones are, notfound where there is none. Else insufficient_nodes, notfound, pr_unsatisfied or r_unsatisfied. Without a
    ``clock`` all objects are concurrent. A request has as many replies as replicas, so gathering them is bounded.
    """
    status = F.col("status")
    object_ = status.isin("ok", "tombstone")
    counts = object_ | (status == "notfound" if notfound_ok else F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    clock = F.col("clock") if "clock" in replies.columns else F.lit(None).cast("map<string,bigint>")
    sums = [count(counts).alias("oks"), count(counts & F.col("primary")).alias("poks"), count(status == "tombstone").alias("dead"), count(status == "notfound").alias("missing"), count(status == "error").alias("failed")]
    if node_confirms:
        sums.append(F.count_distinct(F.when(counts, F.col("node"))).alias("nodes"))
    held = replies.groupBy("request").agg(*sums, F.collect_list(F.when(object_, F.struct(clock.alias("clock"), (status == "ok").alias("live")))).alias("objects"))
    left = undominated(F.col("objects")) if "clock" in replies.columns else F.col("objects")
    merged = F.when(F.exists(left, lambda x: x["live"]), "ok").when(F.lit(deleted_clock) & (F.size("objects") > 0), "deleted").otherwise("notfound")
    unheard = F.lit(0) if notfound_ok else F.col("missing")
    nothing = (unheard + F.col("dead") > 0) & (F.col("oks") == F.col("dead")) & (F.col("failed") == 0)
    if basic_quorum:
        nothing = nothing | ((F.size("objects") == F.col("dead")) & (F.col("missing") + F.col("dead") >= n // 2 + 1))
    outcome = F.when(F.col("nodes") < node_confirms, "insufficient_nodes") if node_confirms else F.when(F.lit(False), "")
    outcome = outcome.when((F.col("oks") >= r) & (F.col("poks") >= pr), merged).when(nothing, "notfound").when(F.lit(pr > 0) & (F.col("poks") < pr) & (F.col("oks") >= r), "pr_unsatisfied").otherwise("pr_unsatisfied" if pr >= r else "r_unsatisfied")
    return held.select("request", outcome.alias("outcome"))


def put_decision(acks: DataFrame, n: int = 3, w: int = 2, dw: int = 1, pw: int = 0, node_confirms: int = 0) -> DataFrame:
    """(request, outcome) from acknowledgements (request, kind in w/dw/fail, primary, node)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    durable = F.col("kind") == "dw"
    sums = acks.groupBy("request").agg(
        count(F.col("kind").isin("w", "dw")).alias("ws"), count(durable).alias("dws"), count(durable & F.col("primary")).alias("pws"), count(F.col("kind") == "fail").alias("fails"), F.count_distinct(F.when(durable, F.col("node"))).alias("nodes")
    )
    met = (F.col("ws") >= w) & (F.col("dws") >= dw)
    outcome = (
        F.when(met & (F.col("pws") >= pw) & (F.col("nodes") >= node_confirms), "ok").when(met & (F.col("pws") < pw), "pw_unsatisfied").when((F.col("fails") > n - pw) & F.lit(pw >= dw), "pw_unsatisfied")
        .when(met & (F.col("nodes") < node_confirms), "node_confirms_unsatisfied").when((F.col("fails") > n - node_confirms) & F.lit(node_confirms >= dw), "node_confirms_unsatisfied").when(F.col("fails") > n - dw, "dw_unsatisfied").otherwise("w_unsatisfied")
    )
    return sums.select("request", outcome.alias("outcome"))


def node_diversity(acks: DataFrame) -> DataFrame:
    """Distinct nodes among durable acknowledgements."""
    return acks.groupBy("request").agg(F.count_distinct(F.when(F.col("kind") == "dw", F.col("node"))).alias("nodes"))


def read_repair(replicas: DataFrame, expected: DataFrame) -> DataFrame:
    """(bucket, key, replica, action) of what a read must mend, given all (bucket, key, replica) that should hold the key."""
    held = replicas.groupBy(*NAME).agg(F.collect_list("clock").alias("cs"))
    merged = held.select(*NAME, F.aggregate("cs", F.create_map().cast("map<string,bigint>"), lambda a, c: clocks.merged(a, c)).alias("m"))
    both = expected.join(merged, NAME).join(replicas.select(*NAME, "replica", "clock"), [*NAME, "replica"], "left")
    action = F.when(F.col("clock").isNull(), "notfound").when(clocks.dominates(F.col("m"), F.col("clock")), "outofdate")
    return both.select(*NAME, "replica", action.alias("action")).filter("action is not null")


def final_delete(objects: DataFrame, marked: DataFrame) -> DataFrame:
    """Objects less the tombstones that are still what they were when marked: equal (bucket, key, delete_hash)."""
    return objects.join(marked.select(*NAME, "delete_hash"), [*NAME, "delete_hash"], "left_anti")


def approximate_size(objects: DataFrame) -> DataFrame:
    """(bucket, key, approx_size): bytes of names, clock and contents."""
    contents = F.aggregate("siblings", F.lit(0), lambda a, s: a + F.octet_length(F.coalesce(s["value"], F.lit(""))))
    return objects.select(*NAME, (F.octet_length("bucket") + F.octet_length("key") + F.octet_length(clocks.text(F.col("clock"))) + contents).cast("bigint").alias("approx_size"))


def conditional(stored: DataFrame, incoming: DataFrame, *, if_none_match: bool = False, if_not_modified: bool = False) -> DataFrame:
    """Incoming writes that may go ahead: where nothing is stored, or where the stored clock equals the one read."""
    now = stored.select(*NAME, clocks.text(F.col("clock")).alias("_now"))
    if if_none_match:
        return incoming.join(now, NAME, "left_anti")
    if if_not_modified:
        return incoming.withColumn("_then", clocks.text(F.col("clock"))).join(now, NAME).filter("_then = _now").drop("_then", "_now")
    return incoming


def find_best(replies: DataFrame) -> DataFrame:
    """Of each key's replies (bucket, key, replica, clock, arrival) those to fetch: undominated, of equal clocks full objects before heads, then the first to arrive.

    ``is_head`` may tell which replies are heads.
    """
    live = remove_dominated(replies)
    first = W.partitionBy(*NAME, "_c").orderBy(*(["is_head"] if "is_head" in replies.columns else []), "arrival", "replica")
    return live.withColumn("_c", clocks.text(F.col("clock"))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_c")


def prune(clock: Column, small: int = 50, big: int = 50, young: int = 20, old: int = 86400, now: Column | None = None, times: Column | None = None) -> Column:
    """Clock entries kept: the oldest goes while there are more than ``small``, it is ``young`` seconds old, and there are more than ``big`` or it is over ``old``."""
    if times is None or now is None:
        return clock
    entries = F.array_sort(F.transform(F.map_entries(clock), lambda e: F.struct((-F.element_at(times, e["key"])).alias("t"), e["key"].alias("key"), e["value"].alias("value"))))
    # i entries are newer; whatever lets an entry go lets all older ones go before it
    kept = F.filter(entries, lambda e, i: (i < small) | (now + e["t"] < young) | ((i < big) & (now + e["t"] <= old)))
    return F.map_from_arrays(F.transform(kept, lambda e: e["key"]), F.transform(kept, lambda e: e["value"]))
