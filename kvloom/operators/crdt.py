"""Convergent data types as aggregates over operations or replica states: counters, sets, maps, flags, registers, cardinality sketches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch precision by default and its limits.
HLL_PRECISION, HLL_LEAST, HLL_MOST = 14, 4, 16
#: Empty values by type, for keys that hold nothing.
EMPTY = {"counter": 0, "set": [], "gset": [], "hll": 0, "map": {}, "flag": False, "register": ""}


class Precondition(ValueError):
    """An update needs a context it was not given, or removes what is not there."""


# ------------------------------------------------------------------ counters

def gcounter_merge(states: DataFrame, key: list[str]) -> DataFrame:
    """(key, actor, cnt): the greatest count a replica has seen of each actor."""
    return states.groupBy(*key, "actor").agg(F.max("cnt").alias("cnt"))


def gcounter_value(states: DataFrame, key: list[str]) -> DataFrame:
    return gcounter_merge(states, key).groupBy(*key).agg(F.sum("cnt").alias("value"))


def pncounter_value(states: DataFrame, key: list[str]) -> DataFrame:
    """States (key, actor, p, n): increments less decrements after merging."""
    merged = states.groupBy(*key, "actor").agg(F.max("p").alias("p"), F.max("n").alias("n"))
    return merged.groupBy(*key).agg((F.sum("p") - F.sum("n")).alias("value"))


def counter_ops(ops: DataFrame, key: list[str]) -> DataFrame:
    """Value of signed amounts; a zero changes nothing."""
    return ops.groupBy(*key).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("value"))


def counter_equal(a: Column, b: Column) -> Column:
    """Equality of structure, entry by entry, of ``map<actor, count>``: equal values alone do not do."""
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def parse_counter_op(body: str | int | dict) -> int:
    """Amount of an operation: an integer, a text of one, or increment or decrement with one or none."""
    op = body
    if isinstance(body, str):
        try:
            op = json.loads(body)
        except ValueError:
            op = {body: 1}
    if isinstance(op, bool) or op is None:
        raise ValueError(f"bad counter operation {body!r}")
    if isinstance(op, int):
        return op
    if isinstance(op, str):
        op = {op: 1}
    if isinstance(op, dict) and len(op) == 1:
        ((name, amount),) = op.items()
        if name in ("increment", "decrement") and isinstance(amount, int):
            return amount if name == "increment" else -amount
    raise ValueError(f"bad counter operation {body!r}")


def counter_amount(body: Column) -> Column:
    """``parse_counter_op`` over a column of texts; what is no operation is null."""
    whole = F.regexp_extract(body, r'^"?([+-]?[0-9]+)"?$', 1)
    word = F.regexp_extract(body, r'^\s*[{]?"?(increment|decrement)"?(?:\s*:\s*(-?[0-9]+)\s*[}])?\s*$', 1)
    by = F.regexp_extract(body, r'^\s*[{]?"?(?:increment|decrement)"?(?:\s*:\s*(-?[0-9]+)\s*[}])?\s*$', 1)
    amount = F.when(by == "", F.lit(1)).otherwise(F.try_to_number(by, F.lit("S9999999999999999"))).cast("bigint")
    return F.when(whole != "", whole.cast("bigint")).when(word == "increment", amount).when(word == "decrement", -amount)


# ------------------------------------------------------------------ sets

def checked_updates(ops: DataFrame, present: DataFrame, key: list[str], element: str = "element") -> DataFrame:
    """``ops`` (key, element, op, context) with ``error``: a removal without context of what is not ``present`` (key, element) fails its precondition.

    Holds for elements of sets and fields of maps; disabling a flag needs a context that is not empty.
    """
    there = present.select(*key, element).distinct().withColumn("_there", F.lit(True))
    removes = F.col("op").isin("remove", "remove_field", "disable")
    missing = F.col("_there").isNull() | (F.col("op") == "disable")
    bare = F.coalesce(F.col("context") == "", F.lit(True))
    return ops.join(there, [*key, element], "left").withColumn("error", F.when(removes & bare & missing, "not_present")).drop("_there")


def gset_merge(elements: DataFrame, key: list[str], element: str = "element") -> DataFrame:
    """Union of a grow-only set, a row an element."""
    return elements.select(*key, element).distinct()


def orset_fold(ops: DataFrame, key: list[str]) -> DataFrame:
    """Elements of an add-wins set from its operations: (key, element).

    ``ops``: element, op (add or remove), actor, cnt (the event of an add), context map<actor, cnt> (what a remove had seen). An add survives unless a
    remove of the same element had seen its event. Removes are merged per element first, so an element's operations meet as one row against its adds.
    """
    adds = ops.filter("op = 'add'").select(*key, "element", "actor", "cnt").distinct()
    seen = ops.filter("op = 'remove'").select(*key, "element", F.explode("context").alias("actor", "seen")).groupBy(*key, "element", "actor").agg(F.max("seen").alias("seen"))
    left = adds.join(seen, [*key, "element", "actor"], "left").filter(F.coalesce("seen", F.lit(0)) < F.col("cnt"))
    return left.select(*key, "element").distinct()


def orset_merge(a: dict, b: dict) -> dict:
    """Merge two set states {clock: {actor: n}, entries: {element: [[actor, n], ...]}}: an event stays if both have it or the other never saw it."""
    def kept(mine, theirs):
        out = {}
        for e, dots in mine["entries"].items():
            other = {tuple(d) for d in theirs["entries"].get(e, ())}
            left = [d for d in map(tuple, dots) if d in other or theirs["clock"].get(d[0], 0) < d[1]]
            if left:
                out[e] = set(left)
        return out

    entries = kept(a, b)
    for e, dots in kept(b, a).items():
        entries[e] = entries.get(e, set()) | dots
    clock = {k: max(a["clock"].get(k, 0), b["clock"].get(k, 0)) for k in {*a["clock"], *b["clock"]}}
    return {"clock": clock, "entries": {e: sorted(map(list, d)) for e, d in sorted(entries.items())}}


def orset_states(states: DataFrame, key: list[str]) -> DataFrame:
    """Merge replica states, JSON texts in ``state``, key by key: (key, elements)."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"clock": {}, "entries": {}}
        for text in rows["state"]:
            out = orset_merge(out, json.loads(text))
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in key}, "elements": [",".join(sorted(out["entries"]))]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in states.schema if f.name in key)
    return states.groupBy(*key).applyInPandas(merge, f"{schema}, elements string")


def set_update(elements: set[str], op: dict, context: bool = True) -> set[str]:
    """One JSON operation: add, remove, add_all, remove_all, or update with a list of these."""
    out = set(elements)
    for name, arg in op.items():
        if name == "update":
            for o in arg:
                out = set_update(out, o, context)
        elif name in ("add", "add_all"):
            out |= {arg} if name == "add" else set(arg)
        elif name in ("remove", "remove_all"):
            gone = {arg} if name == "remove" else set(arg)
            if not context and not gone <= out:
                raise Precondition(f"not present: {sorted(gone - out)}")
            out -= gone
        else:
            raise ValueError(f"bad set operation {name}")
    return out


# ------------------------------------------------------------------ flags, registers, maps

def register_fold(ops: DataFrame, key: list[str], value: str = "value", order: str = "ts") -> DataFrame:
    """The last write; of equal times the greater value."""
    return ops.groupBy(*key).agg(F.max(F.struct(order, value)).alias("m")).select(*key, F.col(f"m.{value}").alias("value"))


def flag_fold(ops: DataFrame, key: list[str]) -> DataFrame:
    """Whether the last enable or disable was an enable; of equal times enable wins."""
    return ops.groupBy(*key).agg(F.max(F.struct("ts", (F.col("op") == "enable").alias("on"))).alias("m")).select(*key, F.col("m.on").alias("value"))


def map_fold(ops: DataFrame, key: list[str]) -> DataFrame:
    """Fields of maps from operations (field, kind, op, amount, element, value, ts), each by its own type: (key, field, kind, value text)."""
    by = [*key, "field", "kind"]
    counters = ops.filter("kind = 'counter'").groupBy(*by).agg(F.sum("amount").cast("string").alias("value"))
    registers = register_fold(ops.filter("kind = 'register'"), by).select(*by, F.col("value").cast("string").alias("value"))
    flags = flag_fold(ops.filter("kind = 'flag'"), by).select(*by, F.col("value").cast("string").alias("value"))
    sets = ops.filter("kind = 'gset'").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("element")), ",").alias("value"))
    gone = ops.filter("op = 'remove_field'").groupBy(*by).agg(F.max("ts").alias("gone"))
    newest = ops.filter("op <> 'remove_field'").groupBy(*by).agg(F.max("ts").alias("latest"))
    out = counters.unionByName(registers).unionByName(flags).unionByName(sets)
    live = newest.join(gone, by, "left").filter("gone is null or latest > gone").select(*by)
    return out.join(live, by, "left_semi")


def field_name(name: str) -> tuple[str, str]:
    """A map field's name and type, which its suffix tells."""
    stem, _, kind = name.rpartition("_")
    if not stem or kind not in EMPTY:
        raise ValueError(f"no field type in {name}")
    return stem, kind


# ------------------------------------------------------------------ cardinality sketches

def _checked(precision: int) -> int:
    if not HLL_LEAST <= precision <= HLL_MOST:
        raise ValueError(f"precision {precision} is not in {HLL_LEAST}..{HLL_MOST}")
    return precision


def hll_sketch(rows: DataFrame, key: list[str], element: str, precision: int = HLL_PRECISION) -> DataFrame:
    """(key, sketch): partial sketches merge before the shuffle."""
    return rows.groupBy(*key).agg(F.hll_sketch_agg(element, _checked(precision)).alias("sketch"))


def hll_merge(sketches: DataFrame, key: list[str]) -> DataFrame:
    """Union, at the lowest precision among them."""
    return sketches.groupBy(*key).agg(F.hll_union_agg("sketch", True).alias("sketch"))


def hll_value(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def hll_reduce(spark, sketches: DataFrame, precision: int, current: int) -> DataFrame:
    """Sketches at a lower precision; a higher one is an error."""
    if _checked(precision) > current:
        raise ValueError("precision only goes down")
    empty = spark.range(0).agg(F.hll_sketch_agg("id", precision).alias("low"))
    # the one empty sketch is a scalar, beside each row
    return sketches.join(F.broadcast(empty)).withColumn("sketch", F.hll_union("sketch", "low", True)).drop("low")


def hll_bytes(sketch: Column) -> Column:
    return F.octet_length(sketch)


# ------------------------------------------------------------------ values

def merge_siblings(siblings: DataFrame, key: list[str]) -> DataFrame:
    """Siblings (kind, state, value) of each key: set states merge to one row a kind, counters to their merged value, and what is of no known type stays.

    Counter states are JSON ``{actor: [p, n]}``; states that do not parse stay as they are, with ``error`` set.
    """
    parsed = F.from_json("state", "map<string,array<bigint>>")
    counters = siblings.filter("kind = 'counter'")
    good = counters.filter(parsed.isNotNull()).select(*key, F.explode(parsed).alias("actor", "pn")).select(*key, "actor", F.col("pn")[0].alias("p"), F.col("pn")[1].alias("n"))
    merged = pncounter_value(good, key).select(*key, F.lit("counter").alias("kind"), F.col("value").cast("string").alias("value"), F.lit(False).alias("error"))
    sets = orset_states(siblings.filter("kind = 'set'").select(*key, "state"), key).select(*key, F.lit("set").alias("kind"), F.col("elements").alias("value"), F.lit(False).alias("error"))
    opaque = siblings.filter("kind is null or kind not in ('counter', 'set')").select(*key, "kind", "value", F.lit(False).alias("error"))
    broken = counters.filter(parsed.isNull()).select(*key, "kind", F.col("state").alias("value"), F.lit(True).alias("error"))
    return merged.unionByName(sets).unionByName(opaque).unionByName(broken)


def metadata_merge(rows: DataFrame, key: list[str]) -> DataFrame:
    """Metadata of merged siblings: the later modified; of equal times the first by content."""
    first = F.min(F.struct((-F.coalesce(F.unix_micros(F.col("last_mod").cast("timestamp")), F.lit(-(1 << 62)))).alias("t"), F.col("meta").alias("meta"), F.col("last_mod").alias("last_mod"))).alias("m")
    return rows.groupBy(*key).agg(first).select(*key, "m.meta", "m.last_mod")


def value_or_empty(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.lit(json.dumps(EMPTY[kind]) if isinstance(EMPTY[kind], (list, dict)) else EMPTY[kind]))


def fetch_response(rows: DataFrame, kind: str, value: str = "value", context: str | None = None) -> DataFrame:
    """JSON of type, value and, unless empty, context."""
    fields = [F.lit(kind).alias("type"), F.col(value).alias("value")]
    if context:
        fields.append(F.when(F.col(context) != "", F.col(context)).alias("context"))
    return rows.withColumn("json", F.to_json(F.struct(*fields)))


def is_crdt(kind: Column, tagged: Column) -> Column:
    return kind.isin(*EMPTY) & tagged
