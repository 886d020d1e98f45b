"""Jobs compiled to DataFrames: inputs, fetches, map, reduce and link phases.

Between phases rows have ``bucket_type, bucket, key, keydata`` where they name objects, or ``value`` where they are results. Built-in functions are
Columns and aggregates; Python functions run in ``mapInPandas``. A job is a plan: nothing runs before its result is used.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.functions import keyfilters
from kvloom.operators import sync
from kvloom.operators.index import IndexQuery, lookup
from kvloom.plans.jobs import BadJob, Inputs, Job, Phase

KEYS = ["bucket_type", "bucket", "key", "keydata"]
BATCH = 20


class Tables:
    """What jobs read. ``objects`` is canonical; ``postings`` may be missing; ``generators`` are the allowed input functions by name."""

    def __init__(self, spark: SparkSession, objects: DataFrame, postings: DataFrame | None = None, generators: dict[str, Callable[[SparkSession, Any], DataFrame]] | None = None) -> None:
        self.spark, self.objects, self.postings, self.generators = spark, objects, postings, generators or {}


# ------------------------------------------------------------------ inputs

def input_keys(tables: Tables, i: Inputs) -> DataFrame:
    """(bucket_type, bucket, key, keydata). Named keys keep duplicates; buckets and indexes list what is there."""
    none = F.lit(None).cast("string").alias("keydata")
    if i.kind == "keys":
        return tables.spark.createDataFrame([(t, b, k, None if d is None else str(d)) for t, b, k, d in i.keys], ", ".join(f"{c} string" for c in KEYS))
    if i.kind == "generator":
        run = i.function if callable(i.function) else tables.generators.get(i.function)
        if run is None:
            raise BadJob(f"generator {i.function} is not allowed")
        rows = run(tables.spark, i.arg)
        have = set(rows.columns)
        return rows.select(F.col("bucket_type") if "bucket_type" in have else F.lit("default").alias("bucket_type"), "bucket", "key", F.col("keydata").cast("string") if "keydata" in have else none)
    named = [F.lit(i.bucket_type).alias("bucket_type"), F.lit(i.bucket).alias("bucket"), "key", none]
    own = tables.objects.filter((F.col("bucket_type") == i.bucket_type) & (F.col("bucket") == i.bucket))
    if i.kind == "bucket":
        return own.select("key").select(*named)
    if i.kind == "filtered":
        return keyfilters.keep(own.select("key"), i.chain).select(*named)
    if i.kind == "index":
        same = i.start == i.end
        more = {"bucket_type": i.bucket_type}
        q = IndexQuery.eq(i.bucket, i.field, i.start, **more) if same and not i.field.startswith("$") else IndexQuery.between(i.bucket, i.field, i.start, i.end, return_terms=False, **more)
        return lookup(q, tables.postings, tables.objects.select("bucket_type", "bucket", "key")).select(*named)
    raise BadJob(f"no inputs {i.kind}")


def fetched(tables: Tables, i: Inputs, keys: DataFrame) -> DataFrame:
    """Inputs with their objects' siblings, null where not found. A whole bucket is one scan, not a listing and a join."""
    if i.kind in ("bucket", "filtered"):
        own = tables.objects.filter((F.col("bucket_type") == i.bucket_type) & (F.col("bucket") == i.bucket))
        return keyfilters.keep(own, i.chain).select("bucket_type", "bucket", "key", F.lit(None).cast("string").alias("keydata"), "siblings")
    objects = tables.objects.select("bucket_type", "bucket", "key", "siblings")
    if i.kind == "keys" and len(i.keys) <= 10_000:  # as many found objects at most, so they can be broadcast
        found = objects.join(F.broadcast(keys.select("bucket_type", "bucket", "key").distinct()), ["bucket_type", "bucket", "key"], "left_semi")
        return keys.join(F.broadcast(found.limit(len(i.keys))), ["bucket_type", "bucket", "key"], "left")
    return keys.join(objects, ["bucket_type", "bucket", "key"], "left")


# ------------------------------------------------------------------ map functions

def _missing(rows: DataFrame, arg: Any, value: Column) -> DataFrame:
    """What becomes of objects that are not there."""
    here = F.col("siblings").isNotNull()
    if arg == "filter_notfound":
        return rows.filter(here).select(value.alias("value"))
    if arg in (None, "include_notfound"):
        return rows.select(F.when(here, value).otherwise(F.lit("not_found")).alias("value"))
    if arg == "include_keydata":
        return rows.select(F.when(here, value).otherwise(F.concat(F.lit("not_found:"), F.coalesce("keydata", F.lit("")))).alias("value"))
    if isinstance(arg, dict) and "sub" in arg:
        return rows.select(F.when(here, value).otherwise(F.lit(str(arg["sub"]))).alias("value"))
    raise BadJob(f"no action {arg!r} for what is not found")


def _single() -> Column:
    """The value of an object without conflicts; siblings fail the job."""
    clash = F.raise_error(F.concat(F.lit("object has siblings: "), F.col("key"))).cast("string")
    return F.when(F.size("siblings") == 1, F.col("siblings")[0]["value"]).otherwise(clash)


def map_identity(rows: DataFrame, arg: Any) -> DataFrame:
    return rows


def map_object_value(rows: DataFrame, arg: Any) -> DataFrame:
    return _missing(rows, arg, _single())


def map_object_value_list(rows: DataFrame, arg: Any) -> DataFrame:
    """Values that are JSON lists, an element a row."""
    held = _missing(rows, arg, _single())
    return held.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).alias("value"))


def filter_not_found(rows: DataFrame, arg: Any) -> DataFrame:
    return rows.filter(F.col("siblings").isNotNull())


def map_values(rows: DataFrame, arg: Any) -> DataFrame:
    """The first sibling's data; lists are opened."""
    held = rows.filter(F.col("siblings").isNotNull()).select(F.col("siblings")[0]["value"].alias("value"))
    return held.select(F.explode(F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))).alias("value"))


def map_values_json(rows: DataFrame, arg: Any) -> DataFrame:
    """Parsed values; ``arg`` is their schema, else a map of texts."""
    return map_values(rows, None).select(F.from_json("value", arg or "map<string,string>").alias("value"))


def map_by_fields(rows: DataFrame, arg: dict) -> DataFrame:
    """Objects whose JSON value has all the given fields equal, compared as texts."""
    keep = F.lit(True)
    for name, value in arg.items():
        keep = keep & (F.get_json_object(F.col("siblings")[0]["value"], f"$.{name}") == (json.dumps(value) if isinstance(value, bool) else str(value)))
    return rows.filter(F.col("siblings").isNotNull()).filter(keep)


def python_map(rows: DataFrame, f: Callable, arg: Any) -> DataFrame:
    """``f(row dict or None, keydata, arg)`` gives a list of results."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.to_dict("records"):
                got = f(r, r.get("keydata"), arg)
                if not isinstance(got, list):
                    raise TypeError(f"a map function gave {type(got).__name__}, not a list")
                out += [None if x is None else x if isinstance(x, str) else json.dumps(x) for x in got]
            yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

    held = rows.select("bucket", "key", "keydata", F.when(F.col("siblings").isNotNull(), F.transform("siblings", lambda s: s["value"])).alias("values"))
    return held.mapInPandas(run, "value string")


MAPS = {
    "map_identity": map_identity, "map_object_value": map_object_value, "map_object_value_list": map_object_value_list, "filterNotFound": filter_not_found,
    "mapValues": map_values, "mapValuesJson": map_values_json, "mapByFields": map_by_fields,
}


# ------------------------------------------------------------------ reduce functions

def _values(rows: DataFrame) -> DataFrame:
    """Rows as results: objects are named by bucket and key."""
    return rows if "value" in rows.columns else rows.select(F.concat_ws("/", "bucket", "key").alias("value"))


def reduce_identity(rows: DataFrame, arg: Any) -> DataFrame:
    """Pairs of bucket and key; results that name no object fail."""
    if "bucket" not in rows.columns:
        raise BadJob("reduce_identity needs keys")
    return rows.select(*[c for c in KEYS if c in rows.columns])


def reduce_set_union(rows: DataFrame, arg: Any) -> DataFrame:
    return rows.select(*[c for c in KEYS if c in rows.columns] or ["value"]).distinct()


def reduce_sum(rows: DataFrame, arg: Any) -> DataFrame:
    """Sum of numbers, 0 of none; what was not found does not count."""
    v = _values(rows).filter(~F.coalesce(F.col("value").cast("string").startswith("not_found"), F.lit(False)))
    return v.agg(F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("value"))


def reduce_plist_sum(rows: DataFrame, arg: Any) -> DataFrame:
    """Sums by name of (name, value) rows, or of JSON lists of [name, number]."""
    if "name" not in rows.columns:
        pair = F.explode(F.from_json("value", "array<array<string>>")).alias("p")
        rows = rows.select(pair).select(F.col("p")[0].alias("name"), F.col("p")[1].cast("double").alias("value"))
    return rows.groupBy("name").agg(F.sum("value").alias("value"))


def reduce_sort(rows: DataFrame, arg: Any) -> DataFrame:
    return _values(rows).orderBy("value")


def reduce_numeric_sort(rows: DataFrame, arg: Any) -> DataFrame:
    return _values(rows).orderBy(F.col("value").cast("double"))


def reduce_count_inputs(rows: DataFrame, arg: Any) -> DataFrame:
    """Inputs counted; inputs that are whole numbers, counts of earlier runs, are added."""
    v = _values(rows)
    whole = F.col("value").cast("string").rlike("^-?[0-9]+$")
    return v.agg(F.coalesce(F.sum(F.when(whole, F.try_to_number(F.col("value").cast("string"), F.lit("S9999999999999999")).cast("bigint")).otherwise(1)), F.lit(0)).alias("value"))


def reduce_count_keys(rows: DataFrame, arg: Any) -> DataFrame:
    return rows.agg(F.count("*").alias("value"))


def reduce_string_to_integer(rows: DataFrame, arg: Any) -> DataFrame:
    v = _values(rows).filter(~F.coalesce(F.col("value").cast("string").startswith("not_found"), F.lit(False)))
    return v.select(keyfilters.string_to_int(F.col("value").cast("string")).alias("value"))


def reduce_min(rows: DataFrame, arg: Any) -> DataFrame:
    """Nothing of nothing."""
    return _values(rows).agg(F.min(F.col("value").cast("double")).alias("value")).filter("value is not null")


def reduce_max(rows: DataFrame, arg: Any) -> DataFrame:
    return _values(rows).agg(F.max(F.col("value").cast("double")).alias("value")).filter("value is not null")


def reduce_limit(rows: DataFrame, arg: int) -> DataFrame:
    """One row fewer than asked for, as ever."""
    return rows.limit(max(int(arg) - 1, 0))


def reduce_slice(rows: DataFrame, arg: tuple[int, int]) -> DataFrame:
    """Results from start to before end, by value; all if there are fewer than end."""
    start, end = arg
    v = _values(rows)
    held = v.select("value").orderBy("value").limit(end).select("value", F.row_number().over(W.orderBy("value")).alias("_n"))  # partitions send ``end`` rows each
    total = v.limit(end).agg(F.count("*").alias("_total"))
    short = F.col("_total") < end
    return held.join(F.broadcast(total)).filter(short | ((F.col("_n") > start) & (F.col("_n") <= end))).select("value")


def python_reduce(rows: DataFrame, f: Callable, arg: Any, batch: int = BATCH, once: bool = False, prereduce: bool = False) -> DataFrame:
    """``f(list, arg)`` gives a list, and is fed its own result before each next batch; with no inputs it runs once on [].

    One task sees all inputs, for results may depend on that; with ``prereduce`` every partition is reduced where it is first, and one task reduces what
    these give. A map phase asks for that with the argument ``do_prereduce``.
    """

    def reduced(alone: bool) -> Callable:
        return lambda parts: _reduced(parts, f, arg, batch, once, alone)

    values = _values(rows).select(F.col("value").cast("string"))
    if prereduce and not once:
        values = values.mapInPandas(reduced(False), "value string")
    return values.repartition(1).mapInPandas(reduced(True), "value string")


def _reduced(parts: Iterator[pd.DataFrame], f: Callable, arg: Any, batch: int, once: bool, alone: bool) -> Iterator[pd.DataFrame]:
    """One task's reduction; ``alone``: it also runs on no inputs."""
    held: list = []
    waiting: list = []
    ran = False
    for part in parts:
        for v in part["value"]:
            waiting.append(v)
            if not once and len(waiting) == batch:
                held, waiting, ran = f(held + waiting, arg), [], True
    if waiting or (alone and not ran):
        held = f(held + waiting, arg)
    yield pd.DataFrame({"value": pd.Series([None if x is None else x if isinstance(x, str) else json.dumps(x) for x in held], dtype=object)})


REDUCES = {
    "reduce_identity": reduce_identity, "reduce_set_union": reduce_set_union, "reduce_sum": reduce_sum, "reduce_plist_sum": reduce_plist_sum, "reduce_sort": reduce_sort,
    "reduce_count_inputs": reduce_count_inputs, "reduce_string_to_integer": reduce_string_to_integer, "reduceSum": reduce_sum, "reduceMin": reduce_min, "reduceMax": reduce_max,
    "reduceSort": reduce_sort, "reduceNumericSort": reduce_numeric_sort, "reduceLimit": reduce_limit, "reduceSlice": reduce_slice,
}


# ------------------------------------------------------------------ jobs

def link(tables: Tables, rows: DataFrame, p: Phase) -> DataFrame:
    """Targets of matching links as inputs of the next phase, the tag as their keydata; what was not found has none."""
    if "siblings" not in rows.columns:
        rows = rows.join(tables.objects.select("bucket_type", "bucket", "key", "siblings"), ["bucket_type", "bucket", "key"])
    edges = sync.links(rows.filter(F.col("siblings").isNotNull()))
    for column, wanted in (("to_bucket", p.bucket), ("tag", p.tag)):
        if wanted != "_":
            edges = edges.filter(F.col(column) == wanted)
    return edges.select(F.lit("default").alias("bucket_type"), F.col("to_bucket").alias("bucket"), F.col("to_key").alias("key"), F.col("tag").alias("keydata"))


def run(tables: Tables, job: Job, batch: int = BATCH) -> DataFrame | list[DataFrame]:
    """The kept phases' results: one DataFrame, or a list in phase order if several are kept. Without phases the inputs; if none is kept, nothing."""
    rows = input_keys(tables, job.inputs)
    if not job.phases:
        return rows
    out: list[DataFrame] = []
    combine = False
    for n, p in enumerate(job.phases):
        try:
            if p.kind in ("map", "link"):
                if "siblings" not in rows.columns and "bucket" in rows.columns:
                    rows = fetched(tables, job.inputs, rows) if n == 0 else rows.join(tables.objects.select("bucket_type", "bucket", "key", "siblings"), ["bucket_type", "bucket", "key"], "left")
            if p.kind == "link":
                rows = link(tables, rows, p)
            elif p.kind == "map":
                arg, combine = p.arg, False
                if isinstance(arg, dict) and "do_prereduce" in arg:
                    combine = bool(arg["do_prereduce"])
                    arg = {k: v for k, v in arg.items() if k != "do_prereduce"} or None
                if callable(p.function):
                    rows = python_map(rows, p.function, arg)
                elif p.function in MAPS:
                    rows = MAPS[p.function](rows, arg)
                else:
                    raise BadJob(f"no map function {p.function}")
            else:
                options = p.arg if isinstance(p.arg, dict) else {}
                if callable(p.function):
                    rows = python_reduce(rows, p.function, p.arg, options.get("reduce_phase_batch_size", batch), bool(options.get("reduce_phase_only_1")), combine)
                elif p.function == "reduce_count_inputs" and "value" not in rows.columns:
                    rows = reduce_count_keys(rows, p.arg)
                elif p.function in REDUCES:
                    rows = REDUCES[p.function](rows, p.arg)
                else:
                    raise BadJob(f"no reduce function {p.function}")
        except BadJob as bad:
            raise BadJob(f"phase {n}: {bad}") from bad
        if p.keep:
            out.append(rows)
    if not out:
        return rows.limit(0)
    return out[0] if len(out) == 1 else out


def collected(df: DataFrame, timeout_ms: int | None = None) -> list:
    """A result's rows; its Spark jobs are cancelled past the timeout (none or 0: no limit)."""
    if not timeout_ms:
        return df.collect()
    context, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    timer = threading.Timer(timeout_ms / 1000, lambda: context.cancelJobGroup(group))
    context.setJobGroup(group, "job with a timeout", interruptOnCancel=True)
    timer.start()
    try:
        return df.collect()
    except Exception as failed:
        if not timer.is_alive():
            raise TimeoutError(f"over {timeout_ms} ms") from failed
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def explain(tables: Tables, job: Job) -> str:
    """The physical plan of a job's results."""
    got = run(tables, job)
    parts = got if isinstance(got, list) else [got]
    return "\n".join(p._jdf.queryExecution().explainString(p._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) for p in parts)
