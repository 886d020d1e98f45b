"""Secondary-index queries over postings: exact and range lookups, patterns, paging, and what writes need."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.model import BINARY_SUFFIX, BUCKET_FIELD, INTEGER_SUFFIX, KEY_FIELD


class IndexesNotSupported(RuntimeError):
    """The table was written without an index."""


@dataclass(frozen=True)
class IndexQuery:
    """A lookup. Defaults: both ends belong to the range, terms are returned for ranges, nothing is sorted."""

    bucket: str
    field: str
    start: str | int | None = None
    end: str | int | None = None
    start_key: str = ""
    start_inclusive: bool = True
    end_inclusive: bool = True
    exact: bool = False
    return_terms: bool = True
    return_body: bool = False
    term_regex: str | None = None
    max_results: int | None = None
    pagination_sort: bool = False
    bucket_type: str = "default"

    @staticmethod
    def eq(bucket: str, field: str, value: str | int, **more) -> IndexQuery:
        return IndexQuery(bucket, field, value, value, exact=True, return_terms=False, **more)

    @staticmethod
    def between(bucket: str, field: str, start: str | int | None, end: str | int | None, **more) -> IndexQuery:
        return IndexQuery(bucket, field, start, end, **more)

    @property
    def built_in(self) -> bool:
        return self.field in (KEY_FIELD, BUCKET_FIELD)

    @property
    def integer(self) -> bool:
        return field_type(self.field) == "integer"

    def checked(self) -> IndexQuery:
        if self.term_regex is not None and self.integer:
            raise ValueError("a pattern cannot search integers")
        if self.return_body and not self.built_in:
            raise ValueError("bodies are returned for $key and $bucket only")
        if field_type(self.field) == "unknown":
            raise ValueError(f"unknown_field_type: {self.field}")
        return self


def field_type(field: str) -> str:
    """binary, integer, built_in or unknown: by the suffix of a longer name, in lower case."""
    name = field.lower()
    if name in (KEY_FIELD, BUCKET_FIELD):
        return "built_in"
    for suffix, kind in ((BINARY_SUFFIX, "binary"), (INTEGER_SUFFIX, "integer")):
        if name.endswith(suffix) and len(name) > len(suffix) and not name.startswith("$"):
            return kind
    return "unknown"


def _bounds(q: IndexQuery, value: Column) -> Column:
    """Both flags count for keys."""
    keep = F.lit(True)
    if q.start is not None:
        keep = keep & (value >= F.lit(q.start) if q.start_inclusive else value > F.lit(q.start))
    if q.end is not None and q.field != BUCKET_FIELD:
        keep = keep & (value <= F.lit(q.end) if q.end_inclusive else value < F.lit(q.end))
    return keep


def lookup(q: IndexQuery, postings: DataFrame | None, keys: DataFrame) -> DataFrame:
    """Matching rows: ``key``, after ``term`` where terms are returned, or all columns of ``keys`` where bodies are.

    ``keys`` holds bucket_type, bucket and key, one row an object; ``$key`` and ``$bucket`` read it, other fields read postings. Filters are on plain
    columns, so they reach the scan; a limit sorts no more than it returns in each partition. A key found by two terms is returned twice.
    """
    q = q.checked()
    if q.built_in:
        rows = keys.filter((F.col("bucket_type") == q.bucket_type) & (F.col("bucket") == q.bucket)).filter(_bounds(q, F.col("key")))
        if q.term_regex is not None and q.field == KEY_FIELD:
            rows = rows.filter(F.col("key").rlike(q.term_regex))
        rows = rows if q.return_body else rows.select("key")
        order = ["key"]
    else:
        if postings is None:
            raise IndexesNotSupported(q.field)
        term = F.col("term_int" if q.integer else "term_bin")
        rows = postings.filter((F.col("bucket_type") == q.bucket_type) & (F.col("bucket") == q.bucket) & (F.col("field") == q.field.lower()))
        if q.exact:
            rows = rows.filter(term == F.lit(q.start))
            rows = rows if q.start_inclusive else rows.filter(F.col("key") > q.start_key)
        else:
            # the end always belongs to the range of a user's field; an excluded start is the pair of term and key
            if q.start is not None:
                rows = rows.filter(term >= F.lit(q.start))
            if q.end is not None:
                rows = rows.filter(term <= F.lit(q.end))
            if not q.start_inclusive:
                rows = rows.filter((term > F.lit(q.start)) | (F.col("key") > q.start_key))
        if q.term_regex is not None:
            rows = rows.filter(term.rlike(q.term_regex))
        terms = q.return_terms and not q.exact
        rows = rows.select(term.alias("term"), "key") if terms else rows.select(term.alias("_term"), "key")
        order = ["term", "key"] if terms else ["_term", "key"]
    if q.max_results is not None:
        rows = rows.orderBy(*order).limit(q.max_results)
    elif q.pagination_sort:
        rows = rows.orderBy(*order)
    return rows.drop("_term")


def encode_continuation(last: Row) -> str:
    return base64.b64encode(json.dumps({"key": last["key"], "term": last["term"] if "term" in last else None}).encode()).decode()


def resume(q: IndexQuery, continuation: str) -> IndexQuery:
    """The query for what comes strictly after a page's last result; it is sorted from then on."""
    try:
        at = json.loads(base64.b64decode(continuation, validate=True))
        key, term = at["key"], at["term"]
    except (ValueError, KeyError, TypeError) as bad:
        raise ValueError("invalid continuation") from bad
    if q.built_in:
        return replace(q, start=key, start_inclusive=False, pagination_sort=True)
    if q.exact:
        return replace(q, start_key=key, start_inclusive=False, pagination_sort=True)
    return replace(q, start=term, start_key=key, start_inclusive=False, pagination_sort=True)


def page(q: IndexQuery, postings: DataFrame | None, keys: DataFrame) -> tuple[list[Row], str | None]:
    """One page, at most ``max_results`` rows, and where the next begins: only a full page has a next."""
    if q.max_results is None:
        raise ValueError("a page needs max_results")
    rows = lookup(q, postings, keys).collect()
    return rows, encode_continuation(rows[-1]) if rows and len(rows) == q.max_results else None


def streamed(q: IndexQuery, postings: DataFrame | None, keys: DataFrame) -> Iterator[Row]:
    """Rows as partitions come."""
    return lookup(q, postings, keys).toLocalIterator(prefetchPartitions=True)


def parsed(entries: DataFrame, group: list[str]) -> DataFrame:
    """Validate raw index entries (``field``, ``value``) per object: ``entries`` sorted and distinct where all are sound, else ``errors``."""
    name = F.lower("field")
    binary = name.endswith(BINARY_SUFFIX) & (F.length(name) > len(BINARY_SUFFIX))
    integer = name.endswith(INTEGER_SUFFIX) & (F.length(name) > len(INTEGER_SUFFIX))
    special = name.isin(KEY_FIELD, BUCKET_FIELD)
    error = F.when(special | binary | (integer & F.col("value").rlike("^[+-]?[0-9]+$")), F.lit(None).cast("string")).otherwise(
        F.when(integer, F.concat(F.lit("field_parsing_failed:"), name, F.lit(":"), F.col("value"))).otherwise(F.concat(F.lit("unknown_field_type:"), name))
    )
    held = entries.select(*group, name.alias("field"), F.when(integer, F.regexp_replace("value", r"^([+-]?)0*([0-9])", "$1$2")).otherwise(F.col("value")).alias("value"), error.alias("error"))
    out = held.groupBy(*group).agg(F.array_sort(F.collect_set(F.when(F.col("error").isNull(), F.struct("field", "value")))).alias("entries"), F.array_sort(F.collect_set("error")).alias("errors"))
    return out.withColumn("entries", F.when(F.size("errors") == 0, F.col("entries")))


def spec_diff(old: Column, new: Column) -> Column:
    """What an overwrite does to the index: (op, entry) of entries that are new, then of those that are gone."""
    def marked(op, entries):
        return F.transform(entries, lambda e: F.struct(F.lit(op).alias("op"), e.alias("entry")))

    return F.concat(marked("add", F.array_except(new, old)), marked("remove", F.array_except(old, new)))


def one_replica(rows: DataFrame, key: list[str], replica: str) -> DataFrame:
    """One row a key of a table that holds replicas: the lowest replica's."""
    first = W.partitionBy(*key).orderBy(replica)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def merge_sorted(sources: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of sorted sources in one order, duplicates kept."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy(*order)


def index_repairs(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Differences both ways between the stored postings and those that objects imply: (op, ...posting)."""
    columns = derived.columns
    missing = derived.exceptAll(stored.select(*columns)).withColumn("op", F.lit("add"))
    extra = stored.select(*columns).exceptAll(derived).withColumn("op", F.lit("remove"))
    return missing.unionByName(extra)
