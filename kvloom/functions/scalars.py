"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def power10(size: Column) -> Column:
    """Order of magnitude: 0 for 0 to 9, 1 for 10 to 99, and so on; free of floating point."""
    return F.length(size.cast("string")) - 1


def quorum(n: int) -> int:
    """More than half."""
    return n // 2 + 1


def wanted(value: str | int, n: int) -> int:
    """one, quorum or all of ``n``, or the number itself."""
    return {"one": 1, "quorum": quorum(n), "all": n}.get(value, value) if isinstance(value, str) else value


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, rounded, halves to even, as SQL casts them."""
    whole, part = F.unix_timestamp(ts), F.extract(F.lit("SECOND"), ts) % 1
    return whole + F.when((part > 0.5) | ((part == 0.5) & (whole % 2 != 0)), 1).otherwise(0)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def segment(bucket: Column, key: Column, segments: int, portable: bool = False) -> Column:
    """The hash-tree segment of a key."""
    name = F.concat(bucket, F.lit("/"), key)
    if portable:
        return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % segments).cast("int")
    return F.pmod(F.xxhash64(name), F.lit(segments)).cast("int")


def owner(bucket: Column, key: Column, partitions: int) -> Column:
    """Partition that owns a key: diagnostic, Spark places rows itself."""
    return segment(bucket, key, partitions)


def link_targets(header: Column, prefix: str = "kv") -> Column:
    """(bucket, key, tag) of a comma-separated Link header, in two shapes of reference: ``</buckets/B[/keys/K]>`` and ``</prefix/B[/K]>``.

    A bucket's own link has a null key. Names are URL-decoded.
    """
    each = F.regexp_extract_all(header, F.lit(r'(<[^>]*>; *[a-z]+="[^"]*")'), F.lit(1))
    shape = rf'^</(?:buckets|{prefix})/([^/>]+)(?:/(?:keys/)?([^/>]+))?>; *[a-z]+="([^"]*)"$'
    part = lambda s, n: F.url_decode(F.regexp_extract(s, shape, n))
    return F.transform(F.filter(each, lambda s: s.rlike(shape)), lambda s: F.struct(part(s, 1).alias("bucket"), F.nullif(part(s, 2), F.lit("")).alias("key"), part(s, 3).alias("tag")))
