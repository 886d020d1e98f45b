"""Version clocks as ``map<string,bigint>`` Columns: actor to counter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(clock: Column, actor: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, actor), F.lit(0).cast("bigint"))


def descends(a: Column, b: Column) -> Column:
    """``a`` has seen all that ``b`` has; equal clocks descend from each other."""
    return F.forall(F.map_entries(b), lambda e: _of(a, e["key"]) >= e["value"])


def dominates(a: Column, b: Column) -> Column:
    return descends(a, b) & ~descends(b, a)


def equal(a: Column, b: Column) -> Column:
    return descends(a, b) & descends(b, a)


def merged(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def increment(clock: Column, actor: Column) -> Column:
    """One more event of ``actor``."""
    return F.map_concat(F.map_filter(clock, lambda k, _: k != actor), F.create_map(actor, _of(clock, actor) + 1))


def text(clock: Column) -> Column:
    """Canonical text of a clock: equal clocks have equal texts."""
    entries = F.array_sort(F.transform(F.map_entries(clock), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return F.array_join(entries, ",")


def hashed(clock: Column, iv: int | None = None, portable: bool = False) -> Column:
    """Hash of the sorted clock, salted by ``iv`` where given. The portable one is 60 bits of MD5, for engines without xxHash."""
    body = text(clock) if iv is None else F.concat(F.lit(f"{iv}:"), text(clock))
    return F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("bigint") if portable else F.xxhash64(body)
