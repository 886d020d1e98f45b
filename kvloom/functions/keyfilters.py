"""Key filters: chains of transforms and predicates over a key, compiled to one Column.

A chain is a list of ``[name, *arguments]``, applied left to right; the last step of a filter must yield a boolean. An empty chain keeps everything.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class BadFilter(ValueError):
    """A filter that does not exist, or a chain that cannot run."""


@F.pandas_udf(StringType())
def _scientific(v: pd.Series) -> pd.Series:
    """Twenty digits after the point, as no built-in prints them."""
    return v.map(lambda x: None if pd.isna(x) else "%.20e" % x)


def _gate(v: Column, pattern: str, kind: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.coalesce(v, F.lit("null"))))
    return F.when(v.rlike(pattern), v.cast(kind)).when(v.isNotNull(), bad.cast(kind))


def int_to_string(v: Column) -> Column:
    return v.cast("string")


def string_to_int(v: Column) -> Column:
    """Digits with a sign at most; anything else fails the query."""
    return _gate(v, "^[+-]?[0-9]+$", "bigint")


def float_to_string(v: Column) -> Column:
    return _scientific(v.cast("double"))


def string_to_float(v: Column) -> Column:
    """A decimal point is required."""
    return _gate(v, r"^[+-]?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$", "double")


def to_upper(v: Column) -> Column:
    return F.upper(v.cast("string"))


def to_lower(v: Column) -> Column:
    return F.lower(v.cast("string"))


def tokenize(v: Column, separators: str, n: int) -> Column:
    """The n-th token from 1 between any of the separators' characters; empty tokens do not count, and too few tokens fail the query."""
    parts = F.filter(F.split(v, "[" + re.sub(r"([\\\]\[^&~-])", r"\\\1", separators) + "]"), lambda t: t != "")
    return F.element_at(parts, n)


def urldecode(v: Column) -> Column:
    return F.url_decode(v)


def greater_than(v: Column, x) -> Column:
    return v > F.lit(x)


def less_than(v: Column, x) -> Column:
    return v < F.lit(x)


def greater_than_eq(v: Column, x) -> Column:
    return v >= F.lit(x)


def less_than_eq(v: Column, x) -> Column:
    return v <= F.lit(x)


def between(v: Column, low, high, inclusive: bool = True) -> Column:
    """Both ends count, or neither."""
    return (v >= F.lit(low)) & (v <= F.lit(high)) if inclusive else (v > F.lit(low)) & (v < F.lit(high))


def matches(v: Column, pattern: str) -> Column:
    """A search: the pattern need not cover the whole value."""
    return v.cast("string").rlike(pattern)


def neq(v: Column, x) -> Column:
    return v != F.lit(x)


def eq(v: Column, x) -> Column:
    return v == F.lit(x)


def _text(x) -> str:
    """A literal's text form; numbers with a point have twenty digits after it."""
    return "%.20e" % x if isinstance(x, float) else str(x)


def set_member(v: Column, *members) -> Column:
    """Membership by text form."""
    return v.cast("string").isin(*[_text(m) for m in members])


def similar_to(v: Column, other: str, distance: int) -> Column:
    return F.levenshtein(v.cast("string"), F.lit(_text(other))) <= distance


def starts_with(v: Column, prefix: str) -> Column:
    return v.cast("string").startswith(_text(prefix))


def ends_with(v: Column, suffix: str) -> Column:
    return v.cast("string").endswith(_text(suffix))


def and_all(v: Column, *chains, floats: bool = False) -> Column:
    return reduce(and_, [compiled(c, v, floats) for c in chains])


def or_any(v: Column, *chains, floats: bool = False) -> Column:
    return reduce(or_, [compiled(c, v, floats) for c in chains])


def not_first(v: Column, chain, *_ignored, floats: bool = False) -> Column:
    """Only the first chain counts."""
    return ~compiled(chain, v, floats)


def sounds_like(*_) -> Column:
    raise NotImplementedError("sounds_like has a name but no meaning")


FILTERS = {
    f.__name__: f
    for f in (int_to_string, string_to_int, float_to_string, string_to_float, to_upper, to_lower, tokenize, urldecode, greater_than, less_than, greater_than_eq, less_than_eq, between, matches, neq, eq, set_member, similar_to, starts_with, ends_with, sounds_like)
} | {"and": and_all, "or": or_any, "not": not_first}


#: Predicates on the text form of a value, and filters that take chains.
BY_TEXT, NESTED = ("set_member", "similar_to", "starts_with", "ends_with"), ("and", "or", "not")


def compiled(chain: Sequence[Sequence], value: Column, floats: bool = False) -> Column:
    """The chain as a Column of ``value``. ``floats``: the value is a floating-point number, whose text form is that of ``float_to_string``."""
    if chain and isinstance(chain[0], str):  # one step, not in a list
        chain = [chain]
    out = value
    for step in chain:
        name, *args = step
        if name not in FILTERS:
            raise BadFilter(f"bad_filter: {name}")
        if name in NESTED:
            out = FILTERS[name](out, *args, floats=floats)
        else:
            out = FILTERS[name](_scientific(out.cast("double")) if floats and name in BY_TEXT else out, *args)
        floats = name == "string_to_float"
    return out if chain else F.lit(True)


def keep(df, chain: Sequence[Sequence], column: str = "key"):
    """Rows for which the chain is exactly true."""
    return df.filter(compiled(chain, F.col(column), df.schema[column].dataType.typeName() in ("float", "double")))
