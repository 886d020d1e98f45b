"""The canonical tables: objects, postings, keystore; and lenses that present plain tables as such.

objects   one row a (bucket_type, bucket, key): version clock and an array of siblings, each with value, metadata, index entries and links
postings  one row a (bucket, field, term, key): the secondary index; terms are binary-ordered text or integers
keystore  one row a key: what folds read, never the values
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest key in bytes, the untyped bucket type, the bare index fields and the suffixes of the others.
MAX_KEY_BYTES = 65536
DEFAULT_TYPE = "default"
KEY_FIELD, BUCKET_FIELD = "$key", "$bucket"
BINARY_SUFFIX, INTEGER_SUFFIX = "_bin", "_int"

SIBLING = (
    "struct<value:string,content_type:string,last_mod:timestamp,deleted:boolean,vtag:string,dot:struct<actor:string,counter:bigint>,"
    "indexes:map<string,array<string>>,links:array<struct<bucket:string,key:string,tag:string>>,meta:map<string,string>>"
)
OBJECTS = f"bucket_type string, bucket string, key string, clock map<string,bigint>, siblings array<{SIBLING}>"
POSTINGS = "bucket_type string, bucket string, field string, term_bin string, term_int bigint, key string"
KEYSTORE = "bucket_type string, bucket string, key string, clock map<string,bigint>, size bigint, sib_count int, last_mod timestamp, is_tombstone boolean"


def sibling(value: Column, *, last_mod: Column | None = None, deleted: Column | None = None, vtag: Column | None = None, dot: Column | None = None, indexes: Column | None = None, links: Column | None = None, content_type: str = "application/json", meta: Column | None = None) -> Column:
    """One sibling of an object; what is not given is empty."""
    none = F.lit(None)
    return F.struct(
        value.cast("string").alias("value"),
        F.lit(content_type).alias("content_type"),
        (none if last_mod is None else last_mod).cast("timestamp").alias("last_mod"),
        (F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))).alias("deleted"),
        (none if vtag is None else vtag).cast("string").alias("vtag"),
        (none if dot is None else dot).cast("struct<actor:string,counter:bigint>").alias("dot"),
        (F.create_map() if indexes is None else indexes).cast("map<string,array<string>>").alias("indexes"),
        (F.array() if links is None else links).cast("array<struct<bucket:string,key:string,tag:string>>").alias("links"),
        (F.create_map() if meta is None else meta).cast("map<string,string>").alias("meta"),
    )


@dataclass(frozen=True)
class Lens:
    """Presents a table as objects, postings and keystore. Expressions are SQL over the table's columns."""

    table: str
    bucket: str
    key: str
    value: Sequence[str]
    indexes: Mapping[str, str] = field(default_factory=dict)
    links: Sequence[tuple[str, str, str]] = ()
    last_mod: str | None = None
    deleted: str | None = None
    clock: str | None = None
    unique: bool = True
    bucket_type: str = DEFAULT_TYPE

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet")

    def _key(self) -> Column:
        return F.expr(self.key).cast("string")

    def _named(self) -> list[Column]:
        return [F.lit(self.bucket_type).alias("bucket_type"), F.lit(self.bucket).alias("bucket"), self._key().alias("key")]

    def _value(self) -> Column:
        return F.to_json(F.struct(*self.value))

    def _sibling(self, at: Callable[[str], Column], parts: Sequence[str] | None) -> Column:
        """The sibling that a row is; ``at`` gives the value of an expression, ``parts`` the fields wanted, all if None."""
        want = lambda part: parts is None or part in parts
        value = F.to_json(F.struct(*[at(c).alias(c) for c in self.value])) if want("value") or want("vtag") else None
        entries = [x for name, e in self.indexes.items() for x in (F.lit(name), F.array(at(e).cast("string")))] if want("indexes") else []
        links = [F.struct(F.lit(b).alias("bucket"), at(k).cast("string").alias("key"), F.lit(t).alias("tag")) for b, k, t in self.links] if want("links") else []
        return sibling(
            value if want("value") else F.lit(None), last_mod=at(self.last_mod) if self.last_mod and want("last_mod") else None, deleted=at(self.deleted) if self.deleted and want("deleted") else None,
            vtag=F.md5(value) if want("vtag") else None, indexes=F.create_map(*entries) if entries else None, links=F.array(*links) if links else None,
        )

    def objects(self, rows: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
        """A row a key; rows that share a key become siblings in one shuffle, and unique keys need none.

        With ``parts`` the siblings' other fields stay empty. Only the columns that the parts are made of cross the network, each once.
        """
        none = F.create_map(F.lit("origin"), F.lit(1).cast("bigint"))
        if self.unique:
            clock = F.expr(self.clock) if self.clock else none
            return rows.select(*self._named(), clock.cast("map<string,bigint>").alias("clock"), F.array(self._sibling(F.expr, parts)).alias("siblings"))
        used: dict[str, str] = {}

        def seen(e: str) -> Column:
            used.setdefault(e, f"c{len(used)}")
            return F.expr(e)

        self._sibling(seen, parts)
        if self.clock:
            seen(self.clock)
        each = rows.select(self._key().alias("key"), *[F.expr(e).alias(c) for e, c in used.items()])
        # dealt out before they are gathered: hardly any two rows of a key meet sooner, and lists are wider than rows
        grouped = each.repartition("key").groupBy("key").agg(F.collect_list(F.struct(*used.values()) if used else F.struct(F.lit(0))).alias("r"))
        clock = F.col("r")[0][used[self.clock]] if self.clock else none
        siblings = F.transform("r", lambda r: self._sibling(lambda e: r[used[e]], parts))
        return grouped.select(*self._named()[:2], "key", clock.cast("map<string,bigint>").alias("clock"), siblings.alias("siblings"))

    def narrowed(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows that may have ``key``: where keys are a whole-number column, a filter on it that the scan can take."""
        if self.key not in rows.columns or rows.schema[self.key].dataType.typeName() not in ("byte", "short", "integer", "long"):
            return rows
        whole = key.removeprefix("-").isdigit() and str(int(key)) == key
        return rows.filter(F.col(self.key) == int(key)) if whole else rows.filter(F.lit(False))

    def _entry(self, name: str) -> list[Column]:
        whole, term = name.endswith(INTEGER_SUFFIX), F.expr(self.indexes[name])
        return [F.lit(name).alias("field"), (F.lit(None) if whole else term).cast("string").alias("term_bin"), (term if whole else F.lit(None)).cast("bigint").alias("term_int")]

    def postings(self, rows: DataFrame) -> DataFrame:
        """A row an index entry. Nothing is made distinct: a key with two terms in a range is found twice.

        A union of a part a field: a lookup of one field leaves one part, whose filter on the term is one on the column and reaches the scan.
        """
        out = None
        for name in self.indexes:
            part = rows.select(*self._named()[:2], *self._entry(name), self._key().alias("key"))
            out = part if out is None else out.unionByName(part)
        return out

    def all_postings(self, rows: DataFrame) -> DataFrame:
        """The same rows in one scan, for folds over every field."""
        each = rows.select(*self._named(), F.explode(F.array(*[F.struct(*self._entry(name)) for name in self.indexes])).alias("p"))
        return each.select("bucket_type", "bucket", "p.field", "p.term_bin", "p.term_int", "key")

    def edges(self, rows: DataFrame) -> DataFrame:
        """Links (bucket, key, to_bucket, to_key, tag) straight from the columns, without building objects."""
        targets = F.array(*[F.struct(F.lit(b).alias("to_bucket"), F.expr(k).cast("string").alias("to_key"), F.lit(t).alias("tag")) for b, k, t in self.links])
        each = rows.select(F.lit(self.bucket).alias("bucket"), self._key().alias("key"), F.inline(targets))
        return each if self.unique else each.distinct()

    def keystore(self, rows: DataFrame) -> DataFrame:
        """Size, sibling count, newest modification and tombstone flag of each key, without collecting values."""
        size = (F.octet_length(self._value()) + F.octet_length(self._key()) + F.octet_length(F.lit(self.bucket))).cast("bigint")
        modified = (F.lit(None) if self.last_mod is None else F.expr(self.last_mod)).cast("timestamp")
        deleted = F.lit(False) if self.deleted is None else F.coalesce(F.expr(self.deleted), F.lit(False))
        clock = (F.expr(self.clock) if self.clock else F.create_map(F.lit("origin"), F.lit(1).cast("bigint"))).cast("map<string,bigint>")
        each = rows.select(*self._named(), clock.alias("clock"), size.alias("size"), modified.alias("last_mod"), deleted.alias("is_tombstone"))
        if self.unique:
            return each.select("bucket_type", "bucket", "key", "clock", "size", F.lit(1).alias("sib_count"), "last_mod", "is_tombstone")
        return each.groupBy("bucket_type", "bucket", "key").agg(
            F.first("clock").alias("clock"), F.sum("size").alias("size"), F.count("*").cast("int").alias("sib_count"), F.max("last_mod").alias("last_mod"), F.min("is_tombstone").alias("is_tombstone")
        )


def postings_of(objects: DataFrame) -> DataFrame:
    """All siblings' index entries of canonical objects, as postings; one an object, field and term."""
    each = objects.select("bucket_type", "bucket", "key", F.explode("siblings").alias("s")).select("bucket_type", "bucket", "key", F.explode("s.indexes").alias("field", "terms"))
    each = each.select("bucket_type", "bucket", F.lower("field").alias("field"), "key", F.explode("terms").alias("term")).distinct()
    whole = F.col("field").endswith(INTEGER_SUFFIX)
    return each.select("bucket_type", "bucket", "field", F.when(~whole, F.col("term")).alias("term_bin"), F.when(whole, F.col("term").cast("bigint")).alias("term_int"), "key")


def keystore_of(objects: DataFrame) -> DataFrame:
    """The keystore of canonical objects. No siblings at all count as deleted; a tombstone has only deleted ones."""
    size = F.octet_length("bucket") + F.octet_length("key") + F.aggregate("siblings", F.lit(0), lambda a, s: a + F.octet_length(F.coalesce(s["value"], F.lit(""))))
    return objects.select(
        "bucket_type", "bucket", "key", "clock", size.cast("bigint").alias("size"), F.size("siblings").alias("sib_count"),
        F.array_max(F.transform("siblings", lambda s: s["last_mod"])).alias("last_mod"), F.forall("siblings", lambda s: s["deleted"]).alias("is_tombstone"),
    )


#: The driver's tables as buckets.
LENSES = {
    "orders": Lens(
        "orders", "orders", "o_orderkey", ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
        {"o_custkey_int": "o_custkey", "o_orderpriority_bin": "o_orderpriority", "o_orderstatus_bin": "o_orderstatus"}, (("customer", "o_custkey", "placed_by"),), "o_orderdate", "o_orderstatus = 'P'",
        "map('a', o_orderkey % 5 + 1, 'b', o_custkey % 3 + 1)",
    ),
    "lineitem": Lens(
        "lineitem", "lineitem", "concat(l_orderkey, '-', l_linenumber)", ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag"),
        {"l_partkey_int": "l_partkey", "l_suppkey_int": "l_suppkey", "l_returnflag_bin": "l_returnflag"}, (("orders", "l_orderkey", "order"), ("part", "l_partkey", "part"), ("supplier", "l_suppkey", "supplier")), "l_shipdate", unique=False,
    ),
    "customer": Lens("customer", "customer", "c_custkey", ("c_name", "c_nationkey", "c_mktsegment"), {"c_nationkey_int": "c_nationkey", "c_mktsegment_bin": "c_mktsegment"}, (("nation", "c_nationkey", "lives_in"),)),
    "supplier": Lens("supplier", "supplier", "s_suppkey", ("s_name", "s_nationkey"), {"s_nationkey_int": "s_nationkey"}, (("nation", "s_nationkey", "lives_in"),)),
    "part": Lens("part", "part", "p_partkey", ("p_name", "p_brand", "p_size"), {"p_brand_bin": "p_brand", "p_size_int": "p_size"}),
    "nation": Lens("nation", "nation", "n_nationkey", ("n_name", "n_regionkey"), {"n_regionkey_int": "n_regionkey"}, (("region", "n_regionkey", "part_of"),)),
    "region": Lens("region", "region", "r_regionkey", ("r_name",), {"r_name_bin": "r_name"}),
    "events": Lens("events", "events", "event_id", ("user_id", "event_type", "value"), {"user_id_int": "user_id", "event_type_bin": "event_type"}, (), "ts"),
    "documents": Lens("documents", "documents", "doc_id", ("lang", "source", "n_chars"), {"lang_bin": "lang", "source_bin": "source", "n_chars_int": "n_chars"}),
}
