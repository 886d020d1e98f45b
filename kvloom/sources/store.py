"""Stores of objects: parquet, cached memory, several routed together, synthetic; and what clients do with them."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kvloom.functions import clocks, keyfilters, scalars
from kvloom.model import DEFAULT_TYPE, MAX_KEY_BYTES, OBJECTS, POSTINGS, keystore_of, postings_of, sibling
from kvloom.operators import reconcile
from kvloom.operators.index import IndexesNotSupported

NAME = ["bucket_type", "bucket", "key"]


class Backend(Protocol):
    """What a store offers; everything else is built on these."""

    indexes: bool

    def objects(self) -> DataFrame: ...

    def write(self, objects: DataFrame) -> None: ...

    def drop(self) -> None: ...


class ParquetStore:
    """Objects in parquet files, partitioned by type and bucket and sorted by key, so that a bucket is a folder and a key range skips row groups.

    A write goes to a new version beside the old one and is named by one small file, so readers of the old version are not disturbed. The index is
    written before its objects, by bucket and field and sorted by term.
    """

    def __init__(self, spark: SparkSession, path: str, indexes: bool = True) -> None:
        self.spark, self.path, self.indexes = spark, path.rstrip("/"), indexes

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _version(self) -> str | None:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return None
        done = [f.getPath() for f in fs.listStatus(path(self.path)) if f.getPath().getName().startswith("v") and fs.exists(path(f.getPath(), "_SUCCESS"))]
        return max((p.toString() for p in done), default=None)

    def objects(self) -> DataFrame:
        at = self._version()
        if at is None:
            return self.spark.createDataFrame([], OBJECTS)
        return self.spark.read.schema(OBJECTS).parquet(at)

    def write(self, objects: DataFrame) -> None:
        long = F.octet_length("key") > MAX_KEY_BYTES
        checked = objects.withColumn("key", F.when(long, F.raise_error(F.lit("key_too_large")).cast("string")).otherwise(F.col("key")))
        name = f"{time.time_ns():020d}"
        # ranges of keys, as many as shuffle partitions and fewer where these are small: files of a bucket hold disjoint ranges
        if self.indexes:
            entries = [*NAME[:2], "field", "term_bin", "term_int", "key"]
            postings_of(checked).repartitionByRange(*entries).sortWithinPartitions(*entries).write.partitionBy(*NAME[:2], "field").parquet(f"{self.path}/index-{name}")
        checked.repartitionByRange(*NAME).sortWithinPartitions(*NAME).write.partitionBy("bucket_type", "bucket").parquet(f"{self.path}/v{name}")

    def postings(self) -> DataFrame:
        """The index as it was written: a field is a folder, and a range of terms skips files and row groups."""
        at = self._version()
        if not self.indexes:
            raise IndexesNotSupported(type(self).__name__)
        if at is None:
            return self.spark.createDataFrame([], POSTINGS)
        folder, _, version = at.rpartition("/v")
        return self.spark.read.schema(POSTINGS).parquet(f"{folder}/index-{version}")

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def backup(self, to: str) -> None:
        """A copy of the present version, anywhere but inside the store."""
        if to.rstrip("/").startswith(self.path):
            raise ValueError("bad_request: a backup cannot go into its store")
        self.objects().write.partitionBy("bucket_type", "bucket").parquet(to)


class MemoryStore:
    """Objects cached in executors; with a time to live, rows older than it are not seen."""

    indexes = True

    def __init__(self, spark: SparkSession, ttl: int | None = None) -> None:
        self.spark, self.ttl, self._held = spark, ttl, None

    def objects(self) -> DataFrame:
        if self._held is None:
            return self.spark.createDataFrame([], OBJECTS)
        return self._held if self.ttl is None else alive(self._held, self.ttl)

    def write(self, objects: DataFrame) -> None:
        new = objects.persist()
        new.count()
        old, self._held = self._held, new
        if old is not None:
            old.unpersist()

    def drop(self) -> None:
        if self._held is not None:
            self._held.unpersist()
        self._held = None


class MultiStore:
    """Several stores; a bucket goes where its name's prefix says, else where its property says, else to the default."""

    def __init__(self, stores: Mapping[str, Backend], default: str, prefixes: Mapping[str, str] = (), buckets: Mapping[str, str] = ()) -> None:
        self.stores, self.default, self.prefixes, self.buckets = dict(stores), default, dict(prefixes), dict(buckets)

    @property
    def indexes(self) -> bool:
        return all(s.indexes for s in self.stores.values())

    def route(self, bucket: Column) -> Column:
        return routed(bucket, self.default, self.prefixes, self.buckets)

    def objects(self) -> DataFrame:
        """Of every store the rows that are its own."""
        parts = [s.objects().filter(self.route(F.col("bucket")) == name) for name, s in self.stores.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write(self, objects: DataFrame) -> None:
        for name, s in self.stores.items():
            s.write(objects.filter(self.route(F.col("bucket")) == name))

    def drop(self) -> None:
        for s in self.stores.values():
            s.drop()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; one of our own only where none is set and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kvloom-')}"
    return f"{found.rstrip('/')}/kvloom/{name}-{uuid.uuid4().hex}"


def routed(bucket: Column, default: str, prefixes: Mapping[str, str] = (), buckets: Mapping[str, str] = ()) -> Column:
    """Name of the store of a bucket: prefixes first, the longest before others, then the bucket's own property."""
    out = None
    for prefix, name in sorted(dict(prefixes).items(), key=lambda p: -len(p[0])):
        out = (F.when if out is None else out.when)(bucket.startswith(prefix), name)
    for b, name in dict(buckets).items():
        out = (F.when if out is None else out.when)(bucket == b, name)
    return F.lit(default) if out is None else out.otherwise(default)


def alive(rows: DataFrame, ttl: int, now: Column | None = None, last_mod: str | None = None) -> DataFrame:
    """Rows not older than ``ttl`` seconds, times rounded to whole ones; those without a time stay."""
    at = F.col(last_mod) if last_mod else F.array_max(F.transform("siblings", lambda s: s["last_mod"]))
    since = F.coalesce(now, F.current_timestamp()) if now is not None else F.current_timestamp()
    return rows.filter(at.isNull() | (scalars.epoch(at) + ttl >= scalars.epoch(since)))


def synthetic(spark: SparkSession, n: int, bucket: str = "synthetic", size: int = 16) -> DataFrame:
    """``n`` made-up objects of one bucket: values depend on the key alone."""
    rows = spark.range(n).select(F.lit(DEFAULT_TYPE).alias("bucket_type"), F.lit(bucket).alias("bucket"), F.col("id").cast("string").alias("key"))
    value = F.repeat(F.md5("key"), -(-size // 32)).substr(1, size)
    return rows.select("*", F.create_map(F.lit("origin"), F.lit(1).cast("bigint")).alias("clock"), F.array(sibling(value)).alias("siblings"))


# ------------------------------------------------------------------ a client

class Client:
    """Reads and writes of a store. Reads are plans; writes replace the store's version."""

    def __init__(self, store: Backend, precommit: Sequence[Callable[[DataFrame], DataFrame]] = (), postcommit: Sequence[Callable[[DataFrame], None]] = ()) -> None:
        """Hooks: those before a write see its rows and give what is written, or raise; those after see what was written."""
        self.store, self.precommit, self.postcommit = store, tuple(precommit), tuple(postcommit)

    def get(self, bucket: str, key: str, bucket_type: str = DEFAULT_TYPE) -> Row | None:
        """The object, or None where it is missing or a tombstone."""
        rows = get(self.store.objects(), bucket, key, bucket_type).filter(~F.forall("siblings", lambda s: s["deleted"])).limit(1).collect()
        return rows[0] if rows else None

    def head(self, bucket: str, key: str, bucket_type: str = DEFAULT_TYPE) -> Row | None:
        rows = heads(get(self.store.objects(), bucket, key, bucket_type)).limit(1).collect()
        return rows[0] if rows else None

    def put(self, rows: DataFrame, allow_mult: bool = True, last_write_wins: bool = False) -> None:
        """``rows`` (bucket_type, bucket, key, clock, siblings) over what is stored."""
        for hook in self.precommit:
            rows = hook(rows)
        self.store.write(merge_objects(self.store.objects(), rows, allow_mult, last_write_wins))
        for hook in self.postcommit:
            hook(rows)

    def delete(self, keys: DataFrame) -> None:
        """Tombstones for (bucket_type, bucket, key) with the clock that was read."""
        self.store.write(tombstoned(self.store.objects(), keys))

    def compact(self, mode: str | int = 3000, now: Column | None = None) -> None:
        self.store.write(compacted(self.store.objects(), mode, now))

    def keys(self, bucket: str, chain: Sequence = (), bucket_type: str = DEFAULT_TYPE) -> DataFrame:
        return list_keys(self.store.objects(), bucket, chain, bucket_type)

    def buckets(self, bucket_type: str = DEFAULT_TYPE) -> DataFrame:
        return list_buckets(self.store.objects(), bucket_type)

    def stream_buckets(self, bucket_type: str = DEFAULT_TYPE) -> Iterator[str]:
        return (r["bucket"] for r in self.buckets(bucket_type).toLocalIterator())

    def postings(self) -> DataFrame:
        if not self.store.indexes:
            raise IndexesNotSupported(type(self.store).__name__)
        return self.store.postings() if hasattr(self.store, "postings") else postings_of(self.store.objects())

    def keystore(self) -> DataFrame:
        return keystore_of(self.store.objects())

    def is_empty(self) -> bool:
        return self.store.objects().isEmpty()


def get(objects: DataFrame, bucket: str, key: str, bucket_type: str = DEFAULT_TYPE) -> DataFrame:
    return objects.filter((F.col("bucket_type") == bucket_type) & (F.col("bucket") == bucket) & (F.col("key") == key))


def heads(objects: DataFrame) -> DataFrame:
    """Objects with sizes in place of values."""
    return objects.withColumn("siblings", F.transform("siblings", lambda s: s.dropFields("value").withField("size", F.octet_length(s["value"]))))


def list_keys(objects: DataFrame, bucket: str, chain: Sequence = (), bucket_type: str = DEFAULT_TYPE) -> DataFrame:
    """Keys of a bucket that pass a filter chain; tombstones are keys too."""
    rows = objects.filter((F.col("bucket_type") == bucket_type) & (F.col("bucket") == bucket)).select("key")
    return keyfilters.keep(rows, chain)


def list_buckets(objects: DataFrame, bucket_type: str = DEFAULT_TYPE) -> DataFrame:
    return objects.filter(F.coalesce("bucket_type", F.lit(DEFAULT_TYPE)) == bucket_type).select("bucket").distinct()


def fold_objects(objects: DataFrame, bucket: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """All objects, a bucket's, or a key range of a bucket."""
    rows = objects if bucket is None else objects.filter(F.col("bucket") == bucket)
    rows = rows if low is None else rows.filter(F.col("key") >= low)
    return rows if high is None else rows.filter(F.col("key") < high)


def fold_postings(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "field").agg(F.count("*").alias("n"))


def merge_objects(stored: DataFrame, new: DataFrame, allow_mult: bool = True, last_write_wins: bool = False) -> DataFrame:
    """Whole objects over stored ones: descendants replace, others become siblings, deleted by one side's later clock."""
    if last_write_wins:
        return stored.join(new.select(*NAME), NAME, "left_anti").unionByName(new)
    both = stored.unionByName(new).groupBy(*NAME).agg(F.collect_list(F.struct("clock", "siblings")).alias("r"))
    live = both.withColumn("r", reconcile.undominated(F.col("r")))
    clock = F.aggregate("r", F.create_map().cast("map<string,bigint>"), lambda a, x: clocks.merged(a, x["clock"]))
    # maps have no order or equality: contents are told apart by their text
    every = F.flatten(F.transform("r", lambda x: x["siblings"]))
    texts = F.transform(every, lambda s: F.to_json(s))
    first = F.filter(every, lambda s, i: F.array_position(texts, F.to_json(s)) == i + 1)
    out = live.select(*NAME, clock.alias("clock"), first.alias("siblings"))
    if not allow_mult:
        order = lambda s: F.struct((-F.coalesce(F.unix_micros(s["last_mod"]), F.lit(-(1 << 62)))).alias("t"), s["deleted"].alias("d"), s["value"].alias("v"))
        best = F.array_min(F.transform("siblings", order))
        out = out.withColumn("_b", best).withColumn("siblings", F.slice(F.filter("siblings", lambda s: order(s) == F.col("_b")), 1, 1)).drop("_b")
    return out


def tombstoned(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Objects with a tombstone in place of each (bucket_type, bucket, key, clock) that is still as it was read."""
    now = keys.select(*NAME, clocks.text(F.col("clock")).alias("_then"))
    gone = F.array(sibling(F.lit(""), last_mod=F.current_timestamp(), deleted=F.lit(True)))
    both = objects.join(now, NAME, "left").withColumn("siblings", F.when(clocks.text(F.col("clock")) == F.col("_then"), gone).otherwise(F.col("siblings")))
    return both.select(*objects.columns)


def compacted(objects: DataFrame, mode: str | int = 3000, now: Column | None = None) -> DataFrame:
    """Objects without the tombstones that the delete mode lets go: keep none away, immediate all, or those older than so many milliseconds."""
    if mode == "keep":
        return objects
    dead = F.forall("siblings", lambda s: s["deleted"])
    if mode == "immediate":
        return objects.filter(~dead)
    at = F.array_max(F.transform("siblings", lambda s: s["last_mod"]))
    passed = F.unix_millis(F.current_timestamp() if now is None else now) - F.unix_millis(at) > int(mode)
    return objects.filter(~(dead & F.coalesce(passed, F.lit(True))))


def to_json(objects: DataFrame) -> DataFrame:
    """(bucket, key, json); events of siblings do not leave the store."""
    values = F.transform("siblings", lambda s: F.struct(s.dropFields("value", "dot").alias("metadata"), s["value"].alias("data")))
    body = F.to_json(F.struct("bucket_type", "bucket", "key", F.col("clock").alias("vclock"), values.alias("values")))
    return objects.select("bucket", "key", body.alias("json"))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    meta = "struct<content_type:string,last_mod:timestamp,deleted:boolean,vtag:string,indexes:map<string,array<string>>,links:array<struct<bucket:string,key:string,tag:string>>,meta:map<string,string>>"
    schema = f"bucket_type string, bucket string, key string, vclock map<string,bigint>, `values` array<struct<metadata:{meta},data:string>>"
    o = rows.select(F.from_json(column, schema).alias("o")).select("o.*")
    back = F.transform("values", lambda v: F.struct(v["data"].alias("value"), v["metadata"]["content_type"].alias("content_type"), v["metadata"]["last_mod"].alias("last_mod"), v["metadata"]["deleted"].alias("deleted"), v["metadata"]["vtag"].alias("vtag"), F.lit(None).cast("struct<actor:string,counter:bigint>").alias("dot"), v["metadata"]["indexes"].alias("indexes"), v["metadata"]["links"].alias("links"), v["metadata"]["meta"].alias("meta")))
    return o.select("bucket_type", "bucket", "key", F.col("vclock").alias("clock"), back.alias("siblings"))


def choose(objects: DataFrame, vtag: str | None = None) -> DataFrame:
    """(bucket, key, value, vtags): the one sibling, or the one of ``vtag``; else the tags to choose from."""
    some = F.col("siblings") if vtag is None else F.filter("siblings", lambda s: s["vtag"] == vtag)
    return objects.select("bucket", "key", F.when(F.size(some) == 1, some[0]["value"]).alias("value"), F.array_sort(F.transform("siblings", lambda s: s["vtag"])).alias("vtags"))
