"""Folds over the keystore: scans and aggregates of per-key metadata. Ranges include both ends; modification times are epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions import clocks, scalars

#: Names of tree sizes, and keys that a replication fold hands over at a time.
TREE_SIZES = ("xxsmall", "xsmall", "small", "medium", "large", "xlarge")
BATCH = 128
#: Our own geometry: segments of each tree size, a branch holds 1024 of them at most.
SEGMENTS = {"xxsmall": 1 << 8, "xsmall": 1 << 12, "small": 1 << 14, "medium": 1 << 16, "large": 1 << 20, "xlarge": 1 << 22}
BRANCH = 1024


@dataclass(frozen=True)
class Scope:
    """What a fold looks at."""

    bucket: str
    key_range: tuple[str, str] | None = None
    modified: tuple[int, int] | None = None
    segments: Sequence[int] | None = None
    tree_size: str = "large"
    bucket_type: str = "default"
    portable: bool = False

    def checked(self) -> Scope:
        for low, high in (r for r in (self.key_range, self.modified) if r):
            if high < low:
                raise ValueError(f"empty range {low}..{high}")
        if self.tree_size not in SEGMENTS:
            raise ValueError(f"no tree size {self.tree_size}")
        return self


def scoped(keystore: DataFrame, s: Scope) -> DataFrame:
    """Keys in scope: all conditions are plain filters."""
    s = s.checked()
    rows = keystore.filter((F.col("bucket_type") == s.bucket_type) & (F.col("bucket") == s.bucket))
    if s.key_range:
        rows = rows.filter(F.col("key").between(*s.key_range))
    if s.modified:
        rows = rows.filter(F.col("last_mod").between(*[F.timestamp_seconds(F.lit(x)) for x in s.modified]))
    if s.segments is not None:
        rows = rows.filter(segment_of(s).isin(*s.segments))
    return rows


def segment_of(s: Scope) -> Column:
    return scalars.segment(F.col("bucket"), F.col("key"), SEGMENTS[s.tree_size], s.portable)


def tree(keystore: DataFrame, s: Scope, iv: int | None = None) -> DataFrame:
    """(branch, segment, seg_hash): XOR of key-and-clock hashes, so order and partitioning do not matter. ``iv`` salts the clocks' hashes."""
    salted = clocks.hashed(F.col("clock"), iv, s.portable)
    name = F.concat("bucket", F.lit("/"), "key", F.lit("@"), clocks.text(F.col("clock")))
    body = F.conv(F.substring(F.md5(name if iv is None else F.concat(F.lit(f"{iv}:"), name)), 1, 15), 16, 10).cast("bigint") if s.portable else F.xxhash64("bucket", "key", salted)
    each = scoped(keystore, s).select(segment_of(s).alias("segment"), body.alias("h"))
    return each.groupBy("segment").agg(F.bit_xor("h").alias("seg_hash")).select((F.col("segment") / BRANCH).cast("int").alias("branch"), "segment", "seg_hash")


def root(tree: DataFrame) -> DataFrame:
    """(branch, branch_hash) of a tree."""
    return tree.groupBy("branch").agg(F.bit_xor("seg_hash").alias("branch_hash"))


def branches(tree: DataFrame, ids: Sequence[int]) -> DataFrame:
    return tree.filter(F.col("branch").isin(*ids))


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Segments whose hashes differ or that only one side has."""
    x, y = a.select("segment", F.col("seg_hash").alias("ha")), b.select("segment", F.col("seg_hash").alias("hb"))
    return x.join(y, "segment", "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("segment")


def fetch_clocks(keystore: DataFrame, s: Scope, ordered: bool = True) -> DataFrame:
    """Distinct (bucket, key, clock text) in scope."""
    rows = scoped(keystore, s).select("bucket", "key", clocks.text(F.col("clock")).alias("clock")).distinct()
    return rows.orderBy("bucket", "key") if ordered else rows


def find_keys(keystore: DataFrame, s: Scope, *, sibling_count: int | None = None, object_size: int | None = None) -> DataFrame:
    """Keys with more siblings, or more bytes, than given."""
    column, least = ("sib_count", sibling_count) if sibling_count is not None else ("size", object_size)
    return scoped(keystore, s).filter(F.col(column) > least).select("bucket", "key", column)


def object_stats(keystore: DataFrame, s: Scope) -> DataFrame:
    """(stat, id, n): count and bytes in all, keys by size's power of ten, keys by sibling count. One pass; a row a stat is shuffled."""
    rows = scoped(keystore, s)
    def stat(name, i, n):
        return F.struct(F.lit(name).alias("stat"), i.cast("int").alias("id"), n.cast("bigint").alias("n"))

    none, one = F.lit(0), F.lit(1)
    stats = F.array(stat("total_count", none, one), stat("total_size", none, F.col("size")), stat("sizes", scalars.power10(F.col("size")), one), stat("siblings", F.col("sib_count"), one))
    return rows.select(F.explode(stats).alias("s")).groupBy("s.stat", "s.id").agg(F.sum("s.n").alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """Histograms (id, n) added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("n").alias("n"))


def delete_hash(portable: bool = False) -> Column:
    return clocks.hashed(F.col("clock"), None, portable)


def find_tombs(keystore: DataFrame, s: Scope) -> DataFrame:
    return scoped(keystore, s).filter("is_tombstone").select("bucket", "key", delete_hash(s.portable).alias("delete_hash"))


def reap_tombs(keystore: DataFrame, s: Scope) -> DataFrame:
    """How many tombstones are in scope."""
    return scoped(keystore, s).filter("is_tombstone").agg(F.count("*").alias("n"))


def reaped(keystore: DataFrame, tombs: DataFrame, portable: bool = False) -> DataFrame:
    """The keystore without tombstones found earlier, if they are still tombstones of the same clock."""
    marked = keystore.withColumn("delete_hash", delete_hash(portable))
    gone = marked.filter("is_tombstone").select("bucket_type", "bucket", "key", "delete_hash").join(tombs.select("bucket", "key", "delete_hash"), ["bucket", "key", "delete_hash"], "left_semi")
    return keystore.join(gone, ["bucket_type", "bucket", "key"], "left_anti")


def erase_keys(keystore: DataFrame, s: Scope) -> DataFrame:
    """How many live keys are in scope."""
    return scoped(keystore, s).filter("not is_tombstone").agg(F.count("*").alias("n"))


def erased(keystore: DataFrame, wanted: DataFrame) -> DataFrame:
    """The keystore with tombstones in place of the wanted (bucket, key, clock) whose clock is still the same."""
    now = wanted.select("bucket", "key", F.col("clock").alias("_then"), F.lit(True).alias("_gone"))
    both = keystore.withColumn("_now", clocks.text(F.col("clock"))).join(now, ["bucket", "key"], "left")
    return both.withColumn("is_tombstone", F.col("is_tombstone") | (F.coalesce("_gone", F.lit(False)) & F.coalesce(F.col("_now") == F.col("_then"), F.lit(False)))).select(*keystore.columns)


def repl_keys(keystore: DataFrame, s: Scope) -> DataFrame:
    """What a replication fold sends: (bucket, key, clock), dealt to batches of up to 128 a partition."""
    rows = scoped(keystore, s).select("bucket", "key", clocks.text(F.col("clock")).alias("clock"))
    nth = F.monotonically_increasing_id()
    return rows.withColumn("batch", F.floor(nth / BATCH))


def repair_keys(keystore: DataFrame, s: Scope) -> DataFrame:
    """What a repair fold reads again: (bucket, key) of every key in scope, to be fetched and mended."""
    return scoped(keystore, s).select("bucket", "key")


def dispatched(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def list_buckets(keystore: DataFrame, bucket_type: str | None = None) -> DataFrame:
    rows = keystore if bucket_type is None else keystore.filter(F.col("bucket_type") == bucket_type)
    return rows.select("bucket").distinct()


def encoded(result: DataFrame) -> DataFrame:
    """A JSON text a row."""
    return result.select(F.to_json(F.struct(*result.columns)).alias("json"))


#: Query names of range folds, with what runs them.
FOLDS = {
    "merge_tree_range": tree, "fetch_clocks_range": fetch_clocks, "find_keys": find_keys, "object_stats": object_stats, "find_tombs": find_tombs,
    "reap_tombs": reap_tombs, "erase_keys": erase_keys, "repl_keys_range": lambda k, s: dispatched(repl_keys(k, s)), "repair_keys_range": lambda k, s: dispatched(repair_keys(k, s)),
}


def fold(name: str, keystore: DataFrame, scope: Scope, **options) -> DataFrame:
    """A fold by name; names and scopes are checked before anything runs."""
    if name == "list_buckets":
        return list_buckets(keystore)
    if name not in FOLDS:
        raise ValueError(f"no fold {name}")
    if not scope.bucket or scope.bucket == "all":
        raise ValueError("a range fold needs a bucket")
    return FOLDS[name](keystore, scope, **options)
