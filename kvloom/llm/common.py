"""What the corpus operators share: scratch tables, bounded slices of text, word shingles, ranks."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SHINGLE_WORDS = 5
#: Bytes of text that a Python worker holds in numpy arrays at a time, besides one whole document.
SLICE_BYTES = 1 << 20
#: Rows of ``cut`` that one file holds, about, where their number is known.
FILE_ROWS = 20_000
#: Rows up to which a table of known size goes whole to the driver or to every executor.
FEW = 100_000

_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and there is no cluster, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _scratch.setdefault("own", [f"file://{tempfile.mkdtemp(prefix='kvloom-')}"])[0]
    return found.rstrip("/")


def cut(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    ``rows``: about how many things it is about, where known. A small table of many shuffle partitions then becomes no more files than two a core.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kvloom/{what}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    paths = _scratch.setdefault("paths", [])
    if not paths:
        atexit.register(release, spark)
    paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; call it when results that read them are stored."""
    for path in _scratch.pop("paths", []):
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone at exit
            return


def texts_of(docs: DataFrame, *columns: Column) -> DataFrame:
    """``docs.select(columns)``, read by Python in batches of 1000 rows at most, for texts can be long."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select(*columns)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again, and let Spark's cleaner find the shuffle files of finished jobs."""
    for df in tables:
        spark = df.sparkSession
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


#: Bits of the map of keys in ``told_apart``: a bound of what it broadcasts.
BITS = 1 << 27


def told_apart(df: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may have one of ``keys``, and rows that have none, so that these need not move to meet them.

    A bitmap of hashed keys, two million words at most, is broadcast; past its capacity it only tells fewer rows apart.
    """
    at = f"pmod(xxhash64({', '.join(names)}), {BITS})"
    bits = keys.select(F.expr(f"{at} div 64").alias("_w"), F.expr(f"shiftleft(1L, cast({at} % 64 as int))").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_set"))
    told = df.join(F.broadcast(bits), F.expr(f"{at} div 64") == F.col("_w"), "left")
    hit = F.coalesce(F.expr(f"getbit(_set, cast({at} % 64 as int)) = 1"), F.lit(False))
    return told.filter(hit).drop("_w", "_set"), told.filter(~hit).drop("_w", "_set")


#: Share of all rows from which on a key's rows stay where they are in ``with_facts``, so at most as many keys as its inverse are broadcast.
HEAVY = 1e-4


def with_facts(df: DataFrame, facts: DataFrame, key: str, rows: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``df`` left-joined with ``facts``, a row a ``key`` that tells how many ``rows`` have it: rows of heavy keys, and all others.

    Heavy keys, 10,000 at most, are broadcast, so no task gathers the rows of one of them; both parts together are the join.
    """
    heavy = facts.filter(F.col(rows) > max(1000.0, HEAVY * total))
    held = df.join(F.broadcast(heavy), key, "left")
    apart = F.col(rows).isNotNull()
    return held.filter(apart), held.filter(~apart).select(*df.columns).join(facts.filter(F.col(rows) <= max(1000.0, HEAVY * total)), key, "left")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learns(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn labels from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


# ------------------------------------------------------------------ text in numpy

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("0") : ord("9") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_FOLD = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] = _FOLD[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The prime's and its inverse's powers 0 to n, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            x = np.full(max(n + 1, SLICE_BYTES + 1), base)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary array as one run of bytes and its offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    run = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return run, at - at[0]


def give_back() -> None:
    """Hand memory that this worker has freed back to the system: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices whose ``column`` holds at most ``most`` bytes (or one row), with those bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        run, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), run[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
    give_back()


def word_spans(run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of ASCII letters, digits and bytes from 128), and each document's first word among them."""
    n = len(run)
    inside = _LETTER[run]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = inside[1:] != inside[:-1]
    if n:
        edge[0], edge[n] = inside[0], inside[-1]
    inner = at[(at > 0) & (at < n)]
    both = inside[inner] & inside[inner - 1]  # a word ends with its document
    cuts = np.flatnonzero(edge)
    if both.any():
        cuts = np.sort(np.concatenate([cuts, np.repeat(np.unique(inner[both]), 2)]))
    start, end = cuts[0::2], cuts[1::2]
    return start, end, np.searchsorted(start, at, "left")


def span_hashes(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z folded."""
    up, down = powers(len(run))
    sums = np.zeros(len(run) + 1, dtype=np.uint64)
    np.cumsum(_FOLD[run] * up[: len(run)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and their offsets."""
    start, end, first = word_spans(run, at)
    return span_hashes(run, start, end), first


def shingles(run: np.ndarray, at: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's ``width``-word shingles and their offsets; fewer words make one shingle, none make none."""
    hashed, first = words(run, at)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][doc] + np.arange(out_at[-1]) - out_at[:-1][doc]
    end = first[1:][doc]
    total = np.zeros(len(begin), dtype=np.uint64)
    padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
    for k in range(width):
        total = total * np.uint64(0x9FB21C651E98DF25) + np.where(begin + k < end, padded[begin + k], np.uint64(0))
        total ^= total >> np.uint64(29)
    return mix(total), out_at


def numbered(hashed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's multiset of shingles as a set: the k-th repeat of a shingle (k from 0) is an element of its own. Also k."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashed, doc))
    d, h = doc[order], hashed[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    k = np.arange(len(h)) - begin
    return np.where(k == 0, h, mix(h + k.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))), k


def lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


# ------------------------------------------------------------------ ranks without one large task

def ranked(df: DataFrame, group: list[str], spread: Column, order: list[Column], size: str | None = None, rows_each: int = 5_000) -> DataFrame:
    """Add ``rank`` (and ``before``: the sum of ``size`` ahead of a row), both from 0, within ``group`` in the order of (spread, *order).

    ``spread`` is a 64-bit hash of what orders the rows. Its top bits split every group, so no group, however large, meets in one task:
    ranks count within a split, and the splits' counts, a small table, are summed up ahead of each.
    Rows equal in all of ``order`` must be equal in ``spread`` too; they may swap ranks.
    """
    n = max(1, df.count())
    bits = min(40, max(0, (n // rows_each).bit_length()))
    split = F.shiftright(F.col("_spread"), 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    held = df.withColumn("_spread", spread).withColumn("_split", split)
    amount = F.col(size).cast("long") if size else F.lit(0).cast("long")
    within = W.partitionBy(*group, "_split").orderBy("_spread", *order)
    running = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    held = held.withColumn("_rank", F.row_number().over(within).cast("long") - 1).withColumn("_before", F.sum(amount).over(running) - amount)
    counts = df.withColumn("_spread", spread).withColumn("_split", split).groupBy(*group, "_split").agg(F.count("*").alias("_n"), F.sum(amount).alias("_size"))
    ahead = W.partitionBy(*group).orderBy("_split").rowsBetween(W.unboundedPreceding, W.currentRow) if group else W.partitionBy(F.lit(0)).orderBy("_split").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_split").alias("_s"), (F.sum("_n").over(ahead) - F.col("_n")).alias("_n0"), (F.sum("_size").over(ahead) - F.col("_size")).alias("_b0"))
    on = (F.col("_split") == F.col("_s")) if not group else F.col("_split").eqNullSafe(F.col("_s"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = held.join(offsets, on).withColumn("rank", F.col("_rank") + F.col("_n0"))
    if size:
        out = out.withColumn("before", F.col("_before") + F.col("_b0"))
    return out.select(*df.columns, "rank", *(["before"] if size else []))
