"""Repeated passages: a run-length index over aligned contexts, matching statistics, and removal of long matches.

Every byte goes that is covered by a string of 200 bytes which also starts anywhere else in the corpus.

Two equal strings of 200 bytes hold the same least 48-gram (by hash, the rightmost of equals) at the same place, so each window of a document is owned
by one anchor, and windows can only match where the anchors' 48-grams do. Anchors are joined by hash. An anchor whose owned context, all bytes of its
windows, stands somewhere else too is settled at once. What is left are the borders of repeated passages: there the contexts of one anchor are lined up
on it, and since the anchor fixes the alignment, the Burrows-Wheeler transform is built in its positional form, column by column: rows in the order of
what they read backwards from a column. In a repetitive group its columns are few runs. As in a run-length index, only run ends carry information:
inside a run, order and match length with the row above carry over, and at a run's head the match length follows from the maxima of the runs passed
over since the last run of the same byte. Streaming the columns gives for every row and column the length of the longest match with any other row that
ends there, its matching statistic; 200 or more marks a window. Contexts of anchors too common for one task are not lined up but compared window by
window through 128-bit hashes, which gives the same answer.

Rows are numbered as they are first read, and the numbers stand for them until spans go back to the documents by id and a 128-bit digest of the text.

Defined results: a null text is empty; texts below 200 bytes lose nothing; rows of equal text lose everything from 200 bytes on; rows without an id, or
of equal id and different texts, are judged each by its own text; an empty table gives an empty result; other columns pass through ``deduplicated`` and
are not read elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import SLICE_BYTES, cut, discard, give_back, mix, powers, slices, texts_of, told_apart

WINDOW = 200
GRAM = 48
#: Windows that can share an anchor.
REACH = WINDOW - GRAM + 1
#: Contexts of one anchor that are lined up at most; bytes of contexts a task about.
MOST_ROWS, SHARD_BYTES = 20_000, 8 << 20
_PLACE = np.uint64((1 << 26) - 1)
_TABLE = np.random.default_rng(61).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Contexts that are cut out of texts at once.
_CUT_OUT = 20_000


def _grams(run: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on: of 32 bytes by doubling, then of the 16 after them."""
    h, size, kept = _TABLE[run], 1, None
    while size < 32:
        n = max(len(run) - 2 * size + 1, 0)
        a = h[:n] * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(29)
        a += h[size : size + n]
        h, size = a, 2 * size
        if size == 16:
            kept = h
    n = max(len(run) - GRAM + 1, 0)
    return mix(h[:n] * np.uint64(0x94D049BB133111EB) ^ kept[32 : 32 + n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:n], x[width - size : width - size + n])


def owners(run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: their hash, document, place in ``run``, and the first and last start of the windows they own."""
    h = _grams(run)
    none = np.zeros(0, np.int64)
    if len(run) < WINDOW:
        return h[:0], none, none, none, none
    key = (h & ~_PLACE) | (~np.arange(len(h), dtype=np.uint64) & _PLACE)
    low = _least(key, REACH)
    start = np.arange(len(low))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low)]
    inside = start + WINDOW <= at[1:][doc]
    start, doc, low = start[inside], doc[inside], low[inside]
    back = (~low & _PLACE).astype(np.int64)
    owner = start + ((back - start) & int(_PLACE))
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return h[owner[first]], doc[first], owner[first], start[first], start[last[: len(first)]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, r, place, c, doc, digest): place packs the anchor's position and how far its first and last window start before it.

    r numbers the rows: the partition, then the row in it. A row's first anchor bears its id and digest.
    """
    done = TaskContext.get().partitionId() << 40
    for rows, run, at in slices(batches, "_text", SLICE_BYTES // 2):
        h, doc, owner, first, last = owners(run, at)
        up, down = powers(len(run))
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(_TABLE[run] * up[: len(run)], out=sums[1:])
        far, near = (owner - first).astype(np.uint64), (owner - last).astype(np.uint64)
        c = mix((sums[last + WINDOW] - sums[first]) * down[first] + (far * np.uint64(256) + near) * np.uint64(0xD6E8FEB86659FD93))
        place = (owner - at[doc]).astype(np.uint64) << np.uint64(16) | far << np.uint64(8) | near
        lead = np.ones(len(doc), bool)
        lead[1:] = doc[1:] != doc[:-1]
        named = pa.array(doc, mask=~lead)
        columns = [pa.array(h.view(np.int64)), pa.array(doc + done), pa.array(place.view(np.int64)), pa.array(c.view(np.int64)), rows.column(0).take(named), rows.column(1).take(named)]
        yield pa.RecordBatch.from_arrays(columns, ["h", "r", "place", "c", "doc", "digest"])
        done += rows.num_rows


def matched(group: np.ndarray, far: np.ndarray, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, and the first and last start of each run of windows in them that another context of their group holds too.

    ``group`` is sorted; ``far``: bytes before the anchor.
    """
    n = len(rows)
    size = np.array([len(r) for r in rows])
    width = REACH - 1 + WINDOW
    table = np.full((n, width), 256, np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    begin = REACH - 1 - far
    row = np.repeat(np.arange(n), size)
    table[row, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) + begin[row]] = data
    found = np.zeros((n, REACH), bool)
    order = np.arange(n)
    top = np.ones(n, bool)
    top[1:] = group[1:] != group[:-1]
    base = group * 512
    since = np.zeros(n, np.int64)  # column from which on a row matches the one above it
    for j in range(width):
        key = base + table[order, j]
        head = np.ones(n, bool)
        head[1:] = key[1:] != key[:-1]
        if not (key[1:] >= key[:-1]).all():
            runs = np.flatnonzero(head)
            maxima = [np.maximum.reduceat(since, runs)]
            run_of = np.cumsum(head) - 1
            moved = np.argsort(key, kind="stable")
            order, new_key, after = order[moved], key[moved], since[moved]
            same = np.zeros(n, bool)
            same[1:] = new_key[1:] == new_key[:-1]
            jump = np.flatnonzero(same & head[moved])  # heads of runs whose byte had an earlier run
            if len(jump):
                lo, hi = run_of[moved[jump - 1]] + 1, run_of[moved[jump]] - 1
                level = 0
                while 2 << level <= len(runs):
                    x = maxima[-1]
                    maxima.append(np.maximum(x[: -(1 << level)], x[1 << level :]))
                    level += 1
                depth = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
                passed = np.empty(len(jump), np.int64)
                for k in np.unique(depth):
                    at = depth == k
                    passed[at] = np.maximum(maxima[k][lo[at]], maxima[k][hi[at] - (1 << k) + 1])
                after[jump] = np.maximum(passed, after[jump])
            since = np.where(same, after, j + 1)
            key = new_key
        else:
            since = np.where(head, j + 1, since)
        since[top | ((key & 511) == 256)] = j + 1
        if j + 1 >= WINDOW:
            long = since <= j + 1 - WINDOW
            long[:-1] |= long[1:] & ~top[1:]
            if long.any():
                found[order[long], j + 1 - WINDOW] = True
    edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
    which, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return which, first - begin[which], last - begin[which]


def _plain(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """(doc, digest, _text) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return texts_of(docs, F.col(doc_id).cast("long").alias("doc"), F.unhex(F.md5(body)).alias("digest"), body.alias("_text"), *more)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that rows (r, _text, asked) ask for."""
    for rows, run, at in slices(batches, "_text"):
        asked = rows.column(2)
        flat = asked.flatten()
        doc = np.repeat(np.arange(rows.num_rows), np.diff(asked.offsets.to_numpy()))
        r = rows.column(0).to_numpy()
        h, place, far, near, nc = (flat.field(x).to_numpy() for x in ("h", "at", "far", "near", "nc"))
        start, size = place - far, far - near + WINDOW
        for i in range(0, len(doc), _CUT_OUT):
            k = np.s_[i : i + _CUT_OUT]
            ends = np.cumsum(size[k])
            step = np.arange(ends[-1]) - np.repeat(ends - size[k], size[k])
            data = run[np.repeat(at[doc[k]] + start[k], size[k]) + step]
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            context = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(r[doc[k]]), pa.array(start[k]), pa.array(far[k]), pa.array(nc[k]), context], ["h", "r", "start", "far", "nc", "context"])


def _line_up(part: pd.DataFrame) -> pd.DataFrame:
    """(r, first, last) of the matches among a shard's contexts."""
    part = part.drop_duplicates(["h", "r", "start"]).sort_values(["h", "r", "start"]).reset_index(drop=True)  # a row that the table repeats reads its contexts again
    group = (part["h"] != part["h"].shift()).cumsum().to_numpy(np.int64)
    bounds = np.flatnonzero(np.diff(group, prepend=-1))
    out = []
    i = 0
    while i < len(part):  # whole groups, about a few thousand rows at a time
        k = np.searchsorted(bounds, i + 8192, "right")
        j = len(part) if k >= len(bounds) else int(bounds[k])
        rows = part.iloc[i:j]
        which, first, last = matched(group[i:j], rows["far"].to_numpy(np.int64), rows["context"].tolist())
        start = rows["start"].to_numpy(np.int64)[which]
        out.append(pd.DataFrame({"r": rows["r"].to_numpy(np.int64)[which], "first": start + first, "last": start + last + WINDOW}))
        i = j
    give_back()
    return pd.concat(out).astype({"r": "int64", "first": "int32", "last": "int32"})


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans to remove as (doc, digest, spans), a row an id and text that lose something."""
    plain = _plain(docs, doc_id, text)
    anchors = cut(plain.filter(F.octet_length("_text") >= WINDOW).mapInArrow(_anchors, "h long, r long, place long, c long, doc long, digest binary"), "anchors")
    numbers = cut(anchors.filter("digest is not null").groupBy("doc", "digest").agg(F.min("r").alias("r")), "numbers")
    contexts = anchors.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("r", "place")).alias("one"))
    grams = contexts.groupBy("h").agg(F.count("*").alias("nc"), F.sum("n").alias("m")).filter("m > 1").select("h", "nc")
    known = contexts.join(grams, "h")
    mine = (F.col("one.r") == F.col("r")) & (F.col("one.place") == F.col("place"))
    held = anchors.join(known, ["h", "c"]).select("h", "r", "place", "nc", (F.col("n") > 1).alias("whole"), ((F.col("nc") > 1) & mine).alias("asks")).filter("whole or asks")
    held = cut(held.select("h", "r", F.expr("cast(place >> 16 as int)").alias("at"), F.expr("cast(place >> 8 & 255 as int)").alias("far"), F.expr("cast(place & 255 as int)").alias("near"), "nc", "whole", "asks"), "held")
    discard(anchors)
    border = held.filter("asks").groupBy("r").agg(F.collect_list(F.struct("h", "at", "far", "near", "nc")).alias("asked"))
    border = cut(border.join(numbers, "r").select("r", F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), "asked"), "border")
    asking, _ = told_apart(plain, border.select(F.col("_doc").alias("doc"), F.col("_digest").alias("digest")), ["doc", "digest"])
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest"))
    asked = cut(asking.join(border, same).select("r", "_text", "asked").mapInArrow(_read, "h long, r long, start int, far int, nc long, context binary"), "contexts")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    few = asked.filter(F.col("nc") <= MOST_ROWS).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    lined = few.select("shard", "h", "r", "start", "far", "context").groupBy("shard").applyInPandas(_line_up, "r long, first int, last int")
    # too common for one task: a row a window, counted by two hashes of its bytes and the anchor
    windows = asked.filter(F.col("nc") > MOST_ROWS).select("h", "r", "start", "context").distinct()
    windows = windows.select("h", "r", "start", "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - WINDOW)).alias("i"))
    piece = F.expr(f"substring(context, i + 1, {WINDOW})")
    windows = windows.select("r", (F.col("start") + F.col("i")).cast("int").alias("first"), F.xxhash64("h", piece).alias("k1"), F.xxhash64(piece, F.lit(1)).alias("k2"))
    twice = windows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
    common = windows.join(twice, ["k1", "k2"]).select("r", "first", (F.col("first") + WINDOW).cast("int").alias("last"))
    whole = held.filter("whole").select("r", (F.col("at") - F.col("far")).cast("int").alias("first"), (F.col("at") - F.col("near") + WINDOW).cast("int").alias("last"))
    spans = whole.union(lined).union(common).groupBy("r").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return cut(spans.join(numbers, "r").select("doc", "digest", "spans"), "spans")


def _with_spans(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may lose something, with their ``spans`` (null: none), and rows that lose nothing."""
    some, rest = told_apart(rows, spans, ["doc", "digest"])
    found = spans.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), "spans")
    return some.join(found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left").drop("_doc", "_digest"), rest


def _removed(size: int, spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spans = repeats(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "_text"):
            out = []
            raw = data.tobytes()
            for i, (doc, found) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist())):
                body = raw[at[i] : at[i + 1]]
                runs = _removed(len(body), found)
                out.append((doc, len(body), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(body, runs)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    some, rest = _with_spans(_plain(docs, doc_id, text), spans)
    both = some.select("doc", "_text", "spans").union(rest.select("doc", "_text", F.lit(None).cast("array<struct<first:int,last:int>>")))
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts, at whole characters: one that keeps a byte stays; n_chars follows."""
    spans = repeats(docs, doc_id, text)
    names, kinds = docs.columns, docs.schema
    some, rest = _with_spans(_plain(docs, doc_id, text, F.struct(*[docs[c] for c in names]).alias("_row")).drop("_text"), spans)

    @F.pandas_udf("string")
    def without(body: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for x, s in zip(body, found):
            if x is None or s is None or not len(s):
                out.append(x)
                continue
            raw = x.encode()
            runs = []
            for a, b in _removed(len(raw), list(s)):
                while a < b and raw[a] & 0xC0 == 0x80:  # inside a character that keeps a byte
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                runs.append((a, b))
            out.append(_kept(raw, runs).decode())
        return pd.Series(out, dtype=object)

    changed = some.withColumn("_new", without(F.col(f"_row.{text}"), "spans"))
    fields = {c: F.col(f"_row.{c}") for c in names}
    new = fields | {text: F.col("_new")} | ({n_chars: F.when(F.col(f"_row.{n_chars}").isNotNull(), F.length("_new")).cast(kinds[n_chars].dataType)} if n_chars in names else {})
    return changed.select(*[new[c].alias(c) for c in names]).union(rest.select(*[fields[c].alias(c) for c in names]))
