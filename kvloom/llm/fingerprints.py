"""Document fingerprints: MinHash under many universal hash functions over five-word shingles, in numpy.

A fingerprint has a slot for each hash function: 16 bits of the least hash among the document's shingles, written as four hex digits.
The share of equal slots estimates the Jaccard similarity of the shingle sets; its standard error is at most 0.045 for 128 slots.

Defined results: a null text is empty; a text without words has the fingerprint ''; two such are alike (1.0), one such and another are not (0.0);
equal texts have equal fingerprints; a table of one row has itself as the next document; an empty table gives an empty result; rows of equal
doc_id are ordered by text, and a null doc_id comes after all others. Only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import near_dedup
from kvloom.llm.common import shingles, slices, text_bytes, texts_of

SLOTS = 128
BAND_ROWS = 5
_rng = np.random.default_rng(977)
_A = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)
_CHUNK = 1 << 14
#: Bytes of text that a range of ``edited_fingerprints`` holds, about, and how many ranges there are at most; past that they hold more.
RANGE_BYTES = 128 << 20
MOST_RANGES = 50_000
#: Characters of a text that tell where it stands among those of its id.
TIP = 64


def signatures(hashed: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of 16-bit slots for each document; documents without shingles have zeros."""
    n = len(at) - 1
    out = np.zeros((n, slots), dtype=np.uint16)
    full = np.flatnonzero(np.diff(at) > 0)
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + _CHUNK, "right")) - 1)
        part = full[i:j]
        x = hashed[at[part[0]] : at[part[-1] + 1]]
        begin = at[part] - at[part[0]]
        buffer = np.empty_like(x)
        for k in range(slots):
            np.multiply(x, _A[k], out=buffer)
            np.add(buffer, _B[k], out=buffer)
            out[part, k] = (np.minimum.reduceat(buffer, begin) >> np.uint64(24)).astype(np.uint16)
        i = j
    return out


def _of_texts(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each text and whether it has words."""
    hashed, at = shingles(*text_bytes(pa.array(texts, pa.large_string())))
    return signatures(hashed, at, slots), np.diff(at) > 0


def _written(slots: np.ndarray, full: np.ndarray) -> list[str]:
    big = slots.astype(">u2")
    return [row.tobytes().hex() if f else "" for row, f in zip(big, full)]


def _likeness(a: np.ndarray, a_full: np.ndarray, b: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    return np.where(a_full & b_full, (a == b).mean(axis=1), np.where(a_full | b_full, 0.0, 1.0))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "_text"):
            hashed, first = shingles(data, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_written(signatures(hashed, first, slots), np.diff(first) > 0))], ["doc_id", "fingerprint"])

    plain = texts_of(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return plain.mapInArrow(run, "doc_id long, fingerprint string")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_links): fingerprints' bands joined in Spark, shingle sets' Jaccard similarity verified, linked texts joined to classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "_text"):
            hashed, first = shingles(data, at)
            yield near_dedup.banded(rows, signatures(hashed, first), np.diff(first) > 0, BAND_ROWS)

    return near_dedup.linked(docs, run, doc_id, text, threshold, multiset=False)


@dataclass
class _Ranges:
    """Ranges of (id, text) in the order of descending ids, then texts: ``keys`` (ascending) end ranges of ids, ``cuts`` divide the rows of one of them."""

    keys: np.ndarray
    cuts: list[list[str]]

    def __post_init__(self) -> None:
        held = np.array([len(c) + 1 for c in self.cuts], np.int64)
        self.total = int(held.sum())
        self.last = self.total - 1 - (np.cumsum(held) - held)  # of a key's ranges; the highest key comes first

    def of(self, key: np.ndarray, tips: pd.Series) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, key, "left"), len(self.keys) - 1)
        out = self.last[i].astype(np.int32)
        for j in np.flatnonzero(self.keys[i] <= key):  # rows of the key itself precede those of the ids below it
            cuts = self.cuts[i[j]]
            if cuts:
                out[j] -= len(cuts) - (bisect_left(cuts, tips.iloc[j]) if self.keys[i[j]] == key[j] else 0)
        return out


def _ranges(keyed: DataFrame) -> _Ranges:
    """Ranges of about ``RANGE_BYTES`` of text, MOST_RANGES at most. Where they are cut decides who works on a row, never the result."""
    total = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length("_text")).alias("size")).first()
    n = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, (total["size"] or 0) // RANGE_BYTES))
    found = keyed.agg(F.percentile_approx("_key", F.array(*[F.lit((i + 1) / n) for i in range(n)]), F.lit(max(10_000, 10 * n))).alias("q")).first()["q"]
    keys, times = np.unique(np.array(found or [0], dtype=np.int64), return_counts=True)
    cuts: dict[int, list[str]] = {}
    heavy = {int(k): int(t) for k, t in zip(keys, times) if t > 1}
    if heavy:  # some 16 rows a range are drawn, whose texts' beginnings cut an id's rows evenly
        drawn = keyed.filter(F.col("_key").isin(list(heavy))).filter(F.rand(5) < 16.0 * n / max(1, total["n"])).select("_key", F.substring("_text", 1, TIP).alias("tip"))
        for r in drawn.collect():
            cuts.setdefault(r["_key"], []).append(r["tip"])
    return _Ranges(keys, [sorted(set(sorted(cuts[k])[len(cuts[k]) // heavy[k] :: max(1, len(cuts[k]) // heavy[k])])) if k in cuts else [] for k in keys.tolist()])


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document in descending doc_id.

    Texts cross the network once: rows are dealt to ranges of doc_id, as many as their bytes ask for, and the first row of each range, known from a
    pass over the ids alone, goes to the range before it as well. An id that fills more than a range is cut by the beginnings of its texts.
    """
    least = -(1 << 63)
    plain = texts_of(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    keyed = plain.withColumn("_key", F.coalesce(F.col("doc_id"), F.lit(least)))
    places = _ranges(keyed)
    heavy = [k for k, cuts in zip(places.keys.tolist(), places.cuts) if cuts]
    # only rows of these ids need a look at their texts
    tip = F.when(F.col("_key").isin(heavy), F.substring("_text", 1, TIP)).otherwise("") if heavy else F.lit("")

    @F.pandas_udf("int")
    def part_of(key: pd.Series, tips: pd.Series) -> pd.Series:
        return pd.Series(places.of(key.to_numpy(np.int64), tips))

    ids = keyed.select("_key", tip.alias("_tip"))
    heads = ids.groupBy(part_of("_key", "_tip").alias("p")).agg(F.min(F.struct(F.bitwise_not("_key").alias("k"), "_tip")).alias("h")).collect()
    heads = sorted((r["p"], ~r["h"]["k"], r["h"]["_tip"]) for r in heads)  # a row a range
    before = {(k, t): heads[i - 1][0] for i, (_, k, t) in enumerate(heads)}  # the range that ends where this one begins; before the first comes the last
    begins = np.array(sorted({k for _, k, _ in heads}), np.int64)

    @F.pandas_udf("own int, guest int")
    def dealt_to(key: pd.Series, tips: pd.Series) -> pd.DataFrame:
        k = key.to_numpy(np.int64)
        guest = np.full(len(k), -1, np.int32)
        for i in np.flatnonzero(np.isin(k, begins)):
            guest[i] = before.get((int(k[i]), tips.iloc[i]), -1)
        return pd.DataFrame({"own": places.of(k, tips), "guest": guest})

    both = keyed.withColumn("_to", dealt_to("_key", tip))
    at_home = F.struct(F.col("_to.own").alias("part"), F.lit(0).alias("guest"))
    abroad = F.struct(F.col("_to.guest").alias("part"), F.lit(1).alias("guest"))
    dealt = both.withColumn("_at", F.explode(F.filter(F.array(at_home, abroad), lambda x: x["part"] >= 0)))
    dealt = dealt.select(F.col("_at.part").alias("_part"), F.col("_at.guest").alias("_guest"), "_key", "doc_id", "_text")
    dealt = dealt.repartitionById(places.total, F.col("_part")).sortWithinPartitions("_part", "_guest", F.desc("_key"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for rows, _, _ in slices(batches, "_text"):
            part, guest = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            ids, texts = rows.column(3).to_pylist(), rows.column(4).to_pylist()
            own, full = _of_texts(texts, slots)
            if last:
                part, guest, ids, texts = [last[0][0]] + part, [last[0][1]] + guest, [last[0][2]] + ids, [last[0][3]] + texts
                own, full = np.concatenate([last[0][4][None], own]), np.concatenate([[last[0][5]], full])
            last = [(part[-1], guest[-1], ids[-1], texts[-1], own[-1], full[-1])]
            here = [i for i in range(len(ids) - 1) if not guest[i] and part[i] == part[i + 1]]
            if not here:
                continue
            cut = [len(texts[i]) // 3 for i in here]
            changed = [texts[i][: len(texts[i]) - k] + texts[i + 1][:k] for i, k in zip(here, cut)]
            new, new_full = _of_texts(changed, slots)
            h = np.array(here)
            mine, mine_full = own[h], full[h]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in here], pa.int64()), pa.array([len(texts[i]) for i in here], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array(_written(mine, mine_full)), pa.array(_written(new, new_full)), pa.array(_likeness(mine, mine_full, new, new_full)), pa.array(_likeness(mine, mine_full, own[h + 1], full[h + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
