"""Best-fit packing into sequences of a fixed number of tokens, improved by swap-based local search.

Piece lengths are whole numbers up to the capacity, so all that a packing depends on is how many pieces there are of each length: a table of at most
2048 rows, whatever the corpus. On it the driver packs best-fit decreasing, bins with equal contents as one entry with a count, and then improves:
the emptiest bins give documents to fuller underfull ones by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills, all bins
of equal contents at once, until no exchange of any bin helps or the number of bins has reached its lower bound. Pieces are ranked within their length without one large task, and a
piece's rank tells its sequence and offset. Where sequences follow an order, the bins are ranked in it too, as rows, and meet the pieces by length and rank.

Tokenising: a token never crosses white space or the end of an ASCII word before a stop mark, so documents are cut there, and each distinct part is
given to the tokenizer once a worker, in a bounded cache. The ids are those of the whole text. Most parts are a Latin word, with marks behind it or not:
these are given to it in lines, and told apart by the ids that end a word, where the tokenizer's file says that it splits words so.

Defined results: a null or empty text is one piece, the id 0; rows equal in id and text may swap places; an empty table gives an empty result; only
the named id and text columns are read.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.common import cut, ranked, slices, texts_of

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
_CACHE = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One word of letters that keep to one letter in lower case, up to U+024F, and one of marks, if any; and how a tokenizer must split for that.
_PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,;:!?]*")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "</w>"


class Tokens:
    """Ids of whole documents by a tokenizer file of the public package, through a cache of parts."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        self.mark = "<|endoftext|>"
        self.end = self.tokenizer.token_to_id(self.mark)
        self.ends = self._word_ends()
        self.latest: list[bytes] = []
        self.clear()

    def _word_ends(self) -> np.ndarray | None:
        """Whether an id ends a word, and every word ends with such an id; none if the file does not say so."""
        from tokenizers.pre_tokenizers import ByteLevel

        how = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        steps = how.get("pretokenizers", [])
        if [x.get("type") for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"].get("Regex") != _SPLIT or steps[1].get("use_regex"):
            return None
        vocab = self.tokenizer.get_vocab()
        if getattr(self.tokenizer.model, "end_of_word_suffix", None) != _END or not all(c + _END in vocab for c in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[k for token, k in vocab.items() if token.endswith(_END)]] = True
        return ends

    def clear(self, keep: list[bytes] = ()) -> None:
        """Forget all parts but ``keep``."""
        old = np.array([self.known[p] for p in keep], np.int64)
        start, length, ids = (self.start[old], self.length[old], self.ids) if len(old) else (old, old, np.zeros(0, np.uint32))
        self.known: dict[bytes, int] = dict(zip(keep, range(len(keep))))
        self.start, self.length = np.zeros(max(1 << 16, len(old)), np.int64), np.zeros(max(1 << 16, len(old)), np.int64)
        self.used = int(length.sum())
        self.ids = np.zeros(max(1 << 18, self.used), np.uint32)
        at = np.cumsum(length) - length
        self.start[: len(old)], self.length[: len(old)] = at, length
        self.ids[: self.used] = ids[np.repeat(start - at, length) + np.arange(self.used)]

    def _add(self, parts: list[bytes]) -> None:
        """Plain parts are given to the tokenizer in one string of lines, others in one between end marks; a mark parts what stands beside it."""
        rest = parts
        if self.ends is not None:
            rest, plain, lines = [], [], []
            for p in parts:
                line = p.decode()
                if _PLAIN.fullmatch(line):
                    plain.append(p)
                    lines.append(line)
                else:
                    rest.append(p)
            for i in range(0, len(plain), 512):
                some = lines[i : i + 512]
                ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.int64)
                words = np.cumsum([1 if line[-1].isalpha() else 2 for line in some])
                self._learn(plain[i : i + 512], ids, np.diff(np.flatnonzero(self.ends[ids])[words - 1], prepend=-1))
        for i in range(0, len(rest), 512):
            some = rest[i : i + 512]
            if any(b"<|" in p for p in some):
                ids = [x for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False) for x in (*e.ids, -1)]
                ids, end = np.array(ids, np.int64), -1
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join([*map(bytes.decode, some), ""])], add_special_tokens=False)[0].ids, np.int64)
                end = self.end
            self._learn(some, ids[ids != end], np.diff(np.flatnonzero(ids == end), prepend=-1) - 1)

    def _learn(self, parts: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        """Keep the ids of ``parts``, that stand one after the other."""
        k, n = len(self.known), len(parts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.length[k : k + n] = length
        self.start[k : k + n] = self.used + np.cumsum(length) - length
        self.used += len(ids)
        self.known.update(zip(parts, range(k, k + n)))

    def of(self, run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document's ended by the id 0, and the documents' offsets."""
        if len(self.known) > _CACHE:
            self.clear(self.latest)  # what the last slice held is likely to come again
        docs = len(at) - 1
        if b"<|" not in run.tobytes():  # special tokens are told by case
            run = _LOWER[run]
        edge = np.zeros(len(run) + 1, bool)
        space = _SPACE[run]
        edge[1:-1] = (space[1:] != space[:-1]) | (_ALNUM[run[:-1]] & _STOP[run[1:]])
        edge[at] = True
        bounds = np.flatnonzero(edge)
        if len(run) == 0:
            return np.zeros(docs, np.uint32), np.arange(docs + 1)
        parts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(run))])
        solid = np.flatnonzero(~space[bounds[:-1]])
        coded = parts.take(pa.array(solid)).dictionary_encode()
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.array(list(map(self.known.get, unique, itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            some = [unique[k] for k in new.tolist()]
            self._add(some)
            number[new] = [self.known[p] for p in some]
        self.latest = unique
        which = number[coded.indices.to_numpy()]
        size = self.length[which]
        doc = np.searchsorted(at, bounds[solid], "right") - 1
        out_at = np.concatenate([[0], np.cumsum(np.bincount(doc, size, docs).astype(np.int64) + 1)])
        place = np.cumsum(size) - size + doc  # one id 0 for each document before
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros(total + docs, np.uint32)
        out[np.repeat(place, size) + step] = self.ids[np.repeat(self.start[which], size) + step]
        return out, out_at


_workers: dict[str, Tokens] = {}


def tokens_of(name: str) -> Tokens:
    """This worker's tokenizer; its cache serves all tasks that the worker runs."""
    if name not in _workers:
        _workers[name] = Tokens(name)
    return _workers[name]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, source: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces, and its source if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        for rows, data, at in slices(batches, "_text", 2 << 20):
            ids, first = tokens.of(data, at)
            raw = ids.astype("<u4").tobytes()
            n = np.diff(first)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            begin = first[doc] + start
            crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist())]
            more = [rows.column(2).take(pa.array(doc))] if source else []
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *more], ["doc_id", "piece", "start", "length", "ids_crc32", *["source"] * len(more)])

    plain = texts_of(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *([F.col(source).cast("string").alias("source")] if source else []))
    return plain.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", source string" if source else ""))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths: (lengths in a bin, bins)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_rooms: list[int] = []

    def put(left: int, contents: tuple[int, ...], bins: int) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(open_rooms, left)
        room[left].append((contents, bins))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            k = bisect.bisect_left(open_rooms, length)
            if k < len(open_rooms):
                left = open_rooms[k]
                contents, bins = room[left].pop()
                if not room[left]:
                    del room[left]
                    open_rooms.pop(k)
            else:
                left, contents, bins = capacity, (), todo
            each = left // length
            full = min(bins, todo // each)
            if full:
                put(left - each * length, contents + (length,) * each, full)
                todo -= full * each
            rest = bins - full
            if rest and todo and todo < each:
                put(left - todo * length, contents + (length,) * todo, 1)
                rest, todo = rest - 1, 0
            if rest and contents:
                put(left, contents, rest)
    return [x for xs in room.values() for x in xs]


def improve(packed: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Empty bins by moves and exchanges between underfull ones, until nothing helps or no fewer bins can hold the pieces."""
    bins: dict[tuple[int, ...], int] = {}
    rooms: dict[int, dict[int, dict[tuple[int, ...], None]]] = {}  # by room left and a length that may come back (0: none), the contents that have both
    todo: list[tuple[int, tuple[int, ...]]] = []

    def change(contents: tuple[int, ...], by: int) -> None:
        was = bins.get(contents, 0)
        bins[contents] = was + by
        if not was + by:
            del bins[contents]
        left = capacity - sum(contents)
        if left and not was:
            room = rooms.setdefault(left, {})
            for b in {0, *contents}:
                room.setdefault(b, {})[contents] = None
            heapq.heappush(todo, (-left, contents))
        elif left and contents not in bins:
            room = rooms[left]
            for b in {0, *contents}:
                del room[b][contents]
                if not room[b]:
                    del room[b]
            if not room:
                del rooms[left]

    for contents, n in packed:
        change(tuple(sorted(contents, reverse=True)), n)
    least = -(-sum(sum(k) * n for k, n in bins.items()) // capacity)
    number = sum(bins.values())
    helped = False
    while number > least:
        if not todo:
            if not helped:
                break
            helped = False  # what helped no bin before may do so now
            todo = sorted((sum(k) - capacity, k) for k in bins if sum(k) < capacity)
            continue
        _, giver = heapq.heappop(todo)
        if giver not in bins:
            continue
        out, back, taker = _exchange(giver, bins[giver], rooms, capacity)
        if not out:
            continue
        n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        change(giver, -n)
        change(taker, -n)
        change(_swapped(taker, back, out), n)
        rest = _swapped(giver, out, back)
        if rest:
            change(rest, n)
        else:
            number -= n
        if giver in bins:
            heapq.heappush(todo, (sum(giver) - capacity, giver))
        helped = True
    return sorted(bins.items())


def _swapped(contents: tuple[int, ...], out: list[int], back: list[int]) -> tuple[int, ...]:
    kept = list(contents)
    for x in out:
        kept.remove(x)
    return tuple(sorted([*kept, *back], reverse=True))


def _exchange(giver: tuple[int, ...], copies: int, rooms: dict[int, dict[int, dict[tuple[int, ...], None]]], capacity: int) -> tuple[list[int], list[int], tuple[int, ...]]:
    """What goes over, what comes back and the taker, a bin at least as full, so that the sum of squared fills grows most."""
    mine = sorted(set(giver))
    ways = {a: [a] for a in mine}
    for i, a in enumerate(mine):
        for b in mine[i:]:
            if b > a or giver.count(a) > 1:
                ways.setdefault(a + b, [a, b])
    sums = sorted(ways)
    most, found = 0, ([], [], ())
    space = capacity - sum(giver)
    for left in sorted((x for x in rooms if x <= space), reverse=True):
        if left * space <= most:  # no taker gains more than its room
            break
        for b, takers in rooms[left].items():
            s = sums[k - 1] if (k := bisect.bisect_right(sums, left + b)) else 0
            if s > b and (grows := (s - b) * (space - left + s - b)) > most:
                taker = next((t for t in takers if t != giver or copies > 1), None)
                if taker is not None:
                    most, found = grows, (ways[s], [b] if b else [], taker)
    return found


def places(packed: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks within each length: from ``rank`` on, ``each`` a bin, bins from ``sequence`` on, the first of a bin at ``offset``."""
    rows, next_rank, sequence = [], {}, 0
    for contents, bins in packed:
        offset = 0
        for length in dict.fromkeys(contents):
            each = contents.count(length)
            rank = next_rank.get(length, 0)
            rows.append((length, rank, each, sequence, offset))
            next_rank[length] = rank + each * bins
            offset += each * length
        sequence += bins
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def bins_of(spark: SparkSession, packed: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> DataFrame:
    """(bin, lead, at, length, each, offset): a row a bin and length in it. Bins of a content stand as the pieces of its greatest length do: at the ``at``-th of ``lead``."""
    bins = np.array([n for _, n in packed], np.int64)
    ends = np.cumsum(bins)
    lead = np.array([contents[0] for contents, _ in packed], np.int64)
    pieces_led = np.array([counts[contents[0]] for contents, _ in packed], np.int64)
    # bin j of a content stands at (j + u) / bins of these pieces; u differs, so that single bins do not all stand in the middle
    u = np.arange(len(packed)) * 0.6180339887498949 % 1
    inside = [[(x, contents.count(x)) for x in dict.fromkeys(contents)] for contents, _ in packed]
    lengths = np.array([len(x) for x in inside], np.int64)
    first = np.cumsum(lengths) - lengths
    length, each = np.array([x for xs in inside for x in xs], np.int64).reshape(-1, 2).T
    filled = np.cumsum(length * each) - length * each
    offset = filled - np.repeat(filled[first], lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(0).to_numpy()
            k = np.searchsorted(ends, b, "right")
            at = np.minimum(((b - ends[k] + bins[k] + u[k]) / bins[k] * pieces_led[k]).astype(np.int64), pieces_led[k] - 1)
            n = lengths[k]
            row = np.repeat(np.arange(len(b)), n)
            i = first[k][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b[row], lead[k][row], at[row], length[i], each[i], offset[i])], ["bin", "lead", "at", "length", "each", "offset"])

    return spark.range(int(bins.sum())).mapInArrow(run, "bin long, lead long, at long, length long, each long, offset long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, source: str = "source", order: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    ``order``: (doc_id, source, slot, rank), a row for each id and source; sequences then follow (slot, source, rank).
    """
    held = pieces(docs, doc_id, text, capacity, tokenizer, source if order is not None else None)
    if order is not None:
        order = cut(order.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("slot").alias("_slot"), F.col("rank").alias("_nth")), "order")
        slots = (order.agg(F.max("_slot")).first()[0] or 0) + 1
        held = held.join(order, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_id", "_source")
    held = cut(held, "pieces")
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}  # a row a length
    packed = improve(best_fit(counts, capacity), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if order is not None:
        return _in_order(held, bins_of(held.sparkSession, packed, counts), slots).select(*columns, "sequence_id", "offset")
    table = places(packed)
    key = table["length"] << np.int64(44) | table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(key, length << np.int64(44) | rank, "right") - 1
            turn, nth = np.divmod(rank - table["rank"][k], table["each"][k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(table["sequence"][k] + turn), pa.array(table["offset"][k] + nth * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = ranked(held, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _in_order(held: DataFrame, bins: DataFrame, slots: int) -> DataFrame:
    """``held`` with sequence_id and offset: pieces of a length go to bins in the order of both, and sequences are numbered by their tokens' mean slot.

    A bin has the slot of the piece it stands at, whatever the number of bins: they are rows of a table, ranked and joined as the pieces are.
    """
    wide = (1 << 62) // slots
    follow = [F.col("source").asc_nulls_last(), F.col("_nth"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = cut(ranked(held, ["length"], F.col("_slot") * F.lit(wide), follow).drop("source", "_nth"), "numbered")
    leads = numbered.select(F.col("length").alias("lead"), F.col("rank").alias("at"), F.col("_slot").alias("_time"))
    bins = cut(bins.join(leads, ["lead", "at"]).select("bin", "length", "each", "offset", "_time"), "bins")
    room = ranked(bins, ["length"], F.col("_time") * F.lit(wide), [F.col("bin")], "each").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1)))
    room = room.select("length", (F.col("before") + F.col("_i")).alias("rank"), "bin", (F.col("offset") + F.col("_i") * F.col("length")).alias("offset"))
    placed = cut(numbered.join(room, ["length", "rank"]), "placed")
    sequences = cut(placed.groupBy("bin").agg((F.sum(F.col("_slot") * F.col("length")) / F.sum("length")).alias("_mean")), "sequences")
    sequences = ranked(sequences, [], (F.col("_mean") * F.lit(float(wide))).cast("long"), [F.col("bin")])
    return placed.join(sequences.select("bin", F.col("rank").alias("sequence_id")), "bin")
