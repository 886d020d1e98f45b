"""Near-duplicate classes: BagMinHash signatures of five-word shingle multisets, bands, verified overlap, connected components.

BagMinHash: the weight of a shingle is how often its document has it. The weight axis is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8) ...
and each (shingle, interval) owns one Poisson process, of a rate equal to the interval's length, whose points carry a time, a signature slot and a
mark within the interval. A document sees the points whose mark lies below its weight, so two documents share exactly the points below both
weights; a slot keeps its earliest point, and two slots agree with a probability equal to the weighted Jaccard similarity. Points are made in
order of time and a process is left as soon as its time passes the latest slot, so a document needs about n + m ln m points, not n times m.

Candidates share a band of slots. Links are verified on the shingle multisets themselves, kept as 32-bit hashes. Each text is first compared with one
likely original. In buckets that are then in several classes, texts with so many elements of their own that no overlap can reach the threshold are set
aside (the prefix filter's argument). The rest are compared with a few pivots a round, never inside one class, until all members that were no pivot are
in one class. Any two members are then in one class, were compared, or cannot be alike: no link between classes is lost. A bucket is expanded into pairs
only as far as these bounds leave some: many texts alike but under the threshold are the worst case. Members of a large bucket are dealt to splits.
Thirty bands of seven slots find a link at the threshold with a probability of 0.999.

Defined results: a null text is empty; equal texts are one class, also texts without words, which are near nothing else; the class id is the least
doc_id of the class (null only if all are null); an empty table gives an empty result; only the named id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.llm.common import FEW, HEAVY, cut, discard, lists, mix, numbered, shingles, slices, texts_of, told_apart, with_facts

SLOTS = 210
BAND_ROWS = 7
THRESHOLD = 0.8
#: Members of a bucket that meet its pivots in one task, about.
SPLIT_ROWS = 2000
_U = 2.0**-53


def bag_signatures(hashed: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` 64-bit values for each document's multiset of shingles."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((hashed, doc))
    d, h = doc[order], hashed[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(h)))
    d, h = d[first], h[first]
    level = [np.zeros(len(h), np.int64)]
    pick = [np.arange(len(h))]
    j = 1
    while len(more := np.flatnonzero(weight > 1 << (j - 1))):
        pick.append(more)
        level.append(np.full(len(more), j))
        j += 1
    pick, level = np.concatenate(pick), np.concatenate(level)
    d, weight = d[pick], weight[pick].astype(np.float64)
    seed = mix(h[pick] + level.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    rate = np.where(level == 0, 1.0, low)
    time = np.zeros(len(d))
    best = np.full(n * slots, np.inf)
    turn = 0
    while len(d):
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1.0) * _U) / rate
        other = mix(seed ^ np.uint64(0xD1B54A32D192ED03))
        slot = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        mark = low + (other >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate
        seen = mark < weight
        np.minimum.at(best, d[seen] * slots + slot[seen], time[seen])
        turn += 1
        if turn < 4 or turn % 4 == 0:
            docs, place = np.unique(d, return_inverse=True)
            latest = best.reshape(n, slots)[docs].max(axis=1)
            go = time < latest[place]
            d, seed, time, rate, low, weight = d[go], seed[go], time[go], rate[go], low[go], weight[go]
    return best.view(np.uint64).reshape(n, slots)


def banded(rows: pa.RecordBatch, slots: np.ndarray, full: np.ndarray, band_rows: int) -> pa.RecordBatch:
    """A row's key and the hashes of its bands; none without shingles. The first column of ``rows`` is the id, the second the text's key."""
    bands = slots.shape[1] // band_rows
    wide = slots[:, : bands * band_rows].astype(np.uint64).reshape(len(slots), bands, band_rows)
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), wide.shape[:2]).copy()
    for k in range(band_rows):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + wide[:, :, k])
    at = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists(total[full].reshape(-1).view(np.int64), at)], ["doc_id", "_t", "bands"])


def _bag_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in slices(batches, "_text"):
        hashed, first = shingles(data, at)
        yield banded(rows, bag_signatures(hashed, first), np.diff(first) > 0, BAND_ROWS)


def components(edges: DataFrame, count: int) -> DataFrame:
    """(node, comp) of all nodes of ``edges`` (a, b), a stored table of ``count`` rows; comp is the least node connected.

    Few edges are united by the driver, and the result is marked to be broadcast. Else stars are contracted until nothing moves.
    """
    if count <= FEW:
        return F.broadcast(cut(_united(edges), "comps"))
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, cut(small, "edges")
        discard(last)
        # over when every node hangs on one other, and none hangs on what hangs itself
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    return cut(now.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp"), "comps")


def _united(edges: DataFrame) -> DataFrame:
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    held = edges.select("a", "b").toArrow()
    for a, b in zip(held["a"].to_pylist(), held["b"].to_pylist()):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    columns = [pa.array(x, held.schema.field("a").type) for x in (list(up), [root(x) for x in list(up)])]
    return edges.sparkSession.createDataFrame(pa.Table.from_arrays(columns, ["node", "comp"])).coalesce(1)


def grouped(docs: DataFrame, bands: Callable, doc_id: str, text: str, threshold: float, multiset: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, _t), and (_t, class_id, n_links, copies, kept_t, kept_id) of every distinct text.

    A class keeps the text of its least id (ids before none, then the least text). n_links counts verified links to other texts, as far as classes needed them.
    """
    plain = texts_of(docs, F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_t"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = cut(plain.mapInArrow(bands, "doc_id long, _t binary, bands array<long>"), "bands")
    many = rows.count()
    texts = rows.groupBy("_t").agg(F.first("bands").alias("bands")).select("_t", F.explode("bands").alias("bucket"))
    sizes = cut(texts.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets", many)
    large, small = with_facts(texts, sizes, "bucket", "n", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    members = cut(large.unionByName(small.filter("n is not null")), "members", many)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in slices(batches, "_text"):
            hashed, first = shingles(data, at)
            values, repeat = numbered(hashed, first)
            if not multiset:
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[repeat == 0]
                values, first = values[repeat == 0], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(first) - 1))])
            yield pa.RecordBatch.from_arrays([part.column(0), lists((values >> np.uint64(32)).astype(np.uint32).view(np.int32), first)], ["_t", "s"])

    wanted = members.select("_t").distinct()
    once = rows.groupBy("_t").agg(F.min("doc_id").alias("d")).join(wanted, "_t", "left_semi")
    # one row of each wanted text. A bitmap, of two million words at most, keeps other texts off the network; past its capacity it only saves less
    likely, _ = told_apart(plain, wanted, ["_t"])
    bodies = likely.join(once.select(F.col("_t").alias("_u"), "d"), (F.col("_t") == F.col("_u")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("_t", "_text")
    bags = cut(bodies.mapInArrow(sets, "_t binary, s array<int>").dropDuplicates(["_t"]), "bags", many)

    def overlaps(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes allow a link, with the size ``o`` of their overlap and whether it makes one."""
        ids = pairs.select(F.col("a").alias("_t")).union(pairs.select(F.col("b").alias("_t")))
        asked, _ = told_apart(bags, ids, ["_t"])
        left = asked.select(F.col("_t").alias("a"), F.col("s").alias("sa"))
        right = asked.select(F.col("_t").alias("b"), F.col("s").alias("sb"))
        both = pairs.join(left, "a").join(right, "b")
        short, long = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
        both = both.filter(short >= F.lit(threshold) * long).withColumn("o", F.size(F.array_intersect("sa", "sb")))
        return both.select("a", "b", "o", (F.col("o") >= F.lit(threshold) * (F.size("sa") + F.size("sb") - F.col("o"))).alias("link"))

    # first every text with one other only: of the leaders of its buckets the one with the most company, likely what the others were copied from
    company = members.groupBy("_t").agg(F.sum("n").alias("w"))
    leads = members.join(company, "_t").groupBy("bucket").agg(F.max(F.struct("w", "_t")).alias("lead"), F.count("*").alias("held"))
    everywhere = members.count()
    some, others = with_facts(members.drop("n"), leads, "bucket", "held", everywhere)
    first = some.unionByName(others).groupBy("_t").agg(F.max(F.when(F.col("lead._t") != F.col("_t"), F.col("lead"))).alias("lead"))
    first = first.filter("lead is not null").select("_t", F.col("lead._t").alias("lead"))
    first = cut(first.select("_t", "lead", F.greatest("_t", "lead").alias("a"), F.least("_t", "lead").alias("b")), "first", many)
    met = cut(overlaps(first.select("a", "b").distinct()), "met", many)
    links = cut(met.filter("link").select("a", "b"), "links", many)
    number = links.count()
    comps = components(links, number)

    def placed(table: DataFrame) -> DataFrame:
        return table.join(comps.withColumnRenamed("node", "_t"), "_t", "left").withColumn("comp", F.coalesce("comp", "_t"))

    def in_open(table: DataFrame, count: int) -> DataFrame:
        """The buckets whose members that were no pivot are in several classes; ``count`` is the number of rows of ``table``."""
        fresh = F.when(~F.col("tried"), F.col("comp"))
        several = table.groupBy("bucket").agg(F.min(fresh).alias("lo"), F.max(fresh).alias("hi"), F.count("*").alias("held")).filter("lo <> hi").select("bucket", "held")
        if count <= FEW:
            return table.join(F.broadcast(several.select("bucket")), "bucket")
        large, small = with_facts(table, several, "bucket", "held", everywhere)
        return large.unionByName(small.filter("held is not null")).drop("held")

    left = cut(in_open(placed(members.select("bucket", "_t", F.lit(False).alias("tried"))), everywhere).select("bucket", "_t"), "open", many)
    others = left.groupBy("_t").agg(F.sort_array(F.collect_list("bucket")).alias("all"))  # as many as there are bands
    # elements that only one of these texts has can be in no overlap: a text with too many of them has no link left to find
    wanted = left.select("_t").distinct()
    some = told_apart(bags, wanted, ["_t"])[0].join(wanted, "_t", "left_semi")
    lone = some.select(F.explode("s").alias("e"), F.xxhash64("_t").alias("owner")).groupBy("e").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
    lone = lone.filter("n = 1").groupBy("owner").agg(F.count("*").alias("lone"))
    facts = some.select("_t", F.size("s").alias("size"), F.xxhash64("_t").alias("owner")).join(lone, "owner", "left").select("_t", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("shared"))
    facts = facts.filter(F.col("shared") >= F.lit(threshold) * F.col("size"))
    # what a text has in common with the likely original it was compared with, where that is among these texts
    known = first.join(met, ["a", "b"]).join(wanted.withColumnRenamed("_t", "lead"), "lead", "left_semi").select("_t", "lead", "o")
    facts = cut(facts.join(known, "_t", "left"), "facts", many)
    left = left.join(F.broadcast(facts) if facts.count() <= FEW else facts, "_t")
    discard(first, met)
    least = left.groupBy("bucket").agg(F.min("size").alias("least"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("size") + F.greatest(F.col("least"), F.lit(threshold) * F.col("size"))) - F.lit(1e-6)
    left = cut(left.join(least, "bucket").filter(F.col("shared") >= need).select("bucket", "_t", "size", "shared", "lead", "o", F.lit(False).alias("tried")), "left", many)
    pivots, total = 64, left.count()
    while True:
        left = cut(in_open(placed(left), total), "left", many)
        if left.isEmpty():
            break
        # pivots come from the smallest classes of a bucket; a pair that shares several buckets is made in the first
        held = left.groupBy("bucket", "comp").agg(F.count("*").alias("held"))
        free = left.filter(~F.col("tried")).join(held, ["bucket", "comp"])
        chosen = _first(free, pivots, F.col("held")).select("bucket", "_t", F.lit(True).alias("pivot"))
        marked = cut(left.join(chosen, ["bucket", "_t"], "left").join(others, "_t").withColumn("pivot", F.coalesce("pivot", F.lit(False))), "pivots", many)
        # members of a large bucket are dealt to splits, and its pivots go to each
        large = marked.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > max(SPLIT_ROWS, HEAVY * total)).select("bucket", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("splits"))
        marked = marked.join(F.broadcast(large), "bucket", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
        x = marked.select(F.pmod(F.xxhash64("_t", F.lit(9)), F.col("splits")).cast("int").alias("sx_"), "bucket", F.col("all").alias("ax"), F.col("_t").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("nx"), F.col("shared").alias("sx"), F.col("lead").alias("lx"), F.col("o").alias("ox"), F.col("pivot").alias("px"))
        y = marked.filter("pivot").select(F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("sy_"), F.col("bucket").alias("by"), F.col("all").alias("ay"), F.col("_t").alias("y"), F.col("comp").alias("cy"), F.col("size").alias("ny"), F.col("shared").alias("sy"), F.col("lead").alias("ly"), F.col("o").alias("oy"))
        # common elements are shared ones; with one original they are in what both have of it, or in what both share besides
        most = F.when(F.col("lx") == F.col("ly"), F.least("ox", "oy") + F.least(F.col("sx") - F.col("ox"), F.col("sy") - F.col("oy")))
        most = F.least(F.col("sx"), F.col("sy"), most)
        can = (most >= F.lit(threshold / (1 + threshold)) * (F.col("nx") + F.col("ny")) - F.lit(1e-6)) & (F.col("cx") != F.col("cy"))
        can = can & (F.col("bucket") == F.array_min(F.array_intersect("ax", "ay"))) & ~(F.col("px") & (F.col("x") > F.col("y")))
        pairs = cut(x.join(y, (F.col("bucket") == F.col("by")) & (F.col("sx_") == F.col("sy_")) & can).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "pairs", many)
        # no pair is inside a class, so no link is an old one
        new = cut(overlaps(pairs).filter("link").select("a", "b"), "links", many)
        discard(pairs)
        if found := new.count():
            links, number = links.union(new), number + found
            dropped, comps = comps, components(links, number)
            discard(dropped)
        left = marked.select("bucket", "_t", "size", "shared", "lead", "o", (F.col("tried") | F.col("pivot")).alias("tried"))
        pivots *= 8
    counted = links.select(F.col("a").alias("_t")).union(links.select(F.col("b").alias("_t"))).groupBy("_t").agg(F.count("*").alias("n_links"))
    # facts of a text meet its class first, a row a text; all its copies then meet one row
    of_text = placed(rows.groupBy("_t").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))).join(counted, "_t", "left")
    of_text = of_text.select("_t", "comp", "least", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    order = F.struct(F.col("least").isNull().alias("none"), "least", "_t")
    of_class = of_text.groupBy("comp").agg(F.min("least").alias("class_id"), F.min(order).alias("keeps"))
    return rows.select("doc_id", "_t"), of_text.join(of_class, "comp").select("_t", "class_id", "n_links", "copies", F.col("keeps._t").alias("kept_t"), F.col("keeps.least").alias("kept_id"))


def linked(docs: DataFrame, bands: Callable, doc_id: str, text: str, threshold: float, multiset: bool = True) -> DataFrame:
    """(doc_id, class_id, n_links) of every row. n_links counts the verified links of a row's text to other texts, as far as classes needed them."""
    rows, texts = grouped(docs, bands, doc_id, text, threshold, multiset)
    # a text that nothing else is like or equal to is its own class, whatever its id
    several = cut(texts.filter((F.col("copies") > 1) | (F.col("kept_t") != F.col("_t")) | (F.col("n_links") > 0)).select("_t", "copies", "class_id", "n_links"), "several")
    some, rest = told_apart(rows, several, ["_t"])
    lone = F.col("n_links").isNull()
    columns = ["doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")]
    out = rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    for part in with_facts(some, several, "_t", "copies", rows.count()):
        out = out.union(part.select(*columns))
    return out


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` less all but one of each class: a row of the least id (ids before none, then the least text)."""
    rows, texts = grouped(docs, _bag_bands, doc_id, text, threshold)
    several = cut(texts.filter((F.col("copies") > 1) | (F.col("kept_t") != F.col("_t"))).select("_t", "copies", "kept_t", "kept_id"), "several")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].cast("long").alias("id"), F.unhex(F.md5(F.coalesce(docs[text], F.lit("")))).alias("_t"))
    some, out = told_apart(keyed, several, ["_t"])
    out = out.select("row")
    for part in with_facts(some, several, "_t", "copies", rows.count()):
        twins = part.filter((F.col("kept_t") == F.col("_t")) & F.col("id").eqNullSafe(F.col("kept_id"))).dropDuplicates(["_t"])
        out = out.union(part.filter("kept_t is null").select("row")).union(twins.select("row"))
    return out.select("row.*")


def _first(free: DataFrame, n: int, key) -> DataFrame:
    """The first ``n`` rows of each bucket by ``key``, then by text; a bucket's rows are cut down in parts before they meet."""
    part = F.pmod(F.xxhash64("_t"), F.lit(64))
    some = free.withColumn("_p", part).withColumn("_k", key)
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("bucket", "_p").orderBy("_k", "_t"))).filter(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(W.partitionBy("bucket").orderBy("_k", "_t"))).filter(F.col("_r") <= n).select("bucket", "_t", "comp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every row."""
    return linked(docs, _bag_bands, doc_id, text, threshold)
