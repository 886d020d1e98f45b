import random
from collections import Counter

import corpus_pipeline
from tests.llm.corpora import frame, odd_rows
from tests.llm.test_near import brute_classes, jobs_of
from tests.llm.test_suffix import brute

from kvloom.llm import near_dedup, packing

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple(map(str, r))


def test_stages_follow_their_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen.append((name, docs.collect(), rows))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    (_, all_docs, clean), (_, _, single), (_, _, cut), (_, _, mixed), (_, _, packed) = seen
    assert set(map(key, clean)) <= set(map(key, all_docs))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in all_docs} - {r.doc_id for r in clean}
    assert sum(labels.get(i) == 0 for i in gone) <= 2
    classes = dict(brute_classes([(r.doc_id, r.text) for r in clean]))
    assert Counter(str(r.doc_id) for r in single) == Counter(set(classes.values()))
    want = {(x[0], x[1] - x[2]) for x in brute([(r.doc_id, r.text) for r in single])}
    got = {str(r.doc_id): len(r.text.encode()) for r in cut}
    assert all(0 <= got[i] - n <= 400 for i, n in want) and sum(got[i] != n for i, n in want) <= len(want) // 4
    assert sorted(map(key, cut)) == sorted(map(key, mixed))
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = odd_rows()
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns
                at = spark.createDataFrame(out.collect(), docs.schema)
            assert (n > 0) == (table is docs)


def test_equal_rows_keep_one(spark):
    rows = odd_rows()
    got = near_dedup.one_of_each(frame(spark, rows)).collect()
    want = {c for _, c in brute_classes(rows)}
    assert Counter(str(r.doc_id) for r in got) == Counter(want)


def test_sequences_follow_the_mix(spark):
    r = random.Random(7)
    texts = {"a": 1800, "b": 450}  # bytes 4 to 1, so weights 2 to 1 until b is used up
    rows = [(i, " ".join(r.choices(["sun", "moon", "rain", "tree", "house"], k=r.choice([20, 90, 200]))), "en", s, 0, 0, "", "") for i, s in enumerate(s for s, n in texts.items() for _ in range(n))]
    sources = {x[0]: x[3] for x in rows}
    docs = frame(spark, rows)
    mixed = corpus_pipeline.mix(spark, docs, SF)
    got = corpus_pipeline.pack(spark, mixed, SF).collect()
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, Counter())[sources[g.doc_id]] += g.length
    assert sorted(bins) == list(range(len(bins)))
    half, last = Counter(), Counter()
    for k, n in bins.items():
        if k < len(bins) // 2:
            half += n
        if k >= len(bins) * 4 // 5:
            last += n
    assert abs(half["b"] / half.total() - 1 / 3) < 0.06
    assert last["b"] / last.total() < 0.04
    plain = packing.pack(docs).collect()
    assert len({g.sequence_id for g in plain}) == len(bins)  # the mix costs no sequence


def in_order(pieces, capacity):
    """(piece, sequence, offset) by a plain loop; ``pieces``: (slot, source, rank, doc_id, piece, length, crc)."""
    by = {}
    for p in sorted(pieces):
        by.setdefault(p[5], []).append(p)
    packed = packing.improve(packing.best_fit({n: len(x) for n, x in by.items()}, capacity), capacity)
    bins = []
    for k, (contents, n) in enumerate(packed):
        led = by[contents[0]]
        bins += [(led[int((j + k * 0.6180339887498949 % 1) / n * len(led))][0], contents) for j in range(n)]
    left = {n: iter(x) for n, x in by.items()}
    filled = {}
    for b in sorted(range(len(bins)), key=lambda b: (bins[b][0], b)):
        filled[b] = [next(left[n]) for n in bins[b][1]]
    mean = {b: sum(p[0] * p[5] for p in ps) / sum(p[5] for p in ps) for b, ps in filled.items()}
    return {(p[3], p[4], s, sum(q[5] for q in filled[b][:i])) for s, b in enumerate(sorted(filled, key=lambda b: (mean[b], b))) for i, p in enumerate(filled[b])}


def test_sequences_follow_one_law_at_every_size(spark, monkeypatch):
    r = random.Random(11)
    docs = frame(spark, [(i, " ".join(["sun"] * r.randint(0, 150)), "en", "ab"[i % 2], 0, 0, "", "") for i in range(900)])
    places = [(i, "ab"[i % 2], i * 7 % 90 if i % 2 else i // 10, i) for i in range(900)]
    order = spark.createDataFrame(places, "doc_id long, source string, slot long, rank long")
    got = []
    for most in (500_000, 1):  # rows of the table of places from which on bins were once dealt less finely
        monkeypatch.setattr(packing, "MOST_PLACES", most, raising=False)
        got.append({(x.doc_id, x.piece, x.sequence_id, x.offset) for x in packing.pack(docs, capacity=100, order=order).collect()})
    assert got[0] == got[1]
    at = {i: (slot, source, rank) for i, source, slot, rank in places}
    pieces = packing.pieces(docs, capacity=100).collect()
    assert got[0] == in_order([(*at[x.doc_id], x.doc_id, x.piece, x.length, x.ids_crc32) for x in pieces], 100)


def test_classes_go_by_text_and_not_by_id(spark):
    r = random.Random(3)
    prose = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(80))
    a, b, c, d = prose(), prose(), prose(), prose()
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, c + " more"), (None, d), (None, d + " more"), (None, d), (None, None), (None, "")]
    got = near_dedup.one_of_each(frame(spark, [(i, t, "en", "s", 0, 0, "", "") for i, t in rows])).collect()
    kept = Counter((x.doc_id, (x.text or "")[:200]) for x in got)
    assert kept == Counter([(1, a[:200]), (2, b[:200]), (3, c[:200]), (None, d[:200]), (None, "")])


def test_stage_of_near_duplicates_makes_few_tasks_of_few_rows(spark):
    """The driver keeps a record of every task: many partitions of a small table must not make one each in every step."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rows, got = odd_rows(), []
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        _, tasks = jobs_of(spark, "stage", lambda: got.extend(corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert Counter(str(r.doc_id) for r in got) == Counter({c for _, c in brute_classes(rows)})
    assert tasks < 2600
