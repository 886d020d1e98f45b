import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.corpora import frame, odd_rows

from kvloom.llm import fingerprints, near_dedup
from kvloom.llm.common import shingles, text_bytes


def bag(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def similarity(a, b):
    top = sum((a & b).values())
    return top / max(1, sum((a | b).values()))


def brute_classes(rows):
    bags = [bag(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bags[i], bags[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), str(least.get(find(i)))) for i, r in enumerate(rows))


def test_classes_are_those_of_all_pairs(spark):
    rows = odd_rows()
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows)


def test_large_bucket_of_unlike_members_is_resolved(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in range(i % 40):
            words[(i * 7 + k * 5) % 200] = f"x{i}_{k}"
        rows.append((i, " ".join(words), "en", "s", 0, 0, "", ""))
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    want = dict(brute_classes(rows))
    wrong = [r for r in got if str(r.class_id) != want[str(r.doc_id)]]
    assert len(wrong) <= 3  # a link at the threshold is found with a probability of 0.9999 by design


def test_no_rows_no_classes(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_bag_signatures_estimate_weighted_jaccard():
    texts = ["a b c d e f g h " * 20 + "tail one two", "a b c d e f g h " * 12 + "tail one two"]
    hashed, at = shingles(*text_bytes(pa.array(texts)))
    slots = near_dedup.bag_signatures(hashed, at, 4096)
    assert abs((slots[0] == slots[1]).mean() - similarity(bag(texts[0]), bag(texts[1]))) < 0.03
    assert np.isfinite(slots.view(np.float64)).all()


def test_edited_fingerprints_match_a_plain_loop(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = fingerprints.edited_fingerprints(frame(spark, rows)).collect()
    rows = sorted(rows, key=lambda r: (-r[0], (r[1] or "").encode()))
    by = {}
    for i, r in enumerate(rows):
        text, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        by.setdefault((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest()), []).append((text, changed, after))
    assert len(got) == len(rows)
    for g in got:
        text, changed, after = by[(g.doc_id, g.n_chars, g.edited_sha256)][0]
        for value, other in ((g.near_edited, changed), (g.near_next, after)):
            a, b = set(bag(text)), set(bag(other))
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - true) < 0.2
    prints = {}
    for g in got:
        prints.setdefault(by[(g.doc_id, g.n_chars, g.edited_sha256)][0][0], set()).add(g.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_one_row_follows_itself(spark):
    (row,) = fingerprints.edited_fingerprints(frame(spark, [(5, "abcdef", "en", "s", 0, 0, "", "")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fingerprints.edited_fingerprints(frame(spark, [])).collect() == []


def test_minhash_classes(spark):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] < 3006]
    got = {r.doc_id: r.class_id for r in fingerprints.classes(frame(spark, rows)).collect()}
    assert got[1000] == got[0] and got[1006] == got[6]


def test_minhash_classes_are_those_of_all_pairs_of_sets(spark):
    rows = odd_rows()
    sets = [set(bag(r[1])) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    want = sorted((str(d), str(min((x for x in g if x is not None), default=None))) for g in groups.values() for d in g)
    assert sorted((str(r.doc_id), str(r.class_id)) for r in fingerprints.classes(frame(spark, rows)).collect()) == want


def test_rows_without_an_id_come_after_all_others(spark):
    rows = [(2, "b" * 9, "en", "s", 0, 0, "", ""), (None, "n" * 6, "en", "s", 0, 0, "", ""), (None, "m" * 6, "en", "s", 0, 0, "", ""), (1, "a" * 9, "en", "s", 0, 0, "", "")]
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    texts = [(2, "b" * 6 + "a" * 3), (1, "a" * 6 + "m" * 3), (None, "m" * 4 + "n" * 2), (None, "n" * 4 + "b" * 2)]
    assert got == {(i, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}


def test_an_id_that_fills_several_ranges_is_cut_by_its_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1000)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ape", "bear", "cat", "élan", "𝄞"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    ids = [7 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(300)]
    rows = [(d, t, "en", "s", 0, 0, "", "") for d, t in zip(ids, texts)]
    keyed = frame(spark, rows).selectExpr("coalesce(doc_id, -9223372036854775808) AS _key", "text AS _text")
    held = fingerprints._ranges(keyed)
    assert [k for k, c in zip(held.keys.tolist(), held.cuts) if len(c) > 3] == [-(1 << 63), 7] and held.total > 20
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1].encode()))
    want = []
    for r, after in zip(order, order[1:] + order[:1]):
        k = len(r[1]) // 3
        want.append((str(r[0]), len(r[1]), hashlib.sha256((r[1][: len(r[1]) - k] + after[1][:k]).encode()).hexdigest()))
    got = fingerprints.edited_fingerprints(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_large_buckets_are_dealt_to_splits(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT_ROWS", 20)
    monkeypatch.setattr(near_dedup, "HEAVY", 0.0)
    test_large_bucket_of_unlike_members_is_resolved(spark)


def test_texts_longer_than_a_slice(spark):
    words = [f"w{i % 7000}x{i % 11}" for i in range(250_000)]  # over a slice
    rows = [(1, " ".join(words), "en", "s", 0, 0, "", ""), (2, " ".join(words[:-9]), "en", "s", 0, 0, "", ""), (3, "short one", "en", "s", 0, 0, "", "")]
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    assert got[2].near_next > 0.95 and got[1].near_next == 0.0 and got[1].n_chars == len(rows[0][1])


def jobs_of(spark, name, run):
    """The jobs that ``run`` starts, and their tasks."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    jobs = told.getJobIdsForGroup(name)
    stages = {s for j in jobs for s in told.getJobInfo(j).stageIds}
    return len(jobs), sum(x.numCompletedTasks for s in stages if (x := told.getStageInfo(s)))


def test_components_of_few_and_of_many_edges_are_the_same(spark, monkeypatch):
    rng = random.Random(6)
    some = {tuple(sorted(rng.sample(range(400), 2))) for _ in range(250)} | {(i, i + 1) for i in range(500, 540)}
    edges = [(b"%03d" % b, b"%03d" % a) for a, b in some]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    held = spark.createDataFrame(edges, "a binary, b binary")
    for few in (near_dedup.FEW, 0):
        monkeypatch.setattr(near_dedup, "FEW", few)
        got = {bytes(r.node): bytes(r.comp) for r in near_dedup.components(held, len(edges)).collect()}
        assert parent == {x: x for x in parent} | got  # a least node may be left out
    assert near_dedup.components(held.limit(0), 0).collect() == []


def test_many_partitions_of_few_rows_make_few_tasks(spark):
    """A small table takes no task a shuffle partition to write, and its links no rounds."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = odd_rows()
    got = []
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        _, tasks = jobs_of(spark, "near", lambda: got.extend(near_dedup.near_duplicates(frame(spark, rows)).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows)
    assert tasks < 2500


def test_rounds_beyond_few_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FEW", 0)
    test_classes_are_those_of_all_pairs(spark)
    test_large_bucket_of_unlike_members_is_resolved(spark)
