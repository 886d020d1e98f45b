import hashlib
import random
from collections import Counter

import pytest
from tests.llm.corpora import frame, odd_rows

from kvloom.llm import suffix_dedup
from kvloom.llm.common import SLICE_BYTES


def brute(rows):
    bodies = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for r, b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((str(r[0]), len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(r.randint(30, 120)) for _ in range(6)]
    line = prose(12)
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.35:
                p = r.choice(passages)
                a = r.randint(0, len(p) // 3)
                parts.append(p[a : len(p) - r.randint(0, len(p) // 3)])
            elif kind < 0.45:
                parts.append(line)
            elif kind < 0.5:
                parts.append("ab" * r.randint(50, 200))
            else:
                parts.append(prose(r.randint(5, 80)))
        texts.append(r.choice([" ", "\n", ""]).join(parts))
    texts += [texts[0], texts[3], texts[4][:-1] + "!", "x" * 199, "x" * 199, "y" * 200, "z" * 201, passages[0][:199], "é" * 150]
    return [(i, t, "en", "s", 0, 0, "", "") for i, t in enumerate(texts)]


def same(spark, rows):
    got = suffix_dedup.digests(frame(spark, rows)).collect()
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_byte_is_as_brute_force_says(spark, seed):
    same(spark, corpus(seed))


def test_common_anchors_go_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_ROWS", 3)
    same(spark, corpus(3))


def test_odd_rows(spark):
    same(spark, odd_rows())
    same(spark, [])


def test_texts_are_cut_at_whole_characters(spark):
    rows = odd_rows() + [(7000, "é" * 120 + "a", "fr", "s", 121, 0, "", ""), (7001, "b" + "é" * 120, "fr", "s", 121, 0, "", "")]
    got = suffix_dedup.deduplicated(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    got = got.collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    assert by[1000].text == by[0].text and (by[0].text == "" or len(by[0].text) < 200)
    assert by[7000].text.endswith("a") and by[7000].n_chars == len(by[7000].text) < 121
    assert by[3000].text is None


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    passage = "".join(random.Random(5).choices("abcdefgh", k=260))
    rows = [(5, "start " + passage + " end", "en", "s", 0, 0, "", "")]
    for k, who in enumerate([None] * 400 + [7] * 400):
        body = "".join(random.Random(100 + k).choices("ijklmnop", k=300))
        rows.append((who, body[:150] + passage + body[150:] if k % 100 == 3 else body, "en", "s", 0, 0, "", ""))
    rows += [rows[9], (None, None, "en", "s", 0, 0, "", "")]
    same(spark, rows)


def test_texts_longer_than_a_slice(spark):
    r = random.Random(9)
    long = "".join(r.choices("abcdefghijklmnop ", k=SLICE_BYTES + 5000))
    rows = [(1, long, "en", "s", 0, 0, "", ""), (2, "x" + long[1_000_000:1_000_700] + "y", "en", "s", 0, 0, "", ""), (3, long[:199], "en", "s", 0, 0, "", ""), (4, long[-400:], "en", "s", 0, 0, "", "")]
    same(spark, rows)
