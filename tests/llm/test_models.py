import re

import numpy as np
from tests.llm.corpora import frame, odd_rows

from kvloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def spans(text: bytes):
    from kvloom.llm.common import word_spans

    run = np.frombuffer(text, np.uint8)
    return run, *word_spans(run, np.array([0, len(run)]))[:2]


def test_automaton_accepts_what_edit_distance_allows():
    terms = [(b"moron", False, 1.0), (b"clown", False, 2.0), (b"bad", False, 3.0), (b"vequ", True, 4.0), (b"crown", False, 5.0)]
    rng = np.random.default_rng(3)
    words = [b"moron", b"mroon", b"MORON", b"moro", b"moronn", b"clwn", b"bad", b"bax", b"vequ", b"vequx", b"vqux", b"a", b"clowns", b"xclown"]
    words += [bytes(rng.choice(list(b"morclwnbadx"), rng.integers(1, 7))) for _ in range(3000)]
    which, kind, _ = toxicity.hits(toxicity.intersect(terms), *spans(b" ".join(words)))
    got = dict(zip(which, kind))
    for i, w in enumerate(words):
        w = w.lower()
        exact = w in (b"moron", b"clown", b"bad", b"crown")
        near = min(edits(w, t) for t in (b"moron", b"clown", b"crown")) == 1
        stem = w.startswith(b"vequ") and len(w) > 4
        assert got.get(i, 0) == (1 if exact else 3 if stem else 2 if near else 0), w


def held_out(spark, scores, labels, name):
    rows = scores.filter("held_out").join(labels, "doc_id").select("score", "predicted", name).toPandas()
    order = rows.score.rank().to_numpy()
    y = rows[name].to_numpy()
    auc = (order[y == 1].mean() - (y == 1).sum() / 2 - 0.5) / (y == 0).sum()
    return auc, (rows.predicted.to_numpy() == y).mean()


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    auc, right = held_out(spark, quality.judged(toxicity.score(docs, toxicity.fit(docs, labels)), 0.5), labels, "toxic")
    assert auc > 0.94 and right > 0.97


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    auc, right = held_out(spark, quality.judged(quality.score(docs, quality.fit(docs, labels)), 0.3), labels, "quality")
    assert auc > 0.99 and right > 0.98


def test_odd_rows_are_scored(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0), int(r[0] % 4 == 0)) for r in rows if r[0] is not None] + [(77_777, None, None)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        for module in (quality, toxicity):
            model = module.fit(docs, table)
            got = module.score(docs, model).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
            assert module.score(docs.limit(0), model).collect() == []
            by = {}
            for r in got:
                by.setdefault(r.doc_id, set()).add(r.score)
            assert all(len(x) == 1 for x in by.values())
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_quotation_is_told_from_abuse():
    model = toxicity.Model(toxicity.intersect([(b"moron", False, 1.0)]), [])
    texts = ["you are a moron and that is it", 'he wrote "you moron" in the report', "“moron” is a word", ""]
    import pyarrow as pa

    from kvloom.llm.common import text_bytes

    doc, kind, _, quoted, words, _ = toxicity.windows(model, *text_bytes(pa.array(texts)))
    assert doc.tolist() == [0, 1, 2] and quoted.tolist() == [False, True, True] and words[3] == 0


def plain_hit(word, terms):
    """(kind, weight) of a word by edit distances to every term, or None."""
    found = []
    for term, stem, weight in terms:
        if stem:
            if word.startswith(term) and len(word) > len(term):
                found.append((2, weight, 3))
        elif word == term:
            found.append((3, weight, 1))
        elif len(term) >= 5 and edits(word, term) == 1:
            found.append((1, weight, 2))
    return max(found)[:0:-1] if found else None


def plain_score(text, model):
    """A text's score by loops over its words."""
    from kvloom.llm.common import span_hashes

    raw = (text or "").encode()
    bare = re.sub(rb"\xe2\x80.|\xc2[\xab\xbb]", lambda m: b" " * len(m[0]), raw, flags=re.S)
    words = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", bare)]
    bucket = lambda a, b: int(span_hashes(np.frombuffer(raw[a:b], np.uint8), np.array([0]), np.array([b - a]))[0] % np.uint64(1024))
    marks = [q.encode() for q in "\"“”„«»"]
    kinds, weights, best, near_all = [0, 0, 0, 0], [], 0.0, 0.0
    for w, (a, b) in enumerate(words):
        hit = plain_hit(raw[a:b].lower(), model.terms)
        if not hit:
            continue
        around = words[max(0, w - 5) : w] + words[w + 1 : w + 6]
        near = float(np.mean([model.near[bucket(*x)] for x in around])) if around else 0.0
        left = raw[max(0, words[max(0, w - 5)][0] - 3) : a]
        right = raw[b : words[min(len(words) - 1, w + 5)][1] + 3]
        near_all += near
        if any(m in left for m in marks) and any(m in right for m in marks):
            kinds[3] += 1
        else:
            kinds[hit[0] - 1] += 1
            weights.append(hit[1])
            best = max(best, near)
    total = len(weights)
    x = [*np.log1p(kinds), total > 0, 100 * total / max(len(words), 20), best, near_all, min(sum(weights), 20.0), max([0.0, *weights])]
    return 1 / (1 + np.exp(-(model.weights[0] + np.dot(x, model.weights[1:]))))


def test_scores_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(8)
    terms = [(b"moron", False, 1.5), (b"clown", False, 2.0), (b"crown", False, 0.5), (b"bad", False, 1.0), (b"vequ", True, 0.7), ("éclat".encode(), False, 1.2)]
    model = toxicity.Model(toxicity.intersect(terms), terms, rng.normal(size=1024), rng.normal(size=11) / 4)
    words = ["moron", "MORON", "mroon", "moro", "clowns", "Crown", "crowm", "bad", "bat", "vequ", "vequist", "éclat", "Éclat", "eclat", "plain", "word", "日本", "naïve", "x"]
    joints = [" ", " ", " ", " ", ", ", ' "', '" ', " “", "” ", "«", "»", "—", ".\n"]
    make = lambda n: "".join(w + j for w, j in zip(rng.choice(words, n), rng.choice(joints, n)))
    texts = [None, "", "moron", '"moron"', *(make(n) for n in rng.integers(1, 60, 150))]
    texts += texts[4:7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts) and len(set(got.values())) > 100
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(t, model)) < 1e-9, t


def test_terms_are_counted_by_rows(spark):
    texts = [("a “vile” word, Vile VILE éclairs", 1), ("éclairs in vilest words", 0), (None, 1), ("", 0), ("vilest vileness", 1)]
    plain = spark.createDataFrame([(t or "", y) for t, y in texts], "text string, label int").repartition(1)
    got = {(r.term, r.stem): (r.bad, r.n) for r in plain.mapInArrow(toxicity._counted, "term string, stem boolean, bad long, n long").collect()}
    assert got["vile", False] == (1, 1) and got["éclairs", False] == (1, 2) and got["vilest", False] == (1, 2)
    assert got["vile", True] == (1, 2) and got["éclai", True] == (1, 2) and got["viles", True] == (1, 2) and got["vilen", True] == (1, 1)
    assert ("in", False) not in got and ("word", True) in got and ("word", False) in got


def test_the_lexicon_has_no_cap(spark):
    rng = np.random.default_rng(6)
    make = lambda: "".join(rng.choice(list("bcdfghklmnprst"), 7))
    bad, good = [make() for _ in range(400)], [make() for _ in range(400)]
    rows = [(i, " ".join([*rng.choice(good, 20), *(rng.choice(bad, 20) if i % 2 else rng.choice(good, 20))]), i % 2) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {t.decode() for t, stem, _ in model.terms if not stem} >= set(bad) - set(good)
    got = quality.judged(toxicity.score(docs, model), 0.5).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 1190


def test_columns_named_like_outputs_do_no_harm(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 9, "x", 7, 1) for i in range(30)], "doc_id long, text string, score int, predicted string, held_out int, label int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = quality.judged(module.score(docs, module.fit(docs, labels)), 0.5)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 30
    assert toxicity.kept(docs, toxicity.fit(docs, labels)).columns == docs.columns


def test_texts_longer_than_a_slice_are_scored(spark):
    long = "some plain words here. " * 60_000  # over a slice
    docs = spark.createDataFrame([(1, long), (2, long[:23 * 40]), (3, None)], "doc_id long, text string")
    for score in (toxicity.score(docs, toxicity.Model(toxicity.intersect([(b"moron", False, 1.0)]), [])), quality.score(docs, quality.grow(np.zeros((0, 27), np.float32), np.zeros(0)))):
        assert sorted(r.doc_id for r in score.collect()) == [1, 2, 3]
    import pyarrow as pa

    from kvloom.llm.common import text_bytes

    apart = [quality.statistics(*text_bytes(pa.array([t])))[0] for t in (long, "tiny")]
    assert np.allclose(quality.statistics(*text_bytes(pa.array([long, "tiny"]))), apart)


def plain_trees(x, y, trees, depth, bins, rate=0.2, l2=2.0):
    """Boosting by loops over nodes, features and edges, and a walk row by row."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower").astype(np.float32)
    mean = y.mean()
    raw = np.full(len(x), np.log(mean / (1 - mean)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes = [np.arange(len(x))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-6, None)
                for f in range(x.shape[1]):
                    for e in edges[:, f]:
                        left = x[rows, f] <= e
                        a, b = rows[left], rows[~left]
                        if h[a].sum() < 1 or h[b].sum() < 1:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, b))
                below += best[1] or (rows, rows[:0])
            nodes = below
        for rows in nodes:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-raw))


def test_trees_are_those_of_a_plain_search():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(size=300) * 0.5) > 0).astype(float)
    model = quality.grow(x, y, trees=5, depth=3, bins=8)
    assert np.allclose(model.scores(x), plain_trees(x, y, 5, 3, 8), atol=1e-6)


def test_trees_learn_a_step():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 2] > 0.3) ^ (x[:, 4] < 0)).astype(float)
    model = quality.grow(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
