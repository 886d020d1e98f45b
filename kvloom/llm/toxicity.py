"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned: words, and word stems, that labelled toxic documents hold and others do not. Its words form a trie. The automaton of all
strings within one edit of a word of five letters or more is intersected with that trie once, on the driver, into a table of states; a batch of
documents runs all its words through the table in lockstep, a letter a step, so misspelled terms cost no more than exact ones. Edits are counted in
UTF-8 bytes after folding A-Z.

Every hit is looked at in a window of words around it: marks of quotation on both sides, and how much more often the words around it stand near hits
of toxic documents than near hits of others. A logistic model weighs plain, misspelled, stem and quoted hits and the windows' scores.

Defined results: a null text is empty; an empty text has no hits and gets the model's score for none; repeated rows get equal scores; with no
labelled rows the lexicon is empty and every score is 0.5; an empty table gives an empty result; only the text decides a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import slices, span_hashes, texts_of, word_spans
from kvloom.llm.training import labelled

#: Labelled rows that a model is fitted on, about.
MOST_ROWS = 20_000
THRESHOLD = 0.5
WINDOW = 5
STEMS = (4, 5, 6, 7, 8)
FUZZY_FROM = 5
_BUCKETS = 1024
_QUOTES = ('"', "“", "”", "„", "«", "»")
_EXACT, _MISSPELLED, _STEM = 1, 2, 3


class Trie:
    def __init__(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.ends: dict[int, dict[int, float]] = {}  # by node and kind: the term's weight

    def add(self, term: bytes, kind: int, weight: float) -> None:
        at = 0
        for c in term:
            at = self.children[at].setdefault(c, len(self.children))
            if at == len(self.children):
                self.children.append({})
        self.ends.setdefault(at, {})[kind] = weight


@dataclass
class Automaton:
    """step[state, letter class] is the next state, 0 the dead one and 1 the first; accepts[state] is the kind of hit for a word that ends there, weight[state] its term's."""

    letter: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    weight: np.ndarray


def intersect(terms: list[tuple[bytes, bool, float]], fuzzy_from: int = FUZZY_FROM) -> Automaton:
    """The trie of ``terms`` (bytes, is a stem, weight) met with the automaton of one edit, made deterministic."""
    trie, strict = Trie(), Trie()  # words that allow an edit; words and stems that do not
    for term, stem, weight in terms:
        if stem or len(term) < fuzzy_from:
            strict.add(term, _STEM if stem else _EXACT, weight)
        else:
            trie.add(term, _EXACT, weight)
    letters = sorted({c for term, _, _ in terms for c in term})
    letter = np.zeros(256, np.int64)  # class 0: any other byte
    for k, c in enumerate(letters, 1):
        letter[c] = k
        if 97 <= c <= 122:
            letter[c - 32] = k
    both = (trie, strict)

    def closed(states: set) -> frozenset:
        """With letters of a term left out, and without what a state with fewer edits covers."""
        todo = list(states)
        while todo:
            t, node, edits = todo.pop()
            if t == 0 and edits == 0:
                for child in trie.children[node].values():
                    if (0, child, 1) not in states:
                        states.add((0, child, 1))
                        todo.append((0, child, 1))
        return frozenset(s for s in states if not (s[2] == 1 and (s[0], s[1], 0) in states))

    def moved(states: frozenset, c: int) -> frozenset:
        out = set()
        for t, node, edits in states:
            if t == 1 and _STEM in strict.ends.get(node, ()):
                out.add((t, node, 2))  # past a stem, whatever follows
            if edits == 2:
                continue
            child = both[t].children[node].get(c)
            if child is not None:
                out.add((t, child, edits))
            if t == 0 and edits == 0:
                out.add((0, node, 1))
                out.update((0, x, 1) for x in trie.children[node].values())
        return closed(out)

    start = closed({(0, 0, 0), (1, 0, 0)})
    number, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
    for states in order:
        told = {c for t, node, edits in states if edits < 2 for c in both[t].children[node]}  # all other letters lead where -1 does
        row = []
        for c in [-1, *letters]:
            if c >= 0 and c not in told:
                row.append(row[0])
                continue
            to = moved(states, c)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)

    def ending(states: frozenset) -> tuple[int, float]:
        """Plain words come before stems and these before misspellings; then the greatest weight."""
        found = []
        for t, node, edits in states:
            ends = both[t].ends.get(node, {})
            if edits == 2:
                found.append((2, ends[_STEM], _STEM))
            elif _EXACT in ends:
                found.append((1 if edits else 3, ends[_EXACT], _MISSPELLED if edits else _EXACT))
        return max(found)[:0:-1] if found else (0, 0.0)

    last = [ending(s) for s in order]
    return Automaton(letter, np.array(rows, np.int32), np.array([k for k, _ in last], np.int64), np.array([w for _, w in last]))


def hits(automaton: Automaton, run: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hits, of what kind, and their terms' weights."""
    live = np.arange(len(start))
    state = np.ones(len(start), np.int32)
    found, kinds, weights = [], [], []
    k = 0
    while len(live):
        state = automaton.step[state, automaton.letter[run[start[live] + k]]]
        k += 1
        over = end[live] - start[live] == k
        kind = automaton.accepts[state]
        hit = over & (kind > 0)
        found.append(live[hit])
        kinds.append(kind[hit])
        weights.append(automaton.weight[state[hit]])
        go = ~over & (state > 0)
        live, state = live[go], state[go]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    found, kinds, weights = np.concatenate(found), np.concatenate(kinds), np.concatenate(weights)
    order = np.argsort(found)
    return found[order], kinds[order], weights[order]


@dataclass
class Model:
    automaton: Automaton
    terms: list[tuple[bytes, bool, float]]
    near: np.ndarray = field(default_factory=lambda: np.zeros(_BUCKETS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(11))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights, -30, 30)))


def _bare(run: np.ndarray) -> np.ndarray:
    """Typographic punctuation (U+2000 to U+203F, guillemets) in place of which stand spaces: it parts words."""
    out = run.copy()
    for k in np.flatnonzero((run[:-2] == 0xE2) & (run[1:-1] == 0x80)) if len(run) > 2 else ():
        out[k : k + 3] = 32
    for k in np.flatnonzero((run[:-1] == 0xC2) & ((run[1:] == 0xAB) | (run[1:] == 0xBB))) if len(run) > 1 else ():
        out[k : k + 2] = 32
    return out


def windows(model: Model, run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each hit's document, kind, weight and whether it is quoted; each document's words; and the buckets of the words around each hit."""
    start, end, first = word_spans(_bare(run), at)
    which, kind, weight = hits(model.automaton, run, start, end)
    doc = np.searchsorted(first, which, "right") - 1
    doc = np.minimum(doc, len(at) - 2) if len(at) > 1 else doc
    quoted = np.zeros(len(which), bool)
    around = []
    marks = [q.encode() for q in _QUOTES]
    for i, (w, d) in enumerate(zip(which, doc)):
        lo, hi = max(first[d], w - WINDOW), min(first[d + 1], w + WINDOW + 1)
        left = bytes(run[max(at[d], start[lo] - 3) : start[w]])
        right = bytes(run[end[w] : min(at[d + 1], end[hi - 1] + 3)])
        quoted[i] = any(m in left for m in marks) and any(m in right for m in marks)
        others = np.concatenate([np.arange(lo, w), np.arange(w + 1, hi)])
        around.append((span_hashes(run[at[d] : at[d + 1]], start[others] - at[d], end[others] - at[d]) % np.uint64(_BUCKETS)).astype(np.int64) if len(others) else others)
    return doc, kind, weight, quoted, np.diff(first), around


def features(model: Model, run: np.ndarray, at: np.ndarray) -> np.ndarray:
    doc, kind, weight, quoted, words, around = windows(model, run, at)
    n = len(at) - 1
    near = np.array([model.near[a].mean() if len(a) else 0.0 for a in around])
    plain = ~quoted
    count = lambda of: np.bincount(doc[of], minlength=n).astype(np.float64)
    total = count(plain)
    best, heaviest = np.zeros(n), np.zeros(n)
    np.maximum.at(best, doc[plain], near[plain])
    np.maximum.at(heaviest, doc[plain], weight[plain])
    heavy = np.minimum(np.bincount(doc[plain], weight[plain], n), 20.0)
    columns = [count(plain & (kind == _EXACT)), count(plain & (kind == _MISSPELLED)), count(plain & (kind == _STEM)), count(quoted)]
    return np.column_stack([*np.log1p(columns), total > 0, 100 * total / np.maximum(words, 20), best, np.bincount(doc, near, n), heavy, heaviest])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, bad, n): in how many rows, and toxic rows, a slice has each word of three letters or more and each beginning of longer words."""
    for rows, data, at in slices(batches, "text"):
        start, end, first = word_spans(_bare(data), at)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        _, one, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        number: dict[tuple[str, bool], int] = {}
        word, term = [], []
        for k, i in enumerate(one.tolist()):
            w = raw[start[i] : end[i]].lower().decode()
            if len(w) >= 3:
                forms = [(w, False), *((w[:n], True) for n in STEMS if len(w) > n)]
                word += [k] * len(forms)
                term += [number.setdefault(f, len(number)) for f in forms]
        if not number:
            continue
        word, term = np.array(word), np.array(term)
        of_word = np.searchsorted(word, np.arange(len(one) + 1))
        pair = np.unique(doc * len(one) + which)  # a word counts once a row
        doc, which = pair // len(one), pair % len(one)
        count = np.diff(of_word)[which]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found = np.unique(np.repeat(doc, count) * len(number) + term[np.repeat(of_word[:-1][which], count) + step])
        label = rows.column(1).to_numpy()
        bad = np.bincount(found % len(number), label[found // len(number)] > 0, len(number)).astype(np.int64)
        n = np.bincount(found % len(number), minlength=len(number))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in number]), pa.array([s for _, s in number]), pa.array(bad), pa.array(n)], ["term", "stem", "bad", "n"])


def _terms(train: DataFrame) -> list[tuple[bytes, bool, float]]:
    """Words, and stems of longer words, that mark toxic rows: at least eight have them, and more than half of the rows with them are toxic after smoothing.

    Words are those that scoring sees. Nothing but the bounded sample of rows bounds the lexicon.
    """
    counted = train.mapInArrow(_counted, "term string, stem boolean, bad long, n long").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    rows, bad = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = bad / rows if rows else 0.0
    sure = (F.col("bad") + 4 * F.lit(prior)) / (F.col("n") + 4)
    found = counted.filter((F.col("bad") >= 8) & (sure >= 0.55)).collect()
    found.sort(key=lambda r: (-r["bad"], len(r["term"]), r["term"], r["stem"]))
    begun: dict[str, int] = {}  # by beginning: the most toxic rows of one word
    for r in found:
        if not r["stem"]:
            for n in STEMS:
                begun[r["term"][:n]] = max(begun.get(r["term"][:n], 0), r["bad"])
    out: list[tuple[str, bool, float]] = []
    stems: dict[str, float] = {}
    for r in found:
        term, stem = r["term"], r["stem"]
        if stem and begun.get(term, 0) >= 0.9 * r["bad"]:
            continue  # a single word's beginning; the word itself allows misspellings
        good = r["n"] - r["bad"]
        weight = float(np.log((r["bad"] + 0.5) / (bad + 1)) - np.log((good + 0.5) / (rows - bad + 1)))
        if not any(stems.get(term[:n], -np.inf) > weight - 0.3 for n in STEMS if n < len(term)):  # else a shorter stem in the lexicon covers it
            out.append((term, stem, weight))
            if stem:
                stems[term] = weight
    return [(t.encode(), s, w) for t, s, w in out]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    train = labelled(docs, labels, "toxic", most)
    terms = _terms(train)
    model = Model(intersect(terms), terms)

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "text"):
            doc, *_, around = windows(model, data, at)
            label = rows.column(1).to_numpy()
            table = np.zeros((2, _BUCKETS), np.int64)
            for d, a in zip(doc, around):
                np.add.at(table[int(label[d] > 0)], a, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], _BUCKETS)), pa.array(np.tile(np.arange(_BUCKETS), 2)), pa.array(table.ravel())], ["label", "bucket", "n"])

    table = np.zeros((2, _BUCKETS))
    for r in train.mapInArrow(nearby, "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():
        table[r["label"], r["bucket"]] = r["n"]
    odds = np.log((table[1] + 1) / (table[1].sum() + _BUCKETS)) - np.log((table[0] + 1) / (table[0].sum() + _BUCKETS))
    model.near = odds * min(1.0, table[0].sum() / 2000)  # few hits outside toxic rows tell little

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(list(features(model, data, at))), rows.column(1)], ["x", "label"])

    held = train.mapInArrow(measured, "x array<double>, label int").toPandas()
    if len(held):
        x, y = np.stack(held["x"]), held["label"].to_numpy(np.float64)
        order = np.lexsort([y, *x.T])
        model.weights = _logistic(x[order], y[order])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, turns: int = 30) -> np.ndarray:
    """Newton's method with a ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + l2 * w)
    return w


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(features(model, data, at)))], ["doc_id", "score"])

    return texts_of(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, text):
            yield rows.filter(pa.array(model.scores(features(model, data, at)) < threshold))

    return docs.mapInArrow(run, schema)
