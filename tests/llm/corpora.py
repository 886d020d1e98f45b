"""Small tables with the odd rows that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, class_id string, _text string"


def odd_rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Plain and near copies, nulls, empty, tiny and long texts, repeated rows, and columns with names that operators use."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = r.choices(vocabulary, k=r.choice([1, 3, 5, 40, 120, 300]))
        rows.append([i, " ".join(words)])
        if i % 6 == 0:
            rows.append([1000 + i, rows[-1][1]])
        if i % 5 == 0 and len(words) > 30:
            other = list(words)
            for _ in range(r.choice([1, 2, 9])):
                other[r.randrange(len(other))] = "zebra"
            rows.append([2000 + i, " ".join(other)])
    rows += [[3000, None], [3001, ""], [3002, ""], [3003, " \n\t"], [3004, "É 日本語 ñandú 𝄞 " * 30], [3005, "a"], [3006, "word " * 5000], [3007, "word " * 5000 + "end"], [None, "no id here at all"], [3008, None]]
    rows += [rows[0], rows[0]]
    return [(d, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, i, "x", "y") for i, (d, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
