import random
import re
import textwrap

import duckdb
from tests.llm.corpora import frame, odd_rows

from kvloom.llm import license_scan
from kvloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    ws = words(text)
    starts, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    best, labels = 0.0, set(base)
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, t in license_scan.TEMPLATES:
            t = set(t.split())
            c = len(t & have) / len(t)
            if c >= license_scan.THRESHOLD - 1e-12:
                labels.add(label)
                best = max(best, c)
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


TEXTS = [
    "Released under the MIT’License? no", "MIT... License; mit\nlicense\tMIT", "permit license mit licenses", "Apache\x00License", "the apacheé license", "GNU general  public-license gnu GENERAL public LICENSE",
    "Licensed under the Apache Licence, Version 2.0", "licensed apache version 2 0 under, the: thing", "CC BY-NC 4.0 under licensed!", "cc by", "Kelvin mit K license", "word " * 3000 + "released under the mit license " + "tail " * 3000,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions hold",
]


def test_scan_is_as_brute_force_says(spark):
    rows = odd_rows() + [(8000 + i, t, "en", "s", 0, 0, "", "") for i, t in enumerate(TEXTS)]
    got = license_scan.scan(frame(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert sorted(map(str, (tuple(g) for g in got))) == sorted(str((r[0], *brute(r[1]))) for r in rows)


def test_columns_of_the_input_stay(spark):
    docs = frame(spark, odd_rows()).withColumnRenamed("rank", "score").withColumnRenamed("class_id", "labels")
    got = license_scan.scan(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "_text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op9_license_scan"](spark, SF)
    want = c.sql(ORACLE_SQL["op9_license_scan"]).select(*got.columns).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def brute_runs(text):
    """Labels and the best containment of runs of words across line breaks."""
    ws, labels, best = words(text), set(), 0.0
    for label, t in license_scan.TEMPLATES:
        width = -(-len(t.split()) * 5 // 4)
        c = max((len(set(t.split()) & set(ws[i : i + width])) / len(set(t.split())) for i in range(len(ws))), default=0)
        if c >= license_scan.THRESHOLD - 1e-12:
            labels.add(label)
            best = max(best, c)
    return labels, best


def test_wrapped_notices_are_found(spark):
    r = random.Random(3)
    other = lambda: " ".join(r.choices("some other words stand here in the file and of no license".split(), k=30))
    texts, want = [], []
    for label, notice in license_scan.TEMPLATES:
        for width in (20, 34, 70):
            for mark in ("", "# ", " * ", "// ", "dnl "):
                if width == 20 and mark == "dnl ":
                    continue
                lines = textwrap.wrap(f"{notice.capitalize()}.", width)
                texts.append(r.choice(["\n", "\r\n"]).join([other(), *[mark + x for x in lines], other()]))
                want.append(label)
    texts.append("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software")
    texts.append("/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */")
    want += ["mit", "bsd"]
    # far apart, the words are no notice
    texts.append("\n".join(f"{w} {other()}" for w in license_scan.TEMPLATES[2][1].split()))
    want.append(None)
    got = {g.doc_id: g for g in license_scan.scan(frame(spark, [(i, t, "en", "s", 0, 0, "", "") for i, t in enumerate(texts)])).collect()}
    for i, (t, label) in enumerate(zip(texts, want)):
        one = brute(t)
        labels, best = brute_runs(t)
        assert label is None or label in labels
        assert label is not None or "bsd" not in labels
        assert got[i].labels == ",".join(sorted({x for x in one[5].split(",") if x} | labels)), t
        assert got[i].score == max(one[6], best)


def test_rows_of_a_common_text_are_dealt_to_splits(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "SPLIT_ROWS", 10)
    text = "Released under the MIT License"
    rows = [(i if i % 2 else 7, text if i < 150 else f"{text} {i % 5}" if i < 200 else f"nothing {i}") for i in range(240)] + [(None, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert sum(r.labels == "mit" and r.score == 1.0 and len(r.notices) == 1 for r in got) == 200
    assert sum(r.labels == "" and r.score == 0.0 and r.notices == [] for r in got) == 41
