"""License scans: phrases by their word positions, notices by an exact set-similarity join. SQL functions only.

A text block is a line, or a run of words across line breaks, as many as the template's words divided by ``threshold``, so that wrapped and commented
notices are held. A notice (template) is found in a block when at least ``threshold`` of its distinct words are in the block.
The join is exact: the words of all templates are ordered by how many blocks hold them, rarest first; a block is paired with a template only
where a word of the block's prefix meets one of the template's prefix (prefix filter), the block has enough of the templates' words (length
filter), and enough of both remain after that word (positional filter). The pairs left are verified by counting common words.
Only words that some template has can add to an overlap, so blocks are reduced to those before anything else.
A run of words can only have what its text has, so the join takes all words of a text of several lines as a block more, and runs are looked at in the
texts and for the templates that it pairs.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows get equal results; other columns pass through
untouched unless they bear an output's name, in which case the output replaces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import HEAVY, cut, told_apart

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Usual license notices and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.8
#: Rows of a common text that meet its notices in one task, about.
SPLIT_ROWS = 1000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """A-Z in lower case. Of all other characters only U+212A would become an ASCII letter; it is swapped for another non-ASCII one."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0101")))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def phrase_places(text: Column, phrases: dict[str, str]) -> Column:
    """Per phrase the word positions where it begins, as an array of arrays; null where no phrase can be."""
    maybe = "|".join(_BREAK_ANY_CASE.join(p.split()) for p in phrases)
    words = F.filter(F.split(_lowered(text), BREAK), lambda w: w != "")
    found = F.transform(F.array(words), lambda ws: F.array(*[_places(ws, p) for p in phrases]))[0]
    return F.when(text.rlike(f"(?i){maybe}"), found)


def _in_runs(words: Column, template: Column, width: Column) -> Column:
    """The most distinct words of ``template`` that a run of ``width`` of ``words`` (line, w) has, and the line where it begins, as (common, -line)."""
    placed = F.filter(F.transform(words, lambda x, pos: F.struct(pos.alias("pos"), x["line"].alias("line"), x["w"].alias("w"))), lambda x: F.array_contains(template, x["w"]))

    def common(hits: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            run = F.filter(F.slice(hits, i + 1, width), lambda y: y["pos"] < x["pos"] + width)
            return F.struct(F.size(F.array_distinct(F.transform(run, lambda y: y["w"]))).alias("common"), (-x["line"]).alias("before"))

        return F.array_max(F.transform(hits, one))

    return F.transform(F.array(placed), common)[0]


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score, and ``notices``: structs (line, template, label, containment)."""
    sets = [sorted(set(t.split())) for _, t in templates]
    needs = [max(1, math.ceil(round(threshold * len(s), 9))) for s in sets]
    vocabulary = sorted(set().union(*sets))
    body = F.coalesce(F.col(text), F.lit(""))
    known = F.array(*[F.lit(w) for w in vocabulary])
    blocks = F.transform(F.split(_lowered(body), "\n"), lambda line, i: F.struct(i.alias("line"), F.array_intersect(known, F.split(line, BREAK)).alias("tokens")))
    fresh = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"}
    kept = [c for c in docs.columns if c != text and c not in fresh]

    def joined(lines: Column) -> Column:
        whole = F.struct(F.lit(-1).alias("line"), F.array_distinct(F.flatten(lines["tokens"])).alias("tokens"))
        return F.filter(F.when(F.size(lines) > 1, F.concat(lines, F.array(whole))).otherwise(lines), lambda b: F.size(b["tokens"]) >= min(needs))

    blocks = F.transform(F.array(blocks), joined)[0]
    held = docs.select(
        F.struct(*[docs[c] for c in kept] or [F.lit(0).alias("none")]).alias("row"), F.regexp_count(body, F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"), phrase_places(body, phrases).alias("_places"), blocks.alias("_blocks"),
        F.sha2(F.col(text), 256).alias("_text"),
    )
    held = cut(held, "license")
    # equal texts give equal blocks, so one row a text is joined
    each = held.filter(F.size("_blocks") > 0).groupBy("_text").agg(F.first("_blocks").alias("_blocks")).select("_text", F.explode("_blocks").alias("b")).select("_text", "b.line", "b.tokens")
    counts = dict(each.select(F.explode("tokens").alias("w")).groupBy("w").count().collect())  # a row a word of the templates at most
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    sorted_sets = [sorted(s, key=place.get) for s in sets]
    prefixes = [(w, k, j, len(s), need, templates[k][0], s) for k, (s, need) in enumerate(zip(sorted_sets, needs)) for j, w in enumerate(s[: len(s) - need + 1])]
    index = each.sparkSession.createDataFrame(prefixes, "w string, template int, j int, n int, need int, label string, tokens_t array<string>")
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("tokens"))
    probes = each.withColumn("tokens", ordered).select("*", F.posexplode(F.slice("tokens", 1, F.size("tokens") - min(needs) + 1)).alias("i", "w"))
    left = F.least(F.size("tokens") - F.col("i"), F.col("n") - F.col("j"))
    pairs = probes.join(F.broadcast(index), "w").filter((F.size("tokens") >= F.col("need")) & (left >= F.col("need")))
    common = F.size(F.array_intersect("tokens_t", "tokens"))
    found = pairs.withColumn("_c", common).filter(F.col("_c") >= F.col("need"))
    found = found.select("_text", "line", "template", "label", "_c", "n", "need", "tokens_t")
    found = cut(found, "notices")
    # texts are read again only where all their words together would do
    maybe = found.filter("line < 0").drop("line", "_c")
    texts, _ = told_apart(docs.select(F.sha2(F.col(text), 256).alias("_text"), F.col(text).alias("_body")), maybe.select("_text"), ["_text"])
    texts = texts.join(maybe.select("_text").distinct(), "_text", "left_semi").groupBy("_text").agg(F.first("_body").alias("_body"))
    by_line = F.transform(F.split(_lowered(F.col("_body")), "\n"), lambda line, i: F.transform(F.filter(F.split(line, BREAK), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("w"))))
    widths = F.array(*[F.lit(math.ceil(round(len(t.split()) / threshold, 9))) for _, t in templates])
    runs = texts.select("_text", F.flatten(by_line).alias("_words")).join(maybe, "_text").withColumn("_best", _in_runs(F.col("_words"), F.col("tokens_t"), F.get(widths, F.col("template"))))
    runs = runs.filter(F.col("_best.common") >= F.col("need")).select("_text", (-F.col("_best.before")).alias("line"), "template", "label", F.col("_best.common").alias("_c"), "n")
    found = found.filter("line >= 0").select("_text", "line", "template", "label", "_c", "n").unionByName(runs)
    found = found.groupBy("_text").agg(F.array_sort(F.collect_set(F.struct("line", "template", "label", (F.col("_c").cast("double") / F.col("n")).alias("containment")))).alias("notices"))
    out = _noticed(held.drop("_blocks"), cut(found, "found"), held.count())
    starts = F.coalesce(F.flatten("_places"), F.array().cast("array<int>"))
    base = F.array_distinct(F.flatten(F.array(*[F.when(F.size(F.coalesce(F.get("_places", F.lit(k)), F.array().cast("array<int>"))) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, label in enumerate(phrases.values())])))
    out = out.withColumn("_starts", starts).withColumn("_base", base).withColumn("notices", F.coalesce("notices", F.array().cast("array<struct<line:int,template:int,label:string,containment:double>>")))
    return out.select(
        *[F.col("row")[c].alias(c) for c in kept], "n_words", F.size("_starts").cast("long").alias("n_base"), F.array_min("_starts").cast("long").alias("first_word"), F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_base", F.col("notices.label"))), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("notices.containment")), F.lit(0.0))).alias("score"), "notices",
    )


def _noticed(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """``rows`` with the notices of their texts. Rows whose text has none stay where they are; those of a common text are dealt to splits."""
    some, rest = told_apart(rows, found, ["_text"])
    found = cut(found.join(some.groupBy("_text").agg(F.count("*").alias("copies")), "_text"), "copies")
    common = found.filter(F.col("copies") > max(SPLIT_ROWS, HEAVY * total)).select("_text", F.ceil(F.col("copies") / SPLIT_ROWS).cast("int").alias("splits"))
    splits = F.coalesce("splits", F.lit(1))
    # at most 10,000 texts are as common, so their numbers of splits, but not their notices, may be broadcast
    dealt = some.join(F.broadcast(common), "_text", "left").withColumn("_split", F.pmod(F.xxhash64("row", F.spark_partition_id()), splits).cast("int")).drop("splits")
    facts = found.join(F.broadcast(common), "_text", "left").select("_text", "notices", F.explode(F.sequence(F.lit(0), splits - 1)).alias("_split"))
    return dealt.join(facts, ["_text", "_split"], "left").drop("_split").unionByName(rest, allowMissingColumns=True)


def oracle(phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the query's rows."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    hits = " UNION ALL ".join(f"SELECT r, '{label}' AS label, i - 1 AS pos FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split())) for p, label in phrases.items())
    rows = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))}, {max(1, math.ceil(round(threshold * len(set(t.split())), 9)))})" for k, (label, t) in enumerate(templates))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lowered} AS low, regexp_extract_all({lowered}, '{word}') AS ws FROM documents),
hits AS ({hits}),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS b FROM hits GROUP BY r),
t(k, label, tokens, need) AS (VALUES {rows}),
blocks AS (SELECT r, list_distinct(regexp_extract_all(line, '{word}')) AS tokens FROM (SELECT r, unnest(string_split(low, chr(10))) AS line FROM d)),
notices AS (SELECT r, label, len(list_intersect(t.tokens, b.tokens))::DOUBLE / len(t.tokens) AS c FROM blocks b, t WHERE len(list_intersect(t.tokens, b.tokens)) >= need),
tags AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS tags FROM (SELECT r, label FROM hits UNION SELECT r, label FROM notices) GROUP BY r),
base_tags AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS tags FROM hits GROUP BY r),
best AS (SELECT r, max(c) AS c FROM notices GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(base_tags.tags, '') AS base_labels, coalesce(tags.tags, '') AS labels,
CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN tags USING (r) LEFT JOIN base_tags USING (r) LEFT JOIN best USING (r)"""
