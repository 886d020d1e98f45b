import os

import pytest
from pyspark.sql import functions as F

from kvloom.llm import common


def test_facts_reach_all_rows_of_heavy_and_light_keys(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    facts = spark.createDataFrame([(-1, 3000, "heavy"), (4000, 1, "light"), (9999, 1, "none")], "k long, n long, what string")
    heavy, light = common.with_facts(rows, facts, "k", "n", 6000)
    assert heavy.count() == 3000 and heavy.filter("what = 'heavy'").count() == 3000
    got = {r["id"]: r["what"] for r in light.collect()}
    assert sorted(got) == list(range(3000, 6000)) and {i: w for i, w in got.items() if w} == {4000: "light"}


def test_a_full_bitmap_tells_nothing_apart_but_loses_nothing(spark, monkeypatch):
    rows = spark.range(500).withColumnRenamed("id", "k")
    for bits in (64, 1 << 27):
        monkeypatch.setattr(common, "BITS", bits)
        some, rest = common.told_apart(rows, rows.filter("k % 3 = 0"), ["k"])
        a, b = ({r.k for r in x.collect()} for x in (some, rest))
        assert a | b == set(range(500)) and not a & b and a >= set(range(0, 500, 3))


@pytest.mark.parametrize("rows_each", [3, 10_000])
def test_ranks_over_splits_are_ranks(spark, rows_each):
    rows = spark.range(400).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), (F.col("id") % 7).alias("size"))
    rows = rows.withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    got = common.ranked(rows, ["g"], F.xxhash64("x"), [F.col("x")], "size", rows_each).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    for part in groups.values():
        part.sort(key=lambda r: r.rank)
        assert [r.rank for r in part] == list(range(len(part)))
        before = 0
        for r in part:
            assert r.before == before
            before += r.size


def test_scratch_is_deleted_again(spark):
    out = common.cut(spark.range(5), "x")
    path = out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert out.count() == 5 and os.path.isdir(path)
    common.discard(out)
    assert not os.path.isdir(path)
