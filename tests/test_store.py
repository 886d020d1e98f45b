"""Literal cases and properties of the store's queries."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kvloom import catalog
from kvloom.functions import clocks, keyfilters, scalars
from kvloom.model import OBJECTS, sibling
from kvloom.operators import crdt, folds, index, reconcile, sync
from kvloom.operators.index import IndexQuery
from kvloom.plans import jobs, mapreduce
from kvloom.sources import props, store
from kvloom.streaming import queues

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def one(spark, chain, value, kind="string"):
    return spark.range(1).select(keyfilters.compiled(chain, F.lit(value).cast(kind)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("chain", "yes", "no"),
    [
        ([["tokenize", "-", 3], ["string_to_int"], ["between", 2009, 2010]], "12-20-2009", "12-20-2011"),
        ([["to_lower"], ["similar_to", "bashful", 3]], "BAYSHFUL", "lolcaTS"),
        ([["similar_to", "bashful", 1]], "bayshful", "bayshful!"),
        ([["matches", "johnm.*"]], "johnm@there.com", "earl@there.com"),
        ([["set_member", "12-20-2010", "12-21-2010"]], "12-21-2010", "12-22-2010"),
        ([["starts_with", "12-20"]], "12-20-2010", "11-20-2010"),
        ([["ends_with", "2010"]], "12-20-2010", "12-20-2011"),
        ([["and", [["to_lower"], ["starts_with", "hello"]], [["to_lower"], ["ends_with", "dolly"]]]], "hello DOLLY", "dolly hello"),
        ([["or", [["starts_with", "hello"]], [["starts_with", "cloned"]]]], "cloned sheep", "sheep"),
        ([["not", [["ends_with", "2010"]]]], "12-20-2011", "12-20-2010"),
        ([["urldecode"], ["eq", "a b c"]], "a%20b+c", "abc"),
        ([["to_upper"], ["neq", "A"]], "b", "a"),
        ([["string_to_float"], ["greater_than_eq", 1.5]], "1.5", "1.4"),
    ],
)
def test_key_filters(spark, chain, yes, no):
    assert one(spark, chain, yes) is True and one(spark, chain, no) is False


def test_filters_that_fail(spark):
    with pytest.raises(keyfilters.BadFilter):
        keyfilters.compiled([["no_such_filter"]], F.lit("x"))
    with pytest.raises(NotImplementedError):
        keyfilters.compiled([["sounds_like", "x"]], F.lit("x"))
    for chain, value in (([["string_to_int"]], " 42 "), ([["string_to_int"]], "4.56"), ([["string_to_float"]], "4"), ([["tokenize", "-", 9]], "a-b")):
        with pytest.raises(Exception, match="not a|INVALID_ARRAY_INDEX"):
            one(spark, chain, value)
    assert one(spark, [], "x") is True
    assert one(spark, [["between", 2008, 2010, False]], 2010, "int") is False
    assert one(spark, [["float_to_string"]], 0.1, "double") == "1.00000000000000005551e-01"


def test_scalars(spark):
    got = spark.createDataFrame([(0,), (9,), (10,), (99,), (100,)], "n long").select(scalars.power10(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [0, 0, 1, 1, 2]
    assert [scalars.quorum(n) for n in (1, 2, 3, 4, 5)] == [1, 2, 2, 3, 3] and scalars.wanted("all", 3) == 3
    header = '</buckets/b>; rel="up", </buckets/b/keys/k%201>; tag="t", </kv/c/d>; tag="u"'
    links = spark.range(1).select(scalars.link_targets(F.lit(header)).alias("l")).first()["l"]
    assert [tuple(x) for x in links] == [("b", None, "up"), ("b", "k 1", "t"), ("c", "d", "u")]


def test_index_entries_are_parsed(spark):
    rows = [(1, "field_bin", "A"), (1, "FIELD_int", "1"), (2, "field_bin", "A"), (2, "field_int", "1"), (2, "field_int", "A"), (3, "field_foo", "f"), (3, "field_int", "A"), (4, "field_int", ""), (5, "_int", "1"), (6, "test_$key", "x"), (7, "field_int", "4.56"), (8, "field_bin", "")]
    got = {r.id: r for r in index.parsed(spark.createDataFrame(rows, "id int, field string, value string"), ["id"]).collect()}
    assert [tuple(e) for e in got[1].entries] == [("field_bin", "A"), ("field_int", "1")] and not got[1].errors
    assert got[2].errors == ["field_parsing_failed:field_int:A"] and got[2].entries is None
    assert got[3].errors == ["field_parsing_failed:field_int:A", "unknown_field_type:field_foo"]
    assert got[4].errors and got[5].errors == ["unknown_field_type:_int"] and got[6].errors and got[7].errors and not got[8].errors


def test_excluded_start_is_a_pair(spark):
    posts = spark.createDataFrame([("default", "b", "f_int", None, 1, "k"), ("default", "b", "f_int", None, 2, "k")], "bucket_type string, bucket string, field string, term_bin string, term_int long, key string")
    got = index.lookup(IndexQuery("b", "f_int", 1, 3, start_key="k", start_inclusive=False), posts, posts).collect()
    assert [tuple(r) for r in got] == [(2, "k")]


@pytest.mark.parametrize("size", [1, 3, 7])
@pytest.mark.parametrize("q", [IndexQuery.between("orders", "o_custkey_int", 2, 9), IndexQuery.eq("orders", "o_orderstatus_bin", "O"), IndexQuery.between("orders", "$key", "1", "12")])
def test_pages_make_up_the_whole(spark, size, q):
    from dataclasses import replace

    posts, names = catalog.postings(spark, SF, "orders").filter("length(key) < 3").cache(), catalog.keys(spark, SF, "orders").filter("length(key) < 3").cache()
    whole = [tuple(r) for r in index.lookup(replace(q, pagination_sort=True), posts, names).collect()]
    got, page = [], replace(q, max_results=size)
    for _ in range(60):
        rows, more = index.page(page, posts, names)
        got += [tuple(r) for r in rows]
        if more is None or len(got) >= 40:
            break
        page = replace(index.resume(q, more), max_results=size)
    assert got == whole[: len(got)] and (more or got == whole)


def test_bad_index_queries(spark):
    names = catalog.keys(spark, SF, "region")
    for bad in (IndexQuery("b", "f_int", 1, term_regex="x"), IndexQuery("b", "f_bin", "1", return_body=True), IndexQuery("b", "f_foo", "1")):
        with pytest.raises(ValueError):
            index.lookup(bad, names, names)
    with pytest.raises(index.IndexesNotSupported):
        index.lookup(IndexQuery.eq("b", "f_bin", "x"), None, names)
    with pytest.raises(ValueError, match="invalid continuation"):
        index.resume(IndexQuery.eq("b", "f_bin", "x"), "###")


def test_clock_algebra(spark):
    def col(**c):
        return F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]) if c else F.create_map().cast("map<string,bigint>")

    a, b, c = col(x=2, y=1), col(x=1), col(z=1)
    r = spark.range(1).select(clocks.descends(a, b), clocks.dominates(a, b), clocks.dominates(a, a), clocks.descends(a, c), clocks.descends(a, col()), clocks.text(clocks.merged(a, c)), clocks.text(clocks.increment(a, F.lit("y"))), clocks.hashed(a, 100) == clocks.hashed(a, 200)).first()
    assert tuple(r) == (True, True, False, False, True, "x=2,y=1,z=1", "x=2,y=2", False)


def test_dotted_merge():
    a = ({"x": 1}, [{"value": "a", "dot": ("x", 1)}])
    b = ({"y": 1}, [{"value": "b", "dot": ("y", 1)}])
    ab = reconcile.merge_dotted(a, b)
    assert ab == reconcile.merge_dotted(b, a) and [s["value"] for s in ab[1]] == ["a", "b"]
    assert reconcile.merge_dotted(ab, ab) == ab and reconcile.merge_dotted(ab, a)[1] == ab[1]
    resolved = ({"x": 2, "y": 1}, [{"value": "c", "dot": ("x", 2)}])
    assert reconcile.merge_dotted(ab, resolved)[1] == resolved[1] == reconcile.syntactic_merge(ab, resolved)[1]


def test_puts_in_order(spark):
    rows = [("b", "k", 1, "x", {}, "v1"), ("b", "k", 2, "y", {}, "v2"), ("b", "k", 3, "x", {"x": 1, "y": 1}, "v3"), ("b", "j", 1, "x", None, "w")]
    got = {r.key: r for r in reconcile.apply_puts(spark.createDataFrame(rows, "bucket string, key string, seq long, actor string, context map<string,bigint>, value string")).collect()}
    assert (got["k"].clock, got["k"].vals, got["j"].vals) == ("x=2,y=1", "v3", "w")
    early = reconcile.apply_puts(spark.createDataFrame(rows[:2], "bucket string, key string, seq long, actor string, context map<string,bigint>, value string")).first()
    assert early.vals == "v1,v2"


def test_last_write_moves_its_own_clock(spark):
    rows = [("b", "k", 1, "x", {"y": 7}, "v1"), ("b", "k", 2, "x", {"y": 5}, "v2")]
    got = reconcile.apply_puts(spark.createDataFrame(rows, "bucket string, key string, seq long, actor string, context map<string,bigint>, value string"), last_write_wins=True).first()
    assert (got.clock, got.vals) == ("x=1,y=5", "v2")


def test_replies_are_merged_before_the_outcome(spark):
    rows = [
        ("newer tombstones", "ok", {"a": 1}, 1), ("newer tombstones", "tombstone", {"a": 2}, 2), ("newer tombstones", "tombstone", {"a": 2}, 3),
        ("newer value", "tombstone", {"a": 1}, 1), ("newer value", "ok", {"a": 2}, 2),
        ("concurrent", "tombstone", {"a": 1}, 1), ("concurrent", "ok", {"b": 1}, 2),
        ("one node", "ok", {"a": 1}, 1), ("one node", "ok", {"a": 1}, 1),
        ("failing", "ok", {"a": 1}, 1), ("failing", "error", None, 2), ("failing", "error", None, 3), ("nothing", "notfound", None, 1), ("nothing", "notfound", None, 2),
    ]
    replies = spark.createDataFrame([(*r, True) for r in rows], "request string, status string, clock map<string,bigint>, node int, primary boolean")
    got = {r.request: r.outcome for r in reconcile.get_decision(replies, node_confirms=2, deleted_clock=True).collect()}
    assert got == {"newer tombstones": "deleted", "newer value": "ok", "concurrent": "ok", "one node": "insufficient_nodes", "failing": "insufficient_nodes", "nothing": "notfound"}
    got = {r.request: r.outcome for r in reconcile.get_decision(replies, pr=2).collect()}
    assert got["newer tombstones"] == "notfound" and got["one node"] == "ok" and got["failing"] == "pr_unsatisfied"


def test_events_of_replicas_merge_as_pairs_do(spark):
    a = ({"x": 2}, [("v1", "x", 2)])
    b = ({"x": 1, "y": 1}, [("v0", "x", 1), ("w", "y", 1)])
    c = ({"x": 2, "y": 1}, [("v1", "x", 2)])  # saw w and gave it up
    rows = spark.createDataFrame([("b", "k", clock, s) for clock, s in (a, b, c)] + [("b", "j", *a)], "bucket string, key string, clock map<string,bigint>, siblings array<struct<value:string,actor:string,counter:bigint>>")
    got = {r.key: ([s.value for s in r.siblings], r.clock) for r in reconcile.dotted(rows).collect()}
    assert got == {"k": (["v1"], {"x": 2, "y": 1}), "j": (["v1"], {"x": 2})}
    plain = [(clock, [{"value": v, "dot": (n, k)} for v, n, k in s]) for clock, s in (a, b, c)]
    merged = reconcile.merge_dotted(reconcile.merge_dotted(plain[0], plain[1]), plain[2])
    assert [s["value"] for s in merged[1]] == ["v1"] == got["k"][0]


def test_clocks_are_pruned(spark):
    def kept(small, big, young, old):
        clock = F.create_map(*[x for k in "abcd" for x in (F.lit(k), F.lit(1).cast("bigint"))])
        times = F.create_map(*[x for k, t in zip("abcd", (10, 20, 30, 40)) for x in (F.lit(k), F.lit(t).cast("bigint"))])
        return "".join(sorted(spark.range(1).select(reconcile.prune(clock, small, big, young, old, F.lit(50).cast("bigint"), times).alias("c")).first()["c"]))

    assert kept(4, 4, 0, 0) == "abcd" and kept(2, 4, 0, 100) == "abcd" and kept(2, 3, 0, 100) == "bcd" and kept(2, 4, 0, 25) == "cd" and kept(1, 1, 25, 25) == "cd"


def test_lookups_reach_the_scan(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for q, column in ((IndexQuery.eq("orders", "o_custkey_int", 42), "o_custkey"), (IndexQuery.between("orders", "o_orderpriority_bin", "1", "3"), "o_orderpriority")):
        got = plan(index.lookup(q, catalog.postings(spark, SF, "orders"), catalog.keys(spark, SF, "orders")))
        assert got.count("FileScan") == 1 and "Generate" not in got and f"({column}," in got.split("PushedFilters")[1], got
    assert "EqualTo(o_orderkey,77)" in plan(catalog.QUERIES["s10_get"](spark, SF))


def test_text_forms_of_floats(spark):
    assert one(spark, [["string_to_float"], ["starts_with", "2.05"]], "20.5") is True and one(spark, [["string_to_float"], ["ends_with", "e+01"]], "20.5") is True
    assert one(spark, [["string_to_float"], ["set_member", 20.5]], "20.5") is True and one(spark, [["string_to_float"], ["not", [["starts_with", "20"]]]], "20.5") is True
    assert one(spark, [["or", [["starts_with", "1.5"]], [["eq", 2.0]]]], "1.5") is True and one(spark, [["string_to_int"], ["starts_with", "2"]], "20") is True


def test_histograms_merge(spark):
    a = spark.createDataFrame([(1, 23), (4, 36), (3, 17), (8, 12)], "id int, n long")
    b = spark.createDataFrame([(7, 11), (8, 15), (1, 15)], "id int, n long")
    assert {r.id: r.n for r in folds.merge_histograms(a, b).collect()} == {1: 38, 3: 17, 4: 36, 7: 11, 8: 27}


def test_folds_are_checked(spark):
    k = catalog.keystore(spark, SF, "orders")
    for name, scope in (("fetch_clock_range", folds.Scope("orders")), ("object_stats", folds.Scope("all")), ("object_stats", folds.Scope("orders", ("SK", "EK"))), ("object_stats", folds.Scope("orders", modified=(9, 1))), ("merge_tree_range", folds.Scope("orders", tree_size="nano"))):
        with pytest.raises(ValueError):
            folds.fold(name, k, scope)
    a, b = folds.tree(k, folds.Scope("orders"), 100), folds.tree(k, folds.Scope("orders"), 200)
    assert folds.tree_diff(a, b).count() > 0 and folds.tree_diff(a, a).count() == 0


def test_data_types(spark):
    assert [crdt.parse_counter_op(x) for x in (5, "5", "-2", "increment", {"decrement": 3}, '{"increment": 4}')] == [5, 5, -2, 1, -3, 4]
    with pytest.raises(ValueError):
        crdt.parse_counter_op("wrong")
    assert crdt.set_update({"a"}, {"update": [{"add_all": ["b", "c"]}, {"remove": "a"}]}) == {"b", "c"}
    with pytest.raises(crdt.Precondition):
        crdt.set_update({"a"}, {"remove": "z"}, context=False)
    assert crdt.field_name("visits_per_day_counter") == ("visits_per_day", "counter")
    a = {"clock": {"x": 1}, "entries": {"e": [["x", 1]]}}
    b = {"clock": {"x": 1, "y": 1}, "entries": {"f": [["y", 1]]}}  # saw e added and removed it
    assert crdt.orset_merge(a, b) == crdt.orset_merge(b, a) and list(crdt.orset_merge(a, b)["entries"]) == ["f"]
    for p in (3, 17):
        with pytest.raises(ValueError):
            crdt.hll_sketch(spark.range(1), [], "id", p)
    for p in (4, 10, 14):
        got = crdt.hll_sketch(spark.range(20_000).withColumn("g", F.lit(1)), ["g"], "id", p).select(crdt.hll_value(F.col("sketch")).alias("v")).first()["v"]
        assert abs(got - 20_000) <= 20_000 * 3 * 1.04 / 2 ** (p / 2) + 1


MR = [("k1", "1", 1), ("k2", "2", 1), ("k3", '["a","b"]', 1), ("k4", "x", 2)]


def mr_tables(spark):
    rows = spark.createDataFrame([(k, v, n) for k, v, n in MR], "key string, value string, n int")
    many = rows.select(F.lit("default").alias("bucket_type"), F.lit("foo").alias("bucket"), "key", F.create_map(F.lit("a"), F.lit(1).cast("bigint")).alias("clock"), F.array_repeat(sibling(F.col("value")), F.col("n")).alias("siblings"))
    return mapreduce.Tables(spark, many)


def test_map_values(spark):
    t = mr_tables(spark)

    def values(keys, function, arg=None):
        job = jobs.Job(jobs.Inputs("keys", keys=tuple(("default", "foo", k, d) for k, d in keys)), (jobs.Phase("map", function, arg, True),))
        return sorted(str(r["value"]) for r in mapreduce.run(t, job).collect())

    assert values([("k1", None), ("k1", None), ("no", None)], "map_object_value", "filter_notfound") == ["1", "1"]
    assert values([("no", "d")], "map_object_value", "include_notfound") == ["not_found"]
    assert values([("no", "d")], "map_object_value", "include_keydata") == ["not_found:d"]
    assert values([("no", "d"), ("k2", None)], "map_object_value", {"sub": "zero"}) == ["2", "zero"]
    assert values([("k3", None)], "map_object_value_list", "filter_notfound") == ["a", "b"]
    with pytest.raises(jobs.BadJob, match="phase 0"):
        values([("k1", None)], "map_object_value", "none")
    with pytest.raises(Exception, match="object has siblings"):
        values([("k4", None)], "map_object_value", "filter_notfound")


def test_reducers(spark):
    def frame(xs):
        return spark.createDataFrame([(x,) for x in xs], "value string")

    def of(f, xs, arg=None):
        return [r["value"] for r in f(frame(xs), arg).collect()]

    assert of(mapreduce.reduce_sum, ["1", "2", "3", "4", "not_found"]) == [10.0] and of(mapreduce.reduce_sum, []) == [0.0]
    assert sorted(of(mapreduce.reduce_set_union, ["foo", "foo", "bar", "baz"])) == ["bar", "baz", "foo"]
    assert of(mapreduce.reduce_sort, ["b", "a", "c"]) == ["a", "b", "c"] and of(mapreduce.reduce_numeric_sort, ["10", "9"]) == ["9", "10"]
    assert of(mapreduce.reduce_string_to_integer, ["1", "2", "3"]) == [1, 2, 3]
    assert of(mapreduce.reduce_count_inputs, ["a/x", "a/y", "a/z", "2", "4"]) == [9]
    assert of(mapreduce.reduce_max, []) == [] and of(mapreduce.reduce_min, ["3", "2"]) == [2.0]
    assert len(of(mapreduce.reduce_limit, list("abcdef"), 4)) == 3
    assert of(mapreduce.reduce_slice, list("abcdef"), (1, 3)) == ["b", "c"] and sorted(of(mapreduce.reduce_slice, list("abc"), (1, 9))) == ["a", "b", "c"]
    lists = frame(['[["a", 1], ["b", 1]]', '[["a", 2]]', '[["b", 4]]'])
    assert {r["name"]: r["value"] for r in mapreduce.reduce_plist_sum(lists, None).collect()} == {"a": 3.0, "b": 5.0}
    calls = mapreduce.python_reduce(frame([]), lambda xs, arg: [len(xs)], None)
    assert [r["value"] for r in calls.collect()] == ["0"]
    for again in (False, True):
        parts = mapreduce.python_reduce(frame(["1"] * 50).repartition(7), lambda xs, arg: [sum(map(int, xs))], None, batch=3, prereduce=again)
        assert [r["value"] for r in parts.collect()] == ["50"]
    fed = mapreduce.python_reduce(frame(["1"] * 7).repartition(3), lambda xs, arg: [sum(map(int, xs))], None, batch=2)
    assert [r["value"] for r in fed.collect()] == ["7"]


def test_jobs_are_parsed():
    query = [{"map": {"language": "erlang", "module": "m", "function": "map_identity", "keep": False}}, {"reduce": {"language": "javascript", "name": "Any.reduceSum"}}]
    for inputs, kind in (("b", "bucket"), (["t", "b"], "bucket"), ([["b", "k"]], "keys"), ([["b", "k", "d", "t"]], "keys"), ({"module": "m", "function": "f", "arg": 1}, "generator"), ({"bucket": "b", "index": "f_bin", "key": "x"}, "index"), ({"bucket": ["t", "b"], "index": "f_int", "start": 1, "end": 2}, "index"), ({"bucket": "b", "key_filters": [["eq", "x"]]}, "filtered")):
        job = jobs.parse({"inputs": inputs, "query": query, "timeout": "soon"})
        assert job.inputs.kind == kind and job.timeout == jobs.DEFAULT_TIMEOUT and [p.keep for p in job.phases] == [False, True] and job.phases[1].function == "reduceSum"
    for bad in ({"query": query}, {"inputs": "b"}, {"inputs": [], "query": query}, {"inputs": {"bucket": "b", "query": "q"}, "query": query}, {"inputs": {"bucket": "b", "key_filters": []}, "query": query}, {"inputs": "b", "query": [{"map": {"language": "javascript", "source": "f"}}]}, {"inputs": "b", "query": [{"filter": {}}]}):
        with pytest.raises(jobs.BadJob):
            jobs.parse(bad)


def test_links_are_walked(spark):
    def obj(bucket, key, *links):
        return (bucket, key, [Row(value="", content_type=None, last_mod=None, deleted=False, vtag=None, dot=None, indexes={}, links=[Row(bucket=b, key=k, tag=t) for b, k, t in links], meta={})])

    rows = [obj("p", "a", ("p", "b", "friend"), ("p", "c", "foe")), obj("p", "b", ("p", "d", "friend"), ("p", "zz", "friend")), obj("p", "c"), obj("p", "d")]
    schema = OBJECTS.replace("bucket_type string, ", "").replace("clock map<string,bigint>, ", "")
    o = spark.createDataFrame(rows, schema)
    edges, start = sync.links(o), o.filter("key = 'a'").select("bucket", "key")
    first, last = sync.walk(edges, o, start, [("p", "friend", True), ("_", "_", None)])
    assert [r.key for r in first.collect()] == ["b"] and [r.key for r in last.collect()] == ["d"]


def test_store_conformance(spark, tmp_path):
    def obj(*names, value="v"):
        return spark.createDataFrame([("default", b, k) for b, k in names], "bucket_type string, bucket string, key string").select("*", F.create_map(F.lit("a"), F.lit(1).cast("bigint")).alias("clock"), F.array(sibling(F.lit(value))).alias("siblings"))

    for backend in (store.ParquetStore(spark, f"{tmp_path}/s"), store.MemoryStore(spark), store.MultiStore({"x": store.ParquetStore(spark, f"{tmp_path}/x"), "y": store.MemoryStore(spark)}, "x", {"b2": "y"})):
        client = store.Client(backend)
        assert client.is_empty()
        client.put(obj(("b1", "k1"), ("b2", "k2")))
        assert {r.bucket for r in client.buckets().collect()} == {"b1", "b2"} == set(client.stream_buckets())
        assert [r.key for r in client.keys("b1").collect()] == ["k1"] and client.get("b1", "k3") is None
        assert client.postings().count() == 0
        client.delete(client.store.objects().filter("key = 'k2'"))
        assert client.get("b2", "k2") is None and [r.key for r in client.keys("b2").collect()] == ["k2"]
        client.compact("immediate")
        assert client.keys("b2").count() == 0
        client.put(obj(("b3", "k3"), value="new"))
        assert client.get("b3", "k3").siblings[0].value == "new" and client.head("b3", "k3").siblings[0].size == 3
        client.put(obj(("b3", "k3"), value="other"))
        assert sorted(s.value for s in client.get("b3", "k3").siblings) == ["new", "other"]
        backend.drop()
        assert client.is_empty()
    plain = store.ParquetStore(spark, f"{tmp_path}/s", indexes=False)
    with pytest.raises(index.IndexesNotSupported):
        store.Client(plain).postings()
    plain.write(obj(("b", "k")))
    with pytest.raises(ValueError):
        plain.backup(f"{tmp_path}/s/inside")
    plain.backup(f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 1


def test_hooks_and_timeouts(spark, tmp_path):
    import time

    row = spark.createDataFrame([("default", "b", "k")], "bucket_type string, bucket string, key string").select("*", F.create_map(F.lit("a"), F.lit(1).cast("bigint")).alias("clock"), F.array(sibling(F.lit("v"))).alias("siblings"))
    seen = []
    client = store.Client(store.ParquetStore(spark, f"{tmp_path}/s"), [lambda d: d.withColumn("key", F.upper("key"))], [lambda d: seen.append(d.count())])
    client.put(row)
    assert client.get("b", "K") and seen == [1]

    def slow(parts):
        for p in parts:
            time.sleep(20)
            yield p

    with pytest.raises(TimeoutError):
        mapreduce.collected(spark.range(1).mapInPandas(slow, "id long"), 500)
    assert len(mapreduce.collected(spark.range(3), 60_000)) == 3


def test_sibling_states_merge(spark):
    rows = [(1, "counter", '{"x": [3, 1]}', None), (1, "counter", '{"x": [2, 2], "y": [1, 0]}', None), (1, None, None, "plain"), (2, "counter", "broken", None), (2, "set", '{"clock": {"x": 1}, "entries": {"e": [["x", 1]]}}', None), (2, "set", '{"clock": {"x": 1}, "entries": {}}', None)]
    got = crdt.merge_siblings(spark.createDataFrame(rows, "id int, kind string, state string, value string"), ["id"]).collect()
    assert sorted((r.id, str(r.kind), r.value, r.error) for r in got) == [(1, "None", "plain", False), (1, "counter", "2", False), (2, "counter", "broken", True), (2, "set", "", False)]


def test_bucket_properties():
    c = props.Catalog()
    assert c.get("b")["r"] == "quorum" and c.set("b", {"pr": 2, "allow_mult": "true"})["allow_mult"] is True and c.reset("b")["pr"] == 0
    c.set_type("once", {"write_once": True})
    assert props.kind(c.get("b", "once")) == "write_once" and props.kind({"consistent": True, "write_once": True}) == "consistent"
    for bad in ({"pr": -1}, {"allow_mult": "maybe"}, {"n_val": 0}, {"datatype": "tree"}, {"datatype": "hll", "hll_precision": 20, "allow_mult": True}, {"datatype": "set", "allow_mult": False}):
        with pytest.raises(ValueError):
            c.set("other", bad)
    with pytest.raises(ValueError, match="cannot change"):
        c.set_type("once", {"write_once": False})


def test_queues(spark):
    text = "cluster_a:bucketprefix.user|cluster_b:any|cluster_c:buckettype.repl|cluster_d:bucketname,wrongdelim|cluster_e.bucketname.name"
    assert [(q.name, q.kind, q.value) for q in queues.parse_definitions(text)] == [("cluster_a", "bucketprefix", "user"), ("cluster_b", "any", None), ("cluster_c", "buckettype", "repl")]
    assert queues.auto_check(False, False, True, False) == "all" and queues.auto_check(False, False, False, True) == "no" and queues.auto_check(True, False, True, True) == "range" and queues.auto_check(False, False, False, False) == "day"
    assert queues.next_range([("b", 20, 1, 9)], 16) == {"bucket": "b", "low": 1, "high": 9} and queues.next_range([("b", 10, 1, 5), ("c", 10, 3, 9)], 16) == {"bucket": "all", "low": 1, "high": 9} and queues.next_range([("b", 3, 1, 5)], 16) is None
    assert queues.analyse_repairs([("a", 25), ("b", 2)], 30) == ("bucket", "a") and queues.analyse_repairs([("a", 8), ("b", 8)], 30) == ("modtime", None) and queues.analyse_repairs([], 30) == ("none", None)
    assert queues.work_range("day", 100_000) == (13_600, 100_000) and queues.work_range("all", 5) is None
    plan = queues.slices({"all": 1, "day": 2, "hour": 3}, 600)
    assert [t for t, _ in plan] == [0, 100, 200, 300, 400, 500]


def test_streams_follow_tables(spark, tmp_path):
    changes = spark.createDataFrame([("b", str(i % 5), str(i), i) for i in range(40)], "bucket string, key string, value string, ts long")
    changes.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state = {"rows": spark.createDataFrame([], changes.schema)}

    def upsert(batch, _):
        state["rows"] = spark.createDataFrame(queues.newest_wins(state["rows"], batch).collect(), changes.schema)

    queues.sink(stream, upsert, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted((r.key, r.value) for r in state["rows"].collect()) == [(str(k), str(35 + k)) for k in range(5)]
    seen = queues.distinct_buckets(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    seen.awaitTermination(120)
    assert spark.table("seen").count() == 1


def _canon(rows):
    return sorted(tuple("" if v is None else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert _canon(got.select(*columns).collect()) == _canon(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", ["s3_time_to_live", "s11_head", "d13_repair_filter"])
def test_times_are_rounded_as_in_sql(spark, tmp_path, name):
    c = duckdb.connect()
    # half a second and more count as the next one, halves go to even ones; events without a time are not alive
    at = "make_timestamp(1700000000500000 + CASE WHEN i % 2 = 0 THEN 1296000000000 ELSE 0 END + i // 2 * 250000)"
    c.sql(f"COPY (SELECT i AS event_id, CASE WHEN i < 195 THEN {at} END AS ts FROM range(199) t(i)) TO '{tmp_path}/events.parquet'")
    c.sql(f"COPY (SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, {at} AS o_orderdate, 'LOW' AS o_orderpriority FROM range(195) t(i)) TO '{tmp_path}/orders.parquet'")
    for t in ("events", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = c.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert _canon(got.collect()) == _canon(want.fetchall())


@pytest.mark.parametrize("name", ["x2_links", "s31_choose_sibling"])
def test_siblings_are_made_behind_the_shuffle(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning", 1)[1]
    assert not any(made in below for made in ("to_json", "md5", "map(", "collect_list"))


def test_gathered_siblings_are_those_of_the_rows(spark):
    lens = catalog.LENSES["lineitem"]
    rows = lens.read(spark, SF).limit(500).localCheckpoint()
    alone = replace(lens, unique=True).objects(rows)
    text = lambda o: sorted(map(tuple, o.select("bucket_type", "bucket", "key", F.to_json("clock"), F.explode("siblings").alias("s")).select("bucket_type", "key", F.to_json("s")).collect()))
    every = lens.objects(rows)
    assert text(every) == text(alone) and every.dtypes == alone.dtypes and every.groupBy("key").count().filter("count > 1").isEmpty()
    some = lens.objects(rows, ["links"])
    assert some.columns == every.columns and some.select(F.explode("siblings.value").alias("v")).filter("v is not null").isEmpty()
    assert sorted(map(tuple, sync.links(some).collect())) == sorted(map(tuple, sync.links(every).collect()))
