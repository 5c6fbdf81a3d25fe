"""Rows that joins make and that go through the driver do not grow with pairs or with what is exploded."""

import random
import time

from archgraph.operators import build, rebuild, resolve, substrings
from archgraph.plans import catalog
from archgraph.sources import extract
from pyspark.sql import functions as F
from tests.plans import rows_made


def test_a_call_meets_one_endpoint_for_each_rule(spark):
    calls = spark.range(300).select(F.concat(F.lit("c"), "id").alias("call_id"), F.lit("GET").alias("verb"), F.lit("/same").alias("target_path"), F.concat(F.lit("/a"), "id", F.lit("/list")).alias("url"))
    ends = spark.range(300).select(F.concat(F.lit("e"), "id").alias("endpoint_id"), F.lit("get").alias("verb"), F.when(F.col("id") % 2 == 0, "/same").otherwise(F.concat(F.lit("/b"), "id", F.lit("/list"))).alias("path"))
    found = resolve.displayed_target(calls, ends)
    assert {(r["endpoint_id"], r["rule"]) for r in found.collect()} == {("e0", 0)} and found.count() == 300
    assert rows_made(found, "Join") <= 300


def test_displayed_targets_equal_all_pairs(spark):
    rnd = random.Random(4)
    path = lambda: "".join("/" + rnd.choice(["a", "b", "c", "{x}"]) for _ in range(rnd.randint(0, 3)))
    verb = lambda: rnd.choice(["GET", "get", "PUT", None])
    calls = [(k, verb(), rnd.choice([None, path()]), path()) for k in range(150)]
    ends = [(rnd.randint(0, 60), verb(), path()) for _ in range(80)]
    want = {}
    for c, v, target, url in calls:
        last = ([x for x in url.split("/") if x] or [""])[-1]
        hits = [(0 if v and w and v.upper() == w.upper() else 1, e) for e, w, p in ends if target is not None and p == target]
        hits += [(2, e) for e, _, p in ends if last and "{" not in last and last in p.split("/")]
        if hits:
            want[c] = min(hits)
    got = resolve.displayed_target(spark.createDataFrame(calls, "call_id long, verb string, target_path string, url string"), spark.createDataFrame(ends, "endpoint_id long, verb string, path string"))
    assert {r["call_id"]: (r["rule"], r["endpoint_id"]) for r in got.collect()} == want and {0, 1, 2} == {rule for rule, _ in want.values()}


def test_grams_of_texts_do_not_go_through_the_driver(spark, tmp_path):
    # Read from files, so that the planner takes what is exploded for small.
    spark.range(3_000).select("id", F.concat(F.lit("com.shop.Service"), "id", F.lit(".run()")).alias("text")).write.parquet(str(tmp_path / "texts"))
    spark.range(40).select(F.concat(F.lit("Service"), F.col("id") * 50).alias("name")).write.parquet(str(tmp_path / "names"))
    found = substrings.containing(spark.read.parquet(str(tmp_path / "texts")), "text", spark.read.parquet(str(tmp_path / "names")), "name")
    assert rows_made(found, "BroadcastExchange") <= 500
    assert {r["name"] for r in found.filter("id = 1500").collect()} == {"Service150", "Service1500"}


def test_grams_too_many_to_broadcast_are_merged(spark, monkeypatch):
    texts = [(i, f"t{i}.{i * 7}") for i in range(200)]
    names = sorted({f"{i}." for i in range(30)} | {"t1", "99", "."})
    frames = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    monkeypatch.setattr(substrings, "FEW_GRAMS", 0)
    got = substrings.containing(frames[0], "text", frames[1], "name")
    assert rows_made(got, "BroadcastExchange") == 0
    assert sorted((r["id"], r["name"]) for r in got.collect()) == sorted((i, n) for i, t in texts for n in names if n in t)


def test_beginnings_of_packages_do_not_go_through_the_driver(spark, tmp_path):
    spark.range(3_000).select("id", F.concat(F.lit("com.shop.p"), F.col("id") % 7, F.lit(".inner")).alias("package_name")).write.parquet(str(tmp_path / "types"))
    spark.range(7).select(F.concat(F.lit("app"), "id").alias("app_key"), F.concat(F.lit("com.shop.p"), "id").alias("base_package")).write.parquet(str(tmp_path / "apps"))
    found = build.scoped(spark.read.parquet(str(tmp_path / "types")), spark.read.parquet(str(tmp_path / "apps")))
    assert rows_made(found, "BroadcastExchange") <= 7 and rows_made(found, "Generate") == 3_000
    assert found.count() == 3_000 and found.filter("app_key <> concat('app', id % 7)").isEmpty()


def test_scoping_equals_all_pairs(spark):
    types = [(k, p) for k, p in enumerate(["a.b", "a.bc", "a", "", None, "x.y", "a.b.c", "é.b"])]
    apps = [("all", ""), ("none", None), ("a", "a"), ("ab", "a.b"), ("ab2", "a.b"), ("e", "é."), ("long", "a.b.c.d.e.f")]
    got = build.scoped(spark.createDataFrame(types, "id long, package_name string"), spark.createDataFrame(apps, "app_key string, base_package string"))
    assert sorted((r["id"], r["app_key"]) for r in got.collect()) == sorted((k, a) for k, p in types for a, b in apps if b is not None and (p or "").startswith(b))
    assert build.scoped(spark.createDataFrame(types, "id long, package_name string"), spark.createDataFrame([], "app_key string, base_package string")).isEmpty()


def test_sources_made_from_a_small_table_are_dealt_out(spark, tmp_path):
    many = 2 * catalog.SOURCES_PER_TASK + 1
    spark.range(many).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = catalog.class_sources(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 3 and made.select("path").distinct().count() == many


def test_braces_and_brackets_of_a_source():
    source = extract.Source('class A { int f = g(")"); void m() { if (x) { y(); } } class B { } }')
    assert [source.depth(k) for k in (0, 10, 38, 46, len(source.plain))] == [0, 1, 2, 3, 0]
    assert source.closed(9) == len(source.plain) - 1 and source.plain[source.closed(source.plain.index("m()") + 5)] == "}"
    assert extract.cut_outside("f(a, ',', \"x,\\\"\"), b", 0, ",") == 17 and extract.split_flow(" ") == [] and extract.split_flow(" a ") == ["a"]


def test_deleting_reads_nodes_and_edges_once_and_leaves_no_shuffle_files(spark, tmp_path):
    rnd = random.Random(5)
    nodes = [(f"n{k}", rnd.choice(["A", "B", None, None])) for k in range(120)]
    edges = [(f"n{rnd.randrange(125)}", f"n{rnd.randrange(125)}", rnd.choice("XY")) for _ in range(140)]
    spark.createDataFrame(nodes, "id string, app_key string").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame(edges, "src string, dst string, type string").write.parquet(str(tmp_path / "edges"))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f.getName() for f in iter_java(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, was = names(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept, links = rebuild.without_applications(spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "edges")), spark.createDataFrame([("A",)], "app_key string"))
    # Files go a moment after the write that made them.
    for _ in range(50):
        if not (left := names() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    assert not any(str(tmp_path) in f for f in kept.inputFiles() + links.inputFiles())
    stay = {i for i, a in nodes if a == "B"}
    there = {i for i, a in nodes if a != "A"}
    while more := {d for s, d, _ in edges if s in stay and d in there} - stay:
        stay |= more
    assert {r["id"] for r in kept.collect()} == stay
    assert sorted(tuple(r) for r in links.collect()) == sorted(e for e in edges if e[0] in stay and e[1] in stay)


def iter_java(items):
    return [items.apply(k) for k in range(items.size())]
