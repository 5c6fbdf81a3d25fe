from archgraph.operators import rebuild
from archgraph.sources import store

NODES = [("a", "A"), ("s", "A"), ("b", "B"), ("t", "B"), ("topic", None), ("table", None), ("lone", None), ("chain1", None), ("chain2", None), ("ring1", None), ("ring2", None)]
EDGES = [("a", "s"), ("b", "t"), ("s", "topic"), ("t", "topic"), ("s", "table"), ("t", "chain1"), ("chain1", "chain2"), ("s", "ring1"), ("ring1", "ring2"), ("ring2", "ring1"), ("s", "t"), ("lone", "lone")]


def frames(spark):
    return spark.createDataFrame(NODES, "id string, app_key string"), spark.createDataFrame([(*e, "X") for e in EDGES], "src string, dst string, type string")


def test_shared_nodes_stay_and_orphans_go(spark):
    nodes, edges = frames(spark)
    gone = spark.createDataFrame([("A",)], "app_key string")
    kept, links = rebuild.without_applications(nodes, edges, gone)
    assert {r["id"] for r in kept.collect()} == {"b", "t", "topic", "chain1", "chain2"}
    assert {(r["src"], r["dst"]) for r in links.collect()} == {("b", "t"), ("t", "topic"), ("t", "chain1"), ("chain1", "chain2")}
    again, links_again = rebuild.without_applications(kept, links, gone)
    assert again.count() == 5 and links_again.count() == 4
    assert rebuild.without_applications(nodes, edges, spark.createDataFrame([("A",), ("B",)], "app_key string"))[0].count() == 0


def test_rebuilding_replaces_one_application(spark):
    nodes, edges = frames(spark)
    new_nodes = spark.createDataFrame([("a", "A"), ("s2", "A"), ("topic", None), ("fresh", None)], "id string, app_key string")
    new_edges = spark.createDataFrame([("a", "s2", "X"), ("s2", "topic", "X"), ("s2", "fresh", "X")], "src string, dst string, type string")
    once = rebuild.rebuilt(nodes, edges, new_nodes, new_edges)
    assert {r["id"] for r in once[0].collect()} == {"a", "s2", "b", "t", "topic", "fresh", "chain1", "chain2"}
    twice = rebuild.rebuilt(*once, new_nodes, new_edges)
    assert {tuple(r) for r in twice[0].collect()} == {tuple(r) for r in once[0].collect()} and {tuple(r) for r in twice[1].collect()} == {tuple(r) for r in once[1].collect()}


def test_only_changed_partitions_are_written(spark, tmp_path):
    folder = str(tmp_path / "graph")
    rows = [(f"n{i}", i if i % 5 else None, f"app{i % 4}") for i in range(40)] + [("x", 1, None)]
    frame = lambda r: spark.createDataFrame(r, "id string, v long, app_key string")
    held = lambda: sorted(map(repr, (tuple(r) for r in spark.read.schema("id string, v long, app_key string").parquet(folder).collect())))
    assert store.save_changed(frame(rows), folder, "app_key") == {"written": 5, "deleted": 0}
    assert store.save_changed(frame(rows[::-1]), folder, "app_key") == {"written": 0, "deleted": 0}
    changed = [r for r in rows if r[2] != "app3"] + [("n1", 1, "app1")]
    assert store.save_changed(frame(changed), folder, "app_key") == {"written": 1, "deleted": 1}
    assert held() == sorted(map(repr, changed))
    assert store.save_changed(frame([r for r in changed if r[2] is not None]), folder, "app_key") == {"written": 0, "deleted": 1}
