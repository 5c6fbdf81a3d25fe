"""The small fixture graph: services, one repository, two endpoints, a snapshot before and one after."""

import itertools
import random
import re

import pytest
from archgraph.operators import build, chunks, cycles, diff, impact, pattern, resolve, summarize, traverse
from archgraph.plans import catalog
from archgraph.sources import extract, store
from archgraph.streaming import webhooks
from pyspark.sql import functions as F

BEFORE = [("e1", "Order.place"), ("Order.place", "Payment.pay"), ("Order.place", "OrderRepo.save"), ("Payment.pay", "User.get"), ("e2", "User.get")]
AFTER = [x for x in BEFORE if x != ("Order.place", "OrderRepo.save")] + [("User.get", "Order.place")]
OWNERS = [("Order.place", "Order"), ("Payment.pay", "Payment"), ("User.get", "User"), ("OrderRepo.save", "OrderRepo")]


@pytest.fixture(scope="module")
def calls(spark):
    return {k: spark.createDataFrame(v, "src string, dst string") for k, v in (("before", BEFORE), ("after", AFTER))}


@pytest.fixture(scope="module")
def owners(spark):
    return spark.createDataFrame(OWNERS, "id string, owner string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def start(spark, x):
    return spark.createDataFrame([(x,)], "id string")


def test_reach(spark, calls):
    assert ids(traverse.reach(calls["before"], start(spark, "Order.place"))) == ["OrderRepo.save", "Payment.pay", "User.get"]
    assert ids(traverse.reach(calls["before"], start(spark, "User.get"), reverse=True)) == ["Order.place", "Payment.pay", "e1", "e2"]
    assert "Order.place" in ids(traverse.reach(calls["after"], start(spark, "Order.place"))), "a start on a cycle is reached"
    assert ids(traverse.reach(calls["before"], start(spark, "nowhere"))) == []
    assert {r["id"]: r["depth"] for r in traverse.reach(calls["before"], start(spark, "e1"), max_depth=2).collect()} == {"Order.place": 1, "Payment.pay": 2, "OrderRepo.save": 2}


def test_trails(spark, calls):
    found = traverse.walks(calls["before"], spark.createDataFrame([("e1",), ("e2",)], "id string"), 10, trail=True)
    assert sorted(r[0] for r in found.filter("end = 'User.get'").select(F.array_join("path", ">")).collect()) == ["e1>Order.place>Payment.pay>User.get", "e2>User.get"]
    looped = traverse.walks(calls["after"], start(spark, "Order.place"), 10, trail=True)
    assert looped.agg(F.max("depth")).first()[0] == 3


def test_owner_graph_and_dependencies(calls, owners):
    lifted = summarize.owner_graph(calls["before"], owners)
    assert sorted(map(tuple, lifted.collect())) == [("Order", "OrderRepo"), ("Order", "Payment"), ("Payment", "User")]
    got = {r["start"]: r["reached"] for r in traverse.closure_collect(lifted, lifted.select(F.col("src").alias("id")).distinct(), 3).collect()}
    assert got == {"Order": ["OrderRepo", "Payment", "User"], "Payment": ["User"]}


def test_cycles(calls, owners):
    assert cycles.service_cycles(summarize.owner_graph(calls["before"], owners)).count() == 0
    after = cycles.service_cycles(summarize.owner_graph(calls["after"], owners))
    assert [r["signature"] for r in after.collect()] == ["Order>Payment>User>Order"]
    methods = cycles.method_cycles(calls["after"], owners)
    assert [(r["signature"], r["severity"]) for r in methods.collect()] == [("Order.place>Payment.pay>User.get>Order.place", "WARNING")]
    marked = cycles.marked_new(after, cycles.service_cycles(summarize.owner_graph(calls["before"], owners)))
    assert marked.first()["new_in_shadow"]
    assert cycles.cycle_edges(after).count() == 3


def cycle_sets(edges):
    """Brute force: nodes of each strongly connected component, from who reaches whom."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for a in after:
        seen, stack = set(), [a]
        while stack:
            for b in after.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}


def test_components_and_shortest_cycles(spark):
    rnd = random.Random(3)
    ring = [(f"r{i:02}", f"r{(i + 1) % 12:02}") for i in range(12)] + [(f"q{i}", f"q{(i + 1) % 7}") for i in range(7)] + [("r00", "q0"), ("z", "r00"), ("q3", "y")]
    some = [(f"n{rnd.randrange(30):02}", f"n{rnd.randrange(30):02}") for _ in range(45)]
    for edges in (ring, some):
        frame = spark.createDataFrame(edges, "src string, dst string")
        want = cycle_sets([e for e in edges if e[0] != e[1]])
        assert {r["id"]: r["component"] for r in cycles.components(frame).collect()} == want
        found = {(r["src"], r["dst"]): r["path"] for r in cycles.shortest_cycles(frame).collect()}
        assert set(found) == {(a, b) for a, b in edges if a != b and a in want and want[a] == want.get(b)}
        for (a, b), path in found.items():
            steps = list(itertools.pairwise(path))
            assert (a, b) in steps
            assert path[0] == path[-1] == min(path)
            assert set(steps) <= set(edges)
            assert len(set(path)) == len(path) - 1
        lengths = {r["length"] for r in cycles.service_cycles(frame).collect()}
        assert edges is some or lengths == {7, 12}
    long = [(f"k{7 * i % 50:02}", f"k{7 * (i + 1) % 50:02}") for i in range(50)]
    assert {r["component"] for r in cycles.components(spark.createDataFrame(long, "src string, dst string")).collect()} == {"k00"}
    assert cycles.components(frame.limit(0)).count() == 0


def test_detected_cycles_of_both_levels(spark, calls, owners):
    got = cycles.detected(summarize.owner_graph(calls["after"], owners), calls["after"], owners).collect()
    assert {r["severity"] for r in got} == {"ERROR", "WARNING"}


def test_components_of_the_call_graph(spark, small):
    edges = [tuple(r) for r in catalog.rings(spark, small).collect()]
    assert {r["id"]: r["component"] for r in catalog.call_components(spark, small).collect()} == cycle_sets(edges)


def test_relation_diff(calls):
    got = {(r["src"], r["dst"], r["change"]) for r in diff.relation_diff(calls["before"], calls["after"], ["src", "dst"]).collect()}
    assert got == {("User.get", "Order.place", "ADDED"), ("Order.place", "OrderRepo.save", "REMOVED")}
    assert diff.relation_diff(calls["before"], calls["before"], ["src", "dst"]).count() == 0


def test_node_diff_is_null_safe(spark):
    a = spark.createDataFrame([("p", "A", None), ("p", "B", 1), (None, "C", 1)], "package_name string, class_name string, method_count int")
    b = spark.createDataFrame([("p", "A", 1), (None, "C", 1), ("p", "D", 1)], "package_name string, class_name string, method_count int")
    got = diff.snapshot_diff({"Service": a}, {"Service": b})
    assert {(r["key"], r["change"], tuple(r["changed"])) for r in got.collect()} == {("p::A", "MODIFIED", ("method_count",)), ("p::B", "REMOVED", ()), ("p::D", "ADDED", ())}
    assert [tuple(r) for r in diff.property_diff(got).collect()] == [("p::A", "method_count", None, "1")]
    assert diff.snapshot_diff({"Service": a}, {"Service": a}).count() == 0


def test_resolution(spark):
    ends = spark.createDataFrame([(1, "/api/orders"), (2, "/api/users/{id}"), (3, ""), (4, "/x/{a}/{b}")], "endpoint_id long, path string")
    urls = [("a", "http://user-service:8080/api/users/42?x=1"), ("b", "/gw/api/orders"), ("c", "/foo"), ("d", "http://host"), ("e", "<dynamic>"), ("f", None), ("g", "/p/q/r")]
    got = {r["call_id"]: (r["endpoint_id"], r["score"]) for r in resolve.resolve(spark.createDataFrame(urls, "call_id string, url string"), ends).collect()}
    # Two trailing segments agree for "/foo" as well: the place before its slash and foo itself, both against variables.
    assert got == {"a": (2, 8), "b": (1, 10), "c": (4, 3), "g": (4, 3)}


def test_first_match_takes_prefixes(spark):
    registry = spark.createDataFrame([(1, "get", "/a/{x}", 0), (2, "GET", "/a/b", 1), (3, None, "/z", 2)], "endpoint_id int, verb string, path string, ord int")
    rows = spark.createDataFrame([("p", "GET", "/a/b/c"), ("q", None, "/z"), ("r", "POST", "/a/b")], "call_id string, verb string, path string")
    assert {r["call_id"]: r["endpoint_id"] for r in resolve.first_match(rows, registry).collect()} == {"p": 1, "q": 3}


def test_first_match_equals_all_patterns(spark):
    """Every call against every template by its pattern."""
    rnd = random.Random(12)
    segment = lambda: rnd.choice(["a", "b", "{x}", "{y}", "c-{z}", "<dynamic>", "v1"])
    paths = ["/" + "/".join(segment() for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "", "/"]) for _ in range(40)]
    urls = [rnd.choice(["/", "/", ""]) + "/".join(rnd.choice(["a", "b", "c-1", "v1", "q", ""]) for _ in range(rnd.randint(1, 4))) for _ in range(80)]
    order = rnd.sample(range(40), 40)
    registry = spark.createDataFrame([(k, "GET", p, order[k]) for k, p in enumerate(paths)], "endpoint_id int, verb string, path string, ord int")
    calls = spark.createDataFrame([(k, "get", u) for k, u in enumerate(urls)], "call_id int, verb string, path string")
    want = {}
    for k, u in enumerate(urls):
        hits = [e for e, p in enumerate(paths) if u == p or re.fullmatch(re.sub(r"\\\{[^}]+\}", "[^/]+", re.escape(p).replace("<dynamic>", "[^/]*")) + "(/.*)?", u)]
        if hits:
            want[k] = min(hits, key=lambda e: order[e])
    assert {r["call_id"]: r["endpoint_id"] for r in resolve.first_match(calls, registry).collect()} == want


def test_risk_of_the_fixture_change(spark):
    zero = dict.fromkeys(impact.COUNTERS, 0)
    row = zero | {"controllers_changed": 1, "controllers_modified": 1, "controllers": 1, "services": 1, "lines": 260, "components": 2, "endpoints": 3, "flows": 2, "error_cycles": 1, "high_fan_in": 1}
    got = impact.risk(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} int" for k in row))).withColumn("status", impact.merge_status()).first()
    assert (got["breaking"], got["downstream"], got["criticality"], got["complexity"], got["total"], got["level"], got["status"]) == (20, 16, 4, 4, 44, "MEDIUM", impact.MERGE_TEXTS["CYCLES"])


def test_patterns(spark):
    links = spark.createDataFrame([("t1", "producer"), ("t1", "consumer"), ("t2", "producer"), ("t3", "consumer")], "topic string, side string")
    assert ids(pattern.both_sides(links, "topic", "side", "producer", "consumer"), "topic") == ["t1"]
    assert ids(pattern.orphans(links, "topic", "side", "producer", "consumer"), "topic") == ["t2"]
    a = spark.createDataFrame([(1, "/api/users"), (2, "/x")], "k int, path string")
    b = spark.createDataFrame([("/api",), ("/api/users/1",), ("/y",)], "prefix string")
    assert sorted(r["prefix"] for r in pattern.prefix_related(a, "path", b, "prefix").collect()) == ["/api", "/api/users/1"]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 4), r["rank"]) for r in chunks.search(rows, [1.0, 0.0], 3).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (3, 0.7071, 2), (2, 0.0, 3)]
    assert chunks.search(rows, [1.0, 0.0], 3, min_score=0.5).count() == 2
    assert len(spark.range(1).select(chunks.hashed_embedding(F.lit("a b a")).alias("v")).first()["v"]) == 64


def test_build_resolves_in_order(spark):
    components = spark.createDataFrame(
        [("p.UserController", "UserController", "p", ["RestController"], [], False, 0), ("p.UserServiceImpl", "UserServiceImpl", "p", ["Service"], ["UserService"], False, 1), ("p.UserRepo", "UserRepo", "p", [], ["JpaRepository"], False, 2), ("p.Plain", "Plain", "p", [], [], False, 3)],
        "qualified_name string, class_name string, package_name string, annotations array<string>, interfaces array<string>, has_listener boolean, ord int",
    )
    kinds = build.classified(components)
    assert {r["qualified_name"]: r["kind"] for r in kinds.collect()} == {"p.UserController": "Controller", "p.UserServiceImpl": "Service", "p.UserRepo": "Repository"}
    methods = spark.createDataFrame([("m1", "p.UserController", "get", "User get(Long)", 0), ("m2", "p.UserServiceImpl", "load", "User load(Long)", 1), ("m3", "p.UserRepo", "findById", "findById(Long)", 2)], "method_id string, component_id string, method_name string, signature string, ord int")
    injections = spark.createDataFrame([("p.UserController", "service", "UserService", 0), ("p.UserServiceImpl", "repo", "Other", 0), ("p.UserServiceImpl", "repo", "UserRepo", 1)], "component_id string, field_name string, declared string, ord int")
    calls = spark.createDataFrame([("i1", "m1", "p.UserController", "service", "UserService", "load", False), ("i2", "m2", "p.UserServiceImpl", "repo", "UserRepo", "findById", False), ("i3", "m2", "p.UserServiceImpl", None, "x.Y", "nothing", False)], "invocation_id string, method_id string, component_id string, target_field string, declared string, method_name string, self_call boolean")
    assert {(r["caller"], r["callee"]) for r in build.resolved_calls(calls, methods, injections, kinds).collect()} == {("m1", "m2"), ("m2", "m3")}


def test_extract(spark, tmp_path):
    (tmp_path / "application.yml").write_text("kafka:\n  topic: orders\nlist:\n  - a\n  - b\n")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "application.properties").write_text("kafka.topic=late\n# no\nx = 1\n")
    files = extract.text_files(spark, str(tmp_path), "application.*")
    assert {r["key"]: r["value"] for r in extract.properties(files).collect()} == {"kafka.topic": "late", "list[0]": "a", "list[1]": "b", "x": "1"}
    java = 'package a.b;\n@RestController @RequestMapping("/u")\npublic class C extends D implements I {\n  private final UserService service;\n  @GetMapping("/{id}")\n  public User get(Long id) { return service.load("x"); }\n}\n'
    rows = extract.java_staging(spark.createDataFrame([("C.java", java)], "path string, text string")).collect()
    assert [(r["kind"], r["name"]) for r in rows if r["kind"] != "call"] == [("type", "C"), ("field", "service"), ("method", "get")]
    assert [(r["declared"], r["member"], r["argument"]) for r in rows if r["kind"] == "call"] == [("service", "load", "x")]
    assert [a["annotation"] for a in rows[0]["annotations"]] == ["RestController", "RequestMapping"]


def test_store(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    store.save_snapshot(rows, folder, "p")
    store.save_snapshot(rows, folder, store.shadow_id("p", "1"))
    store.save_snapshot(rows.limit(1), folder, "p")
    assert store.read_snapshot(spark, folder, "p").count() == 1
    assert store.read_snapshot(spark, folder, "p::shadow::1").count() == 2
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "id string, v string")
    assert sorted(map(tuple, store.upserted(rows, new, ["id"]).collect())) == [("a", "x"), ("b", "z"), ("c", "w")]


def test_webhook_stream(spark, tmp_path):
    bodies = tmp_path / "in"
    spark.createDataFrame([('{"action": "opened", "number": 7}',), ("payload=%7B%22action%22%3A%22closed%22%2C%22number%22%3A7%7D",), ("broken",)], "body string").write.parquet(str(bodies))
    stream = webhooks.parsed(spark.readStream.schema("body string").parquet(str(bodies)))
    webhooks.run_available(stream, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check"))
    assert sorted(r["todo"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["build", "clean", "ignore"]


def test_prompt_and_context(spark):
    from archgraph.operators import render

    hits = spark.createDataFrame([(2, "b"), (1, "a")], "rank int, text string")
    assert tuple(render.numbered_context(hits).first()) == (2, "[1] a\n\n[2] b")
    assert tuple(render.numbered_context(hits.limit(0)).first()) == (0, "Nothing relevant was found.")
    assert "Question: q" in hits.select(render.prompt(F.lit("q"), F.col("text"))).first()[0]
    assert spark.range(1).select(render.filled("{{A}}-{{B}}-{{C}}", {"A": F.lit(1), "B": F.lit(None)})).first()[0] == "1--{{C}}"


def test_warnings_and_file_components(spark):
    files = spark.createDataFrame([("m/src/main/java/a/UserService.java",), ("m/src/main/java/a/Odd.java",), ("README.md",)], "filename string")
    mapped = impact.file_components(files, spark.createDataFrame([("UserService", "Service"), ("UserService", "Controller")], "class_name string, type string"))
    assert {r["class_name"]: r["component_type"] for r in mapped.collect()} == {"UserService": "Controller", "Odd": "Other", "README": "Other"}
    none = spark.range(0)
    assert {(r["warning"], r["n"]) for r in impact.warnings(mapped, none, spark.range(2)).collect()} == {("not main Java", 1), ("unmapped", 1), ("new cycles", 2)}


def test_patch_raises_versions(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.patched(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", 6)]


def test_diff_ignores_row_order(spark, calls):
    a = calls["before"]
    assert diff.relation_diff(a, a.orderBy(F.desc("src")), ["src", "dst"]).count() == 0
    found = {r["signature"] for r in cycles.service_cycles(calls["after"]).collect()}
    assert found == {r["signature"] for r in cycles.service_cycles(calls["after"].orderBy(F.desc("dst"))).collect()}


def test_database_access_ends_on_cycles(spark, calls):
    accesses = spark.createDataFrame([("OrderRepo.save", "orders")], "src string, dst string")
    assert [tuple(r) for r in traverse.accesses_reached(calls["before"], accesses, start(spark, "e1")).collect()] == [("OrderRepo.save", "orders")]
    assert traverse.accesses_reached(calls["after"], accesses, start(spark, "e1")).count() == 0


def test_urls_are_assembled_from_literals_constants_and_variables():
    java = """class C {
  private static final String BASE = "http://h/api";
  public void a(Long id) { String url = BASE + "/users/" + id; rest.getForObject(url, X.class); }
  public void b() { rest.delete(String.format("/o/%s/i/%d", x(1, 2), y)); rest.put("/a,b(c)" + f("x+y"), 1); rest.get(); }
}"""
    got = [(r[9], r[10]) for r in extract.java_rows("C.java", java) if r[2] == "call" and r[5] == "rest"]
    assert got == [("getForObject", "http://h/api/users/<dynamic>"), ("delete", "/o/<dynamic>/i/<dynamic>"), ("put", "/a,b(c)<dynamic>"), ("get", None)]


def test_method_text_lists_all_topics_and_tables(spark):
    methods = spark.createDataFrame([("m", "Svc", "run", "public")], "id string, owner string, label string, kind string")
    names = [f"x{i:02}" for i in range(12)]
    links = spark.createDataFrame([("m", n, t) for n in names for t in ("CALLS", "PRODUCES_TO", "ACCESSES", "MAKES_EXTERNAL_CALL")], "src string, label string, type string")
    lines = dict(x.split(": ") for x in chunks.method_text(methods, links).first()["text"].split("\n"))
    assert {k: len(v.split(", ")) for k, v in lines.items() if ", " in v} == {"Calls": 10, "Kafka Topics": 12, "Database Tables": 12, "External Calls": 5}
