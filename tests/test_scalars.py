import pytest
from archgraph.functions import rules, scalars
from archgraph.operators import impact
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, want",
    [("/api/users/{id}", "/api/users/{*}"), ("/api/users/123", "/api/users/{*}"), ("/api/orders/{orderId}/items/{itemId}", "/api/orders/{*}/items/{*}"), ("/u/1/2/x", "/u/{*}/2/x"), ("/a/", "/a"), ("/", "/"), (None, "")],
)
def test_normalize_path(spark, path, want):
    assert value(spark, scalars.normalize_path(F.lit(path).cast("string"))) == want


@pytest.mark.parametrize(
    "url, want",
    [("http://localhost:8080/api/users/123", "/api/users/{*}"), ("https://api.example.com/v1/orders?status=active", "/v1/orders"), ("https://h.example", "/"), ("http://h/a/<dynamic>/1", "/a/{*}/1"), (None, "")],
)
def test_normalize_external_url(spark, url, want):
    assert value(spark, scalars.normalize_external_url(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("url, want", [("http://h:1/a//b/?x=1", "/a/b"), ("http://host", ""), ("a/b#c", "/a/b"), ("/x/<dynamic>/", "/x"), (None, "")])
def test_resolver_url(spark, url, want):
    assert value(spark, scalars.resolver_url(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("signature, want", [("method(String name, int age)", "String,int"), ("method()", ""), ("m(List<String> items)", "List<String>"), (None, ""), ("m", "")])
def test_parameter_types(spark, signature, want):
    assert value(spark, scalars.parameter_types(F.lit(signature).cast("string"))) == want


def test_ids(spark):
    s = lambda x: F.lit(x).cast("string")
    assert value(spark, scalars.controller_id(s("a.b"), s("C"))) == "controller:a.b.C"
    assert value(spark, scalars.controller_id(s(None), s("C"))) == "controller:unknown"
    assert value(spark, scalars.endpoint_id(s("get"), s("/u/1"))) == "endpoint:GET:/u/{*}"
    assert value(spark, scalars.method_id(s(None), s("C"), s("m"), s("m(int a)"))) == "method:C.m(int)"
    assert value(spark, scalars.service_id(s("p"), s("S"))) == "service:p.S"
    assert value(spark, scalars.edge_id(s("CALLS"), s("a"), s("b"))) == "calls:a->b"
    assert value(spark, scalars.table_id(s("Orders"))) == "database_table:orders"
    assert tuple(value(spark, scalars.parse_chunk_id(F.lit("p::shadow::1::METHOD::n")))) == ("p::shadow::1", "METHOD", "n")


def test_names(spark):
    assert value(spark, scalars.snake_case(F.lit("OrderItem"))) == "order_item"
    assert value(spark, scalars.class_of_file(F.lit("src/main/java/com/example/service/MyService.java"))) == "com.example.service.MyService"
    assert value(spark, scalars.class_of_file(F.lit("README.md"))) is None
    assert value(spark, scalars.path_prefix(F.lit("/api/users/roll/"))) == "/api/users"
    assert value(spark, scalars.path_prefix(F.lit("/api"))) == "/api"
    assert value(spark, scalars.service_of_url(F.lit("http://order-service.default.svc/api/orders"))) == "order-service"
    assert value(spark, scalars.service_of_url(F.lit("http://127.0.0.1/x"))) is None
    assert [value(spark, rules.infer_operation(F.lit(x))) for x in ("findAll", "saveX", "setY", "removeZ", "foo")] == ["READ", "WRITE", "UPDATE", "DELETE", "UNKNOWN"]
    assert value(spark, rules.operations_in_name(F.lit("findAndDelete"))) == ["DELETE", "READ"]


def test_placeholders(spark):
    one = lambda t, v: value(spark, scalars.resolve_placeholder(F.lit(t), F.lit(v).cast("string")))
    assert [one("${a}", "x"), one("${a:d}", None), one("${a:d}", ""), one("${a}", None), one("plain", "x")] == ["x", "d", "d", "${a}", "plain"]
    props = F.create_map(F.lit("a"), F.lit("1"))
    assert value(spark, scalars.resolve_all(F.lit("${a}-${b:2}-${c}"), props)) == "1-2-${c}"


@pytest.mark.parametrize(
    "old, new, want",
    [("/api/users/", "/api/accounts/", ("PATH_SEGMENT_CHANGE", 25)), ("/api/users", "/api/users/", ("MINOR_CHANGE", 15)), ("/a/b", "/a/b/c", ("PATH_STRUCTURE_CHANGE", 30)), ("users", "/users", ("COMPLETE_REWRITE", 35))],
)
def test_change_class(spark, old, new, want):
    got = value(spark, impact.change_class(F.lit(old), F.lit(new)))
    assert (got["kind"], got["points"]) == want


def test_url_fold_keeps_equal_pairs_and_resets_after_a_change(spark):
    patch = '--- a\n+++ b\n-x("/api/a")\n+x("/api/a")\n+x("/api/b")\n+x("/api/c")\n-x("/api/d")'
    got = [tuple(x) for x in value(spark, impact.url_changes(F.lit(patch)))]
    assert got == [("/api/a", "/api/b"), ("/api/d", "/api/c")]


@pytest.mark.parametrize(
    "line, want",
    [
        ('+ x("b", "/users/all", "/api/one")', "/api/one"), ('- call("api/x")', "api/x"), ('+ a("/v1/orders/{id}")', "/v1/orders/{id}"), ('+ a("/users")', None), ('+ restTemplate.getForObject("/users", X)', "/users"),
        ('+ webClient.get().uri("/u?x=1")', "/u?x=1"), ('+ @GetMapping("/list")', "/list"), ("+ @PostMapping('/list')", "/list"), ('+ log("it\'s /a/b")', None), ('+ "/open', None), ("+ nothing", None), ('+ a("/a.b/c")', None),
        ('+ x("/Api", "/API/y")', "/API/y"), ('+ httpClient.send("//h/x", "/p")', "//h/x"),
    ],
)
def test_url_in_a_line(spark, line, want):
    assert value(spark, impact.url_in(F.lit(line))) == want
