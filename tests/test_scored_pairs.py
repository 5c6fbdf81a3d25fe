import random

import pytest
from archgraph.functions import scalars
from archgraph.operators import resolve
from pyspark.sql import functions as F

PATHS = [
    ("a0", "/orders/{a}/{b}", "POST"), ("a1", "/orders/{a}/{b}", "GET"), ("b", "/{id}", "GET"), ("c", "/", "GET"), ("d", "/{a}/{b}", "GET"), ("e", "/**", "PUT"), ("f", "/users/{id}", None), ("g", "/long-name/*/a/b", "GET"),
    ("h", "/deep" + "/{x}" * 13, "PATCH"), ("i", "/{a}/{b}/{c}", "DELETE"), ("j", "/files/*", "REQUEST"),
]
URLS = ["/42", "http://h/", "/p/q", "/x/a/b", "/{id}", "/orders/1/2", "/users/7", "/deep" + "/1" * 13, "/1/2/3", "/files/z", "/q/w/e/r/t", "/gw/users/9"]


def all_pairs(spark, calls, ends, match_verb):
    """The best of every pair by the same score."""
    pairs = resolve.candidates(calls).crossJoin(ends.filter("path <> ''").withColumn("path", scalars.resolver_url("path"))).withColumn("score", resolve.match_score(F.col("candidate"), F.col("path")))
    pairs = pairs.groupBy("call_id", "endpoint_id").agg(F.max("score").alias("score")).filter(F.col("score") >= resolve.ACCEPT)
    verb = {r["endpoint_id"]: r["verb"] for r in ends.collect()}
    asked = {r["call_id"]: r["verb"] for r in calls.collect()}
    best = {}
    for r in pairs.collect():
        v, w = asked[r["call_id"]], verb[r["endpoint_id"]]
        if match_verb and not (v in (None, "UNKNOWN", "REQUEST") or w in (None, "REQUEST") or v == w):
            continue
        best[r["call_id"]] = min(best.get(r["call_id"], (0, "")), (-r["score"], r["endpoint_id"]))
    return {c: (e, -s) for c, (s, e) in best.items()}


@pytest.mark.parametrize("match_verb", [False, True])
def test_resolution_equals_all_pairs(spark, match_verb):
    calls = spark.createDataFrame([(f"{v}{u}", u, v) for u in URLS for v in ("GET", "PUT", "DELETE", "UNKNOWN")], "call_id string, url string, verb string")
    ends = spark.createDataFrame(PATHS, "endpoint_id string, path string, verb string")
    got = {r["call_id"]: (r["endpoint_id"], r["score"]) for r in resolve.resolve(calls, ends, match_verb).collect()}
    assert got == all_pairs(spark, calls, ends, match_verb)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_templates_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    segment = lambda: rnd.choice(["users", "orders", "v1", "{id}", "{a}", "{b-c}", "*", "x{y}", "**", "7"])
    paths = sorted({rnd.choice(["", "/"]) + "/".join(segment() for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "/"]) for _ in range(60)})
    urls = ["/" + "/".join(rnd.choice(["users", "orders", "v1", "42", "q", "x7", "{id}"]) for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    verbs = ["GET", "PUT", None, "REQUEST"]
    ends = spark.createDataFrame([(f"e{i:02}", x, rnd.choice(verbs)) for i, x in enumerate(paths)], "endpoint_id string, path string, verb string")
    calls = spark.createDataFrame([(f"c{i}", u, rnd.choice(["GET", "PUT", "UNKNOWN"])) for i, u in enumerate(urls)], "call_id string, url string, verb string")
    for match_verb in (False, True):
        got = {r["call_id"]: (r["endpoint_id"], r["score"]) for r in resolve.resolve(calls, ends, match_verb).collect()}
        assert got == all_pairs(spark, calls, ends, match_verb)
