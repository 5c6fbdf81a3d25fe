"""Routing through tries against all pairs: long runs, wildcards, verbs, many URLs."""

import random

import pytest
from archgraph.operators import resolve
from pyspark.sql import functions as F
from tests.test_scored_pairs import all_pairs

SEGMENTS = ["a", "b", "{x}", "{y}", "c"]


@pytest.mark.parametrize("seed", [3, 4])
def test_long_paths_equal_all_pairs(spark, seed):
    """Runs of more than eight segments score above a template; every score from 3 up occurs."""
    rnd = random.Random(seed)
    path = lambda n, of: "/" + "/".join(rnd.choice(of) for _ in range(n))
    paths = {path(rnd.randint(1, 12), SEGMENTS) for _ in range(60)} | {path(rnd.randint(1, 4), [*SEGMENTS, "*", "**", "{q}z", "{p}-{q}"]) for _ in range(30)}
    tail = ["a", "b", "a", "c", "b", "a", "c", "a", "b"]
    paths |= {"/" + "/".join([rnd.choice("ab"), *["{x}" if rnd.random() < 0.2 else s for s in tail[-k:]]]) for k in range(2, 10) for _ in range(3)}
    urls = [path(rnd.randint(1, 12), ["a", "b", "c", "{x}", "7", "qz", "1-2"]) for _ in range(60)] + ["/" + "/".join(["z", *tail[-k:]]) for k in range(1, 10)] + ["/" + "/".join(tail[-k:]) for k in range(1, 10)] + ["/", "http://h", "http://h/a/b?x=1"]
    verbs = ["GET", "PUT", None, "REQUEST"]
    ends = spark.createDataFrame([(f"e{i:03}", x, rnd.choice(verbs)) for i, x in enumerate(sorted(paths, key=lambda x: rnd.random()))], "endpoint_id string, path string, verb string")
    calls = spark.createDataFrame([(f"c{i}", u, rnd.choice(["GET", "PUT", "UNKNOWN", None])) for i, u in enumerate(urls)], "call_id string, url string, verb string")
    scores = set()
    for match_verb in (False, True):
        got = {r["call_id"]: (r["endpoint_id"], r["score"]) for r in resolve.resolve(calls, ends, match_verb).collect()}
        assert got == all_pairs(spark, calls, ends, match_verb)
        scores |= {s for _, s in got.values()}
    assert len(scores) >= 3


def test_hub_segments_meet_no_pairs(spark):
    """A thousand URLs below one segment and a thousand templates below it: rows follow the URLs, not the pairs."""
    urls = spark.range(1_000).select(F.concat(F.lit("c"), "id").alias("call_id"), F.concat(F.lit("/api/v1/t"), "id", F.lit("/items/"), F.col("id") * 3).alias("url"))
    ends = spark.range(1_000).select(F.concat(F.lit("e"), "id").alias("endpoint_id"), F.concat(F.lit("/api/v1/t"), "id", F.lit("/items/{id}")).alias("path"))
    got = resolve.resolve(urls, ends)
    assert got.filter(F.substring("call_id", 2, 9) == F.substring("endpoint_id", 2, 9)).filter("score = 8").count() == 1_000
    assert resolve.scored(urls, ends).count() <= 3_000


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], "endpoint_id string, path string")
    calls = spark.createDataFrame([("c", "/a"), ("d", None), ("e", "<dynamic>")], "call_id string, url string")
    assert resolve.resolve(calls, none).count() == 0
    assert resolve.resolve(calls.filter("false"), spark.createDataFrame([("e", "/a")], "endpoint_id string, path string")).count() == 0
