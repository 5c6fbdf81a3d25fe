import random

import pytest
from archgraph.operators import impact, substrings
from pyspark.sql import functions as F


@pytest.mark.parametrize("slice_texts", [20_000, 3])
def test_containment_equals_all_pairs(spark, slice_texts):
    rnd = random.Random(slice_texts)
    text = lambda n: "".join(rnd.choice("aabé(") for _ in range(n))
    texts = [(i, text(rnd.randint(0, 30))) for i in range(120)] + [(500, None), (501, ""), (502, "aaa"), (502, "aaa")]
    names = sorted({text(rnd.randint(1, 6)) for _ in range(80)}) + ["", None, "zzz", "aaz"]
    got = substrings.containing(spark.createDataFrame(texts, "id long, text string"), "text", spark.createDataFrame([(n,) for n in names], "name string"), "name", slice_texts=slice_texts)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == sorted((i, n) for i, t in texts if t is not None for n in names if n and n in t)


def test_a_name_meets_the_texts_of_its_rarest_gram_alone(spark):
    texts = spark.range(2_000).select("id", F.concat(F.lit("com.shop.Service"), "id", F.lit(".run()")).alias("text"))
    names = spark.createDataFrame([("Service1999",), ("com.shop.Nothing",), ("1998.r",)], "name string")
    assert sorted((r["id"], r["name"]) for r in substrings.containing(texts, "text", names, "name").collect()) == [(1998, "1998.r"), (1999, "Service1999")]


def test_changes_of_one_file_keep_their_own_urls(spark):
    patch = '-  @GetMapping("/api/orders/all")\n+  @GetMapping("/api/orders/every")\n'
    files = spark.createDataFrame([("A", "src/main/java/a/C.java", patch), ("B", "src/main/java/a/C.java", "")], "change_id string, filename string, patch string")
    got = impact.url_change_details(files, spark.createDataFrame([], "call_id string, url string")).collect()
    assert {r["change_id"] for r in got} == {"A"}
