"""Samples keep their bounds, no language is lost, and rows that repeat an id are spread."""

from archgraph.llm import language, packing
from archgraph.llm.common import labelled_sample, least_by_hash
from pyspark.sql import functions as F


def test_labelled_sample_is_bounded_in_documents(spark):
    docs = spark.range(3_000).select(F.lit(4).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).union(spark.range(100).select("id", F.lit("t")))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = labelled_sample(docs, labels, 30).collect()
    assert len(got) == 30 == len({r["doc_id"] for r in got})
    every = {r["doc_id"]: r["text"] for r in labelled_sample(docs, labels, 10**6).collect()}
    assert len(every) > 60 and every.get(4, "t") == "t"


def test_least_by_hash_equals_an_ordering_of_all(spark):
    df = spark.range(5_000)
    want = [r["id"] for r in df.orderBy(F.xxhash64("id")).limit(40).collect()]
    assert sorted(r["id"] for r in least_by_hash(df, 40, "id").collect()) == sorted(want)
    assert least_by_hash(df, 10_000, "id").count() == 5_000


def test_language_of_one_endless_word_is_learned(spark):
    rows = [(i, "x" * 70_000, "xx") for i in range(8)] + [(i, "the cat and the dog " * 30, "en") for i in range(8, 16)]
    held = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(held) == {"xx", "en"}
    assert language.Compressors(held).of("xxxxxxxxxxxxxxx")[0] == "xx"


def test_marks_stay_with_their_letters(spark):
    rows = [(i, "हिन्दी भाषा में " * 20, "hi") for i in range(8)] + [(i, "मराठी वाक्य आहे " * 20, "mr") for i in range(8, 16)]
    held = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "हिन्दी".encode() in held["hi"]
    assert language.FOLDED.sub(" ", "हिन्दी, 12_भाषा") == "हिन्दी भाषा"
    assert language.Compressors(held).of("हिन्दी भाषा में")[0] == "hi"


def test_rows_without_an_id_are_spread_over_slices(spark):
    df = spark.range(4_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.pack(df, slice_rows=200)
    assert got.count() == 4_000 and got.filter("doc_id IS NULL").count() == 4_000
    sizes = [r["count"] for r in got.groupBy("batch_id").count().collect()]
    assert max(sizes) <= packing.BUDGET // 3
