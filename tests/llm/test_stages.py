"""Stages of the pipeline on odd tables, and against brute force on the smallest documents."""

import corpus_pipeline
from pyspark.sql import functions as F

PROSE = "the and that with from this have which their would there about other into than then them these some what"


def documents(spark, rows):
    """Rows (doc_id, text) with the columns of documents, and columns of the names that operators make."""
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.withColumns({c: F.lit(7) for c in ("n_removed", "score", "bucket", "component", "row", "key", "hits", "kept")})


def test_stages_take_odd_tables(spark, small):
    words = PROSE.split()
    clean = [" ".join(words[(i * k + k) % len(words)] for i in range(60)) for k in (1, 3, 7)]
    rows = [(None, clean[0]), (1, None), (2, ""), (3, " \n"), (4, clean[1]), (4, clean[1]), (4, clean[2]), (5, "12 34 ?!"), (6, clean[0])]
    for docs in (documents(spark, rows), documents(spark, []).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, small)
            assert got.columns == docs.columns
            assert got.count() <= docs.count()
            assert got.filter("row <> 7 OR score <> 7 OR hits <> 7").count() == 0
        assert corpus_pipeline.pack(spark, docs, small).count() == docs.count()
    docs = documents(spark, rows)
    told = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_languages(spark, docs, small).collect() if r["doc_id"])
    assert not {1, 2, 3, 5} & {i for i, _ in told}
    once = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()]
    assert sorted(once, key=str) == sorted([(1, None), (4, clean[1]), (4, clean[2]), (5, "12 34 ?!"), (6, clean[0])], key=str)


def test_repeated_passages_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, want = {}, {}
    rows = sorted((r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect())
    for i, w in rows:
        for k in range(len(w) - 49):
            first.setdefault(b" ".join(w[k : k + 50]), i)
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 49) if first[b" ".join(w[k : k + 50])] < i for j in range(50)}
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    got = corpus_pipeline.drop_repeated_passages(spark, docs, small).collect()
    assert {r["doc_id"]: r["text"].encode().split() for r in got if r["text"] is not None} == {i: w for i, w in want.items() if w or any(r["doc_id"] == i and r["text"] is not None for r in got)}
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None and len(want[r["doc_id"]]) < len(dict(rows)[r["doc_id"]]))
