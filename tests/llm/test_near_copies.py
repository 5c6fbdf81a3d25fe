import itertools
import random

import corpus_pipeline
import numpy as np

from archgraph.llm import jaccard

SCHEMA = "doc_id bigint, text string"


def shingle_set(t):
    return {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()


def brute(texts):
    """Component of each text by all pairs."""
    held = list(map(shingle_set, texts))
    root = list(range(len(texts)))
    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def corpus(seed=7):
    pick = random.Random(seed)
    texts = []
    for _ in range(30):
        words = [f"w{pick.randrange(5000)}" for _ in range(pick.randrange(20, 400))]
        texts.append(" ".join(words))
        for edits in range(1, 9):
            near = list(words)
            for _ in range(edits):
                near[pick.randrange(len(near))] = f"x{pick.randrange(10**6)}"
            texts.append(" ".join(near))
    return texts + ["", " ", "a b c", "A b  C", texts[0]]


def partition(labels):
    out = {}
    for i, label in labels:
        out.setdefault(label, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_groups_equal_all_pairs(spark):
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = jaccard.groups(rows, "doc_id").collect()
    assert partition((r["row"], r["component"]) for r in got) == partition(enumerate(brute(texts)))


def test_tiles_and_bitmaps_lose_no_pair(spark):
    texts = [f"{t} tail of all these texts" for t in corpus(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row bigint, text string")
    sketched = jaccard.sketches(docs, np.zeros(0, np.uint64))
    parts = spark.createDataFrame([(i, i % 7) for i in range(0, len(texts), 2)], "row bigint, part bigint")
    pairs = lambda tile, frequent: {tuple(r) for r in jaccard.candidates(sketched, parts, tile=tile, every=1, frequent=frequent).collect()}
    plain, bitmaps = pairs(10**6, 10**6), pairs(10**6, 1)
    assert pairs(2, 1) == bitmaps <= plain
    held = [shingle_set(t) for t in texts]
    part = lambda i: i % 7 if i % 2 == 0 else i
    like = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if part(i) != part(j) and held[i] and 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])}
    assert like <= bitmaps


def test_order_changes_no_pair(spark, monkeypatch):
    texts = corpus(3)
    monkeypatch.setattr(jaccard, "SAMPLE", 10)
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = jaccard.groups(rows, "doc_id").collect()
    assert partition((r["row"], r["component"]) for r in got) == partition(enumerate(brute(texts)))


def test_stage_drops_near_copies_of_scattered_edits(spark, small):
    words = [f"w{i}" for i in range(300)]
    near = [f"x{i}" if i % 60 == 30 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "something else")], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()) == [1, 3]


def test_stage_keeps_one_row_of_each_group_whatever_its_ids(spark, small):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcd"]
    rows = [(None, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (2, texts[3]), (None, texts[3]), (3, texts[2])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()), key=str)
    assert got == sorted([(None, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[3])], key=str)
