import numpy as np
import pytest
from archgraph.operators import neighbours
from pyspark.sql import functions as F


def all_pairs(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in queries:
        score = np.round(x @ (np.array(q) / np.linalg.norm(q)), neighbours.PLACES)
        order = np.lexsort((ids, -score))[:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def made(spark):
    rnd = np.random.default_rng(3)
    middle = rnd.normal(size=(30, 16))
    rows = [(i, (middle[i % 30] + 0.6 * rnd.normal(size=16)).tolist()) for i in range(3_000)]
    rows += [(5_000 + i, rows[7][1]) for i in range(20)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def test_blocks_equal_all_pairs(spark, made, monkeypatch):
    rows, df = made
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 500)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 17)
    got = grouped(neighbours.nearest(df.filter("vec_id % 50 = 0"), df, 10, neighbours.centres(df), True))
    want = all_pairs(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert got.keys() == want.keys()
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


def test_cells_find_nearly_all(spark, made):
    rows, df = made
    centre = neighbours.centres(df)
    assert centre.centre.shape == (neighbours.CELLS, 16) and centre.probes < neighbours.CELLS / 2
    got = grouped(neighbours.nearest(df.filter("vec_id % 50 = 0"), df, 10, centre))
    want = all_pairs(rows, [r for r in rows if r[0] % 50 == 0], 10)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_cases(spark, made):
    _, df = made
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 16), (3, [1.0]), (4, [1.0] * 15 + [None])], "vec_id long, embedding array<double>")
    centre = neighbours.centres(df)
    assert neighbours.nearest(odd, df, 3, centre).count() == 0
    assert neighbours.nearest(df.limit(5), odd, 3, centre).count() == 0
    assert len(neighbours.centres(odd.filter("false")).centre) == 0 and neighbours.nearest(df, df, 3, neighbours.Cells(np.zeros((0, 0)), 0)).count() == 0
    kept = neighbours.nearest(df.filter("vec_id = 7"), df, 25, centre, True, keep=F.col("vec_id") >= 5_000)
    assert [r["id"] for r in kept.orderBy("rank").collect()] == list(range(5_000, 5_020))


def test_recall_of_the_query(spark):
    """The registered inverted file over the given vectors, against all pairs."""
    from archgraph.plans import catalog

    folder = "/root/testdata/sf0.01"
    got, want = (grouped(catalog.QUERIES[name](spark, folder)) for name in ("vector_cells", "vector_neighbours"))
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
