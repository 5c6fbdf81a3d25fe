"""Nearest neighbours by cosine for a whole table of queries: exact by blocks, or through the cells of an inverted file.

Vectors are dealt into blocks of at most BLOCK_VECTORS, queries into blocks of at most BLOCK_QUERIES; a pair of blocks meets in one task as
two matrices, and only the best k of each query leave it. In the inverted file a vector lies in the cell of its nearest centre and
a query meets the vectors of its `probes` nearest cells; with all cells the result is the exact one. Cells may be of any size, blocks are not.

Centres come from at most SAMPLE_ROWS vectors, those of least hash (k-means on the driver, which holds the sample alone); every vector
is assigned. How many cells a query probes follows from the recall measured on the sample. Scores are rounded to PLACES digits, equal ones are ordered by id.

Cases: null vectors, vectors of another length than most of the sample and zero vectors are never found and find nothing; an empty side gives no rows;
rows that repeat an id are all found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.sources.shared import written

BLOCK_VECTORS, BLOCK_QUERIES = 4_096, 1_024
SAMPLE_ROWS, CELLS, ROUNDS = 20_000, 64, 12
#: Cells are probed until RECALL of the NEAR nearest vectors of QUERIES rows of the sample lie in them.
RECALL, NEAR, QUERIES = 0.98, 10, 500
PLACES = 6


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has the length, no null and is not zero."""
    v = F.col(vector)
    return df.filter((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))


@dataclass(frozen=True)
class Cells:
    centre: np.ndarray  # unit rows
    probes: int


def probes_for(centre: np.ndarray, x: np.ndarray, recall: float = RECALL) -> int:
    """The least number of cells that hold that share of the nearest rows of some rows of x, each one's own place left out."""
    of = (x @ centre.T).argmax(axis=1)
    asked = np.unique(np.linspace(0, len(x) - 1, QUERIES).astype(np.int64))
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    near = np.argsort(-score, axis=1)[:, : min(NEAR, len(x) - 1)]
    rank = np.argsort(np.argsort(-(x[asked] @ centre.T), axis=1), axis=1)
    found = np.sort(np.take_along_axis(rank, of[near], 1).ravel())
    return int(found[int(np.ceil(recall * len(found))) - 1]) + 1 if len(found) else 1


def centres(vectors: DataFrame, vector: str = "embedding", cells: int = CELLS, rows: int = SAMPLE_ROWS, recall: float = RECALL) -> Cells:
    """At most `cells` cells, none if there is no vector."""
    held = vectors.filter(F.col(vector).isNotNull())
    share = min(1.0, (1.2 * rows + 100) / max(1, held.count()))
    h = F.xxhash64(vector)
    sample = held.filter(h <= F.lit(min((1 << 63) - 1, int((share - 0.5) * (1 << 64))))).orderBy(h).limit(rows)
    lengths = sample.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return Cells(np.zeros((0, 0)), 0)
    size = lengths[0][0]
    x = matrix(usable(sample, vector, size).select(vector).toArrow()[vector])
    if not len(x) or x.shape[1] != size:
        return Cells(np.zeros((0, size)), 0)
    # Starts far apart: each next one is the row least like those there are.
    at, near = [0], x @ x[0]
    for _ in range(min(cells, len(x)) - 1):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-12, total / np.maximum(length, 1e-12), c)
    return Cells(c, probes_for(c, x, recall))


def in_cells(df: DataFrame, ident: str, vector: str, centre: np.ndarray, probes: int) -> DataFrame:
    """(id, v, cell): each row once for each of its `probes` nearest cells."""
    shared = df.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        for b in batches:
            near = np.argsort(-(matrix(b.column(1)) @ shared.value.T), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(len(b)), near.shape[1])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in b.columns), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

    return df.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id bigint, v array<double>, cell int")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, cells: Cells, exact: bool = False, ident: str = "vec_id", vector: str = "embedding", keep: Column | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best vectors of each query among those of its cells, or with `exact` among all.

    `keep` is a condition that vectors have to meet, before they are compared. A query finds itself where it is among them.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    centre = cells.centre
    if not len(centre):
        return empty
    size = centre.shape[1]
    searched = usable(vectors if keep is None else vectors.filter(keep), vector, size)
    asked = usable(queries, vector, size)
    if exact:
        one = centre[:1]
        rows, wanted = in_cells(searched, ident, vector, one, 1), in_cells(asked, ident, vector, one, 1)
    else:
        rows, wanted = in_cells(searched, ident, vector, centre, 1), in_cells(asked, ident, vector, centre, cells.probes)
    rows, wanted = written(rows, "vectors"), written(wanted, "queries")
    blocks = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    plan = blocks(rows, BLOCK_VECTORS, "a").join(blocks(wanted, BLOCK_QUERIES, "b"), "cell")
    dealt = lambda df, n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan, "cell").select("id", "v", "cell", dealt(rows, "a").alias("x"), every("b").alias("y"))
    right = wanted.join(plan, "cell").select("id", "v", "cell", dealt(wanted, "b").alias("y"), every("a").alias("x"))

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = a["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        score = np.round(matrix(b["v"]) @ matrix(a["v"])[order].T, PLACES) + 0.0
        # Stable, and columns ascend by id: equal scores are in the order of ids.
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return pa.table({"query_id": np.repeat(b["id"].to_numpy(), best.shape[1]), "id": ids[order][best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    keys = ("cell", "x", "y")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
