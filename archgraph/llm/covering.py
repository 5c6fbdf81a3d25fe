"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: XXH64 (seed 42) of every shingle of words, repeats included; a bit is set if more than half the shingles set it.
Tables: each bit position gets one of the 2^(r+1) - 1 non-zero vectors of r + 1 bits, in turn; table v keeps the positions
whose vector has an odd product with v. Any r positions span at most r dimensions, so some v is even on all of them:
two fingerprints that differ in at most r bits agree on everything that table v keeps. No pair within the radius is lost.

Fingerprints are made distinct first, so copies cost one row. A bucket is compared in square tiles of at most TILE
fingerprints, dealt to different tasks, and a tile gives the edges of a spanning forest, not all its pairs: connections
stay whole, rows stay linear in the bucket. Components come from rounds of star contraction over a written table.

Cases: null, empty and blank texts have the fingerprint zero and are linked like others; fewer words than a shingle make
one shingle of all; repeated rows and ids share a component; a row without an id is linked like others and can give no
component its id (a component of such rows alone has none); an empty table gives no rows. Only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import dropped, text_chunks, written

WORDS, RADIUS, SEED = 3, 3, 42
TILE = 32768


def shingle_hashes(raw: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text in UTF-8, repeats included; A-Z count as lower case."""
    tokens = raw.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    k = min(words, len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is one if more than half the hashes set it."""
    ones = np.zeros(64, np.int64)
    h = hashes.astype(">u8")
    for lo in range(0, len(h), 4096):
        ones += np.unpackbits(h[lo : lo + 4096].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def simhash(raw: bytes, words: int = WORDS) -> int:
    return majority(shingle_hashes(raw, words))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, offs in text_chunks(batch.column(1)):
                raw = data.tobytes()
                out += [simhash(raw[a:b], words) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """One mask of 64 bits for each table, as signed longs."""
    n = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, n + 1):
        mask = sum(1 << bit for bit in range(64) if (v & (bit % n + 1)).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(values: np.ndarray, radius: int) -> list[np.ndarray]:
    """Edges (2, n) that connect all distinct fingerprints that links connect, and no more: a search over those not yet met."""
    out, left = [], values
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                out.append(np.stack([np.full(len(found), at), found]))
                stack.extend(found)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that keep every connection at the radius."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("bigint").alias("mask")) for i, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("m")).select("fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # A bucket of B blocks is compared in tiles of two blocks each; one of a single block is one tile.
    dealt = (
        keyed.join(sizes, ["t", "key"])
        .withColumn("blocks", F.ceil(F.col("n") * 2 / tile).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("fp", "t"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.struct("t", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).alias("tile"), "fp")
        .select(F.xxhash64("tile").alias("dealt"), "tile", "fp")
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "dealt").sortWithinPartitions("tile").select("tile.t", "tile.key", "tile.lo", "tile.hi", "fp")

    def run(batches):
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            keys = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:4]])
            fp = batch.column(4).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            found = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                key = tuple(keys[:, lo]) if hi > lo else last
                if key != last and held:
                    found += forest(np.concatenate(held), radius)
                    held = []
                last = key
                held.append(fp[lo:hi])
            yield edges(found)
        yield edges(forest(np.concatenate(held), radius) if held else [])

    def edges(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1).view(np.int64) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes of (a, b) edges.

    Large-star and small-star rounds in turn until a round changes nothing; each round is a written table.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("m", F.least("a", "least")).select(F.col("a").alias("k"), "m")
        joined = both.join(least, both.a == least.k).select("a", "b", "m")
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(joined.select("a", F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    while True:
        new = written(star(star(now, True), False))
        summary = lambda e: e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        same = summary(now) == summary(new)
        dropped(now)
        now = new
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    prints = written(fingerprints(df, doc_id, text, words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), radius))  # tables of ids and fingerprints; the result reads them
    of = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Few components have many fingerprints: the smallest id of each is aggregated before it is joined back.
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
