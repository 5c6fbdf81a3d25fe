"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes cuts a text wherever its value meets the block size, so an edit moves only the cuts near
it. Each chunk becomes one character of a signature. Block sizes are 3 * 2^k; a fingerprint `size:signature:signature`
holds the signatures at its block size and at twice that, and two fingerprints are compared, by edit distance, at a
block size that both hold; with none in common the likeness is 0.

Cases: null and empty texts have the fingerprint `3::`; equal fingerprints, empty ones included, have likeness 1. Equal
texts have equal fingerprints. With repeated ids the order is by id, then text. A table of one document is its own next.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST_BLOCK, SIGNATURE = 7, 3, 64
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FIRST = -(1 << 63)


def cut_levels(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k): at each position the text is cut for all block sizes up to 3 * 2^k."""
    padded = np.zeros(len(data) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = data
    padded[WINDOW - 1 :] += np.uint32(1)
    h = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += padded[k : k + len(data)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    at = np.flatnonzero(h % np.uint32(3) == 0)
    low = h[at] & (~h[at] + np.uint32(1))
    return at, np.where(low == 0, 32, np.log2(np.maximum(low, 1))).astype(np.int64)


def signature(raw: bytes, cuts: np.ndarray) -> str:
    """One character for each chunk; the last of at most SIGNATURE takes what is left."""
    ends = [*(cuts[: SIGNATURE - 1] + 1).tolist(), len(raw)]
    out, start = bytearray(), 0
    for end in ends:
        if end > start:
            out.append(ALPHABET[zlib.crc32(raw[start:end]) & 63])
        start = end
    return out.decode()


def fingerprint(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return f"{LEAST_BLOCK}::"
    at, level = cut_levels(np.frombuffer(raw, np.uint8))
    k = 0
    while (LEAST_BLOCK << k) * SIGNATURE < len(raw):
        k += 1
    while k and np.count_nonzero(level >= k) < SIGNATURE // 2:
        k -= 1
    return f"{LEAST_BLOCK << k}:{signature(raw, at[level >= k])}:{signature(raw, at[level >= k + 1])}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from the edit distance of the signatures at a common block size; the better of two if both are common."""
    (size_a, one_a, two_a), (size_b, one_b, two_b) = ([F.split_part(x, F.lit(":"), F.lit(i)) for i in (1, 2, 3)] for x in (a, b))
    size_a, size_b = size_a.cast("bigint"), size_b.cast("bigint")

    def alike(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)

    # Signatures at the doubled size are of use only where they are long enough to tell texts apart.
    second = F.when((F.length(two_a) >= 16) & (F.length(two_b) >= 16), alike(two_a, two_b)).otherwise(0.0)
    return (
        F.when(a == b, 1.0)
        .when(size_a == size_b, F.greatest(alike(one_a, one_b), second))
        .when(size_a == 2 * size_b, alike(one_a, two_b))
        .when(size_b == 2 * size_a, alike(two_a, one_b))
        .otherwise(0.0)
    )


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the fingerprint of each row's text."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(fingerprint)

    return df.select(*keep, of(F.col(text)).alias("fingerprint"))


def by_neighbours(df: DataFrame, fn: Callable[[str, str], tuple], schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """fn(text, next text) for every row, the next one in ascending doc_id, after the last the first.

    Rows are dealt into ranges of ids; the least id of each range is found first, and its row is sent to the range before
    it as well. That moves every text once and no range needs another. The driver gets one id for each range.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(doc_id), F.lit(FIRST)).cast("bigint").alias("at"), F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("at")
    cuts = ids.select(F.col("at").cast("double").alias("q")).approxQuantile("q", [i / parts for i in range(1, parts)], 0.2 / parts)
    edges = np.array(sorted({int(x) for x in cuts if x > FIRST}), np.int64)

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(np.int64), "right").astype(np.int32))

    firsts = sorted((r[0], r[1]) for r in ids.groupBy(range_of("at").alias("r")).agg(F.min("at")).collect())
    first_of = {r: at for r, at in firsts}
    before = {firsts[k][0]: firsts[k - 1][0] for k in range(len(firsts))}  # before the first range comes the last

    @F.pandas_udf("array<int>")
    def targets(at: pd.Series) -> pd.Series:
        """2 * range for a row's own range; 2 * range + 1 for the range before, where the row is only looked at."""
        values = at.to_numpy(np.int64)
        own = np.searchsorted(edges, values, "right").tolist()
        return pd.Series([[2 * r, 2 * before[r] + 1] if first_of[r] == v else [2 * r] for r, v in zip(own, values.tolist())])

    dealt = (
        rows.select("at", "doc_id", "text", F.explode(targets("at")).alias("to"))
        .withColumn("part", F.shiftright("to", 1))
        .repartition(parts, "part")
        .sortWithinPartitions("part", "to", "at", "text")
        .select("part", (F.col("to") % 2).alias("ahead"), "doc_id", "text")
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        part = held = None
        for batch in batches:
            out = []
            for p, ahead, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, held = p, None
                if held is not None:
                    out.append((held[0], *fn(held[1], t)))
                held = None if ahead else (i, t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return dealt.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbour_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one, and their likeness."""
    last: dict[str, str] = {}

    def of(text_: str, following: str) -> tuple:
        own = last.get(text_) or fingerprint(text_)
        last.clear()
        last[following] = fingerprint(following)
        changed = edited(text_, following)
        return len(text_), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, fingerprint(changed), last[following]

    found = by_neighbours(df, of, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string", doc_id, text)
    own = F.col("fingerprint")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(own, F.col("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"))
