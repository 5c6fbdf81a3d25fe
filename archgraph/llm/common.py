"""What the operators of this subpackage share: table access, shared-folder tables, and word arrays over Arrow text.

Word arrays: a text column of an Arrow batch is one byte buffer with offsets. The functions here find all words of
many documents in that buffer at once with numpy, without making a Python object for each word. Batches are cut
into chunks of about `CHUNK_BYTES` (a single longer document is its own chunk), so memory follows the longest
document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.sources.shared import dropped, removed, shared_folder, short_scans, written

__all__ = ["FAMILIES", "Powers", "Words", "appended", "dropped", "held_out", "labelled_sample", "least_by_hash", "mixed", "phrase", "removed", "shared_folder", "short_scans", "span_hashes", "table", "text_chunks", "written"]

#: Bytes of text that the numpy kernels take at once.
CHUNK_BYTES = 1 << 19
#: Bytes that are widened to 64 bits at once, in documents longer than a chunk.
SLICE_BYTES = 1 << 22
#: The words of every contract here are runs of bytes other than these six.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

HELD_OUT_MOD, HELD_OUT_REMAINDER = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32 of the decimal id leaves the held-out remainder; never trained on."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == HELD_OUT_REMAINDER


def text_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about CHUNK_BYTES; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


#: Two independent families of polynomial hashes: (byte base, word base).
FAMILIES = [(Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)), (Powers(0xA24BAED4963EE407), Powers(0xC2B2AE3D27D4EB4F))]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Hashes of disjoint spans in order. A hash depends on the bytes of its span alone, so spans are taken in slices of about SLICE_BYTES."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = data[base : int(ends[hi - 1])].astype(np.uint64)
        part += np.uint64(1)
        up, down = FAMILIES[family][0].upto(len(part) + 1)
        part *= up[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


class Words:
    """All words of a chunk: byte spans `starts`, `ends`; `doc`, the row of each; `first`, where each row's words begin."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, spaces: np.ndarray = SPACES):
        self.data = data
        word = ~spaces[data]
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, word
        cut = offs[offs < len(data)]
        inner_start = word.copy()
        inner_start &= ~before[:-1]
        inner_start[cut] = word[cut]
        after = np.empty(len(data) + 1, bool)
        after[-1], after[:-1] = False, word
        after[offs] = False
        inner_end = word & ~after[1:]
        self.starts = np.flatnonzero(inner_start)
        self.ends = np.flatnonzero(inner_end) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def hashes(self, family: int) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, family)

    def sums(self, family: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums from which `phrase` takes the hash of any run of words."""
        h = self.hashes(family)
        up, down = FAMILIES[family][1].upto(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        return total, down


def phrase(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, length) -> np.ndarray:
    """The hash of the words start .. start + length - 1."""
    total, down = sums
    return mixed((total[start + length] - total[start]) * down[start] + np.asarray(length, dtype=np.uint64))


def appended(df: DataFrame, text: str, fields: dict[str, str], start, sources: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `sources` (all, if not given) and those of `fields` (name: type), which a function makes from the text column.

    `start` is called once in each task and gives that function: Arrow column in, list of Arrow arrays out.
    A name in `fields` that the frame has already is an error, so nothing is overwritten silently.
    """
    sources = tuple(df.columns) if sources is None else sources
    if clash := set(sources) & set(fields):
        raise ValueError(f"output names that the input has: {sorted(clash)}")
    held = df.select(*[F.col(f"`{c}`") for c in sources], F.col(f"`{text}`").alias("__text__"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema[:-1]] + [f"`{n}` {t}" for n, t in fields.items()])

    def run(batches):
        of = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *of(batch.columns[-1])], names=[*sources, *fields])

    return held.mapInArrow(run, schema)


def least_by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most `rows` rows, those of least hash of the keys. Only about as many meet in the task that orders them: the rest lie above the share of the hash range that is wanted."""
    share = min(1.0, (1.2 * rows + 100) / max(1, df.count()))
    low = min((1 << 63) - 1, int((share - 0.5) * (1 << 64)))
    h = F.xxhash64(*keys)
    return df.filter(h <= F.lit(low)).orderBy(h, *keys).limit(rows)


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text and quality of at most `rows` labelled documents that are not held out, those of least hash; of rows that repeat an id the one of least text."""
    labelled = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = least_by_hash(labelled, rows, "doc_id")
    # The table of chosen ids has at most `rows` rows; each takes one text along, also where millions of rows have its id.
    taken = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return taken.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")
