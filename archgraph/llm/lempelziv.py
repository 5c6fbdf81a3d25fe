"""Substring de-duplication by a relative Lempel-Ziv parse of documents against all earlier ones.

The reference of a document is every document with a smaller id. It is indexed in blocks: the words around an anchor, where an
anchor is the eight-word phrase of least hash among those of a window. Equal windows have equal anchors, so whatever a
document shares with the reference lies in blocks under the same anchor, and one block in about 22 words is indexed.

Each document is factored greedily from left to right: a factor (begin, length, source document, place there) is the longest
run of words that one block after the other of an earlier document continues, at least WINDOW words. Blocks that agree as a
whole are one row, owned by the smallest id, so a match with them is found at once; only blocks that share an anchor but differ
are opened, and there the match ends where the words do. At the boundary of two factors every window that straddles them is looked
up on its own: found, it begins the next factor, which then overlaps the one before; not found, the two stay apart. Words under
factors are duplicate spans and go.

Hashes: blocks and windows are compared by 128 bits.

Cases: null, empty and blank texts have no words and lose none; documents of fewer than WINDOW words lose none. Rows are told
apart by id and text: a row is judged by its own text, rows that repeat both get equal results, and none of the rows of one id
is earlier than another. A row without an id owns nothing and loses nothing. Empty tables give no rows. Other columns are only
passed through if `keep` names them; one that has a result's name is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import Words, dropped, phrase, text_chunks, written

WINDOW, GRAM = 50, 8
POSITION_BITS = 28


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values: suffix minima of one block, prefix minima of the next."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks_of(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(doc row, first window, number of windows, anchor, block hash) of every run of windows with one anchor."""
    n = len(words.starts)
    if n < window:
        return None
    one, two = words.sums(0), words.sums(1)
    grams = phrase(one, np.arange(n - gram + 1), gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    at = (least & low).astype(np.int64)
    valid = words.doc[: n - window + 1] == words.doc[window - 1 :]
    changed = np.ones(len(at), bool)
    changed[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(changed)
    count = np.diff(np.append(start, len(at)))
    keep = valid[start]
    start, count = start[keep], count[keep]
    doc = words.doc[start]
    return doc, start - words.first[doc], count, grams[at[start]], phrase(two, start, count + window - 1)


def block_runs(df: DataFrame, window: int, gram: int) -> DataFrame:
    """All blocks of all documents (columns doc_id, key, text)."""

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, data, offs in text_chunks(batch.column(2)):
                found = blocks_of(Words(data, offs), window, gram)
                if found is None:
                    continue
                doc, first, count, anchor, block = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array(ids[lo:hi][doc].astype(np.int64)), pa.array(keys[lo:hi][doc]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16))],
                    names=["anchor", "block", "doc_id", "key", "first", "windows"],
                )

    return df.mapInArrow(run, "anchor bigint, block bigint, doc_id bigint, key bigint, first int, windows smallint")


def opened(texts: DataFrame, window: int) -> DataFrame:
    """The windows of chosen blocks: rows of `texts` (doc_id, text, blocks) carry `blocks`, an array of (anchor, block, first, windows)."""
    schema = "anchor bigint, block bigint, first int, at smallint, w1 bigint, w2 bigint, owner bigint"

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(2)
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                words = Words(data, offs)
                one, two = words.sums(0), words.sums(1)
                part = lists.slice(lo, hi - lo)
                flat, sizes = part.flatten(), np.diff(part.offsets.to_numpy())
                anchor, block, first, count = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                row = np.repeat(np.arange(hi - lo), sizes)
                start = words.first[row] + first
                many = np.repeat(np.arange(len(start)), count)
                at = np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)
                where = start[many] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[many]), pa.array(block[many]), pa.array(first[many].astype(np.int32)), pa.array(at.astype(np.int16)), pa.array(phrase(one, where, window).view(np.int64)), pa.array(phrase(two, where, window).view(np.int64)), pa.array(ids[lo:hi][row][many])],
                    names=["anchor", "block", "first", "at", "w1", "w2", "owner"],
                )

    return texts.mapInArrow(run, schema)


def factored(n_words: int, hits: list[dict], window: int) -> np.ndarray:
    """Factors (begin, length, source, source begin) of a text, left to right.

    A hit is a stretch of the text's windows (first, windows, mask; -1 for all) found in the document `source`, window k at place `shift` + k there.
    """
    found, source, place = np.zeros(n_words + 1, bool), np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
    for h in hits:
        first, mask = h["first"], h["mask"]
        at = np.arange(h["windows"])
        if mask != -1:
            at = at[(mask >> at) & 1 == 1]
        found[first + at], source[first + at], place[first + at] = True, h["source"], h["shift"] + at
    at = np.flatnonzero(found)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    # The next window continues the factor if it is the next one both here and in the source.
    ends = np.append((np.diff(at) != 1) | (np.diff(source[at]) != 0) | (np.diff(place[at]) != 1), True)
    begins = np.concatenate([[True], ends[:-1]])
    lo, hi = at[begins], at[ends]
    return np.stack([lo, hi - lo + window, source[lo], place[lo]], axis=1)


def spans_of(factors: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans (begin, end) of the words under factors."""
    spans: list[tuple[int, int]] = []
    for lo, size in factors[:, :2].tolist():
        if spans and lo < spans[-1][1]:
            spans[-1] = (spans[-1][0], lo + size)
        else:
            spans.append((lo, lo + size))
    return spans


FACTOR = "struct<begin: int, length: int, source: bigint, source_begin: int>"


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False, keep: tuple[str, ...] = (), intact: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans array<struct<begin, end>> and factors (all in words), and the kept text (or, with `digest`, its SHA-256).

    `keep` names further columns that pass through; with `intact` a text that loses nothing stays as it is, white space included.
    """
    if not gram <= window <= 64 + gram - 2:
        raise ValueError("a block must have at most 63 windows")
    if clash := {"doc_id", "key", "n_words", "n_removed", "spans", "factors", "text", "hits", "kept_sha256"} & set(keep):
        raise ValueError(f"names of results among the kept columns: {sorted(clash)}")
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`") for c in keep])
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "key", F.coalesce("text", F.lit("")).alias("text"))
    runs = written(block_runs(known, window, gram))
    # One row for each different block: its smallest owner, and a place there to read it from.
    blocks = runs.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "key", "first", "windows")).alias("own"), F.max("doc_id").alias("last"))
    blocks = written(blocks.select("anchor", "block", F.col("own.doc_id").alias("owner"), F.col("own.key").alias("key"), F.col("own.first").alias("first"), F.col("own.windows").alias("windows"), "last"))
    differing = blocks.groupBy("anchor").agg(F.count("*").alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high")).filter("n > 1 AND low < high").select("anchor")
    places = blocks.join(differing, "anchor").groupBy(F.col("owner").alias("doc_id"), "key").agg(F.collect_list(F.struct("anchor", "block", "first", "windows")).alias("blocks"))
    windows = written(opened(known.join(places, ["doc_id", "key"]).select("doc_id", "text", "blocks"), window))
    owners = windows.groupBy("w1", "w2").agg(F.min(F.struct("owner", (F.col("first") + F.col("at")).alias("place"))).alias("least"), F.max("owner").alias("most")).filter("least.owner < most").select("w1", "w2", "least")
    # Windows of a block that one stretch of an earlier document holds are one row.
    earlier = windows.join(owners, ["w1", "w2"]).filter("least.owner < owner").groupBy("anchor", "block", F.col("least.owner").alias("source"), (F.col("least.place") - F.col("at")).alias("shift")).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    earlier = earlier.groupBy("anchor", "block").agg(F.collect_list(F.struct("source", "shift", "mask")).alias("found"))
    # Written, so that both sides of the join below come from plain shuffles and large blocks of copies can be split.
    verdicts = written(blocks.join(earlier, ["anchor", "block"], "left").filter("found IS NOT NULL OR last > owner").select("anchor", "block", "owner", F.col("first").alias("shift"), "found"))
    dropped(windows)
    dropped(blocks)
    whole = F.array(F.struct(F.col("owner").alias("source"), "shift", F.lit(-1).cast("bigint").alias("mask")))
    hits = (
        runs.join(verdicts, ["anchor", "block"])
        .select("doc_id", "key", "first", F.col("windows").cast("int").alias("windows"), F.explode(F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(F.col("found"))).alias("of"))
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("first", "windows", "of.source", "of.shift", "of.mask")).alias("hits"))
    )
    hits = written(hits)
    dropped(runs)
    dropped(verdicts)
    kept = "kept_sha256" if digest else "text"
    passed = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("begin", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_begin", pa.int32())])), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for t, found in zip(batch.column(1), batch.column(2)):
                source = t.as_py()
                words = (source or "").encode("utf-8", "surrogatepass").split()
                factors = factored(len(words), found.as_py() or [], window)
                spans, left, at = spans_of(factors), [], 0
                for lo, hi in spans:
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                out = b" ".join(left)
                result = hashlib.sha256(out).hexdigest() if digest else source if intact and not spans else out.decode("utf-8", "surrogatepass")
                rows.append((len(words), len(words) - len(left), [{"begin": a, "end": b} for a, b in spans], [dict(zip(("begin", "length", "source", "source_begin"), f)) for f in factors.tolist()], result))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], names=["doc_id", "n_words", "n_removed", "spans", "factors", kept, *keep])

    schema = ", ".join([f"doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<begin: int, end: int>>, factors array<{FACTOR}>", f"{kept} string", *passed])
    return docs.join(hits, ["doc_id", "key"], "left").select("doc_id", "text", "hits", *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
