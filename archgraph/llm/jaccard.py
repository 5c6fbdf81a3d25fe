"""Groups of near copies for the pipeline: SimHash links first, then every other pair of similarity LEAST or more.

A document is the set of XXH64 hashes of its five-word shingles. Fingerprints of those are linked by covering LSH as in `covering`;
that finds texts a few bits apart, which is not yet a similarity of 0.8. So the links are completed, with no pair lost:

1. Near: besides SimHash links, documents that share the least value of one of BANDS hash functions are paired with one of
   them, the one that holds most shingles known from elsewhere. This takes as many pairs as documents. Pairs whose whole sets are similar
   enough make parts; a large group of copies becomes one part.
2. Far: two sets of similarity t or more share one of the first n - ceil(2t / (1 + t) n) + 1 shingles of the smaller and one of
   the first n - ceil(t n) + 1 of the larger, in any order that both follow (prefix filter). An equality join on those
   gives the candidates of different parts. Sets that differ by d hashes have bitmaps of parities that differ in at most d bits, so
   most pairs are ruled out by their bitmaps, under shingles that many documents hold before they are made. The others are held
   against their whole sets.

The order puts shingles that a sample of documents holds often last; it decides how many candidates there are, not which pairs
are found. A frequent shingle is compared in tiles dealt to different tasks; documents of its largest part are not compared with each other.

Cases: texts without a word (null, empty, blank) are equal to each other; fewer words than a shingle make one shingle of all;
rows are told apart by a row number, so ids may repeat or be null; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import dropped, mixed, text_chunks, written
from archgraph.llm.covering import RADIUS, components, links, majority, shingle_hashes

WORDS = 5
#: The least similarity as a fraction of whole numbers.
LEAST = (4, 5)
#: Documents that the order of shingles is taken from, and shingles that it puts last.
SAMPLE, LATE = 20_000, 200_000
BANDS, BITS = 4, 1024
#: A shingle of more than FREQUENT documents goes with bitmaps; one in EVERY documents tells which those are. Documents of a tile.
FREQUENT, EVERY, TILE = 100, 64, 2048
#: Documents whose sets are made at once.
SLICE = 256


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of a text in ascending order."""
    return np.unique(shingle_hashes(raw, words))


def each_text(column):
    for _, _, data, offs in text_chunks(column):
        raw = data.tobytes()
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            yield raw[a:b]


def frequent(docs: DataFrame, n: int, words: int) -> np.ndarray:
    """Shingles that several documents of a sample hold, most frequent first. docs: (row, text), n of them."""

    def run(batches):
        for batch in batches:
            for raw in each_text(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(raw, words).view(np.int64))], names=["shingle"])

    sample = docs.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // SAMPLE)))) == 0).select("text").mapInArrow(run, "shingle bigint")
    often = sample.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "shingle").limit(LATE)
    return np.array([r["shingle"] for r in often.collect()], np.int64).view(np.uint64)


def parities(s: np.ndarray) -> np.ndarray:
    """A bitmap of BITS bits: each hash turns one over."""
    return np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


SKETCH = "row bigint, n int, fp bigint, heard int, least array<bigint>, first array<bigint>, bits array<bigint>, packed binary"


def sketches(docs: DataFrame, late: np.ndarray, words: int = WORDS, share: tuple[int, int] = LEAST) -> DataFrame:
    """For each document (row, text): the size of its set, its fingerprint, its shingles among `late` by the thousand, least values, first shingles in order, bitmap (as numbers and as bytes)."""
    t, u = share
    order = np.argsort(late)
    known = late[order]
    seeds = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def of(raw: bytes) -> tuple:
        h = shingle_hashes(raw, words)
        s = np.unique(h)
        fp = int(np.uint64(majority(h)).view(np.int64)) if len(h) else 0
        if not len(s):
            return 0, fp, 0, [], [], [], b""
        last = np.zeros(len(s), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            last = np.where(known[at] == s, len(known) - order[at], 0)
        first = s[np.argsort(last, kind="stable")][: len(s) + (-t * len(s)) // u + 1]
        least = [int(mixed(s ^ x).min().view(np.int64)) for x in seeds]
        bits = parities(s)
        return len(s), fp, int(1000 * (last > 0).sum() // len(s)), least, first.view(np.int64), bits, bits.tobytes()

    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                made = list(zip(*map(of, each_text(batch.column(1))))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(made, kinds))], names=[c.split()[0] for c in SKETCH.split(", ")])

    return docs.select("row", "text").mapInArrow(run, SKETCH)


def stars(sketched: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): SimHash links, and each document with one of those that share a least value with it."""
    prints = sketched.filter("n > 0").groupBy("fp").agg(F.min("row").alias("one"))
    equal = sketched.filter("n > 0").join(prints, "fp").select(F.col("row").alias("x"), F.col("one").alias("y"))
    ends = prints.select(F.col("fp").alias("a"), F.col("one").alias("x")), prints.select(F.col("fp").alias("b"), F.col("one").alias("y"))
    linked = links(prints.select("fp"), radius).join(ends[0], "a").join(ends[1], "b").select("x", "y")
    keyed = sketched.select("row", "heard", F.posexplode("least").alias("band", "key"))
    hubs = keyed.groupBy("band", "key").agg(F.max(F.struct("heard", F.xxhash64("row").alias("h"), "row")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(hubs, ["band", "key"]).select(F.col("row").alias("x"), F.col("hub.row").alias("y"))
    return equal.union(linked).union(shared).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def paired(rows: np.ndarray, n: np.ndarray, pos: np.ndarray, part: np.ndarray, bits: np.ndarray | None, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within one shingle that may be similar enough and whose parts differ."""
    t, u = share
    order = np.lexsort((rows, n))
    rows, n, pos, part = rows[order], n[order], pos[order], part[order]
    bits = None if bits is None else bits[order]
    found = []
    for i in range(len(rows) - 1):
        end = int(np.searchsorted(n, n[i] * u // t, "right"))
        if end <= i + 1 or pos[i] > n[i] - (2 * t * n[i] + t + u - 1) // (t + u):
            continue
        m, p = n[i + 1 : end], pos[i + 1 : end]
        fits = np.flatnonzero((t * m <= u * n[i]) & (part[i + 1 : end] != part[i]) & (np.minimum(n[i] - pos[i], m - p) * (t + u) >= t * (n[i] + m)))
        if bits is not None and len(fits):
            both = n[i] + m[fits]
            fits = fits[np.bitwise_count(bits[i + 1 + fits] ^ bits[i]).sum(axis=1) <= both + 2 * (-t * both // (t + u))]
        if len(fits):
            found.append((np.full(len(fits), rows[i]), rows[i + 1 + fits]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.minimum(a, b), np.maximum(a, b)


def candidates(sketched: DataFrame, parts: DataFrame, share: tuple[int, int] = LEAST, tile: int = TILE, every: int = EVERY, frequent: int = FREQUENT) -> DataFrame:
    """(a, b): pairs of rows, a < b, of different parts that share a first shingle. parts: (row, part); a row without one is its own."""
    held = sketched.join(parts, "row", "left").withColumn("part", F.coalesce("part", "row"))
    entries = held.select("row", "part", "n", F.posexplode("first").alias("pos", "shingle"))
    # Of a frequent shingle: about how many documents hold it, and how many of them are of its largest part.
    sampled = entries.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).groupBy("shingle", "part").agg((F.count("*") * every).alias("k"))
    many = sampled.groupBy("shingle").agg(F.sum("k").alias("about"), F.max_by("part", "k").alias("main"), F.max("k").alias("of_main")).filter(F.col("about") > frequent)
    blocks = lambda k: F.greatest(F.lit(1), F.ceil(k * 2 / tile)).cast("int")
    many = written(many.select("shingle", "main", blocks(F.col("of_main")).alias("mains"), blocks(F.col("about") - F.col("of_main")).alias("rests")))
    few = entries.join(many.select("shingle"), "shingle", "left_anti").select(F.col("shingle").alias("tile"), "row", "part", "n", "pos", F.lit(None).cast("binary").alias("bits"))
    # A tile is two blocks of the documents outside the largest part, or one of those and one of its documents.
    own = (F.col("part") == F.col("main")).alias("own")
    hot = entries.join(many, "shingle").join(sketched.select("row", F.col("packed").alias("bits")), "row").select("*", own, F.pmod(F.xxhash64("row"), F.when(own, F.col("mains")).otherwise(F.col("rests"))).cast("int").alias("block"))
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    with_rests = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: cell(0, F.col("block"), r))
    among = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: cell(1, F.least(F.col("block"), r), F.greatest(F.col("block"), r)))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: cell(0, m, F.col("block")))
    hot = hot.withColumn("cell", F.explode(F.when(F.col("own"), with_rests).otherwise(F.concat(among, with_mains))))
    hot = hot.select(F.xxhash64("shingle", "cell").alias("tile"), "row", "part", "n", "pos", "bits")
    ordered = few.unionByName(hot).repartition(int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile")

    def run(batches):
        left = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            tiles = now.column("tile").to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(tiles[1:] != tiles[:-1]) + 1])
            # The last tile may go on in the next batch.
            left = now.slice(int(bounds[-1]))
            yield pairs(now, bounds)
        if left is not None:
            yield pairs(left, np.array([0, left.num_rows]))

    def pairs(now: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        columns = [now.column(c).to_numpy().astype(np.int64) for c in ("row", "n", "pos", "part")]
        bits = now.column("bits").combine_chunks()
        found = []
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            lo, hi = bounds[k], bounds[k + 1]
            some = bits.slice(lo, hi - lo)
            words = None if some.null_count else np.frombuffer(b"".join(some.to_pylist()), np.uint64).reshape(len(some), -1)
            found.append(paired(*(c[lo:hi] for c in columns), words, share))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def plausible(pairs: DataFrame, sketched: DataFrame, share: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs that their bitmaps do not rule out. Texts of the others need not move."""
    t, u = share
    side = lambda k: sketched.select(F.col("row").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("a_n") + F.col("b_n")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(differ <= both - 2 * F.ceil(t * both / (t + u))).select("a", "b")


def similar(docs: DataFrame, pairs: DataFrame, words: int = WORDS, share: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs (a, b) of rows whose whole sets are similar enough, as a written table. docs: (row, text). Only texts of such rows move."""
    t, u = share
    rows = written(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct())
    needed = written(docs.join(rows, "row", "left_semi"))
    side = lambda k: needed.select(F.col("row").alias(k), F.col("text").alias(f"{k}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        of = lru_cache(maxsize=64)(lambda raw: shingles(raw, words))
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                fits = []
                for a, b in zip(each_text(batch.column(2)), each_text(batch.column(3))):
                    x, y = of(a), of(b)
                    fits.append(len(np.intersect1d(x, y, assume_unique=True)) * (t + u) >= t * (len(x) + len(y)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    found = written(both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint"))
    for table in (rows, needed):
        dropped(table)
    return found


def groups(df: DataFrame, row: str, text: str = "text", words: int = WORDS, share: tuple[int, int] = LEAST) -> DataFrame:
    """(row, component): rows that chains of similar pairs connect have one component. `row` numbers the rows of a written table."""
    some = F.when(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.col(f"`{text}`")).otherwise("")
    docs = df.select(F.col(f"`{row}`").alias("row"), some.alias("text"))
    # Equal texts become one first; only digests move.
    digests = docs.select("row", F.unhex(F.md5("text")).alias("digest"))
    # Written, so that a large group of copies is a plain shuffle that can be split.
    firsts = written(digests.groupBy("digest").agg(F.min("row").alias("first")))
    owners = written(digests.join(firsts, "digest").select("row", "first"))
    late = frequent(docs, owners.count(), words)
    whole = written(sketches(docs, late, words, share))
    sketched = written(whole.join(owners.filter("row = first").select("row"), "row", "left_semi"))
    dropped(whole)
    starred = written(plausible(stars(sketched), sketched, share))
    near = similar(docs, starred, words, share)
    dropped(starred)
    linked = components(near)
    parts = linked.select(F.col("node").alias("row"), F.col("root").alias("part"))
    crossing = written(plausible(candidates(sketched, parts, share), sketched, share))
    far = similar(docs, crossing, words, share)
    for table in (crossing, sketched):
        dropped(table)
    found = components(near.unionByName(far))
    for table in (near, far):
        dropped(table)
    return owners.join(found, owners["first"] == found.node, "left").select("row", F.coalesce("root", "first").alias("component"))
