"""Phrase collocations: frequent phrases of two to four words for each language, scored by their weakest cut.

Shards and automata. A task gathers the words of its documents into shards of about SHARD_WORDS words. The substrings of a shard are the
strings of a generalised suffix automaton of bounded depth, kept as its tree of suffix links: a node of depth d is a phrase of d words,
its link the phrase without the first word, its endpos the places where it ends. Nodes are made depth by depth, by splitting
the endpos set of a node by the word further left; a set's size is the phrase's count in the shard. Nodes of equal endpos sets (a
chain of only children) are one state of the automaton.

Counts are summed over shards by phrase; no key gets more than one row from a shard. Rare phrases are not shuffled as strings where that is
certain: a phrase that is found LEAST times has parts that are. So three rounds sum short keys of words, of pairs of frequent words and of
triples of frequent pairs, about four bytes each, and leave a bitmap of 2^FILTER_BITS bits each of the frequent ones; the fourth sums
the phrases whose words, pairs and triples are in them. A bitmap has that size whatever the corpus (8 MB); what it lets through by chance is counted like the rest and falls at the end, so results
do not depend on it, nor on keys that collide.

Subsumption follows the links: a phrase inside any longer candidate of at least SUBSUMED_PERCENT percent of its count is also inside one that is
one word longer and at least as frequent, since phrases between the two are candidates too. So each candidate reports its count to
its suffix link and to the link of the reversed text (the phrase without the last word).

Cases: null and empty texts have no words; a null language is `und`; rows that repeat a document count again; equal scores and counts
are ordered by the phrase's bytes; a very long document is a shard of its own; an empty table gives no rows; a language without
a candidate gives none; null ids and other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.llm.common import SPACES, Words, mixed, text_chunks, written

LONGEST, LEAST, SUBSUMED_PERCENT, SCALE, TOP = 4, 30, 80, 2_000_000, 2_000
SHARD_WORDS, FILTER_BITS = 1 << 20, 26
#: Keys are shuffled with their leading KEY_BITS bits, in rows of one value of the leading SLOT_BITS; MERGE_ROWS of them are taken in before they are summed.
KEY_BITS, SLOT_BITS, MERGE_ROWS = 40, 12, 1 << 21
PAGE_BITS = 1 << 15
STEP = np.uint64(0x9E3779B97F4A7C15)

BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32

COUNTS = "lang string, phrase string, size int, f bigint"


class Shard:
    """Words of some documents in order: number of the distinct word, how many words of its piece stand before it; and the distinct words."""

    def __init__(self, named: np.ndarray | None = None) -> None:
        self.named = named
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.langs: dict[str, int] = {}
        self.salts: list[int] = []
        self.words = 0

    def add(self, text: pa.Array, langs: list[str | None]) -> Iterator[None]:
        """Takes the texts in, and stops after each chunk."""
        for lo, hi, data, offs in text_chunks(text):
            data = FOLDED[data]
            found = Words(data, offs, SPACES | BREAKS)
            lang = np.array([self.number(k if k is not None else "und") for k in langs[lo:hi]], np.int64)[found.doc]
            keys, at, number = np.unique(mixed(found.hashes(0) ^ np.array(self.salts, np.uint64)[lang]), return_index=True, return_inverse=True)
            told = present(self.named, keys).tolist() if self.named is not None else [False] * len(keys)
            raw = data.tobytes()
            names = pa.array([raw[a:b] if k else b"" for a, b, k in zip(found.starts[at].tolist(), found.ends[at].tolist(), told)], pa.binary()).cast(pa.string())
            self.parts.append((number, places(data, found), keys, lang[at], names))
            self.words += len(number)
            yield

    def number(self, lang: str) -> int:
        if lang not in self.langs:
            self.langs[lang] = len(self.langs)
            self.salts.append(xxhash.xxh64_intdigest(lang))
        return self.langs[lang]

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(word of each position, place in its piece, key of each distinct word, its language, its string)."""
        keys, at, number = np.unique(np.concatenate([p[2] for p in self.parts]), return_index=True, return_inverse=True)
        first = np.cumsum([0, *[len(p[2]) for p in self.parts]])
        word = np.concatenate([number[a + p[0]] for a, p in zip(first, self.parts)])
        return word, np.concatenate([p[1] for p in self.parts]), keys, np.concatenate([p[3] for p in self.parts])[at], pa.concat_arrays([p[4] for p in self.parts]).take(pa.array(at))


def places(data: np.ndarray, words: Words) -> np.ndarray:
    """For each word, how many words of its piece stand before it."""
    broken = np.zeros(len(data) + 1, np.int64)
    np.cumsum(BREAKS[data], out=broken[1:])
    starts = np.ones(len(words.starts), bool)
    starts[1:] = (words.doc[1:] != words.doc[:-1]) | (broken[words.starts[1:]] > broken[words.ends[:-1]])
    here = np.arange(len(starts))
    return here - np.maximum.accumulate(np.where(starts, here, 0)) if len(starts) else here


class Automaton:
    """The tree of suffix links of a shard, down to a depth: `node`, for each position, the node of depth `depth` that ends there, or -1."""

    def __init__(self, word: np.ndarray, place: np.ndarray, keys: np.ndarray):
        self.word, self.place, self.keys = word, place, keys
        self.depth, self.node, self.key, self.good = 1, word, keys[word], np.ones(len(word), bool)
        self.first, self.count = np.unique(word, return_index=True, return_counts=True)[1:]

    def restrict(self, among: np.ndarray) -> None:
        """Only positions whose phrase of this depth is in the bitmap count as good from now on."""
        self.good &= present(among, self.key)

    def deepen(self) -> None:
        """One depth more, at positions where both phrases of the depth before, with and without the last word, are good."""
        d = self.depth
        good = np.zeros(len(self.good), bool)
        good[d:] = self.good[d:] & (self.place[d:] >= d)
        good[1:] &= self.good[:-1]
        at = np.flatnonzero(good)
        left = self.word[at - d]
        edge, first, of, self.count = np.unique(self.node[at] * len(self.keys) + left, return_index=True, return_inverse=True, return_counts=True)
        node, key = np.full(len(good), -1), np.zeros(len(good), np.uint64)
        node[at], key[at] = of, mixed(self.key[at] * STEP + self.keys[left])
        self.depth, self.node, self.key, self.good, self.first = d + 1, node, key, good, at[first]

    def phrases(self, names: pa.Array, of: np.ndarray) -> pa.Array:
        """The phrases of some nodes."""
        parts = [names.take(pa.array(self.word[self.first[of] - k])) for k in range(self.depth - 1, -1, -1)]
        return parts[0] if self.depth == 1 else pc.binary_join_element_wise(*parts, " ")


def present(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of a key are set; true for all keys that the bitmap was made of."""
    out = np.ones(len(keys), bool)
    for at in probes(keys >> np.uint64(64 - KEY_BITS)):
        out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def probes(short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a shortened key."""
    mask, h = np.uint64((1 << FILTER_BITS) - 1), mixed(short)
    return h & mask, h >> np.uint64(32) & mask


def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Shortened keys with their counts, as one row for each slot (the leading bits): steps between the other bits as bytes of seven bits, and counts beyond 1, up to LEAST."""
    short, at = np.unique(keys >> np.uint64(64 - KEY_BITS), return_inverse=True)
    many = np.minimum(np.bincount(at, counts, len(short)), LEAST).astype(np.uint8)
    rest_bits = np.uint64(KEY_BITS - SLOT_BITS)
    slot, rest = (short >> rest_bits).astype(np.int64), short & ((np.uint64(1) << rest_bits) - np.uint64(1))
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(short) else np.zeros(0, np.int64)
    step = np.diff(rest, prepend=np.uint64(0))
    step[starts] = rest[starts]
    value = step << np.uint64(1) | (many > 1)
    size = np.maximum(1, -(-np.frexp(value.astype(np.float64))[1] // 7))
    ends = np.cumsum(size)
    of, place = np.repeat(np.arange(len(value)), size), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    raw = ((value[of] >> (7 * place).astype(np.uint64)) & np.uint64(127)).astype(np.uint8) | ((place < size[of] - 1).astype(np.uint8) << 7)
    told = np.concatenate([[0], np.cumsum(many > 1)])
    last = np.append(starts[1:], len(short))
    cut = np.concatenate([[0], ends])
    extra, raw, counts = many[many > 1].tobytes(), raw.tobytes(), (told[starts], told[last])
    blobs = [raw[a:b] + extra[c:d] for a, b, c, d in zip(cut[starts].tolist(), cut[last].tolist(), counts[0].tolist(), counts[1].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(slot[starts].astype(np.int32)), pa.array((last - starts).astype(np.int32)), pa.array(blobs, pa.binary())], names=["slot", "n", "held"])


def unpacked(slot: int, n: int, held: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(shortened keys, counts) of a row of `packed`."""
    raw = np.frombuffer(held, np.uint8)
    ends = np.flatnonzero(raw < 128)[:n] + 1
    # Counts are below 128 too, so the n first ends are those of the steps.
    starts = np.concatenate([[0], ends[:-1]])
    body = raw[: ends[-1]]
    place = np.arange(len(body)) - np.repeat(starts, ends - starts)
    value = np.add.reduceat((body & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)
    counts = np.ones(n, np.int64)
    counts[(value & np.uint64(1)) == 1] = raw[ends[-1] :]
    return (np.uint64(slot) << np.uint64(KEY_BITS - SLOT_BITS)) + np.cumsum(value >> np.uint64(1)), counts


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.minimum(np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)), LEAST).astype(np.int64)


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that rows of `packed` count LEAST times or more in all. Holds the different keys of a partition, 16 bytes each."""
    parts, waiting = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            parts.append(unpacked(*row))
            waiting += row[1]
            if waiting > MERGE_ROWS:
                parts, waiting = [summed(parts)], 0
    if parts:
        keys, counts = summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= LEAST].view(np.int64))], names=["key"])


def keys_of(shard: Shard, depth: int, words: np.ndarray | None = None, pairs: np.ndarray | None = None) -> pa.RecordBatch:
    """Keys and counts of the phrases of `depth` words in a shard, as `packed`; of two words those whose words are in the bitmap, of three those whose pairs are."""
    tree = Automaton(*shard.joined()[:3])
    while tree.depth < depth:
        if tree.depth == 1 or pairs is not None:
            tree.restrict(words if tree.depth == 1 else pairs)
        tree.deepen()
    return packed(tree.key[tree.first], tree.count)


def phrases_of(shard: Shard, *frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a shard whose words, pairs and triples are in the bitmaps; under size 0 the number of all words of each language."""
    word, place, keys, lang, names = shard.joined()
    tree, langs = Automaton(word, place, keys), pa.array(list(shard.langs), pa.string())
    yield batch(langs, pa.nulls(len(langs), pa.string()), 0, np.bincount(lang[word], minlength=len(langs)))
    while True:
        if tree.depth <= len(frequent):
            tree.restrict(frequent[tree.depth - 1])
        of = np.flatnonzero(tree.good[tree.first])
        yield batch(langs.take(pa.array(lang[tree.word[tree.first[of]]])), tree.phrases(names, of), tree.depth, tree.count[of])
        if tree.depth == LONGEST:
            return
        tree.deepen()


def batch(lang: pa.Array, phrase: pa.Array, size: int, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(count), size, np.int32)), pa.array(count.astype(np.int64))], names=["lang", "phrase", "size", "f"])


def by_shards(documents: DataFrame, schema: str, of, named: np.ndarray | None = None) -> DataFrame:
    """What `of` yields for each shard of the documents; strings of words are there where the bitmap `named` has the word."""
    held = documents.sparkSession.sparkContext.broadcast(named)

    def run(batches):
        shard = Shard(held.value)
        for b in batches:
            for _ in shard.add(b.column(1), b.column(0).to_pylist()):
                if shard.words >= SHARD_WORDS:
                    yield from of(shard)
                    shard.clear()
        if shard.parts:
            yield from of(shard)

    return documents.select("lang", "text").mapInArrow(run, schema)


def bitmap_of(documents: DataFrame, of) -> np.ndarray:
    """The bits of all keys that are found LEAST times or more, as bytes: the same size for any number of keys, at most 2^FILTER_BITS / PAGE_BITS rows."""
    rows = by_shards(documents, "slot int, n int, held binary", lambda shard: [of(shard)])
    # By a stated number of partitions: they are not merged afterwards, since one holds its different keys at once.
    keys = rows.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slot").mapInArrow(frequent, "key bigint")

    def run(batches):
        for b in batches:
            at = np.concatenate(probes(b.column(0).to_numpy().view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["bit"])

    pages = keys.mapInArrow(run, "bit bigint").groupBy(F.expr(f"bit div {PAGE_BITS}").alias("page")).agg(F.bitmap_construct_agg(F.expr(f"bit % {PAGE_BITS}")).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for page, held in pages.collect():
        out[page * PAGE_BITS // 8 :][: len(held)] = np.frombuffer(held, np.uint8)
    return out


def counted(documents: DataFrame) -> DataFrame:
    """lang, phrase, size and f of all phrases that are found LEAST times or more; size 0 holds all words of a language."""
    shared = documents.sparkSession.sparkContext.broadcast
    words = shared(bitmap_of(documents, lambda shard: keys_of(shard, 1)))
    pairs = shared(bitmap_of(documents, lambda shard: keys_of(shard, 2, words.value)))
    triples = shared(bitmap_of(documents, lambda shard: keys_of(shard, 3, words.value, pairs.value)))
    found = by_shards(documents, COUNTS, lambda shard: phrases_of(shard, words.value, pairs.value, triples.value), words.value)
    return written(found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter((F.col("f") >= LEAST) | (F.col("size") == 0)), "phrases")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of every candidate, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = (
        found.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    )
    part = found.filter("size >= 1")
    heads = part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    return (
        cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )


def unsubsumed(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates without a longer one around them of nearly their count."""
    longer = found.filter("size >= 3").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    links = longer.select("lang", F.explode(F.array(*[F.array_join(F.slice("w", at, F.col("size") - 1), " ") for at in (1, 2)])).alias("phrase"), "f")
    around = links.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    near = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(longer AS DECIMAL(19, 0)) >= CAST({SUBSUMED_PERCENT} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))")
    return candidates.join(around, ["lang", "phrase"], "left").filter(~F.coalesce(near, F.lit(False))).drop("longer")


def top_of_each(df: DataFrame, key: str, order: list[Column], k: int, salt: Column, widths: tuple[int, ...] = (64, 8, 2)) -> DataFrame:
    """The first k rows of each key, with their rank. Rows are ranked within shares of a key before those that are left meet, so no task takes a whole key."""
    for width in widths:
        share = Window.partitionBy(key, F.pmod(salt, F.lit(width))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def mine(documents: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    found = counted(documents)
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top_of_each(unsubsumed(scored(found), found), "lang", order, top, F.xxhash64("phrase"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
