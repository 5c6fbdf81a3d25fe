"""Phrases against a plain count of every phrase."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from archgraph.llm import phrases
from pyspark.sql import functions as F


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counts(docs):
    found = collections.defaultdict(collections.Counter)
    for text, lang in docs:
        for w in pieces(text):
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    found["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    return found


def plain(docs, top=2000):
    out = []
    for lang, f in counts(docs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 30}
        ranked = []
        for p, a in candidates.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, x, y, n, -s) for k, (s, a, p, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def sentences(seed, n, words):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    langs = ["en", "fr", None, "und", ""]
    out = [(t, langs[i % 5]) for i, t in enumerate(sentences(1, 400, ["a", "B", "cé", "É", "dd", "x-y", "日本", "New York"]))]
    out += [("One two three four five six! " * 3, "en")] * 40 + [(None, "en"), ("", "fr"), ("...", None), ("lone", "xx"), ("tick tock " * 3_000, "fr")]
    return out


def test_mining_equals_a_plain_count(spark, docs):
    df = spark.createDataFrame([(1, t, k, "s") for t, k in docs], "doc_id long, text string, lang string, phrase string").repartition(5)
    got = sorted(tuple(r) for r in phrases.mine(df).collect())
    assert got == plain(docs) and {r[0] for r in got} == {"en", "fr", "und", ""}
    assert sorted(tuple(r) for r in phrases.mine(df, 7).collect()) == plain(docs, 7)


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


@pytest.mark.parametrize("size", [1, 50, 10**9])
def test_shards_together_hold_every_phrase(docs, size, monkeypatch):
    """Automata of shards of any size, with a bitmap of what is frequent, count every frequent phrase in full."""
    want = counts(docs)
    monkeypatch.setattr("archgraph.llm.common.CHUNK_BYTES", 300)

    def shards(named=None):
        shard = phrases.Shard(named)
        for _ in shard.add(pa.array([t for t, _ in docs]), [k for _, k in docs]):
            if shard.words >= size:
                yield shard
                shard.clear()
        if shard.parts:
            yield shard

    def bitmap(depth, *frequent):
        out = np.zeros((1 << phrases.FILTER_BITS) // 8, np.uint8)
        for b in phrases.frequent(phrases.keys_of(shard, depth, *frequent) for shard in shards()):
            for at in phrases.probes(b.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(out, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    words = bitmap(1)
    pairs, found = bitmap(2, words), collections.Counter()
    triples = bitmap(3, words, pairs)
    for shard in shards(words):
        for b in phrases.phrases_of(shard, words, pairs, triples):
            for lang, p, n, f in zip(*(c.to_pylist() for c in b.columns)):
                found[lang, tuple(p.split(" ")) if n else ()] += f
    got = {k: f for k, f in found.items() if f >= 30 and k[1]}
    assert got == {(lang, p): c for lang, of in want.items() for p, c in of.items() if c >= 30}
    assert {lang: f for (lang, p), f in found.items() if not p} == {k: sum(c for p, c in of.items() if len(p) == 1) for k, of in want.items()}


def test_links_lead_to_the_phrase_without_its_first_word(docs):
    shard = phrases.Shard(np.full((1 << phrases.FILTER_BITS) // 8, 255, np.uint8))
    list(shard.add(pa.array([t for t, _ in docs]), [k for _, k in docs]))
    word, place, keys, _, names = shard.joined()
    tree = phrases.Automaton(word, place, keys)
    while tree.depth < 4:
        above, held = tree.node, tree.phrases(names, np.arange(len(tree.first))).to_pylist()
        tree.deepen()
        for at, p in zip(tree.first.tolist(), tree.phrases(names, np.arange(len(tree.first))).to_pylist()):
            assert p.split(" ", 1)[1] == held[above[at]]


def test_ranks_in_shares_equal_ranks_of_the_whole(spark):
    df = spark.range(3_000).select((F.col("id") % 7 == 0).cast("string").alias("key"), (F.col("id") * 7919 % 101).alias("v"), "id")
    got = {(r["key"], r["rank"]): r["id"] for r in phrases.top_of_each(df, "key", [F.col("v").desc(), F.col("id")], 50, F.xxhash64("id")).collect()}
    for key in ("true", "false"):
        rows = sorted((-(i * 7919 % 101), i) for i in range(3_000) if (i % 7 == 0) == (key == "true"))
        assert [got[key, k] for k in range(1, 51)] == [i for _, i in rows[:50]]
    assert len(got) == 100


def test_packed_keys_come_back():
    rnd = np.random.default_rng(7)
    keys = np.unique(rnd.integers(0, 1 << 63, 5_000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    keys = np.concatenate([keys, np.arange(1, 50, dtype=np.uint64) << np.uint64(64 - phrases.KEY_BITS)])
    counts = rnd.choice([1, 1, 1, 2, 29, 30, 500], len(keys))
    rows = [phrases.unpacked(*r) for r in zip(*(c.to_pylist() for c in phrases.packed(keys, counts).columns))]
    got = dict(zip(np.concatenate([k for k, _ in rows]).tolist(), np.concatenate([c for _, c in rows]).tolist()))
    want = collections.Counter()
    for k, c in zip((keys >> np.uint64(64 - phrases.KEY_BITS)).tolist(), counts.tolist()):
        want[k] += c
    assert got == {k: min(c, phrases.LEAST) for k, c in want.items()}
    assert phrases.packed(keys[:0], counts[:0]).num_rows == 0
    (k, c), = [phrases.summed([(np.array([5, 9], np.uint64), np.array([20, 1])), (np.array([5], np.uint64), np.array([20]))])]
    assert (k.tolist(), c.tolist()) == ([5, 9], [30, 1])
