"""Queries without SQL over the smallest tables: every row of their results against the library or a plain version."""

import hashlib
import itertools
import re
import zlib

import pytest
import sentencepiece
import xxhash
from archgraph.llm import packing, queries
from tests.llm.test_operators import base_counts, slow_fingerprint, slow_likeness


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows(spark, small, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, small).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_equals_the_library(spark, small, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    got = rows(spark, small, "op1_sentencepiece")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert got[i]["span_bytes"] == len(t.encode())


def test_op2_equals_the_plain_hash(spark, small, texts):
    got, order = rows(spark, small, "op2_fingerprints"), sorted(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        changed = texts[i][: len(texts[i]) - half] + texts[j][:half]
        own, edited, other = map(slow_fingerprint, (texts[i], changed, texts[j]))
        assert (got[i]["n_chars"], got[i]["edited_sha256"], got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (len(texts[i]), sha(changed), own, edited)
        assert (got[i]["near_edited"], got[i]["near_next"]) == (pytest.approx(slow_likeness(own, edited)), pytest.approx(slow_likeness(own, other)))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op4_and_op7_learn_and_hold_out(spark, small, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    quality = rows(spark, small, "op4_quality")
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in quality.items())
    judged = [quality[i]["predicted"] == q for i, q in labels.items() if held_out(i) and i in quality]
    assert sum(judged) >= 0.9 * len(judged)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    told = rows(spark, small, "op7_language")
    right = [told[i]["lang_pred"] == k for i, k in langs.items() if held_out(i) and k is not None]
    assert sum(right) >= 0.95 * len(right)


def test_op5_pads_least(spark, small, texts):
    got = rows(spark, small, "op5_packing")
    lengths = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert {i: r["n_tokens"] for i, r in got.items()} == lengths
    histogram = sorted((x, sum(y == x for y in lengths.values())) for x in set(lengths.values()))
    # The plain recurrence: least padding of the first j lengths in k buckets.
    n, best = len(histogram), {0: 0}
    for _ in range(packing.BUCKETS):
        new = dict(best)
        for j in range(1, n + 1):
            for i, cost in best.items():
                if i < j:
                    new[j] = min(new.get(j, 1 << 60), cost + sum(c * (histogram[j - 1][0] - x) for x, c in histogram[i:j]))
        best = new
    assert sum(r["padding"] for r in got.values()) == best[n]


def test_op9_equals_all_pairs(spark, small, texts):
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    got = rows(spark, small, "op9_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_op10_counts(spark, small, texts):
    got = rows(spark, small, "op10_rules")
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(t)
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    agreed = [got[i]["kept"] == bool(q) for i, q in labels.items() if i in got and not got[i]["base_failed"]]
    assert sum(agreed) >= 0.9 * len(agreed)
