"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; and brute force."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from archgraph.llm import boosting, chat, covering, language, lempelziv, linechain, packing, piecewise, warc
from archgraph.llm.common import Words, phrase, text_chunks
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, extra int"
RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(1, 8))) for _ in range(300)]


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, shared = prose(400, 1), prose(70, 2)
    rows = [(1, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, prose(30, 3) + " " + shared + "\n" + prose(20, 4)), (9, shared + "\t" + prose(60, 5)), (10, prose(20_000, 6)), (11, "ÄÖ é 日本 " * 40), (12, shared[:-3]), (13, "one"), (14, "a " * 120)]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)


def collected(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_words_and_phrases():
    import pyarrow as pa

    texts = ["a b  c\na b", None, "", "é\x0bx a b"]
    for _, _, data, offs in text_chunks(pa.array(texts)):
        w = Words(data, offs)
        assert [bytes(data[a:b]) for a, b in zip(w.starts, w.ends)] == [x for t in texts for x in (t or "").encode().split()]
        h = phrase(w.sums(0), np.array([0, 3, 7]), 2)
        assert h[0] == h[1] == h[2]


def test_span_hashes_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa
    from archgraph.llm import common

    (_, _, data, offs), = text_chunks(pa.array([prose(500, 31), "x" * 900, prose(100, 32)]))
    words = Words(data, offs)
    whole = words.hashes(0)
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    assert (words.hashes(0) == whole).all()


def test_simhash_components_equal_brute_force(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in covering.near_duplicates(docs).collect()}
    prints = {}
    for i, t in collected(docs).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    for _ in prints:
        for a, b in itertools.combinations(sorted(prints), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in covering.masks(3)]
    assert len(masks) == 15
    for bits in itertools.combinations(range(0, 64, 3), 3):
        x = sum(1 << b for b in bits)
        assert any(m & x == 0 for m in masks)


def test_links_are_whole_in_tiles(spark):
    rnd = random.Random(1)
    values = {0}
    while len(values) < 300:
        values.add(rnd.choice(sorted(values)) ^ 1 << rnd.randrange(63))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for tile in (16, 100_000):
        found = covering.components(covering.links(frame, tile=tile)).collect()
        assert len({r["root"] for r in found}) == 1
        assert len(found) == 299


def test_substrings_equal_brute_force(docs):
    got = {r["doc_id"]: r for r in lempelziv.deduplicate(docs).collect()}
    words = {i: t.encode().split() for i, t in sorted(collected(docs).items())}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) == (len(w), len(gone), kept)
        assert sum(s["end"] - s["begin"] for s in got[i]["spans"]) == len(gone)


def test_factors_are_copies_of_their_sources(spark, docs):
    shared, other = prose(120, 41), prose(130, 42)
    rows = [(1, shared), (2, other), (3, prose(9, 43) + " " + " ".join(shared.split()[:80]) + " " + other), (4, " ".join(shared.split()[:50] + other.split()[60:110])), (5, " ".join(shared.split()[20:100]) + " " + prose(60, 44))]
    df = docs.select("doc_id", "text").filter("doc_id <> 10").withColumn("doc_id", F.col("doc_id") + 100).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    words = {i: t.split() for i, t in collected(df).items()}
    got = {r["doc_id"]: r["factors"] for r in lempelziv.deduplicate(df).collect()}
    for i, factors in got.items():
        for f in factors:
            assert f["source"] < i
            assert f["length"] >= 50
            assert words[i][f["begin"] : f["begin"] + f["length"]] == words[f["source"]][f["source_begin"] : f["source_begin"] + f["length"]]
    # Two factors that touch stay two: the windows across them are in no document.
    assert [(f["begin"], f["length"], f["source"], f["source_begin"]) for f in got[4]] == [(0, 50, 1, 0), (50, 50, 2, 60)]
    assert (9, 80) in {(f["begin"], f["length"]) for f in got[3]}


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    s = prose(80, 51)
    rows = [(1, s), (2, prose(30, 52) + " " + s), (2, prose(200, 53)), (2, "one"), (2, prose(30, 52) + " " + s), (3, prose(40, 54) + " " + prose(200, 53))]
    got = lempelziv.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 80, 0), (2, 1, 0), (2, 110, 80), (2, 110, 80), (2, 200, 0), (3, 240, 200)]


def test_substrings_with_repeated_ids_and_no_rows(spark):
    same = spark.createDataFrame([(1, prose(80, 9)), (1, prose(80, 9)), (None, prose(80, 9))], "doc_id long, text string")
    assert [r["n_removed"] for r in lempelziv.deduplicate(same).collect()] == [0, 0, 0]
    assert lempelziv.deduplicate(same.limit(0)).count() == 0


def test_fingerprints_of_neighbours(spark, docs):
    got = {r["doc_id"]: r for r in piecewise.neighbour_fingerprints(docs).collect()}
    texts = collected(docs)
    order = sorted(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        changed = texts[i][: len(texts[i]) - half] + texts[j][:half]
        assert got[i]["n_chars"] == len(texts[i])
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == piecewise.fingerprint(texts[i])
        assert got[i]["edited_fingerprint"] == piecewise.fingerprint(changed)
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[1]["near_next"] == 1
    assert got[2]["near_next"] > 0.9
    assert got[10]["near_edited"] > 0.3 > got[10]["near_next"]
    one = piecewise.neighbour_fingerprints(docs.filter("doc_id = 10")).collect()
    assert len(one) == 1
    assert one[0]["near_next"] == 1
    assert piecewise.neighbour_fingerprints(docs.limit(0)).count() == 0
    twice = piecewise.neighbour_fingerprints(docs.union(docs).union(docs.selectExpr("CAST(NULL AS LONG)", "text", "lang", "source", "extra")))
    assert twice.count() == 3 * len(texts)


@functools.cache
def slow_fingerprint(text):
    """The same hash byte by byte: a cut where the rolling value is divisible by 3 * 2^k."""
    raw, cuts = text.encode(), []
    for i in range(len(raw)):
        h = 0
        for j in range(i - 6, i + 1):
            h = (h * 0x01000193 + (raw[j] + 1 if j >= 0 else 0)) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 12
        if h % 3 == 0:
            cuts.append((i, next((k for k in range(32) if h >> k & 1), 32)))

    def signature(least):
        ends = [i + 1 for i, k in cuts if k >= least][:63] + [len(raw)]
        chunks = [raw[a:b] for a, b in zip([0, *ends], ends) if b > a]
        return "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[zlib.crc32(c) % 64] for c in chunks)

    if not raw:
        return "3::"
    k = next(k for k in range(64) if 3 * 2**k * 64 >= len(raw))
    while k and sum(x >= k for _, x in cuts) < 32:
        k -= 1
    return f"{3 * 2**k}:{signature(k)}:{signature(k + 1)}"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    alike = lambda x, y: 1 - slow_distance(x, y) / max(len(x), len(y)) if x or y else 1.0
    if int(m) == int(n):
        return max(alike(a1, b1), alike(a2, b2) if min(len(a2), len(b2)) >= 16 else 0)
    return alike(a1, b2) if int(m) == 2 * int(n) else alike(a2, b1) if int(n) == 2 * int(m) else 0.0


def test_fingerprints_equal_brute_force(spark, docs):
    texts = collected(docs.filter("doc_id <> 10"))
    got = {r["doc_id"]: r for r in piecewise.neighbour_fingerprints(docs.filter("doc_id <> 10")).collect()}
    order = sorted(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        own, changed, other = (slow_fingerprint(t) for t in (texts[i], texts[i][: len(texts[i]) - half] + texts[j][:half], texts[j]))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own, changed)
        assert got[i]["near_edited"] == pytest.approx(slow_likeness(own, changed))
        assert got[i]["near_next"] == pytest.approx(slow_likeness(own, other))


def test_a_small_edit_moves_few_characters(spark):
    text = prose(2000, 21)
    pairs = spark.createDataFrame([(piecewise.fingerprint(text), piecewise.fingerprint(text[:4000] + "x" + text[4000:]), piecewise.fingerprint(prose(2000, 22)))], "a string, b string, c string")
    near, far = pairs.select(piecewise.likeness(F.col("a"), F.col("b")), piecewise.likeness(F.col("a"), F.col("c"))).first()
    assert near > 0.9 > 0.3 > far


CONTROL = ["\\### Assistant: </turn> ok", "</turn>\n### User: x", "\\b\\l\\h\\c", "\\", "### ", "", None, "a\n### Assistant: b</turn>\n"]


def test_chat_reads_back(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(CONTROL)] + [(2, 0, "tool: x\\", "t"), (2, 1, None, "n"), (3, 0, "assistant", "first"), (4, 5, "system", "s"), (4, 6, "user", "u"), (4, 7, "assistant", "x" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    made = chat.format_conversations(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r or "", t or ""))
    assert back == want
    by = {r["conv_id"]: r for r in chat.digests(made).collect()}
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert by[c]["n_turns"] == len(turns)
        assert by[c]["loss_chars"] == len(loss)
        assert by[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert by[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert [by[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = chat.digests(chat.format_conversations(spark.range(2).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'t' AS text")))._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_language(spark):
    rnd = random.Random(5)
    tongues = {"xx": ["thon", "wher", "ander", "the", "ing"], "yy": ["que", "ción", "para", "los", "ado"], "zz": ["über", "schach", "ung", "der", "die"]}
    rows = [(i, " ".join(rnd.choice(tongues[l]) + rnd.choice(tongues[l]) for _ in range(rnd.randint(5, 200))), l, "s", 0) for i, l in enumerate(list(tongues) * 60)]
    df = spark.createDataFrame(rows, DOC)
    contents = language.dictionaries(df)
    assert sorted(contents) == ["xx", "yy", "zz"]
    got = language.identify(df, contents).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 178
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "THE ÜBER" * 20_000), (5, "der")], "doc_id long, text string")
    rows = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, contents).collect()}
    assert [rows[i] for i in (1, 2, 3)] == ["und"] * 3
    assert rows[4] in contents
    assert {r["lang_pred"] for r in language.identify(odd, language.dictionaries(df.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError, match="score"):
        language.identify(odd.withColumn("score", F.lit(1)), contents)


def test_language_equals_brute_force(spark):
    """Dictionaries from all rows with a plain count, and every piece compressed with every one of them."""
    rnd = random.Random(8)
    tongues = {k: [prose(1, 100 * n + j) for j in range(40)] for n, k in enumerate(("aa", "bb", "cc"))}
    rows = [(i, " ".join(rnd.choice(tongues[k]) for _ in range(rnd.randint(1, 300))), k) for i, k in enumerate(list(tongues) * 30)]
    rows += [(500, "HELD out", "dd"), (None, "no id", "dd"), (501, None, "aa"), (502, rows[1][1], "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = {(k, t) for i, t, k in rows if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    want = {}
    for name in {k for k, _ in train}:
        counts = collections.Counter(w for k, t in train if k == name for w in re.findall(r"[^\W\d_]+", t.lower()))
        want[name] = b" " + b"".join(w.encode() + b" " for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[::-1])
    contents = language.dictionaries(df)
    assert contents == want
    got = language.identify(df, contents).collect()
    for r in got:
        text = " " + " ".join(re.findall(r"[^\W\d_]+", (r["text"] or "").lower())) + " "
        if not text.strip():
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        ring = (text * (512 // len(text) + 2))[: -(-len(text) // 512) * 512] if len(text) < 512 else text + text[: -len(text) % 512]
        rates = {}
        for name, words in contents.items():
            params = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
            one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            rates[name] = sum(len(one.compress(ring.encode()[k : k + 512])) for k in range(0, len(ring), 512)) / len(text)
        assert r["lang_pred"] == min(sorted(rates), key=rates.get)
        least, other = sorted(rates.values())[:2]
        assert r["margin"] == pytest.approx(other - least)


def test_any_number_of_languages(spark):
    df = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} of tongue", f"l{i}") for i in range(400)], "doc_id long, text string, lang string")
    contents = language.dictionaries(df)
    assert len(contents) > 256
    assert language.identify(df.limit(3), contents).count() == 3


def quality_data(spark):
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        t = "\n".join(prose(12, 1000 * i + k).capitalize() + "." for k in range(6))
        rows.append((i, t if good else re.sub(r"(\w+)", r"\1***", t.upper()), "en", "s", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_boosted_trees(spark):
    docs, labels = quality_data(spark)
    trees = boosting.fitted(docs, labels)
    got = {r["doc_id"]: r for r in boosting.score(docs, trees).withColumn("predicted", boosting.predicted()).collect()}
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in got)
    empty = boosting.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), trees).collect()
    assert all(0 <= r["score"] <= 1 for r in empty)
    flat = boosting.fit(np.zeros((0, len(boosting.DOCUMENT_FEATURES))), np.zeros(0))
    assert flat.score(np.zeros((2, len(boosting.DOCUMENT_FEATURES)))).tolist() == [0.5, 0.5]


def test_trees_descend_as_written():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, len(boosting.DOCUMENT_FEATURES)))
    trees = boosting.fit(x, (x[:, 0] + x[:, 3] > 0).astype(float))

    def slow(row):
        total = trees.prior
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            for _ in range(boosting.DEPTH):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - 2**boosting.DEPTH + 1]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [slow(r) for r in x[:50]])
    assert ((trees.score(x) > 0.5) == (x[:, 0] + x[:, 3] > 0)).mean() > 0.95


def test_viterbi_equals_all_labelings():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        score, moves = rnd.normal(size=rnd.integers(1, 7)), rnd.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=len(score)), key=lambda y: sum(s for s, k in zip(score, y) if k) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
        assert linechain.viterbi(score, moves).astype(int).tolist() == list(best)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    grams = [tuple(words[k : k + 5]) for k in range(n - 4)]
    often = collections.Counter(grams)
    marked = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n


def test_line_labels(spark, docs):
    train, labels = quality_data(spark)
    field = linechain.fitted(train, labels)
    got = linechain.judge(train, field).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
    odd = docs.filter("doc_id <> 10").unionByName(spark.createDataFrame([(20, "x\n\nx \nx\n a b c d e a b c d e # <é>\n" * 2, "", "", 0)], DOC))
    rows = {r["doc_id"]: r for r in linechain.judge(odd, field).collect()}
    for i, t in collected(odd).items():
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(t)
    assert linechain.judge(odd.limit(0), field).count() == 0
    assert all(r["content_share"] == 1 for r in linechain.judge(train, linechain.fit([], [])).collect())


def test_line_labels_vary_inside_documents(spark):
    """Bad documents of the sample hold some good lines and good ones some bad lines; only documents are labelled."""
    rnd = random.Random(6)
    good = lambda k: prose(rnd.randint(8, 16), k).capitalize() + "."
    bad = lambda k: re.sub(r"(\w+)", r"\1***", prose(rnd.randint(8, 16), k).upper())
    rows, labels, kinds = [], [], {}
    for i in range(240):
        quality = int(i % 3 > 0)
        marks = [quality] * 7
        if i % 2:
            marks[:2] = [1 - quality] * 2
        kinds[i] = marks
        rows.append((i, "\n".join((good if k else bad)(100 * i + j) for j, k in enumerate(marks))))
        labels.append((i, quality, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights, moves = linechain.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in linechain.judge(docs, (weights, moves)).collect()}
    right = [got[i]["n_content_lines"] == sum(kinds[i]) for i in kinds]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[i]["kept"] == bool(labels[i][1]) for i in kinds)
    assert sum(0 < r["content_share"] < 1 for r in got.values()) >= 110


def test_constrained_labels_agree_with_the_document():
    rnd = np.random.default_rng(4)
    for _ in range(100):
        n = int(rnd.integers(1, 9))
        score, words, moves, good = rnd.normal(size=n), rnd.integers(1, 20, n).astype(float), rnd.normal(size=(2, 2)), int(rnd.integers(2))
        label = linechain.constrained(score, words, moves, good)
        assert (words[label].sum() >= linechain.LEAST_SHARE * words.sum()) == bool(good)


def test_optimal_buckets_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        lengths = sorted(rnd.sample(range(40), rnd.randint(1, 8)))
        hist, k = [(x, rnd.randint(1, 9)) for x in lengths], rnd.randint(1, 5)
        cost = lambda bounds, hist=hist: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist)
        best = min(cost(b) for r in range(1, min(k, len(lengths)) + 1) for b in itertools.combinations(lengths, r) if b[-1] == lengths[-1])
        got = packing.optimal(hist, k)
        assert cost(got.bounds) == got.padding == best
        assert len(got.bounds) <= k


def test_packing(spark, docs):
    got = packing.pack(docs, buckets=3, budget=900, slice_rows=2).collect()
    lengths = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in collected(docs).items()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == lengths
    batches = {}
    for r in got:
        assert r["n_tokens"] + r["padding"] == r["padded_to"]
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r)
    for rows in batches.values():
        assert len(rows) == rows[0]["batch_docs"]
        assert len(rows) == 1 or len(rows) * rows[0]["padded_to"] <= 900
    for bucket in {b for b, _ in batches}:
        assert sorted(n for b, n in batches if b == bucket) == list(range(len([1 for b, _ in batches if b == bucket])))
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs.union(docs)).count() == 2 * len(lengths)


PAYLOADS = [("", 1), ("", 2), ("same", 3), ("same", 9), ("same", 5), ("x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 6), ("é日" * 20_000, 7), (None, 8), ("\r\n", 10), ("a\r", 11), ("0\r\n\r\n" * 5000, 12)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}\n", t, "c") for t, i in PAYLOADS], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.round_trip(df, str(tmp_path / "w"), segment_bytes=1000).collect()}
    chosen = {}
    for t, i in PAYLOADS:
        chosen[t or ""] = max(i, chosen.get(t or "", 0))
    assert len(got) == len(PAYLOADS)
    for t, i in PAYLOADS:
        raw = (t or "").encode()
        other = chosen[t or ""]
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), warc.base32_sha1(raw))
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if other == i else ("revisit", other))
        assert got[i]["complete"]
    back = warc.reassembled(warc.read_records(spark, str(tmp_path / "w"))).filter("page_id = 7").first()
    assert bytes(back["payload"]).decode() == "é日" * 20_000
    broken = warc.read_records(spark, str(tmp_path / "w")).filter("page_id <> 7 OR segment <> 2")
    assert not warc.reassembled(broken).filter("page_id = 7").first()["complete"]


def test_warc_of_repeated_ids_and_none(spark, tmp_path):
    rows = [(1, "u", "a" * 3000), (1, "u", "a" * 3000), (1, "u", "b"), (2, "u", "a" * 3000), (None, None, "a" * 3000), (None, None, "a" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["complete"]) for r in warc.round_trip(df, str(tmp_path / "w"), segment_bytes=1000).collect()), key=str)
    assert got == [(1, 1, "response", None, True), *[(1, 3000, "revisit", 2, True)] * 2, (2, 3000, "response", None, True), *[(None, 3000, "response", None, True)] * 2]
    assert warc.round_trip(df.limit(0), str(tmp_path / "e")).count() == 0


def test_warc_keeps_a_record_of_each_row(spark, tmp_path):
    twice = spark.createDataFrame([(1, "u", "x" * 2500), (1, "u", "x" * 2500)], "page_id long, url string, html string")
    got = warc.round_trip(twice, str(tmp_path / "w"), segment_bytes=1000).collect()
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["complete"]) for r in got] == [(1, 2500, "response", True)] * 2
    sizes = spark.createDataFrame([(1, "u", "a" * 30), (2, "u", "a" * 30), (2, "u", "b" * 500)], "page_id long, url string, html string")
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.round_trip(sizes, str(tmp_path / "s")).collect()}
    assert {(i, r["payload_bytes"], r["record_type"]) for (i, _), r in got.items()} == {(1, 30, "revisit"), (2, 30, "response"), (2, 500, "response")}


def python_in_one_stage(plan, above=0):
    """The most Python operators in a row of a physical plan, without an aggregate between them."""
    name = plan.nodeName()
    here = 0 if "Aggregate" in name else above + (name == "MapInArrow")
    return max([here, *(python_in_one_stage(plan.children().apply(k), here) for k in range(plan.children().size()))])


def test_warc_bytes_pass_one_python_worker_at_a_time(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a" * 30), (2, "u", "b" * 2500), (3, "u", "a" * 30)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), segment_bytes=1000)
    read = warc.read_records(spark, str(tmp_path / "w"))
    back = warc.reassembled(read)
    assert python_in_one_stage(back._jdf.queryExecution().sparkPlan()) == 1
    assert {(r["page_id"], bytes(r["payload"] or b"").decode()) for r in back.collect()} == {(1, ""), (2, "b" * 2500), (3, "a" * 30)}
    heads = {(r["page_id"], r["segment"]): bytes(r["block"]) for r in read.filter("segment < 2").collect()}
    assert all(h.startswith(b"HTTP/1.1 200 OK\r\n") for h in heads.values()) and heads.keys() == {(1, 0), (2, 1), (3, 0)}
    assert heads[3, 0].endswith(b"\r\n\r\n")
    broken = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"
    assert warc.opened("response", broken) == (broken, None)


def test_warc_scans_long_pages_in_short_batches(spark, tmp_path, monkeypatch):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before, seen, text = spark.conf.get(key), [], DataFrameWriter.text
    spark.createDataFrame([(i, "u", "x" * 50) for i in range(300)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **b: (seen.append(int(spark.conf.get(key))), text(self, *a, **b))[1])
    assert warc.round_trip(spark.read.parquet(str(tmp_path / "p"))).filter("complete").count() == 300
    assert seen and max(seen) <= 128 and spark.conf.get(key) == before
    with pytest.raises(Exception, match="(?i)already exists"):
        (tmp_path / "there").mkdir()
        warc.write(spark.range(0).selectExpr("id AS page_id", "'u' AS url", "'' AS html"), str(tmp_path / "there"))
    assert spark.conf.get(key) == before


def test_chunked_framing():
    for payload in (b"", b"abc", b"\r\n" * 3000):
        assert warc.dechunked(warc.chunked(payload, 7)) == payload
    assert warc.dechunked(b"4;x=1\r\nabcd\r\n0\r\n\r\n") == b"abcd"
    assert warc.dechunked(b"4\r\nab") is None
    assert warc.dechunked(b"zz\r\n") is None
