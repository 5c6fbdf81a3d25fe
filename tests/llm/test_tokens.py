import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
import sentencepiece
from archgraph.llm import sentencepiece as own
from archgraph.llm.queries import PIECE_MODEL

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ALPHABET = [",", "_", "'", "²", "*", "a", "t", "the", "in", " ", "  ", "\n", "▁", "é", "日本", "😀", "\t", ".", "1", "<s>", "</s>", "<unk>", "<0x41>", "\0", "​", "\r"]


@pytest.fixture(scope="module")
def model():
    return own.model(PIECE_MODEL)


def texts(n=400):
    rnd = random.Random(7)
    return ["", " ", "   ", "▁", "x" * 5000, *("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(n))]


def test_ids_text_and_spans_equal_the_library(model):
    for t in texts():
        pieces = model.encoded(t)
        ids = [i for i, _, _ in pieces]
        assert ids == LIBRARY.encode(t)
        assert model.decoded(ids) == LIBRARY.decode(ids)
        raw, at = t.encode(), 0
        for _, a, b in pieces:
            assert a in (at, pieces[0][1]) or (a, b) == last, "spans tile the text; byte pieces of one character share its span"
            at, last = b, (a, b)
        assert at == len(raw)
        n, ids_sha, back_sha, spans_sha, spanned = model.digests(t)
        assert spans_sha == hashlib.sha256(b"".join(struct.pack("<qq", a, b) for _, a, b in pieces)).hexdigest()
        assert (n, spanned) == (len(ids), len(raw))
        assert ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert back_sha == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_a_long_unbroken_text(model):
    rnd = random.Random(17)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.process_time()
    n, ids_sha, back_sha, _, spanned = model.digests(text)
    assert time.process_time() - began < 60
    ids = LIBRARY.encode(text)
    assert (n, spanned) == (len(ids), len(text))
    assert ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert back_sha == hashlib.sha256(text.encode()).hexdigest()


def test_scan_and_heap_make_the_same_pieces(model):
    rnd = random.Random(9)
    for _ in range(300):
        symbols = [rnd.choice(["▁", "t", "h", "e", "i", "n", "a", "é", "0", "日"]) for _ in range(rnd.randint(0, 80))]
        assert model.scanned(list(symbols), {}) == model.heaped(list(symbols), {})
        frozen = [own.FROZEN + x if x in "t日" else x for x in symbols]
        assert model.scanned(list(frozen), {}) == model.heaped(list(frozen), {})


def test_the_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(own, "MEMO_BYTES", 20_000)
    small, rnd = own.Model(PIECE_MODEL), random.Random(4)
    for t in texts(40) + [" ".join(str(rnd.random()) for _ in range(300)), "y" * 4000]:
        assert small.digests(t)[1] == hashlib.sha256(",".join(map(str, LIBRARY.encode(t))).encode()).hexdigest()
        assert small.memo.held <= 20_000
        assert all(len(k) <= own.MEMO_LONGEST for k in small.memo)


def test_decoding_of_any_ids(model):
    rnd = random.Random(3)
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(3, 260), rnd.randrange(260, 32000)]) for _ in range(rnd.randint(0, 8))]
        assert model.decoded(ids) == LIBRARY.decode(ids)


def double_array(entries):
    """A small trie in the compiled form: units by brute-force placement."""
    keys = sorted(entries)
    values = {k: i for i, k in enumerate(keys)}
    units, used = {0: 0}, {0}

    def place(node, depth_keys, depth):
        labels = sorted({k[depth] if depth < len(k) else 0 for k in depth_keys})
        base = next(b for b in range(1, 4096) if all((b ^ c) not in used for c in labels))
        offset = node ^ base
        units[node] = units.get(node, 0) | offset << 10 | (1 << 8 if 0 in labels else 0)
        for c in labels:
            used.add(base ^ c)
        for c in labels:
            below = [k for k in depth_keys if (k[depth] if depth < len(k) else 0) == c]
            if c == 0:
                units[base] = 1 << 31 | values[below[0]]
            else:
                units[base ^ c] = c
                place(base ^ c, below, depth + 1)

    place(0, keys, 0)
    strings, at = b"", {}
    for k in keys:
        at[values[k]] = len(strings)
        strings += entries[k] + b"\0"
    words = [units.get(i, 0) for i in range(max(used) + 1)]
    words = [(1 << 31 | at[u & 0x7FFFFFFF]) if u >> 31 else u for u in words]
    return struct.pack("<I", 4 * len(words)) + struct.pack(f"<{len(words)}I", *words) + strings


def test_longest_prefix_of_a_compiled_map():
    charmap = own.CharMap(double_array({b"a": b"1", b"abc": b"3", "é".encode(): b"e", b"x": b""}))
    assert charmap.longest(b"abcd", 0) == (3, b"3")
    assert charmap.longest(b"abd", 0) == (1, b"1")
    assert charmap.longest("é".encode(), 0) == (2, b"e")
    assert charmap.longest(b"xz", 0) == (1, b"")
    assert charmap.longest(b"z", 0) is None


def test_normalisation_keeps_alignment(model):
    other = own.Model(PIECE_MODEL)
    other.charmap, other.trim, other.identity = own.CharMap(double_array({"ﬁ".encode(): b"fi", b"x": b""})), True, False
    text, begins, ends = other.normalized("  aﬁ x b ")
    assert text == "▁afi▁b"
    assert list(zip(begins, ends)) == [(2, 2), (2, 3), (3, 6), (3, 6), (6, 7), (9, 10)]


def test_frames(spark):
    df = spark.createDataFrame([(1, "the in"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in own.encode(df, PIECE_MODEL).collect()}
    assert rows[1]["ids"] == LIBRARY.encode("the in")
    assert list(rows[1]["begins"]) == [0, 3]
    assert rows[2]["ids"] == rows[3]["ids"] == []
    back = own.decode(own.encode(df, PIECE_MODEL), PIECE_MODEL)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {1: "the in", 2: "", 3: ""}
    assert own.encode_digests(df.limit(0), PIECE_MODEL).count() == 0
    with pytest.raises(ValueError, match="ids"):
        own.encode(df.withColumnRenamed("doc_id", "ids"), PIECE_MODEL, keep=("ids",))


def test_digests_show_a_piece_lost_in_encoding():
    faulty, text = own.Model(PIECE_MODEL), "some words of a text"
    whole = faulty.merged
    faulty.merged = lambda stretch: whole(stretch)[:-1] if stretch == "▁words" else whole(stretch)
    n, _, back_sha, _, spanned = faulty.digests(text)
    assert back_sha == hashlib.sha256(LIBRARY.decode([i for i, _, _ in faulty.encoded(text)]).encode()).hexdigest()
    assert back_sha != hashlib.sha256(text.encode()).hexdigest()
    assert spanned < len(text)
