"""SentencePiece BPE encoding with byte spans, and decoding.

`Model` reads the public model file format; `CharMap` is its compiled character map (a double-array trie followed by
the replacement strings). Normalisation replaces, at each place, the longest prefix that the map holds, and notes for
every normalised character which source bytes it stands for, so that each piece can be projected back to a byte span of
the source text. Merges are then made best score first, leftmost on ties, within stretches that no piece of the
vocabulary can cross; unknown characters fall back to bytes. In a long stretch the pairs wait in a heap and its symbols are a
linked list, so n characters take n log n steps.

Spans: pieces tile the source. A piece whose characters all came from the dummy prefix has an empty span; each byte piece
of one character spans that whole character.

Cases: null and empty texts give no pieces and decode to the empty text. Equal texts, and repeated rows, give equal results; an
empty table gives no rows. Only the columns named are read; a kept column that has an output's name is an error, which
`column_prefix` (or `output`) avoids.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
POSITION_BITS = 32
#: Stands before a symbol that is not to be merged; no text in UTF-8 holds it.
FROZEN = "\ud800"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of stretches with their encodings that one Python worker keeps, about; at the bound the memo starts anew.
#: A longer stretch than MEMO_LONGEST characters is not kept. MEMO_ENTRY is what an entry takes besides its contents.
MEMO_BYTES, MEMO_LONGEST, MEMO_ENTRY = 448 << 20, 256, 360
#: Up to so many symbols the best pair is found by looking at all; beyond, by the heap. Both make the same pieces.
SCANNED = 48


def fields(buffer: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buffer):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = buffer[at : at + size]
            at += size
        yield key >> 3, value


class CharMap:
    """Longest-prefix lookup in a compiled character map; an empty one maps nothing."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key that starts at `at`."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != text[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & ((1 << 31) - 1)
                found = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found


def covered(spans: np.ndarray) -> int:
    """Source bytes in spans (begin, end), each counted once. Spans are in order of both."""
    if not len(spans):
        return 0
    begin, end = spans[:, 0], spans[:, 1]
    return int((end - np.maximum(begin, np.concatenate([[0], end[:-1]]))).clip(0).sum())


#: An encoded stretch: decimal ids, their number, the text decoded from them, spans (begin, end) as 32-bit numbers, source bytes.
Stretch = tuple[bytes, int, str, bytes, int]


class Memo(dict):
    """Results by stretch; a missing one is made, and past MEMO_BYTES all go and are made again as they occur."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, stretch: str) -> Stretch:
        out = self.make(stretch)
        if len(stretch) <= MEMO_LONGEST:
            self.held += MEMO_ENTRY + 8 * len(stretch) + len(out[0]) + len(out[3])
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[stretch] = out
        return out


class Model:
    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, self.trim, self.escape, charmap, self.unk_surface = True, True, True, b"", " ⁇ "
        model_type = 1
        with open(path, "rb") as file:
            raw = file.read()
        for number, value in fields(raw):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                spec = dict(fields(value))
                model_type, suffix = spec.get(3, 1), spec.get(24, 0)
                self.unk_surface = spec.get(44, self.unk_surface.encode()).decode()
                if suffix:
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                spec = dict(fields(value))
                charmap = spec.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if model_type != 2:
            raise ValueError("a BPE model is needed")
        self.charmap = CharMap(charmap)
        self.identity = not charmap and not self.trim and self.escape
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.unk = self.kinds.index(UNKNOWN)
        self.whole = {p: i for p, i in self.ids.items() if self.kinds[i] != UNKNOWN}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items() if self.kinds[i] in (NORMAL, USER_DEFINED, UNUSED)}
        # Places of the scores in order, best first: with a position they make one whole number that a heap can order.
        places = {x: k for k, x in enumerate(sorted(set(self.rank.values())))}
        self.place = {p: places[x] << POSITION_BITS for p, x in self.rank.items()}
        own = sorted((p for i, p in enumerate(self.pieces) if self.kinds[i] == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        # A stretch is a run of marks and what follows up to the next mark, line end or sign, if no piece crosses those.
        long = [p for p in self.rank if len(p) > 1]
        crosses = any(a != SPACE and b == SPACE for p in long for a, b in pairwise(p))
        lines = any("\n" in p for p in long)
        # Nor does one go from a letter or digit on to these signs.
        joined = {b for p in long for a, b in pairwise(p) if a.isalnum()}
        signs = "".join(re.escape(c) for c in string.punctuation if c not in joined)
        stop = SPACE if lines else f"{SPACE}\n"
        word = f"{SPACE}*[^\\W_]++(?=[{stop}{signs}]|\\Z)"
        other = f"{SPACE}*[^{stop}](?:(?!(?<=[^\\W_])[{signs}])[^{stop}])*" if signs else f"{SPACE}*[^{stop}]+"
        self.stretch = None if crosses or own else re.compile("|".join([word, other, f"{SPACE}+", *([] if lines else ["\n"])]))
        self.has_unused = UNUSED in self.kinds
        #: What each id shows as; None for bytes, which are joined first.
        self.shown = [None if k == BYTE else self.unk_surface if k == UNKNOWN else "" if k == CONTROL else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds)]
        self.memo = Memo(self.remembered)

    # -- normalisation -------------------------------------------------------------------------------------------

    def normalized(self, text: str, start: bool = True) -> tuple[str, Sequence[int], Sequence[int]]:
        """The normalised text (with the dummy prefix, if it is a text's start), and where the source bytes begin and end that each of its characters stands for."""
        source = text.encode("utf-8", "surrogatepass")
        if not self.charmap.units and not self.own and not self.trim:  # every character stands for itself
            places = range(len(text) + 1) if len(source) == len(text) else list(accumulate((len(c.encode("utf-8", "surrogatepass")) for c in text), initial=0))
            begins, ends = places[:-1], places[1:]
            if text and start and self.dummy_prefix:
                text, begins, ends = " " + text, [0, *begins], [0, *ends]
            return text.replace(" ", SPACE) if self.escape else text, begins, ends
        parts: list[tuple[str, int, int]] = []
        at = place = 0
        while at < len(source):
            if self.own and (m := self.own.match(text, place)):
                taken, out = len(m[0].encode()), m[0].encode()
            elif hit := self.charmap.longest(source, at):
                taken, out = hit
            else:
                lead = source[at]
                taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = source[at : at + taken]
            parts.append((out.decode(), at, at + taken))
            if self.own:
                place += len(source[at : at + taken].decode())
            at += taken
        chars = [(c, a, b) for s, a, b in parts for c in s]
        if self.trim:
            chars = chars[next((i for i, x in enumerate(chars) if x[0] != " "), len(chars)) :]
            while chars and chars[-1][0] == " ":
                chars.pop()
            chars = [x for i, x in enumerate(chars) if x[0] != " " or chars[i - 1][0] != " "]
        if chars and start and self.dummy_prefix:
            chars.insert(0, (" ", chars[0][1], chars[0][1]))
        mark = SPACE if self.escape else " "
        return "".join(mark if c == " " else c for c, _, _ in chars), [a for _, a, _ in chars], [b for _, _, b in chars]

    # -- merging -------------------------------------------------------------------------------------------------

    def merged(self, stretch: str) -> list[str]:
        """The pieces of a stretch: the best-scored neighbouring pair, leftmost on ties, becomes one until none is left."""
        symbols = list(stretch)
        if self.own:
            symbols, at = [], 0
            while at < len(stretch):
                m = self.own.match(stretch, at)
                symbols.append(FROZEN + m[0] if m else stretch[at])
                at = m.end() if m else at + 1
        made: dict[str, tuple[str, str]] = {}
        symbols = self.scanned(symbols, made) if len(symbols) <= SCANNED else self.heaped(symbols, made)
        if self.own:
            symbols = [x.removeprefix(FROZEN) for x in symbols]
        if not self.has_unused:
            return symbols

        def used(symbol: str) -> list[str]:
            if symbol in made and symbol in self.ids and self.kinds[self.ids[symbol]] == UNUSED:
                return [x for part in made[symbol] for x in used(part)]
            return [symbol]

        return [x for s in symbols for x in used(s)]

    def scanned(self, symbols: list[str], made: dict[str, tuple[str, str]]) -> list[str]:
        none, get = 1 << 62, self.place.get
        costs = [get(a + b, none) for a, b in pairwise(symbols)]
        while costs and (best := min(costs)) != none:
            i = costs.index(best)
            left, right = symbols[i], symbols.pop(i + 1)
            both = symbols[i] = left + right
            if self.has_unused:
                made[both] = (left, right)
            del costs[i]
            if i:
                costs[i - 1] = get(symbols[i - 1] + both, none)
            if i < len(costs):
                costs[i] = get(both + symbols[i + 1], none)
        return symbols

    def heaped(self, symbols: list[str | None], made: dict[str, tuple[str, str]]) -> list[str]:
        get = self.place.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        low = (1 << POSITION_BITS) - 1

        def cost(i: int) -> int | None:
            return get(symbols[i] + symbols[after[i]])

        heap = [p + i for i in range(n - 1) if (p := cost(i)) is not None]
        heapify(heap)
        while heap:
            best = heappop(heap)
            i = best & low
            # An entry is out of date if its symbol is gone or now makes another pair.
            if symbols[i] is None or after[i] >= n or cost(i) != best - i:
                continue
            j = after[i]
            left, right = symbols[i], symbols[j]
            both = symbols[i] = left + right
            symbols[j] = None
            if self.has_unused:
                made[both] = (left, right)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := cost(i)) is not None:
                    heappush(heap, p + i)
            if before[i] >= 0 and (p := cost(before[i])) is not None:
                heappush(heap, p + before[i])
        return [x for x in symbols if x is not None]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.whole:
            return [self.whole[piece]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unk]

    def pieced(self, begins: Sequence[int], ends: Sequence[int], stretches: list[str]) -> list[tuple[int, int, int]]:
        out, at = [], 0
        for stretch in stretches:
            for piece in self.merged(stretch):
                end = at + len(piece)
                begin, last = begins[at], ends[end - 1]
                found = self.whole.get(piece)
                if found is not None:
                    out.append((found, begin, last))
                else:
                    out += [(i, begin, last) for i in self.piece_ids(piece)]
                at = end
        return out

    def encoded(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece; begin and end are byte offsets in the source text."""
        normal, begins, ends = self.normalized(text)
        return self.pieced(begins, ends, self.stretch.findall(normal) if self.stretch else [normal] * bool(normal))

    # -- whole texts with the memo -------------------------------------------------------------------------------

    def remembered(self, stretch: str) -> Stretch:
        """The encoding of a stretch whose marks are all spaces of the source."""
        source = stretch.replace(SPACE, " ")
        normal, begins, ends = self.normalized(source, False)
        return self.reduced(self.pieced(begins, ends, [normal]), ends[-1])

    def reduced(self, pieces: list[tuple[int, int, int]], size: int) -> Stretch:
        ids = [i for i, _, _ in pieces]
        return ",".join(map(str, ids)).encode(), len(ids), self.surface(ids), array("i", chain.from_iterable([p[1:] for p in pieces])).tobytes(), size

    def surface(self, ids: list[int]) -> str:
        """The text of ids in the middle of a text: byte pieces are joined, invalid ones become U+FFFD each."""
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        parts: list[str] = []
        pending = bytearray()

        def flush() -> None:
            at = 0
            while at < len(pending):
                for size in (1, 2, 3, 4):
                    try:
                        parts.append(pending[at : at + size].decode() if at + size <= len(pending) else "�")
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    parts.append("�")
                at += size if parts[-1] != "�" else 1
            pending.clear()

        for i, text in zip(ids, shown):
            if text is None:
                pending.append(self.byte_of[i])
                continue
            flush()
            parts.append(text)
        flush()
        return "".join(parts)

    def decoded(self, ids: list[int]) -> str:
        """The text of ids; of leading marks the one that the dummy prefix made goes (all of them if spaces are trimmed)."""
        first = next((i for i, x in enumerate(ids) if self.kinds[x] != CONTROL), len(ids))
        text = self.surface(ids)
        if first < len(ids) and self.pieces[ids[first]].startswith(SPACE) and (self.dummy_prefix or self.trim):
            text = text.lstrip(" ") if self.trim else text[1:]
        return text

    def digests(self, text: str) -> tuple[int, str, str, str, int]:
        """(number of ids, sha256 of the ids, of the decoded text, of the spans as pairs of 64-bit numbers, bytes spanned)."""
        sha = lambda x: hashlib.sha256(x).hexdigest()
        # A mark of the source itself looks like a space's once normalised, so such texts are not taken from the memo.
        if not (text and self.identity and self.stretch and self.dummy_prefix) or SPACE in text:
            pieces = self.encoded(text)
            ids = [i for i, _, _ in pieces]
            spans = np.array([p[1:] for p in pieces], "<i8")
            return len(ids), sha(",".join(map(str, ids)).encode()), sha(self.decoded(ids).encode()), sha(spans.tobytes()), covered(spans.reshape(-1, 2))
        # Normalisation is the same in every place and no piece crosses stretches: ids, decoded texts and, from where a stretch begins, spans add up.
        first, *stretches = self.stretch.findall(SPACE + text.replace(" ", SPACE))
        lead = first[1:].replace(SPACE, " ")
        head = self.encoded(lead) if lead else [(i, 0, 0) for i in self.piece_ids(SPACE)]
        ids, counts, back, spans, sizes = zip(self.reduced(head, len(lead.encode())), *map(self.memo.__getitem__, stretches))
        begins = np.cumsum((0, *sizes[:-1]))
        whole = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2) + np.repeat(begins, counts)[:, None]
        return len(whole), sha(b",".join(ids)), sha("".join(back)[1:].encode()), sha(whole.astype("<i8").tobytes()), covered(whole)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model for each worker process; the path must name a file that every executor has."""
    return Model(path)


def kept_schema(df: DataFrame, keep: tuple[str, ...], made: dict[str, str]) -> str:
    """The schema of kept and made columns, whose names must differ."""
    if clash := set(keep) & set(made):
        raise ValueError(f"output names that the input has: {sorted(clash)}")
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in keep]).schema] + [f"`{n}` {t}" for n, t in made.items()])


def encode(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), column_prefix: str = "") -> DataFrame:
    """`keep`, and arrays `ids`, `begins`, `ends`: every piece's id and byte span in the source text."""
    names = [f"{column_prefix}{n}" for n in ("ids", "begins", "ends")]
    schema = kept_schema(df, keep, dict.fromkeys(names, "array<int>"))

    def run(batches):
        m = model(model_path)
        for batch in batches:
            pieces = [m.encoded(t.as_py() or "") for t in batch.column(len(keep))]
            arrays = [pa.array([[p[k] for p in doc] for doc in pieces], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*keep, *names])

    return df.select(*[f"`{c}`" for c in (*keep, text)]).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), output: str = "decoded") -> DataFrame:
    """`keep` and the text of each row's ids."""
    schema = kept_schema(df, keep, {output: "string"})

    def run(batches):
        m = model(model_path)
        for batch in batches:
            texts = [m.decoded(x.as_py() or []) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, output])

    return df.select(*[f"`{c}`" for c in (*keep, ids)]).mapInArrow(run, schema)


DIGESTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "spans_sha256": pa.string(), "span_bytes": pa.int64()}


def encode_digests(df: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same encoding and decoding, reduced in place to digests: n_tokens, ids_sha256, decoded_sha256, spans_sha256, span_bytes."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            rows = [m.digests(t.as_py() or "") for t in batch.column(1)]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(DIGESTS.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *DIGESTS])

    return df.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}`").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, span_bytes bigint")
