"""Document and line statistics of a chunk of texts, all documents at once."""

from __future__ import annotations

import numpy as np

from archgraph.llm.common import Words, mixed, phrase, span_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CLASSES = {
    "upper": list(range(65, 91)), "lower": list(range(97, 123)), "digit": list(range(48, 58)), "symbol": list(b"#*$%&|<>"), "pipe": list(b"|"),
    "exclaim": list(b"!"), "stop": list(b".?"), "comma": list(b",;:"), "other": list(b"@/\\_=+-~^{}[]()\"'`"), "high": list(range(192, 256)), "continues": list(range(128, 192)),
}
REPEAT_WINDOW = 5


def sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def class_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """How many bytes of each class lie in each span."""
    out = {}
    for name, members in CLASSES.items():
        flags = np.zeros(256, bool)
        flags[members] = True
        out[name] = sums(flags[data], starts, ends)
    return out


class Lines:
    """The \\n-split lines of a chunk: byte spans, `doc`, the number of words of each, and whether an earlier line of the document is equal."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, words: Words):
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([offs[:-1], breaks + 1])
        doc = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, breaks, "right") - 1])
        order = np.lexsort((starts, doc))
        self.starts, self.doc = starts[order], doc[order]
        last = np.ones(len(order), bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.ends = np.empty(len(order), np.int64)
        self.ends[:-1] = self.starts[1:] - 1
        self.ends[last] = offs[1:][self.doc[last]]
        self.first = np.searchsorted(self.doc, np.arange(len(offs)))
        self.words = np.searchsorted(words.starts, self.ends) - np.searchsorted(words.starts, self.starts)
        h = span_hashes(data, self.starts, self.ends, 0)
        full = np.flatnonzero(self.words > 0)
        order = full[np.lexsort((full, h[full], self.doc[full]))]
        self.repeats = np.zeros(len(h), bool)
        self.repeats[order[1:]] = (h[order][1:] == h[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])


def repeated_words(words: Words, n_docs: int, window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each document, how many words lie in windows found twice or more in it."""
    n = len(words.starts) - window + 1
    marks = np.zeros(len(words.starts) + 1, np.int32)
    if n > 0:
        inside = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
        # The row is mixed into the hash, so equal values are of one document.
        h = phrase(words.sums(0), inside, window) ^ mixed(words.doc[inside].astype(np.uint64) + np.uint64(1))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        at = inside[twice]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + window, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=n_docs)


def base_counts(data: np.ndarray, offs: np.ndarray, words: Words, lines: Lines) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    whole = np.zeros(256, bool)
    whole[:] = True
    whole[128:192] = False
    whole[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return {
        "n_words": np.diff(words.first),
        "word_chars": sums(whole[data], offs[:-1], offs[1:]),
        "n_symbols": sums(SYMBOLS[data], offs[:-1], offs[1:]),
        "n_dup_lines": np.bincount(lines.doc[lines.repeats], minlength=n),
        "n_repeat_words": repeated_words(words, n),
    }


DOCUMENT_FEATURES = (
    "log_words", "chars_per_word", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "comma", "other", "high", "dup_lines", "repeat_words", "words_per_line", "distinct_words", "long_words", "short_words", "symbol_words", "upper_words",
)


def document_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of DOCUMENT_FEATURES for each document."""
    words = Words(data, offs)
    lines = Lines(data, offs, words)
    base, counts = base_counts(data, offs, words, lines), class_counts(data, offs[:-1], offs[1:])
    n = len(offs) - 1
    n_words, chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    n_lines = np.maximum(np.bincount(lines.doc[lines.words > 0], minlength=n), 1)
    of_doc = lambda flags: np.bincount(words.doc[flags], minlength=n) / n_words
    length = words.ends - words.starts
    h = words.hashes(1) ^ mixed(words.doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[order[1:]] = h[order][1:] != h[order][:-1]
    marked = class_counts(data, words.starts, words.ends)
    return np.column_stack([
        np.log1p(base["n_words"]), chars / n_words, *(counts[k] / chars for k in ("upper", "digit", "symbol", "pipe", "exclaim", "stop", "comma", "other", "high")),
        base["n_dup_lines"] / n_lines, base["n_repeat_words"] / n_words, n_words / n_lines, of_doc(new), of_doc(length > 12), of_doc(length < 3),
        of_doc(marked["symbol"] > 0), of_doc((marked["upper"] > 1) & (marked["lower"] == 0)),
    ]).astype(np.float64)


LINE_FEATURES = ("bias", "upper", "digit", "symbol", "exclaim", "other", "stops", "repeats", "short", "long", "symbol_words", "upper_words", "words_log", "word_repeats", "pipes")


def line_features(data: np.ndarray, words: Words, lines: Lines) -> np.ndarray:
    """One row of LINE_FEATURES for each line, each between 0 and about 1."""
    counts = class_counts(data, lines.starts, lines.ends)
    chars = np.maximum(lines.ends - lines.starts - counts["continues"], 1)
    n_words = np.maximum(lines.words, 1)
    n = len(lines.starts)
    of = np.searchsorted(lines.starts, words.starts, "right") - 1
    marked = class_counts(data, words.starts, words.ends)
    of_line = lambda flags: np.bincount(of[flags], minlength=n)[:n] / n_words
    h = words.hashes(1) ^ mixed(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order][1:] == h[order][:-1]
    return np.column_stack([
        np.ones(n), *(counts[k] / chars for k in ("upper", "digit", "symbol", "exclaim", "other")), counts["stop"] / n_words, lines.repeats, lines.words < 4, lines.words > 40,
        of_line(marked["symbol"] > 0), of_line((marked["upper"] > 1) & (marked["lower"] == 0)), np.log1p(lines.words) / 5, of_line(again), counts["pipe"] > 1,
    ]).astype(np.float64)
