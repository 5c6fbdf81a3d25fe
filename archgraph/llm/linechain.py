"""Quality rules by line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

The field has weights for line features and for the four transitions. It is fitted on at most SAMPLE_ROWS labelled documents that
are not held out; documents of more than SAMPLE_LINES lines are not taken for fitting. Only documents are labelled, lines are
not, so the labels of lines are found with the field, in rounds: a first fit of the features alone takes every line as its
document is; then the field decodes the sample, and the lines of a good document are taken as decoded as long as half of its words
are content, those of a bad one as long as less than half are (the lines of clearest score change over to keep to that); on these
sequences, which vary inside documents, the whole field is fitted by maximum likelihood (forward-backward, whole sequences).
Viterbi decoding then labels every line of every document; the share of words in content lines decides.

Base rules, applied first: fewer than LEAST_WORDS words, or more than REPEAT_PERCENT percent of words in repeated five-word windows.

Cases: null and empty texts have no words and fail the base rules; lines without a word carry no weight in the share;
a tie of the two labels is content; with no labels every line is content; repeated rows get equal results; an empty table gives no
rows; a column that has a result's name is an error, which `prefix` avoids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from archgraph.llm.common import Words, appended, labelled_sample, text_chunks
from archgraph.llm.statistics import LINE_FEATURES, Lines, base_counts, line_features

SAMPLE_ROWS, SAMPLE_LINES = 6_000, 200
ROUNDS, FIRST_STEPS, STEPS, RATE, PENALTY = 2, 150, 60, 0.2, 1e-3
LEAST_WORDS, REPEAT_PERCENT, LEAST_SHARE = 10, 20, 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def climbed(grid: np.ndarray, lengths: np.ndarray, target: np.ndarray, weights: np.ndarray, moves: np.ndarray, steps: int, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions after `steps` gradient steps with momentum on the likelihood of the target labels.

    grid: (sequence, line, feature), longest sequence first; without `chain` lines are independent and transitions stay.
    """
    longest = int(lengths[0])
    inside = np.arange(longest)[None, :] < lengths[:, None]
    live = inside.sum(axis=0)
    total = lengths.sum()
    seen = np.zeros((2, 2))
    both = inside[:, 1:]
    np.add.at(seen, (target[:, :-1][both], target[:, 1:][both]), 1)
    speed_w, speed_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(steps):
        score = np.clip((grid @ weights.astype(grid.dtype)).astype(np.float64), -30, 30)
        if chain:
            emit, step = np.exp(np.stack([np.zeros_like(score), score], axis=2)), np.exp(moves)
            ahead, scale = np.zeros_like(emit), np.ones(score.shape)
            for t in range(longest):
                m = live[t]
                a = emit[:m, t] if t == 0 else (ahead[:m, t - 1] @ step) * emit[:m, t]
                scale[:m, t] = a.sum(axis=1)
                ahead[:m, t] = a / scale[:m, t, None]
            behind = np.zeros_like(emit)
            pair = np.zeros((2, 2))
            for t in range(longest - 1, -1, -1):
                m, more = live[t], live[t + 1] if t + 1 < longest else 0
                behind[:m, t] = 1
                if more:
                    onward = emit[:more, t + 1] * behind[:more, t + 1] / scale[:more, t + 1, None]
                    behind[:more, t] = onward @ step.T
                    pair += step * (ahead[:more, t].T @ onward)
            chance = (ahead * behind)[:, :, 1]
            speed_m = 0.9 * speed_m + (seen - pair) / total - PENALTY * moves
            moves = moves + RATE * speed_m
        else:
            chance = 1 / (1 + np.exp(-score))
        speed_w = 0.9 * speed_w + np.tensordot(np.where(inside, target - chance, 0).astype(grid.dtype), grid, 2) / total - PENALTY * weights
        weights = weights + 10 * RATE * speed_w
    return weights, moves


def constrained(score: np.ndarray, words: np.ndarray, moves: np.ndarray, good: int) -> np.ndarray:
    """Line labels as decoded, with the clearest lines changed over until the content share agrees with the document's label."""
    label, half = viterbi(score, moves), LEAST_SHARE * words.sum()
    inside = words[label].sum()
    for k in np.argsort(-score if good else score, kind="stable").tolist():
        if (inside >= half) == bool(good):
            break
        if label[k] != bool(good):
            label[k] = bool(good)
            inside += words[k] if good else -words[k]
    return label


def fit(x: list[np.ndarray], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(weights of content over boilerplate, transitions[from, to]) from the line features of documents and their labels; label 1 is content."""
    weights, moves = np.zeros(len(LINE_FEATURES)), np.zeros((2, 2))
    if not x:
        weights[0] = 1.0
        return weights, moves
    order = sorted(range(len(x)), key=lambda i: -len(x[i]))
    lengths = np.array([len(x[i]) for i in order])
    grid = np.zeros((len(x), int(lengths[0]), len(LINE_FEATURES)), np.float32)
    target = np.zeros(grid.shape[:2], np.int64)
    for k, i in enumerate(order):
        grid[k, : len(x[i])], target[k, : len(x[i])] = x[i], y[i]
    weights, moves = climbed(grid, lengths, target, weights, moves, FIRST_STEPS, False)
    for _ in range(ROUNDS):
        for k, i in enumerate(order):
            words = np.rint(np.expm1(5 * x[i][:, LINE_FEATURES.index("words_log")]))
            target[k, : len(x[i])] = constrained(x[i] @ weights, words, moves, y[i])
        weights, moves = climbed(grid, lengths, target, weights, moves, STEPS)
    return weights, moves


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of a sequence whose content label scores `score` over the other."""
    (aa, ab), (ba, bb) = moves.tolist()
    back, a, b = [], 0.0, 0.0
    for k, s in enumerate(score.tolist()):
        if k == 0:
            a, b = 0.0, s
            continue
        to_a, to_b = b + ba >= a + aa, b + bb >= a + ab
        back.append((to_a, to_b))
        a, b = (b + ba if to_a else a + aa), (b + bb if to_b else a + ab) + s
    out = np.zeros(len(score), bool)
    label = b >= a
    for k in range(len(score) - 1, -1, -1):
        out[k] = label
        if k:
            label = back[k - 1][1] if label else back[k - 1][0]
    return out


def fitted(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    sample = labelled_sample(documents, labels, rows)

    def start():
        def of(column):
            out = []
            for _, _, data, offs in text_chunks(column):
                words = Words(data, offs)
                lines = Lines(data, offs, words)
                x = line_features(data, words, lines).astype(np.float32)
                out += [x[a:b].ravel() if b - a <= SAMPLE_LINES else None for a, b in zip(lines.first[:-1], lines.first[1:])]
            return [pa.array(out, pa.list_(pa.float32()))]

        return of

    got = appended(sample, "text", {"x": "array<float>"}, start, ("doc_id", "quality")).filter("size(x) > 0").orderBy("doc_id").toArrow()
    # Views of the Arrow buffer: a list of Python numbers would take eight times its bytes on the driver.
    held = got["x"].combine_chunks()
    values, cuts = held.values.to_numpy(), held.offsets.to_numpy()
    return fit([values[a:b].reshape(-1, len(LINE_FEATURES)) for a, b in zip(cuts[:-1], cuts[1:])], got["quality"].to_pylist())


def judge(df: DataFrame, field: tuple[np.ndarray, np.ndarray], text: str = "text", keep: tuple[str, ...] | None = None, prefix: str = "") -> DataFrame:
    """The frame's columns (or `keep`) with the base counts, base_failed, the numbers of lines and of content lines (with a word), content_share and kept."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def start():
        weights, moves = shared.value

        def of(column):
            parts: list[list[np.ndarray]] = [[] for _ in range(len(BASE) + 5)]
            for _, _, data, offs in text_chunks(column):
                words = Words(data, offs)
                lines = Lines(data, offs, words)
                counts = base_counts(data, offs, words, lines)
                score = line_features(data, words, lines) @ weights
                content = np.concatenate([viterbi(score[a:b], moves) for a, b in zip(lines.first[:-1], lines.first[1:])])
                inside = np.bincount(lines.doc[content], lines.words[content], len(offs) - 1)
                n, repeats = counts["n_words"], counts["n_repeat_words"]
                share = inside / np.maximum(n, 1)
                full = lines.words > 0
                n_lines, n_content = (np.bincount(lines.doc[of], minlength=len(offs) - 1) for of in (full, full & content))
                failed = (n < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
                for p, v in zip(parts, [*(counts[k] for k in BASE), n_lines, n_content, failed, share, ~failed & (share >= LEAST_SHARE)]):
                    p.append(v)
            kinds = [pa.int64()] * (len(BASE) + 2) + [pa.bool_(), pa.float64(), pa.bool_()]
            return [pa.array(np.concatenate(p) if p else np.zeros(0), k) for p, k in zip(parts, kinds)]

        return of

    fields = {f"{prefix}{n}": "bigint" for n in (*BASE, "n_lines", "n_content_lines")} | {f"{prefix}base_failed": "boolean", f"{prefix}content_share": "double", f"{prefix}kept": "boolean"}
    return appended(df, text, fields, start, keep)
