"""Secret scans: fixed patterns, and a character convolutional network over every candidate and the text around it.

Base findings are the leftmost matches of three patterns in whole texts (`assign`, `access`, `hex`). Candidates are all runs of
`[A-Za-z0-9+/_.-]` of LEAST_RUN or more characters that hold a digit, or an upper-case letter after a lower-case one, and lie outside base
findings, and all runs that the value of one covers in part (a keyword is no candidate). A candidate is seen in windows of LEFT bytes before, up to CORE of its own and what follows, as many as
it needs. The network embeds bytes, convolves, takes the greatest response before, inside and behind the candidate, and ends in a small
dense layer; all of it is numpy, forward and backward.

It learns from labelled findings: windows of candidates that a base pattern covers against windows of those that none covers, all
different ones of documents that are not held out. Each is shown as it stands and in upper case, and both again with the text before it
blanked, so that the network has to know a secret by itself too. Training is by parameter mixing: windows are dealt by hash into shards of
about SHARD, every shard goes on from the same network through all of its windows, and the mean of what they reach begins the next of
EPOCHS rounds. The network that judges is trained on all windows. Beside it, each of FOLDS others leaves out a fold (by hash) and gives the
logits of that fold, so that every window has one from a network that has not seen it. On all of these, scores are calibrated to
probabilities (a logistic curve, its Newton steps from sums), and the threshold is the greatest that still finds LEAST_RECALL of the
labelled findings, shown in all ways. What no pattern covers is shown as clean, so a kind of secret that is common in the corpus and in no
pattern is learned as clean. Candidates outside base findings whose greatest window reaches the threshold become spans of kind `model`;
base spans all stay. Only sums, means and counts of a fixed number reach the driver.

Cases: null and empty texts have no spans; a text of any length is read whole, a long candidate through more windows; places are code
points; spans of one place are in the order of KINDS; repeated rows get equal results; rows without an id are held out or not by the
empty string, and scanned; unless windows of both labels lie in two folds or more nothing is added to the base; an empty table gives no
rows; a kept column that has a result's name is an error.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import Words, appended, dropped, held_out, least_by_hash, text_chunks, written

KINDS = ("assign", "access", "hex", "model")
KEYWORD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN = re.compile(KEYWORD.encode() + rb"""\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 6, 20, 24, 8

LEFT, CORE, RIGHT = 24, 32, 8
WIDTH = LEFT + CORE + RIGHT
EMBED, TAP, FILTERS, HIDDEN = 6, 5, 16, 16
LEAST_STEPS, EPOCHS, BATCH, RATE = 600, 6, 128, 4e-3
#: Windows that a shard trains on, and how many of each class at least: a rarer class goes to several shards.
SHARD, LEAST_OF_CLASS = 4_096, 256
#: Networks that leave a fold out; the network of that number leaves out none.
FOLDS = 4
LEAST_RECALL = 0.95
#: Windows that the network takes at once.
AT_ONCE = 4_096


def outside(members: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(members)] = False
    return out


DIGITS, LOWER, UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
NOT_HEX, NOT_RUN = outside(DIGITS + b"abcdef"), outside(DIGITS + LOWER + UPPER + b"+/_.-")


def base_spans(raw: bytes, data: np.ndarray, offs: np.ndarray, named: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes of a chunk, in order; `named` tells which documents hold a keyword with a sign behind it."""
    found = []
    for d in np.flatnonzero(named).tolist():
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw, offs[d], offs[d + 1]) if m.end(2) - m.start(2) >= LEAST_VALUE]
    at, seen = raw.find(b"AKIA"), -1
    while at >= 0:
        d = int(np.searchsorted(offs, at, "right")) - 1
        if d != seen:
            found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw, offs[d], offs[d + 1]) if m.end() - m.start() >= LEAST_ACCESS]
            seen = d
        at = raw.find(b"AKIA", at + 1)
    hexes = Words(data, offs, NOT_HEX)
    long = hexes.ends - hexes.starts >= LEAST_HEX
    return sorted(found + [(a, 2, b, a) for a, b in zip(hexes.starts[long].tolist(), hexes.ends[long].tolist())])


def total(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def covered(size: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Running number of bytes inside any of the spans."""
    edge = np.zeros(size + 1, np.int64)
    for s, e in spans:
        edge[s] += 1
        edge[e] -= 1
    return total(np.cumsum(edge)[:-1] > 0)


def candidates(data: np.ndarray, offs: np.ndarray, spans: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, whether a base value covers a part) of all candidates of a chunk."""
    runs = Words(data, offs, NOT_RUN)
    a, b = runs.starts, runs.ends
    kinds = [~outside(c)[data] for c in (DIGITS, UPPER, LOWER)]
    turned = np.zeros(len(data), bool)
    turned[1:] = kinds[1][1:] & kinds[2][:-1]
    turned[a] = False
    digits, turns = total(kinds[0]), total(turned)
    take = (b - a >= LEAST_RUN) & ((digits[b] > digits[a]) | (turns[b] > turns[a]))
    inside = np.zeros(len(a), bool)
    if spans:
        values, whole = covered(len(data), [(v, e) for _, _, e, v in spans]), covered(len(data), [(s, e) for s, _, e, _ in spans])
        inside = values[b] > values[a]
        take = take & (whole[b] == whole[a]) | inside
    return runs.doc[take], a[take], b[take], inside[take]


def windows(data: np.ndarray, lo: int, hi: int, start: int, end: int) -> bytes:
    """The windows of a candidate of the document at lo .. hi: for each, how many bytes of it are the candidate's, and its bytes; zero beyond the document.

    Each begins CORE bytes after the one before; the last ends with the candidate, so that none sees a mere rest of it.
    """
    out = bytearray()
    for at in [*range(start, end - CORE, CORE), max(start, end - CORE)]:
        a, b = at - LEFT, at + CORE + RIGHT
        held = bytes(max(0, lo - a)) + data[max(a, lo) : min(b, hi)].tobytes()
        out += bytes([min(CORE, end - at)]) + held + bytes(WIDTH - len(held))
    return bytes(out)


def scanned(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The frame's columns (or `keep`) with base (start, kind, end) and candidates (start, end, found, windows); places are code points."""

    def start():
        def of(column):
            base, runs = [], []
            named = pc.fill_null(pc.match_substring_regex(column, KEYWORD, ignore_case=True), False).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in text_chunks(column):
                spans = base_spans(data.tobytes(), data, offs, named[lo:hi])
                points = total((data & 0xC0) != 0x80)
                own, tried = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                where = (np.searchsorted(offs, [s for s, _, _, _ in spans], "right") - 1).tolist()
                for d, (s, k, e, _) in zip(where, spans):
                    own[d].append({"start": points[s] - points[offs[d]], "kind": k, "end": points[e] - points[offs[d]]})
                for d, s, e, f in zip(*(x.tolist() for x in candidates(data, offs, spans))):
                    first = points[offs[d]]
                    tried[d].append({"start": points[s] - first, "end": points[e] - first, "found": f, "windows": windows(data, int(offs[d]), int(offs[d + 1]), s, e)})
                base += own
                runs += tried
            return [pa.array(base, BASE), pa.array(runs, RUNS)]

        return of

    return appended(df, text, {"base": "array<struct<start:bigint,kind:int,end:bigint>>", "candidates": "array<struct<start:bigint,end:bigint,found:boolean,windows:binary>>"}, start, keep)


BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("found", pa.bool_()), ("windows", pa.binary())]))


def opened(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each window, length of the candidate's part)."""
    grid = np.frombuffer(held, np.uint8).reshape(-1, WIDTH + 1)
    return grid[:, 1:], grid[:, 0].astype(np.int64)


@dataclass(frozen=True)
class Net:
    embed: np.ndarray  # (256, EMBED)
    kernel: np.ndarray  # (TAP, EMBED, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray  # (3 FILTERS + 1, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN + 1,)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def forward(self, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(logit, dense input, hidden layer, place of the greatest response in each region) of some windows."""
        x = self.embed[grid]
        last = WIDTH - TAP + 1
        response = self.bias + sum(x[:, k : k + last] @ self.kernel[k] for k in range(TAP))
        center = np.arange(last)[None, :] + TAP // 2
        ends = LEFT + length[:, None]
        places, best = [], []
        for region in (center < LEFT, (center >= LEFT) & (center < ends), center >= ends):
            seen = np.where(region[:, :, None], response, -1)
            at = seen.argmax(axis=1)
            places.append(at)
            best.append(np.maximum(np.take_along_axis(seen, at[:, None, :], 1)[:, 0], 0))
        dense = np.concatenate([*best, length[:, None] / CORE], axis=1).astype(np.float32)
        layer = np.maximum(dense @ self.hidden + self.hidden_bias, 0)
        return layer @ self.out[:-1] + self.out[-1], dense, layer, np.stack(places, axis=1)

    def logits(self, grid: np.ndarray, length: np.ndarray) -> np.ndarray:
        parts = [self.forward(grid[k : k + AT_ONCE], length[k : k + AT_ONCE])[0] for k in range(0, len(grid), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def chance(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -50, 50)))

    def probability(self, grid: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.chance(self.logits(grid, length))

    def gradient(self, grid: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by back-propagation; only the places of greatest response pass it on."""
        z, dense, layer, places = self.forward(grid, length)
        dz = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)).astype(np.float32)
        d_layer = dz[:, None] * self.out[:-1] * (layer > 0)
        d_best = ((d_layer @ self.hidden.T)[:, :-1] * (dense[:, :-1] > 0)).reshape(len(y), 3, FILTERS)
        d_embed, d_kernel = np.zeros_like(self.embed), np.zeros_like(self.kernel)
        rows = np.arange(len(y))[:, None, None]
        for k in range(TAP):
            seen = grid[rows, places + k]
            d_kernel[k] = np.einsum("nrf,nrfe->ef", d_best, self.embed[seen])
            flow = d_best[..., None] * self.kernel[k].T
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(seen.ravel(), flow[..., e].ravel(), 256)
        return {
            "embed": d_embed, "kernel": d_kernel, "bias": d_best.sum(axis=(0, 1)), "hidden": dense.T @ d_layer, "hidden_bias": d_layer.sum(axis=0),
            "out": np.append(layer.T @ dz, dz.sum()),
        }


def started(seed: int = 1) -> Net:
    rnd = np.random.default_rng(seed)
    draw = lambda *shape: rnd.normal(0, 1, shape).astype(np.float32)
    return Net(
        0.5 * draw(256, EMBED), draw(TAP, EMBED, FILTERS) / np.sqrt(TAP * EMBED), np.zeros(FILTERS, np.float32), draw(3 * FILTERS + 1, HIDDEN) / np.sqrt(3 * FILTERS), np.zeros(HIDDEN, np.float32),
        np.append(draw(HIDDEN) / np.sqrt(HIDDEN), 0).astype(np.float32),
    )


PARTS = ("embed", "kernel", "bias", "hidden", "hidden_bias", "out")


@dataclass(frozen=True)
class Training:
    """A network between steps of Adam: its parameters, the running means of gradients and of their squares, and the number of steps."""

    net: Net
    mean: dict[str, np.ndarray]
    square: dict[str, np.ndarray]
    step: float

    def numbers(self) -> np.ndarray:
        each = [part[name] for part in ({n: getattr(self.net, n) for n in PARTS}, self.mean, self.square) for name in PARTS]
        return np.concatenate([*(x.ravel() for x in each), [self.step]]).astype(np.float64)


def resumed(numbers: np.ndarray) -> Training:
    net, at, read = started(), 0, []
    for _ in range(3):
        read.append({})
        for name in PARTS:
            shape = getattr(net, name).shape
            read[-1][name] = numbers[at : (at := at + int(np.prod(shape)))].reshape(shape).astype(np.float32)
    return Training(replace(net, **read[0]), read[1], read[2], float(numbers[at]))


def untrained() -> np.ndarray:
    net = started()
    nothing = {name: np.zeros_like(getattr(net, name)) for name in PARTS}
    return Training(net, nothing, nothing, 0).numbers()


def advanced(numbers: np.ndarray, grid: np.ndarray, length: np.ndarray, y: np.ndarray, *seed: int) -> np.ndarray:
    """Steps of Adam through all windows: batches take half from each class, the larger one once, the smaller as often as that takes."""
    now, rnd, half = resumed(numbers), np.random.default_rng([2, *seed]), BATCH // 2
    net, mean, square, step = now.net, now.mean, now.square, now.step
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    steps = max(LEAST_STEPS // EPOCHS, *(-(-len(side) // half) for side in sides))
    turns = [np.concatenate([rnd.permutation(side) for _ in range(-(-steps * half // len(side)))]) for side in sides]
    for at in range(0, steps * half, half):
        some = np.concatenate([turn[at : at + half] for turn in turns])
        step += 1
        moved = {}
        mean, square = dict(mean), dict(square)
        for name, g in net.gradient(grid[some], length[some], y[some]).items():
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.999 * square[name] + 0.001 * g * g
            move = RATE * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
            moved[name] = (getattr(net, name) - move).astype(np.float32)
        net = replace(net, **moved)
    return Training(net, mean, square, step).numbers()


def trained(grid: np.ndarray, length: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Net:
    """A network fitted to windows at hand, as `mixed_rounds` fits several to a table of them."""
    numbers = untrained()
    for turn in range(epochs):
        numbers = advanced(numbers, grid, length, y, turn, 0)
    return resumed(numbers).net


def logistic(good: int, bad: int, sums: Callable[[float, float, float, float], tuple[float, ...]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps. `sums` gets both, then the smoothed targets of good and bad, and sums over all
    logits z with p their probability, t their target and w = p (1 - p): z z w, z w, w, z (t - p), t - p."""
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        zzw, zw, w, zr, r = sums(*beta.tolist(), (good + 1) / (good + 2), 1 / (bad + 2))
        step = np.linalg.solve(np.array([[zzw, zw], [zw, w]]) + 1e-3 * np.eye(2), np.array([zr, r]) - 1e-3 * (beta - [1, 0]))
        beta = beta + np.clip(step, -1, 1)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def allowed(good: int, recall: float) -> int:
    """How many of so many findings may be missed."""
    return int(np.floor((1 - recall) * good))


def calibrated(net: Net, grid: np.ndarray, length: np.ndarray, y: np.ndarray, recall: float = LEAST_RECALL) -> Net:
    """The network with a logistic curve fitted to its logits on windows at hand, and the greatest threshold of that recall; `calibrated_on` does the same to a table of logits."""
    return calibrated_by(net, net.logits(grid, length), y, recall)


def calibrated_by(net: Net, z: np.ndarray, y: np.ndarray, recall: float = LEAST_RECALL) -> Net:
    good = int(y.sum())

    def sums(slope, shift, t_good, t_bad):
        p = 1 / (1 + np.exp(-np.clip(slope * z.astype(np.float64) + shift, -50, 50)))
        w, r = p * (1 - p), np.where(y == 1, t_good, t_bad) - p
        return (z * z * w).sum(), (z * w).sum(), w.sum(), (z * r).sum(), r.sum()

    slope, shift = logistic(good, len(y) - good, sums)
    net = replace(net, slope=slope, shift=shift)
    return replace(net, threshold=float(np.sort(net.chance(z[y == 1]))[allowed(good, recall)]))


#: In how many ways `shown` shows a window.
WAYS = 4


def shown(grid: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as they stand and in upper case, each also with the text before the candidate blanked."""
    upper = np.where((grid >= 97) & (grid <= 122), grid - 32, grid).astype(np.uint8)
    blank = np.concatenate([grid, upper])
    blank[:, :LEFT] = 0
    return np.concatenate([grid, upper, blank]), np.tile(length, WAYS), np.tile(y, WAYS)


def different(found: DataFrame) -> DataFrame:
    """(window, found) for every different window of documents that are not held out; one found anywhere is found."""
    size = WIDTH + 1
    each = found.filter(~held_out()).select(F.explode("candidates").alias("c")).select("c.found", F.explode(F.expr(f"transform(sequence(0, length(c.windows) div {size} - 1), k -> substring(c.windows, k * {size} + 1, {size}))")).alias("window"))
    return each.groupBy("window").agg(F.max("found").alias("found"))


def labelled(found: DataFrame, positives: int = 6_000, negatives: int = 12_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, lengths, labels) of at most so many of `different`, those of least hash: to look at, not what the network learns from."""
    table = written(different(found), "windows")
    parts = [least_by_hash(table.filter(F.col("found") == label), bound, "window") for label, bound in ((True, positives), (False, negatives))]
    got = parts[0].unionByName(parts[1]).orderBy(F.xxhash64("window"), "window").toArrow()
    dropped(table)
    grid, length = opened(b"".join(got["window"].to_pylist()))
    return grid, length, got["found"].to_numpy().astype(np.int64)


def fold():
    """The fold of a window, by bits of its hash that do not decide its shard."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64("window"), 48), F.lit(FOLDS)).cast("int")


def dealt(train: DataFrame, bad: int, good: int) -> tuple[DataFrame, int]:
    """(window, found, shard) and the number of shards. Every window has a shard by its hash; those of a rare class go to the following ones too."""
    shards = max(1, -(-(bad + good) // SHARD))
    times = F.when(F.col("found"), min(shards, -(-LEAST_OF_CLASS * shards // good))).otherwise(min(shards, -(-LEAST_OF_CLASS * shards // bad)))
    own = F.explode(F.sequence(F.lit(0), times - 1)).alias("k")
    return train.select("window", "found", own).select("window", "found", F.expr(f"pmod(xxhash64(window) + k, {shards})").cast("int").alias("shard")), shards


def going_on(numbers: list[np.ndarray], turn: int):
    """The work of a network's shard in a round: what its training reaches from these numbers, by place."""

    def of(shard):
        shard = shard.sort_by("window")
        net, number = shard["net"][0].as_py(), shard["shard"][0].as_py()
        grid, length = opened(b"".join(shard["window"].to_pylist()))
        y = shard["found"].to_numpy().astype(np.int64)
        reached = advanced(numbers[net], *shown(grid, length, y), turn, number) if 0 < y.sum() < len(y) else numbers[net]
        return pa.table({"net": pa.array(np.full(len(reached), net), pa.int32()), "at": pa.array(np.arange(len(reached)), pa.int32()), "value": pa.array(reached, pa.float64())})

    return of


def mixed_rounds(windows: DataFrame, many: list[tuple[int, int]], epochs: int = EPOCHS) -> list[Net]:
    """A network for each fold, trained on all windows of the others, and one trained on all windows; `many` has the numbers of both classes by fold.

    In each round every shard of a network goes on from the mean of the round before.
    """
    parts, partitions = [], 0
    for k in range(FOLDS + 1):
        bad, good = (sum(n[label] for j, n in enumerate(many) if j != k) for label in (0, 1))
        part, shards = dealt(windows.filter(F.col("fold") != k), bad, good)
        parts.append(part.withColumn("net", F.lit(k)))
        partitions += 2 * shards
    # More partitions than shards, so that few of them hold two. Sums are of decimals, which no order of rows changes.
    table = functools.reduce(DataFrame.unionByName, parts).repartition(partitions, "net", "shard")
    numbers = [untrained()] * (FOLDS + 1)
    for turn in range(epochs):
        reached = table.groupBy("net", "shard").applyInArrow(going_on(numbers, turn), "net int, at int, value double")
        mean = reached.groupBy("net", "at").agg((F.sum(F.col("value").cast("decimal(30,22)")).cast("double") / F.count("*")).alias("value"))
        numbers = np.split(mean.orderBy("net", "at").toArrow()["value"].to_numpy(), FOLDS + 1)
    return [resumed(x).net for x in numbers]


def logits_of(windows: DataFrame, nets: list[Net]) -> DataFrame:
    """(found, z, place) of every window in all the ways it is shown, by the network that left its fold out; places are whole numbers in the order of the logits."""
    shared = windows.sparkSession.sparkContext.broadcast(nets)

    def run(batches):
        for batch in batches:
            grid, length = opened(b"".join(batch.column("window").to_pylist()))
            folds, found = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "found"))
            for k in np.unique(folds).tolist():
                *seen, y = shown(grid[folds == k], length[folds == k], found[folds == k])
                z = (shared.value[k].logits(*seen) + 0.0).astype(np.float32)
                bits = z.view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(z.astype(np.float64)), pa.array(bits ^ ((bits >> 31) & 0x7FFFFFFF), pa.int32())], names=["found", "z", "place"])

    return windows.select("window", "found", "fold").mapInArrow(run, "found boolean, z double, place int")


def ranked_logit(places: DataFrame, rank: int) -> np.ndarray:
    """The logit of that rank (from 0), by counts of the upper, then the lower half of its place: at most 65,536 numbers each."""
    upper, lower = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFFFF)

    def chosen(frame, half, rank):
        counts = frame.groupBy(half.alias("half")).count().orderBy("half").toArrow()
        upto = np.cumsum(counts["count"].to_numpy())
        k = int(np.searchsorted(upto, rank, "right"))
        return counts["half"][k].as_py(), rank - (int(upto[k - 1]) if k else 0)

    high, rank = chosen(places, upper, rank)
    low, _ = chosen(places.filter(upper == high), lower, rank)
    bits = np.array([(high << 16) | low], np.int32)
    return (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.float32)


def calibrated_on(logits: DataFrame, net: Net, bad: int, good: int, recall: float = LEAST_RECALL) -> Net:
    """The network with the logistic curve and the threshold of a table of so many logits."""

    def sums(slope, shift, t_good, t_bad):
        z = F.col("z")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), slope * z + shift))))
        w, r = p * (1 - p), F.when(F.col("found"), t_good).otherwise(t_bad) - p
        return [float(x) for x in logits.select(*(F.sum(x.cast("decimal(30,18)")) for x in (z * z * w, z * w, w, z * r, r))).first()]

    slope, shift = logistic(good, bad, sums)
    net = replace(net, slope=slope, shift=shift)
    missed = allowed(good, recall)
    least = ranked_logit(logits.filter("found").select("place"), missed if slope > 0 else good - 1 - missed)
    return replace(net, threshold=float(net.chance(least)[0]))


def fitted(found: DataFrame) -> Net:
    """The network for the findings of `scanned`: trained on all their different windows, calibrated on what networks say of windows they have not seen."""
    windows = written(different(found).withColumn("fold", fold()), "windows")
    counts = {(r["fold"], r["found"]): r["count"] for r in windows.groupBy("fold", "found").count().collect()}
    many = [(counts.get((k, False), 0), counts.get((k, True), 0)) for k in range(FOLDS)]
    bad, good = map(sum, zip(*many))
    net = started()
    if all(bad > b and good > g for b, g in many):
        *apart, net = mixed_rounds(windows, many)
        logits = written(logits_of(windows, apart), "logits")
        net = calibrated_on(logits, net, WAYS * bad, WAYS * good)
        dropped(logits)
    dropped(windows)
    return net


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def judged(found: DataFrame, net: Net, keep: tuple[str, ...]) -> DataFrame:
    """`keep` with the numbers of base spans by kind, base_sha256, spans, and the number of spans that the network added."""
    shared = found.sparkSession.sparkContext.broadcast(net)

    def start():
        def of(column):
            out = [[] for _ in range(6)]
            base, tried = (pc.struct_field(column, k).to_pylist() for k in ("base", "candidates"))
            open_runs = [(d, c) for d, row in enumerate(tried) for c in row if not c["found"]]
            grid, length = opened(b"".join(c["windows"] for _, c in open_runs))
            chance = shared.value.probability(grid, length)
            many = np.array([len(c["windows"]) // (WIDTH + 1) for _, c in open_runs], np.int64)
            best = np.maximum.reduceat(chance, np.cumsum(many) - many) if len(many) else chance
            added = [[] for _ in base]
            for (d, c), p in zip(open_runs, best.tolist()):
                if p >= shared.value.threshold:
                    added[d].append((c["start"], 3, c["end"]))
            for row, more in zip(base, added):
                spans = [(s["start"], s["kind"], s["end"]) for s in row]
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                for o, v in zip(out, [*counts, hashlib.sha256(written_out(spans).encode()).hexdigest(), written_out(sorted(spans + more)), len(more)]):
                    o.append(v)
            return [pa.array(o, t) for o, t in zip(out, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()])]

        return of

    fields = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string", "n_model": "bigint"}
    return appended(found.withColumn("__both__", F.struct("base", "candidates")), "__both__", fields, start, keep)


def scan(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All spans of every document: texts are read once, findings and candidates are written, the network is fitted on them and judges them."""
    found = written(scanned(documents, keep=tuple(dict.fromkeys([*keep, "doc_id"]))), "findings")
    return judged(found, fitted(found), keep)
