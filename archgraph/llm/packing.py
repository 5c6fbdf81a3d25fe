"""Packing: optimal length buckets and token-budget batches.

The histogram of lengths over the whole table decides the buckets: dynamic programming chooses at most `buckets` upper bounds
such that padding every document to its bucket's bound costs least. The cost of a bucket is linear in its bound, so each
step takes the lower envelope of lines in one pass. Inside a bucket, batches of floor(budget / bound) documents (at
least one) are filled in order of slice, length and id.

Ranks without one large task: a bucket is dealt by hash into slices of about SLICE_ROWS rows, slices are counted, and a row's rank is its slice's
offset plus its place in the slice. Only ids and lengths move, never texts. The histogram that reaches the driver has one
row for each different length: of W words in all at most sqrt(2 W), since that many different lengths add up to W.

Cases: a null or empty text has length 0 and goes to the lowest bucket; a document longer than the budget is a batch of its
own; equal ids and lengths are told apart by the row's hash order; an empty table gives no rows; only the id and the text are read,
so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archgraph.llm.common import written

BUCKETS, BUDGET, SLICE_ROWS = 16, 65_536, 50_000


def word_count(text: str = "text"):
    """The number of words [^\\x20\\x09-\\x0D]+ of a text, as a bigint column."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Buckets:
    bounds: tuple[int, ...]
    padding: int


def optimal(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> Buckets:
    """Bounds of least total padding for (length, documents) pairs."""
    pairs = sorted(histogram)
    if not pairs:
        return Buckets((), 0)
    lengths, counts = [p[0] for p in pairs], [p[1] for p in pairs]
    n = len(pairs)
    docs, tokens = [0], [0]
    for x, c in zip(lengths, counts):
        docs.append(docs[-1] + c)
        tokens.append(tokens[-1] + x * c)
    # best[j]: least padded size of the first j lengths; each bucket from i to j costs lengths[j - 1] * (docs[j] - docs[i]).
    best: list[float] = [0] + [float("inf")] * n
    choices: list[list[int]] = []
    for _ in range(min(buckets, n)):
        new, choice = [float("inf")] * (n + 1), [0] * (n + 1)
        hull: list[int] = []
        at = 0

        def beats(a: int, b: int, c: int) -> bool:
            """The line of b is nowhere lowest between those of a and c (slopes -docs fall from a to c)."""
            return (best[c] - best[a]) * (docs[b] - docs[a]) <= (best[b] - best[a]) * (docs[c] - docs[a])

        for j in range(1, n + 1):
            i = j - 1
            if best[i] < float("inf"):
                while len(hull) >= 2 and beats(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - x * docs[hull[at + 1]] <= best[hull[at]] - x * docs[hull[at]]:
                at += 1
            i = hull[at]
            new[j], choice[j] = best[i] + x * (docs[j] - docs[i]), i
        best = new
        choices.append(choice)
    # With no more buckets than lengths, using all of them is never worse.
    bounds, j = [], n
    for choice in reversed(choices):
        bounds.append(lengths[j - 1])
        j = choice[j]
    return Buckets(tuple(sorted(bounds)), int(best[n] - tokens[n]))


def pack(df: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", length=None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), padded_to, batch_id (from 0 in each bucket), batch_docs and padding of its batch's row."""
    rows = written(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), (word_count() if length is None else length).cast("bigint").alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    sized = rows.groupBy("n_tokens").count().collect()
    bounds = optimal([(r[0], r[1]) for r in sized], buckets).bounds
    if not bounds:
        return rows.select("doc_id", "n_tokens", *(F.lit(0).cast(t).alias(n) for n, t in (("bucket", "int"), ("padded_to", "bigint"), ("batch_id", "bigint"), ("batch_docs", "bigint"), ("padding", "bigint"))))
    per_bucket = [0] * len(bounds)
    for n_tokens, count in ((r[0], r[1]) for r in sized):
        per_bucket[next(k for k, b in enumerate(bounds) if n_tokens <= b)] += count
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
    # Plans of each bucket as small literal arrays, looked up by its number.
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), F.col("bucket") + 1)
    slices = [max(1, -(-n // slice_rows)) for n in per_bucket]
    room = [max(1, budget // max(1, b)) for b in bounds]
    dealt = rows.withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_tokens", "row"), at(slices)))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket", "slice").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select("bucket", "slice", "offset")
    place = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("n_tokens", "doc_id", "row")) - 1
    ranked = dealt.withColumn("place", place).join(offsets, ["bucket", "slice"]).withColumn("rank", F.col("offset") + F.col("place"))
    batch = F.floor(F.col("rank") / at(room)).cast("bigint")
    held = F.least(at(room), at(per_bucket) - F.col("batch_id") * at(room))
    return (
        ranked.withColumn("batch_id", batch)
        .withColumn("padded_to", at(bounds))
        .select("doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "padded_to", "batch_id", held.alias("batch_docs"), (F.col("padded_to") - F.col("n_tokens")).alias("padding"))
    )
