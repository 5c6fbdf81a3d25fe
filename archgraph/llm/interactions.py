"""Filter interaction audit: what five filters remove in every order, alone and together, for each source.

Each document gets five failure flags. One SQL CUBE over the flags and the source sums documents, good and toxic ones; its rows whose
selected flags are all false are the survivors of that subset of filters. A step of an order goes from one subset to the
subset with one filter more, so joining those pairs of subsets gives what a filter removes after any others; an order is five
such pairs.

Flags: A fewer than LEAST_WORDS words; B fewer distinct words than DISTINCT_PERCENT percent; C more `[A-Z]` than UPPER_PERCENT percent of the
code points; D a sign of `[#$%&*|]`; E a text that a smaller doc_id has too, in the whole table.

Cases: a null text is empty (A alone, and E behind a smaller id); a null source is the empty string; a null doc_id comes before and after
none, so E is false for it and it makes none true; rows that repeat an id and its text count each and are not copies of each
other; a label that is repeated counts once, 1 if any row says so; null labels are neither good nor toxic; very long texts pass through one
row of the scan and leave as flags and a digest; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from functools import reduce
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import written

LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
LETTERS = "ABCDE"
ALL = 2 ** len(LETTERS) - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUMS = ("n", "good", "toxic")


def verdicts(documents: DataFrame) -> DataFrame:
    """doc_id, part, the flags A to D and a digest of the text, for each row."""
    text = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n, chars = F.size("words"), F.length("text")
    return words.select(
        "doc_id", "part",
        (n < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n).alias("B"),
        (100 * (chars - F.length(F.translate("text", UPPER, ""))) > UPPER_PERCENT * chars).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """The rows with flag E. The join is on text and id together, so a text that fills a third of the table is no hot key."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("first")


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones for each part and combination of flags: at most 32 rows for each part."""
    marks = labels.groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    rows = with_copies(written(verdicts(documents), "verdicts")).join(marks, "doc_id", "left")
    return rows.groupBy("part", *LETTERS).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS[1:]])


def survivors(found: DataFrame) -> DataFrame:
    """part, subset (a bit for each filter of it) and the sums of the documents that pass the whole subset: 32 rows for each part, zeros included."""
    subset = reduce(lambda a, b: a + b, [(1 - F.grouping(x)).cast("int") * 2**k for k, x in enumerate(LETTERS)])
    passed = reduce(lambda a, b: a & b, [~F.coalesce(F.col(x), F.lit(False)) for x in LETTERS])
    cube = found.cube("part", *LETTERS).agg(F.grouping("part").alias("all_parts"), subset.alias("subset"), *[F.sum(c).alias(c) for c in SUMS])
    whole = found.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    kept = cube.filter("all_parts = 0").filter(passed).select("part", "subset", *SUMS)
    return whole.join(kept, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS])


def pairs(found: DataFrame) -> DataFrame:
    """part, before (a subset), letter (a filter outside it), and what goes when that filter follows that subset: 80 rows for each part."""
    after = found.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in SUMS])
    steps = found.withColumn("bit", F.explode(F.array(*[F.lit(k) for k in range(len(LETTERS))]))).filter("(shiftright(subset, bit) & 1) = 0")
    steps = steps.withColumn("after", F.expr("subset | shiftleft(1, bit)")).join(after, ["part", "after"])
    return steps.select("part", F.col("subset").alias("before"), F.expr(f"substring('{LETTERS}', bit + 1, 1)").alias("letter"), F.col("n_after").alias("kept"), *[(F.col(c) - F.col(f"{c}_after")).alias(f"{c}_lost") for c in SUMS])


def orders() -> list[tuple[str, int, str, int]]:
    """(order, step, its filter, the subset before it) for all permutations: 600 rows."""
    return [("".join(p), k + 1, x, sum(1 << LETTERS.index(y) for y in p[:k])) for p in itertools.permutations(LETTERS) for k, x in enumerate(p)]


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    found = written(survivors(cells(documents, labels)), "survivors")
    step = pairs(found)
    # A subset of k filters stands before a given filter in k! (4 - k)! of the orders.
    weights = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(LETTERS) - 1 - k)) for k in range(len(LETTERS))]), F.bit_count("before") + 1)
    alone = step.groupBy("part", "letter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("n_lost"))).alias("fails"),
        F.sum(F.when(F.bit_count("before") == len(LETTERS) - 1, F.col("n_lost"))).alias("unique_fails"),
        F.sum(F.col("n_lost") * weights).alias("shapley"),
    )
    plan = documents.sparkSession.createDataFrame(orders(), "filter_order string, step int, letter string, before int")
    return (
        step.join(alone, ["part", "letter"]).join(F.broadcast(plan), ["letter", "before"])
        .select("part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"), "unique_fails", F.col("good_lost"), F.col("toxic_lost"), "shapley")
    )
