"""Which texts contain which names, at any place: an index of short grams, keyed by the rarest gram of each name.

No text is compared with all names. A text that contains a name contains every gram of it, so a name is filed under that of its
grams that the fewest texts have, and meets the texts of that gram alone; there the containment is checked. A name with a gram that no
text has meets none. The texts of a frequent gram are dealt into slices, and the names filed under it go to each.

Exploded grams look small to the planner, which would send them through the driver, so joins with them are merges. Only the grams under which
names are filed are dealt out; where these are few, which is bounded, they alone are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.sources.shared import written

GRAM, SLICE_TEXTS = 3, 20_000
#: How many grams of names may be broadcast.
FEW_GRAMS = 50_000


def grams(text: Column, size: int) -> Column:
    """The different runs of `size` characters of a text, none if it is shorter."""
    n = F.length(text)
    return F.array_distinct(F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def containing(left: DataFrame, text: str, right: DataFrame, name: str, gram: int = GRAM, slice_texts: int = SLICE_TEXTS) -> DataFrame:
    """All rows of `left` with each row of `right` whose `name` stands in their `text`. Null and empty names and null texts meet nothing."""
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"names that both sides have: {sorted(clash)}")
    texts = left.filter(F.col(text).isNotNull())
    names = right.filter(F.coalesce(F.col(name), F.lit("")) != "").withColumn("__name", F.col(name))
    different = texts.select(F.col(text).alias("t")).distinct()
    asked = names.select("__name").distinct()
    # A name shorter than a gram is its own gram.
    filed = asked.select("__name", F.explode(F.when(F.length("__name") >= gram, grams(F.col("__name"), gram)).otherwise(F.array("__name"))).alias("gram"))
    found = different.select("t", F.explode(F.flatten(F.array(*[grams(F.col("t"), k) for k in range(1, gram + 1)]))).alias("gram"))
    frequency = found.groupBy("gram").agg(F.count("*").alias("texts"))
    # A gram without a text leaves its names without one: they fall here, since a name is kept only with all of its grams known.
    known = filed.hint("merge").join(frequency, "gram").groupBy("__name").agg(F.min(F.struct("texts", "gram")).alias("rarest"), F.count("*").alias("known"))
    total = F.when(F.length("__name") >= gram, F.size(grams(F.col("__name"), gram))).otherwise(1)
    keyed = written(known.filter(F.col("known") == total).select("__name", "rarest.gram", F.ceil(F.col("rarest.texts") / slice_texts).cast("int").alias("slices")), "names")
    slices = keyed.select("gram", "slices").distinct()
    slices = F.broadcast(slices) if slices.count() <= FEW_GRAMS else slices.hint("merge")
    dealt = found.join(slices, "gram").withColumn("slice", F.pmod(F.xxhash64("t"), F.col("slices")).cast("int")).select("t", "gram", "slice")
    sent = keyed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("__name", "gram", "slice")
    pairs = dealt.hint("merge").join(sent, ["gram", "slice"]).filter(F.col("t").contains(F.col("__name"))).select("t", "__name")
    return texts.hint("merge").join(pairs, F.col(text) == F.col("t")).drop("t").join(names.hint("merge"), "__name").drop("__name")
