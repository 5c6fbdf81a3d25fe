"""Counts, groupings, projections to owners, ordering and first-of-key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, n): nodes of each type, and repositories that access at least one table."""
    counted = nodes.groupBy(F.col("type").alias("metric")).agg(F.count("*").alias("n"))
    reading = edges.filter("type = 'ACCESSES'").select("src").distinct().agg(F.count("*").alias("n")).select(F.lit("RepositoryWithTables").alias("metric"), "n")
    return counted.unionByName(reading)


def grouped(nodes: DataFrame, by: str, null_label: str | None = None) -> DataFrame:
    """(by, n): counts of each value; null is left out, or counted under a label."""
    rows = nodes.filter(F.col(by).isNotNull()) if null_label is None else nodes
    return rows.groupBy(F.coalesce(F.col(by), F.lit(null_label)).alias(by)).agg(F.count("*").alias("n"))


def per_application(applications: DataFrame, nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Component counts of every application, 0 where there are none."""
    counted = nodes.filter(F.col("type").isin(*types)).groupBy("app_key").agg(*[F.count(F.when(F.col("type") == t, 1)).alias(t.lower()) for t in types])
    return applications.select("app_key").join(counted, "app_key", "left").na.fill(0, [t.lower() for t in types])


def first_values(rows: DataFrame, by: str | list[str], value: str, k: int, name: str = "values") -> DataFrame:
    """(by, name): the first k distinct values of each group in order. Only k rows of a group meet, however many it has."""
    by = [by] if isinstance(by, str) else by
    ranked = top_per(rows.select(*by, value).filter(F.col(value).isNotNull()).distinct(), by, [F.col(value)], k)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def lists_by(nodes: DataFrame, by: str, value: str, null_label: str = "Unknown", limit: int | None = None) -> DataFrame:
    """(by, n, values): sorted values of each group, the first `limit` of them."""
    rows = nodes.select(F.coalesce(F.col(by), F.lit(null_label)).alias(by), value)
    if limit is None:
        return rows.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(value)).alias("values"))
    listed = rows.groupBy(by).agg(F.count("*").alias("n")).join(first_values(rows, by, value, limit), by, "left")
    return listed.withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, type, n): how many nodes and edges there are of each type."""
    return nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "type", "n").unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "type", "n"))


def owner_graph(calls: DataFrame, owner_of: DataFrame) -> DataFrame:
    """(src, dst): calls lifted to owners, without self-loops, distinct. owner_of: (id, owner)."""
    a = owner_of.select(F.col("id").alias("src"), F.col("owner").alias("from"))
    b = owner_of.select(F.col("id").alias("dst"), F.col("owner").alias("to"))
    # A caller's owner comes first, then pairs are reduced before the second join.
    half = calls.join(a, "src").select("from", "dst").distinct()
    return half.join(b, "dst").filter(F.col("from") != F.col("to")).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def topic_flow(links: DataFrame, topic: str, side: str, who: str, detail: str) -> DataFrame:
    """For each topic: sorted producer and consumer details, and the distinct names behind them."""
    one = lambda s, c: F.array_sort(F.collect_set(F.when(F.col(side) == s, F.col(c))))
    return links.groupBy(topic).agg(*[one(s, c).alias(f"{s}_{c}s") for s in ("producer", "consumer") for c in (detail, who)])


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times that of the largest tie-breaker."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(at, tie, *[c for c in rest if c not in (at, tie)])).alias("v")).select(*keys, *[F.col(f"v.{c}") for c in rest])


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; the limit is pushed below the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def deduplicated(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a stated order; rows without the key go."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("v")).select(key, *[F.col(f"v.{c}") for c in rest])


def sides_per_application(links: DataFrame, app_of: DataFrame) -> DataFrame:
    """(app_key, producers, consumers): distinct producers and the number of consumer links of each application. links (id, topic, side)."""
    per = links.groupBy("id").agg(F.max((F.col("side") == "producer").cast("int")).alias("p"), F.count(F.when(F.col("side") == "consumer", 1)).alias("c"))
    return per.join(app_of.select("id", "app_key"), "id").groupBy("app_key").agg(F.sum("p").cast("bigint").alias("producers"), F.sum("c").cast("bigint").alias("consumers"))


def scores(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    return df.groupBy(by).agg(F.max(score).alias("most"), F.min(score).alias("least"), F.avg(score).alias("mean"), F.count("*").alias("n"))
