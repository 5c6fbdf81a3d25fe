"""Differences of two snapshots: nodes and their properties by key, relations, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What identifies a node of each type, and which properties are compared.
KEYS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Controller": (("package_name", "class_name"), ("class_name", "package_name", "base_url", "endpoint_count")),
    "Endpoint": (("controller_class", "http_method", "path"), ("http_method", "path", "handler_method", "controller_class", "request_body_type", "response_type")),
    "Service": (("package_name", "class_name"), ("class_name", "package_name", "method_count")),
    "Repository": (("package_name", "class_name"), ("class_name", "package_name", "repository_type", "extends_class")),
    "KafkaListener": (("package_name", "class_name"), ("class_name", "package_name", "listener_method_count")),
    "KafkaTopic": (("name",), ()),
}


def keyed(df: DataFrame, keys: tuple[str, ...], properties: tuple[str, ...]) -> DataFrame:
    """(key, props): a null key part reads 'null'; of equal keys the least properties stay, so both sides choose alike."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    props = F.map_from_arrays(F.array(*[F.lit(p) for p in properties]).cast("array<string>"), F.array(*[F.col(p).cast("string") for p in properties]).cast("array<string>"))
    values = F.struct(*[F.col(p).cast("string") for p in properties]) if properties else F.lit(1)
    return df.select(F.concat_ws("::", *[text(k) for k in keys]).alias("key"), values.alias("__order"), props.alias("props")).groupBy("key").agg(F.min_by("props", "__order").alias("props"))


def node_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...], properties: tuple[str, ...]) -> DataFrame:
    """(key, change, changed): ADDED, REMOVED or MODIFIED; `changed` are the names of properties that differ, null-safe."""
    a, b = keyed(before, keys, properties).withColumnRenamed("props", "old"), keyed(after, keys, properties).withColumnRenamed("props", "new")
    both = a.join(b, "key", "full")
    differs = F.filter(F.array(*[F.lit(p) for p in properties]).cast("array<string>"), lambda p: ~F.try_element_at("old", p).eqNullSafe(F.try_element_at("new", p)))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.size(differs) > 0, "MODIFIED")
    return both.select("key", change.alias("change"), differs.alias("changed"), "old", "new").filter("change IS NOT NULL").select("key", "change", F.when(F.col("change") == "MODIFIED", F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed"), "old", "new")


def property_diff(diff: DataFrame) -> DataFrame:
    """(key, property, old_value, new_value) for each property of a modified node that differs."""
    return diff.filter("change = 'MODIFIED'").select("key", F.explode("changed").alias("property"), "old", "new").select("key", "property", F.try_element_at("old", F.col("property")).alias("old_value"), F.try_element_at("new", F.col("property")).alias("new_value"))


def relation_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Relations that one snapshot alone has: `columns` and change. One aggregation instead of two anti joins."""
    marked = before.select(*columns, F.lit(1).alias("side")).unionByName(after.select(*columns, F.lit(2).alias("side")))
    sides = marked.groupBy(*columns).agg(F.bit_or("side").alias("sides")).filter("sides <> 3")
    return sides.select(*columns, F.when(F.col("sides") == 1, "REMOVED").otherwise("ADDED").alias("change"))


def within_common(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to keys that occur on both: relations of new or removed sources are no relation changes."""
    return before.join(after.select(key), key, "left_semi"), after.join(before.select(key), key, "left_semi")


def snapshot_diff(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(type, key, change, changed, old, new) over all node types that both snapshots hold."""
    out = None
    for kind, (keys, properties) in KEYS.items():
        if kind in before and kind in after:
            one = node_diff(before[kind], after[kind], keys, properties).select(F.lit(kind).alias("type"), "key", "change", "changed", "old", "new")
            out = one if out is None else out.unionByName(one)
    return out


def summary(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, type, change, n): counts of node changes by type, and of relation changes."""
    a = nodes.groupBy("type", "change").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "type", "change", "n")
    b = relations.groupBy("change").agg(F.count("*").alias("n")).select(F.lit("relation").alias("part"), F.lit(None).cast("string").alias("type"), "change", "n")
    return a.unionByName(b)


def shown(snapshots: DataFrame, summaries: DataFrame, with_diff: bool = False) -> DataFrame:
    """Snapshots as they are answered: their own columns and the five counts of the diff's summary; `diff_json` only if asked for.

    snapshots (snapshot_id, status, ..., diff_json); summaries (snapshot_id, part, change, n). A snapshot without a summary has zeros.
    """
    count = lambda part, change: F.coalesce(F.sum(F.when((F.col("part") == part) & (F.col("change") == change), F.col("n"))), F.lit(0)).cast("bigint")
    cells = [("node", "ADDED", "nodes_added"), ("node", "MODIFIED", "nodes_modified"), ("node", "REMOVED", "nodes_removed"), ("relation", "ADDED", "relations_added"), ("relation", "REMOVED", "relations_removed")]
    counts = summaries.groupBy("snapshot_id").agg(*[count(part, change).alias(name) for part, change, name in cells])
    out = snapshots if with_diff else snapshots.drop("diff_json")
    return out.join(counts, "snapshot_id", "left").na.fill(0, [name for _, _, name in cells])
