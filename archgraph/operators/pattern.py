"""Lookups, filters and pattern joins over nodes(id, type, label, owner, app_key, kind) and edges(src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import rules, scalars


def lookup(nodes: DataFrame, ident: str) -> DataFrame:
    """The node of an id, of whatever type; ids are unique, so no limit is needed."""
    return nodes.filter(F.col("id") == ident)


def of_types(nodes: DataFrame, types: list[str] | None) -> DataFrame:
    """Nodes of the given types; applications always stay; no list means all."""
    return nodes.filter(F.col("type").isin(*types, "Application")) if types else nodes


def endpoints_where(endpoints: DataFrame, verb: str | None = None, pattern: str | None = None, verb_column: str = "kind", path_column: str = "label") -> DataFrame:
    """By verb; or else by glob pattern; an empty string counts as absent; the verb beats the pattern."""
    if verb:
        return endpoints.filter(F.col(verb_column) == verb)
    return endpoints.filter(scalars.glob_matches(path_column, pattern)) if pattern else endpoints


def sources_with(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Nodes with at least one outgoing edge of a kind: a semi join, so a hub does not multiply its node."""
    return nodes.join(edges.filter(F.col("type") == kind).select(F.col("src").alias("id")), "id", "left_semi")


def without(nodes: DataFrame, edges: DataFrame, kind: str, end: str = "src") -> DataFrame:
    return nodes.join(edges.filter(F.col("type") == kind).select(F.col(end).alias("id")), "id", "left_anti")


def expand(edges: DataFrame, kind: str) -> DataFrame:
    """(id, targets): each source with its sorted distinct targets."""
    return edges.filter(F.col("type") == kind).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct ends of a two-hop chain."""
    a = edges.filter(F.col("type") == first).select(F.col("src").alias("start"), F.col("dst").alias("via"))
    b = edges.filter(F.col("type") == second).select(F.col("src").alias("via"), F.col("dst").alias("end"))
    return a.join(b, "via").select("start", "end").distinct()


def with_counts(nodes: DataFrame, edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Optional expands: for each (output column: edge kind) the number of targets, 0 without any. One aggregation for all kinds."""
    wanted = edges.filter(F.col("type").isin(*kinds.values()))
    counted = wanted.groupBy(F.col("src").alias("id")).agg(*[F.count(F.when(F.col("type") == k, 1)).alias(c) for c, k in kinds.items()])
    return nodes.join(counted, "id", "left").na.fill(0, list(kinds))


def both_sides(links: DataFrame, topic: str, side: str, left: str, right: str) -> DataFrame:
    """Topics that have links of both sides."""
    return links.groupBy(topic).agg(F.count(F.when(F.col(side) == left, 1)).alias("a"), F.count(F.when(F.col(side) == right, 1)).alias("b")).filter("a > 0 AND b > 0").select(topic)


def orphans(links: DataFrame, topic: str, side: str, present: str, absent: str) -> DataFrame:
    """Topics with links of one side and none of the other: a semi and an anti join."""
    a, b = (links.filter(F.col(side) == s).select(topic) for s in (present, absent))
    return a.distinct().join(b, topic, "left_anti")


def callers_of_owner(edges: DataFrame, nodes: DataFrame, owner: str) -> DataFrame:
    """Distinct callers of anything that an owner owns, from other owners."""
    owned = nodes.filter(F.col("owner") == owner).select(F.col("id").alias("dst"))
    others = nodes.filter(F.col("owner").isNotNull() & (F.col("owner") != owner)).select(F.col("id").alias("src"), F.col("owner").alias("caller_owner"), F.col("type").alias("caller_type"))
    return edges.filter("type = 'CALLS'").join(owned, "dst", "left_semi").select("src").distinct().join(others, "src").select(F.col("src").alias("caller"), "caller_owner", "caller_type")


def containing(left: DataFrame, text: str, right: DataFrame, name: str, token: str = r"[^A-Za-z0-9_]+") -> DataFrame:
    """Rows of `left` whose text names a row of `right` as a whole word: words are exploded and joined by equality, not compared pair by pair."""
    words = left.withColumn("__word", F.explode(F.array_distinct(F.split(text, token)))).filter("__word <> ''")
    return words.join(right, F.col("__word") == F.col(name)).drop("__word")


def prefix_related(left: DataFrame, path: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of which one path begins with the other: each side is exploded into the beginnings of its path and joined by equality."""

    def beginnings(df: DataFrame, column: str) -> DataFrame:
        n = F.length(column)
        every = F.when(n > 0, F.sequence(F.lit(1), n))
        return df.withColumn("__k", F.explode(every)).withColumn("__p", F.substring(F.col(column), F.lit(1), F.col("__k"))).drop("__k")

    longer = beginnings(left, path).join(right.withColumn("__p", F.col(other)), "__p").drop("__p")
    shorter = left.withColumn("__p", F.col(path)).join(beginnings(right, other), "__p").drop("__p")
    return longer.unionByName(shorter).distinct()


def projected(nodes: DataFrame) -> DataFrame:
    """Output nodes: label, group, property map, colour."""
    props = F.map_filter(F.create_map(F.lit("owner"), F.col("owner"), F.lit("appKey"), F.col("app_key"), F.lit("kind"), F.col("kind")), lambda _, v: v.isNotNull())
    return nodes.select("id", "label", "type", F.lower("type").alias("grp"), props.alias("properties"), rules.node_colour(F.col("type")).alias("colour"))


def projected_edges(edges: DataFrame) -> DataFrame:
    """Output edges: id, label in words, colour."""
    return edges.select(
        F.concat_ws("-", "src", "type", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "type",
        F.lower(F.replace("type", F.lit("_"), F.lit(" "))).alias("label"), rules.edge_colour(F.col("type")).alias("colour"),
    )


def matching_calls(sources: DataFrame, calls: DataFrame, on: str, resolved: bool | None) -> DataFrame:
    """Sources with their calls, all or only (un)resolved ones; a source stays even if none of its calls does."""
    kept = calls if resolved is None else calls.filter(F.col("resolved") == resolved)
    return sources.join(kept, on, "left")


def permitted(rows: DataFrame, projects: DataFrame, user: str) -> DataFrame:
    """Rows of projects that a user owns."""
    return rows.join(projects.filter(F.col("user_id") == user).select("project_id"), "project_id", "left_semi")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order: an aggregation of structs, so a hot key is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    value = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *rest)
    return df.groupBy(*keys).agg(F.min(value).alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])
