"""Deleting and rebuilding an application's part of a graph.

An application's own nodes carry its key and go with it. Shared nodes (topics, tables, outgoing calls) carry none: they stay as long as
something that stays leads to them, over other shared nodes too. They are marked by a closure from what stays and swept by an anti
join, so no path is followed from each node on its own.

Edges learn what their ends are once, in slices by their source one after another, and the shuffle files of each slice are deleted before the
next, so the disk holds a slice's shuffles and not those of all edges for every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.operators import traverse
from archgraph.sources.shared import dropped, freed_shuffles, written

#: Slices of edges that are joined with nodes one after another.
SLICES = 4


def marked_ends(nodes: DataFrame, edges: DataFrame, slices: int = SLICES) -> DataFrame:
    """Edges both of whose ends are among the nodes, with what these are: (__from_owned, __from_shared, __to_shared)."""
    owned, shared = F.col("app_key").isNotNull(), F.col("app_key").isNull()
    states = written(nodes.groupBy("id").agg(F.max(owned).alias("owned"), F.max(shared).alias("shared")), "states")
    sources = states.select(F.col("id").alias("src"), F.col("owned").alias("__from_owned"), F.col("shared").alias("__from_shared"))
    targets = states.select(F.col("id").alias("dst"), F.col("shared").alias("__to_shared"))
    own = lambda df, k: df.filter(F.pmod(F.xxhash64("src"), F.lit(slices)) == k)
    out = None
    for k in range(slices):
        part = written(own(edges, k).join(own(sources, k), "src").join(targets, "dst").select(*edges.columns, "__from_owned", "__from_shared", "__to_shared"), "left")
        out = part if out is None else out.unionByName(part)
    dropped(states)
    return out


def unused(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): shared nodes that no application's node leads to, neither directly nor over shared nodes. edges: as `marked_ends` returns them."""
    into = edges.filter("__to_shared")
    first = into.filter("__from_owned").select(F.col("dst").alias("id")).distinct()
    marked = traverse.reach(into.filter("__from_shared"), first, include_starts=True).select("id")
    return nodes.filter("app_key IS NULL").select("id").join(marked, "id", "left_anti")


def without_applications(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after applications (app_key) were deleted, with all shared nodes that nothing uses any more. A second run changes nothing."""
    with freed_shuffles(nodes.sparkSession):
        kept = written(nodes.join(gone.select("app_key"), "app_key", "left_anti").select(nodes.columns), "kept")
        left = marked_ends(kept, edges)
        swept = written(unused(kept, left), "swept")
    # What is used uses what it leads to, so an edge goes only with its source.
    inside = left.filter("__from_shared").join(swept.withColumnRenamed("id", "src"), "src", "left_anti")
    return kept.join(swept, "id", "left_anti").select(nodes.columns), left.filter("NOT __from_shared").select(edges.columns).unionByName(inside.select(edges.columns))


def rebuilt(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the applications of `new_nodes` put in place of what they were; shared nodes of both are one."""
    gone = new_nodes.filter("app_key IS NOT NULL").select("app_key").distinct()
    kept_nodes, kept_edges = without_applications(nodes, edges, gone)
    both = kept_nodes.select(new_nodes.columns).unionByName(new_nodes).dropDuplicates(["id"])
    return both, kept_edges.select(new_edges.columns).unionByName(new_edges).dropDuplicates(["src", "dst", "type"])
