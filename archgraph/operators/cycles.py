"""Dependency cycles of any length: strongly connected components, and shortest cycles through their edges.

Every cycle lies in a component and every edge inside a component lies on a cycle, so components tell all nodes and edges that
cycles use, however long those are; they cost rounds of joins over the edges. Shortest cycles cost one row for each pair of nodes of a
component. All simple cycles, whose number has no bound, are enumerated only up to a stated length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.sources.shared import dropped, written


def core(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without those that no cycle can use: nodes need an edge in and an edge out. A few rounds suffice to thin a graph."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")), "src", "left_semi").join(edges.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return edges


def spread(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label): the least node among a node and those that lead to it.

    A node takes the least label of those before it, and the label that its own label has, since that one leads to it too; so
    labels travel along long paths in few rounds. Each round is a written table, until no label falls.
    """
    now = written(ids.select("id", F.col("id").alias("label")), "labels")
    while True:
        brought = edges.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label")
        leap = now.join(now.select(F.col("id").alias("label"), F.col("label").alias("further")), "label").select("id", F.col("further").alias("label"))
        fallen = now.unionByName(brought).unionByName(leap).groupBy("id").agg(F.min("label").alias("label"))
        new = written(fallen.join(now.withColumnRenamed("label", "old"), "id").select("id", "label", (F.col("label") != F.col("old")).alias("fell")), "labels")
        dropped(now)
        if new.filter("fell").isEmpty():
            return new.select("id", "label")
        now = new.select("id", "label")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes that lie on a cycle with the least node of their strongly connected component. Self-loops are no cycle.

    Each round, nodes take the least node that leads to them as a label; those of a label that lead back to it are a component.
    """
    left = written(core(edges.filter("src <> dst").select("src", "dst").distinct()), "edges")
    found = None
    while not left.isEmpty():
        ids = left.select(F.col("src").alias("id")).union(left.select(F.col("dst").alias("id"))).distinct()
        label = spread(left, ids)
        a, b = (label.select(F.col("id").alias(k), F.col("label").alias(f"{k}_label")) for k in ("src", "dst"))
        # Within a label its node is the least of all, so what leads to it gets it again from the reversed edges.
        inside = written(left.join(a, "src").join(b, "dst").filter("src_label = dst_label").select("src", "dst"), "edges")
        back = spread(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ids).withColumnRenamed("label", "back")
        part = label.join(back, "id").filter("label = back").select("id", F.col("label").alias("component"))
        found = written(part if found is None else found.unionByName(part), "found")
        done = found.select("id")
        left = written(core(left.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti")), "edges")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("id", "component")


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, component): the edges that lie on a cycle."""
    of = written(components(edges), "components")
    a, b = (of.select(F.col("id").alias(k), F.col("component").alias(f"{k}_in")) for k in ("src", "dst"))
    return edges.filter("src <> dst").select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("src_in = dst_in").select("src", "dst", F.col("src_in").alias("component"))


def rotated(path: Column) -> Column:
    """A cycle's nodes, without the last one that repeats the first, from the least one on; that one closes it again."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    turned = F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1))
    return F.concat(turned, F.slice(turned, 1, 1))


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst, path, length): for each edge on a cycle a shortest one through it, the least of equal ones, from its least node."""
    links = written(cyclic_edges(edges), "edges")
    step = written(links.select(F.col("dst").alias("start"), F.col("dst").alias("at")).distinct().withColumn("path", F.array("at")), "paths")
    known, hops = step, 0
    while True:
        hops += 1
        # Targets of a hop that no earlier hop met, with the least path to each.
        new = step.join(links, step.at == links.src).select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        step = written(new.join(known.select("start", "at"), ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min("path").alias("path")), "paths")
        if step.isEmpty():
            break
        known = written(known.unionByName(step), "paths") if hops % 8 == 0 else known.unionByName(step)
    ring = links.join(known.select(F.col("start").alias("dst"), F.col("at").alias("src"), "path"), ["src", "dst"])
    return ring.select("src", "dst", rotated(F.col("path")).alias("path"), F.size("path").alias("length"))


def simple_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """(path, length): all simple cycles of at most max_length nodes, as arrays that begin and end with the cycle's least node.

    A path only visits nodes above its start, so rotations are never made; the edges are written once and read by each hop.
    """
    links = written(cyclic_edges(edges).select("src", "dst"), "edges")
    step = links.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    out = None
    for _ in range(max_length - 1):
        nxt = step.join(links, step.at == links.src).filter("dst >= start").select("start", F.col("dst").alias("to"), "path")
        closed = nxt.filter("to = start").select(F.concat("path", F.array("to")).alias("path"))
        out = closed if out is None else out.unionByName(closed)
        step = nxt.filter("to > start").filter(~F.array_contains("path", F.col("to"))).select("start", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    return out.select("path", (F.size("path") - 1).alias("length"))


def each_once(calls: DataFrame, max_length: int | None) -> DataFrame:
    """(path, length): a shortest cycle through each edge that lies on one, or all simple cycles up to a length."""
    return shortest_cycles(calls).select("path", "length").distinct() if max_length is None else simple_cycles(calls, max_length)


def service_cycles(calls: DataFrame, max_length: int | None = None) -> DataFrame:
    """Cycles of an owner graph (src, dst), severity ERROR."""
    return each_once(calls, max_length).select(F.array_join("path", ">").alias("signature"), "length", F.lit("ERROR").alias("severity"))


def method_cycles(calls: DataFrame, owner_of: DataFrame, max_length: int | None = None) -> DataFrame:
    """Cycles of methods that touch more than one owner, severity WARNING; an unknown owner counts as one."""
    found = each_once(calls, max_length)
    named = found.select("path", "length", F.explode(F.array_distinct("path")).alias("id")).join(owner_of.select("id", "owner"), "id", "left")
    owners = named.groupBy("path", "length").agg((F.countDistinct("owner") + F.max(F.col("owner").isNull().cast("int"))).alias("owners"))
    return owners.filter("owners > 1").select(F.array_join("path", ">").alias("signature"), "length", F.lit("WARNING").alias("severity"))


def detected(service_calls: DataFrame, method_calls: DataFrame, owner_of: DataFrame) -> DataFrame:
    """(signature, length, severity): the cycles of both levels."""
    return service_cycles(service_calls).unionByName(method_cycles(method_calls, owner_of))


def marked_new(after: DataFrame, before: DataFrame) -> DataFrame:
    """Cycles of the later snapshot with whether the earlier one lacks them."""
    return after.join(before.select("signature", F.lit(True).alias("__old")).distinct(), "signature", "left").withColumn("new_in_shadow", F.col("__old").isNull()).drop("__old")


def cycle_edges(cycles: DataFrame, detail: DataFrame | None = None) -> DataFrame:
    """(signature, position, src, dst): the edges of each cycle in order, with the least detail of each pair if given."""
    parts = F.split("signature", ">")
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("src"), F.slice(parts, 2, F.size(parts) - 1).alias("dst"))
    out = cycles.select("signature", F.posexplode(pairs).alias("position", "pair")).select("signature", "position", "pair.src", "pair.dst")
    return out if detail is None else out.join(detail.groupBy("src", "dst").agg(F.min("detail").alias("detail")), ["src", "dst"], "left")
