"""Variable-length traversal: closures, bounded walks and trails, call trees.

A closure keeps a visited set and expands only its frontier; each round is a written table, so the plan stays short and
survives lost executors. Bounded walks join once for each hop and keep only what is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.sources.shared import written


def reach(edges: DataFrame, starts: DataFrame, reverse: bool = False, max_depth: int | None = None, include_starts: bool = False) -> DataFrame:
    """(id, depth): every node that edges lead to from any start (column id), with its least distance.

    A start is in the result only if it lies on a cycle, or if `include_starts`.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    # Written once: the edges may be a plan of joins, and every round reads them.
    links = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL"), "edges")
    frontier = starts.select("id").distinct()
    visited = written(frontier.withColumn("depth", F.lit(0))) if include_starts else None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = links.join(frontier, links.a == frontier.id, "left_semi").select(F.col("b").alias("id")).distinct()
        if visited is not None:
            found = found.join(visited, "id", "left_anti")
        found = written(found.withColumn("depth", F.lit(depth)))
        if found.isEmpty():
            break
        visited = found if visited is None else written(visited.unionByName(found)) if depth % 8 == 0 else visited.unionByName(found)
        frontier = found.select("id")
    return visited if visited is not None else starts.select("id", F.lit(0).alias("depth")).limit(0)


def walks(edges: DataFrame, starts: DataFrame, max_depth: int, trail: bool = False, reverse: bool = False) -> DataFrame:
    """(start, end, depth, path): all walks of 1 to max_depth edges, as arrays of node ids; `trail`: no edge twice.

    Edges and steps are written, so each hop is one join and not one for every longer walk as well; an empty hop ends it.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    links = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    step = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    out = None
    for _ in range(max_depth):
        nxt = step.join(links, step.end == links.a)
        if trail:
            # An edge was used if its two ends follow one another somewhere on the path.
            n = F.size("path")
            pairs = F.arrays_zip(F.slice("path", 1, n - 1).alias("x"), F.slice("path", 2, F.greatest(n - 1, F.lit(0))).alias("y"))
            nxt = nxt.filter(~F.exists(pairs, lambda p: (p["x"] == F.col("a")) & (p["y"] == F.col("b"))))
        step = written(nxt.select("start", F.col("b").alias("end"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("b")).alias("path")))
        out = step if out is None else out.unionByName(step)
        if step.isEmpty():
            break
    return out


def reach_of(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, id, depth): what each start reaches from its nodes, those included, with the least distance. starts: (start, id).

    Each hop takes only pairs that are new, so the work follows the answer and not the number of paths.
    """
    links = written(edges.select("src", "dst").distinct(), "edges")
    step = written(starts.select("start", "id").distinct().withColumn("depth", F.lit(0)))
    out, depth = step, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = step.join(links, step.id == links.src).select("start", F.col("dst").alias("id")).distinct()
        step = written(new.join(out, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        out = written(out.unionByName(step)) if depth % 8 == 0 else out.unionByName(step)
    return out


def closure_collect(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, reached): for each start the sorted distinct nodes within max_depth hops; starts without any are left out.

    Each hop takes only pairs that are new, so the work follows the answer and not the number of paths; no new pair ends it.
    """
    links = written(edges.select("src", "dst").distinct(), "edges")
    step = written(links.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("end")))
    out = step
    for _ in range(max_depth - 1):
        new = step.join(links, step.end == links.src).select("start", F.col("dst").alias("end")).distinct()
        step = written(new.join(out, ["start", "end"], "left_anti"))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out.groupBy("start").agg(F.array_sort(F.collect_list("end")).alias("reached"))


def call_tree(edges: DataFrame, nodes: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """Walks with the type and label of their ends: a tree as flat rows."""
    named = nodes.select(F.col("id").alias("end"), "type", "label")
    return walks(edges, starts, max_depth).join(named, "end").select("start", "end", "type", "label", "depth", F.array_join("path", ">").alias("path"))


def accesses_reached(calls: DataFrame, accesses: DataFrame, starts: DataFrame) -> DataFrame:
    """(repository, table): what repositories that calls lead to from the starts access; cycles end by the visited set."""
    found = reach(calls, starts, include_starts=True).select(F.col("id").alias("src"))
    return accesses.join(found, "src", "left_semi").select(F.col("src").alias("repository"), F.col("dst").alias("table")).distinct()


# Edges of the full graph from an application to its components, from those to their members, and between members.
COMPONENT_EDGES = {"CONTAINS_CONTROLLER": "Controller", "CONTAINS_SERVICE": "Service", "CONTAINS_REPOSITORY": "Repository", "CONTAINS_KAFKA_LISTENER": "KafkaListener"}
MEMBER_EDGES = {"HAS_ENDPOINT": "Endpoint", "HAS_METHOD": "Method", "ACCESSES": "DatabaseTable"}


def full_graph(edges: DataFrame, nodes: DataFrame, depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """edges(src, dst, type) of the graph that is drawn from applications down to a depth.

    Components, the endpoints of controllers and the first table of each repository are there at any depth; the methods of services and the calls of endpoints,
    each hop one more, from depth 2 on. Only what leads to a node of the types asked for (all without) is followed.
    """
    kind = nodes.select(F.col("id").alias("dst"), F.col("type").alias("of"))
    wanted = lambda t: types is None or not types or t in types
    own = {k: v for k, v in COMPONENT_EDGES.items() if wanted(v)}
    members = {k: v for k, v in MEMBER_EDGES.items() if wanted(v) and (k != "HAS_METHOD" or depth > 1)}
    contained = edges.filter(F.col("type").isin(*own)) if own else edges.limit(0)
    parents = contained.select(F.col("dst").alias("src"), F.element_at(F.create_map(*[F.lit(x) for kv in COMPONENT_EDGES.items() for x in kv]), F.col("type")).alias("parent"))
    inner = edges.filter(F.col("type").isin(*members)).join(parents, "src") if members else edges.withColumn("parent", F.lit("")).limit(0)
    inner = inner.filter(F.coalesce(~((F.col("type") == "HAS_METHOD") & (F.col("parent") != "Service")), F.lit(True))).select("src", "dst", "type")
    first_table = inner.filter("type = 'ACCESSES'").groupBy("src", "type").agg(F.min("dst").alias("dst")).select("src", "dst", "type")
    out = contained.select("src", "dst", "type").unionByName(inner.filter("type <> 'ACCESSES'")).unionByName(first_table)
    if depth > 1 and wanted("Method"):
        calls = edges.filter("type = 'CALLS'").join(kind.filter("of = 'Method'").select("dst"), "dst", "left_semi")
        starts = inner.filter("type = 'HAS_ENDPOINT'").select(F.col("dst").alias("id"))
        at = reach(calls, starts, max_depth=depth - 2, include_starts=True) if depth > 2 else starts.distinct()
        out = out.unionByName(calls.join(at.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "type"))
    return out.distinct()


def levels(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges of the full graph whose type belongs to a level at most as deep: 1 applications and services, 2 endpoints and repositories, 3 calls, 4 tables."""
    by_level = {"CONTAINS_SERVICE": 1, "HAS_ENDPOINT": 2, "HAS_REPOSITORY": 2, "CALLS": 3, "ACCESSES": 4}
    kept = [k for k, v in by_level.items() if v <= depth]
    return edges.filter(F.col("type").isin(*kept)).distinct()
