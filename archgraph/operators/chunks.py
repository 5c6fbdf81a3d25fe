"""Text of nodes for search, embeddings, filtered nearest neighbours and their context in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.operators.summarize import first_values

CALLS, EXTERNAL, ENDPOINTS = 10, 5, 15


def listed(label: str, values: Column, limit: int | None = None) -> Column:
    """`label: a, b` of the first sorted values, of all without a limit; null without any, so that concat_ws leaves the line out."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(ordered if limit is None else F.slice(ordered, 1, limit), ", ")))


def gathered(links: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """(id, one array for each type of link): sorted distinct labels of what nodes are linked to, the first ones where a limit is given.

    links: (src, label, type). Labels are ranked before they are collected, so a hub brings no more than its limit to one task.
    """
    rows = links.filter(F.col("type").isin(*limits) & F.col("label").isNotNull()).select("src", "label", "type").distinct()
    rank = F.row_number().over(Window.partitionBy("src", "type").orderBy("label"))
    capped = [k for k, n in limits.items() if n is not None]
    of_limit = F.coalesce(*[F.when(F.col("type") == k, limits[k]) for k in capped]) if capped else F.lit(0)
    first = rows.filter(F.col("type").isin(*capped)).withColumn("rank", rank).filter(F.col("rank") <= max((limits[k] for k in capped), default=0)).filter(F.col("rank") <= of_limit).drop("rank") if capped else rows.limit(0)
    kept = first.unionByName(rows.filter(~F.col("type").isin(*capped)))
    return kept.groupBy(F.col("src").alias("id")).agg(*[F.collect_list(F.when(F.col("type") == k, F.col("label"))).alias(k) for k in limits])


def names_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def counted(links: DataFrame, kind: str) -> DataFrame:
    """(id, n): how many links of a type each node has."""
    return links.filter(F.col("type") == kind).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


def service_text(services: DataFrame, members: DataFrame) -> DataFrame:
    """(id, text): a service with how many members it has and the first of their names. members: (owner, label)."""
    named = first_values(members, "owner", "label", CALLS, "names")
    found = members.groupBy("owner").agg(F.count("*").alias("n")).join(named, "owner", "left").withColumnRenamed("owner", "id")
    lines = F.concat_ws("\n", F.concat(F.lit("Service: "), F.col("label")), F.concat(F.lit("Methods: "), F.coalesce("n", F.lit(0))), listed("Method names", names_of("names")))
    return services.select("id", "label").join(found, "id", "left").select("id", lines.alias("text"))


def controller_text(controllers: DataFrame, links: DataFrame) -> DataFrame:
    """(id, text): a controller with its package, base URL, how many endpoints it has and the first of them. links: HAS_ENDPOINT with the endpoint's verb and path as label."""
    found = counted(links, "HAS_ENDPOINT").join(gathered(links, {"HAS_ENDPOINT": CALLS}), "id", "left")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Controller: "), F.col("label")), F.concat(F.lit("Package: "), F.coalesce("package_name", F.lit(""))), F.concat(F.lit("Base URL: "), F.coalesce("base_url", F.lit(""))),
        F.concat(F.lit("Endpoints: "), F.coalesce("n", F.lit(0))), listed("Endpoint paths", names_of("HAS_ENDPOINT")),
    )
    return controllers.select("id", "label", "package_name", "base_url").join(found, "id", "left").select("id", lines.alias("text"))


def repository_text(repositories: DataFrame, links: DataFrame) -> DataFrame:
    """(id, text): a repository with its type, all its tables, how many methods it has and the first of their names. links: ACCESSES and HAS_METHOD."""
    found = gathered(links, {"ACCESSES": None, "HAS_METHOD": CALLS})
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Repository: "), F.col("label")), F.concat(F.lit("Package: "), F.coalesce("package_name", F.lit(""))), F.concat(F.lit("Type: "), F.coalesce("kind", F.lit(""))),
        listed("Database Tables", names_of("ACCESSES")), F.concat(F.lit("Methods: "), F.coalesce("n", F.lit(0))), listed("Method names", names_of("HAS_METHOD")),
    )
    return repositories.select("id", "label", "package_name", "kind").join(found, "id", "left").join(counted(links, "HAS_METHOD"), "id", "left").select("id", lines.alias("text"))


def endpoint_text(endpoints: DataFrame, links: DataFrame) -> DataFrame:
    """(id, text): an endpoint with its verb, path, controller, handler and signature, its first calls and external calls, and all its topics."""
    found = gathered(links, {"CALLS": CALLS, "PRODUCES_TO": None, "MAKES_EXTERNAL_CALL": EXTERNAL})
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Endpoint: "), F.concat_ws(" ", "kind", "label")), F.concat(F.lit("Controller: "), F.coalesce("owner", F.lit(""))), F.concat(F.lit("Handler: "), F.coalesce("handler", F.lit(""))),
        F.concat(F.lit("Signature: "), F.nullif("signature", F.lit(""))), listed("Calls", names_of("CALLS")), listed("Kafka Topics", names_of("PRODUCES_TO")), listed("External Calls", names_of("MAKES_EXTERNAL_CALL")),
    )
    return endpoints.select("id", "label", "owner", "kind", "handler", "signature").join(found, "id", "left").select("id", lines.alias("text"))


def method_text(methods: DataFrame, links: DataFrame) -> DataFrame:
    """(id, text): a method with its first calls and external calls, and all its topics and tables. links: (src, label, type); one aggregation for all."""
    found = gathered(links, {"CALLS": CALLS, "PRODUCES_TO": None, "ACCESSES": None, "MAKES_EXTERNAL_CALL": EXTERNAL})
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Method: "), F.concat_ws(".", F.col("owner"), F.col("label"))), F.concat(F.lit("Type: "), F.col("kind")),
        listed("Calls", names_of("CALLS")), listed("Kafka Topics", names_of("PRODUCES_TO")), listed("Database Tables", names_of("ACCESSES")), listed("External Calls", names_of("MAKES_EXTERNAL_CALL")),
    )
    return methods.select("id", "owner", "label", "kind").join(found, "id", "left").select("id", lines.alias("text"))


def chunked(texts: dict[str, DataFrame], nodes: DataFrame, project: str) -> DataFrame:
    """(point_id, level, text, payload): the chunks of all kinds, and what a vector store keeps beside each vector.

    texts: (id, text) for each level; nodes: (id, label, owner, app_key, package_name, signature), of which absent values stay out of the payload.
    """
    out = None
    for level, rows in texts.items():
        one = rows.select("id", "text", F.lit(level).alias("level"))
        out = one if out is None else out.unionByName(one)
    method = F.col("level") == "METHOD"
    known = nodes.select("id", "label", "owner", "app_key", "package_name", "signature")
    fixed = {"projectId": F.lit(project), "nodeId": F.col("id"), "nodeType": F.col("level"), "level": F.col("level"), "chunkId": F.concat_ws("::", F.lit(project), "level", "id"), "text": F.col("text")}
    free = {"appKey": F.col("app_key"), "className": F.when(method, F.col("owner")).otherwise(F.col("label")), "methodName": F.when(method, F.col("label")), "packageName": F.col("package_name"), "signature": F.col("signature")}
    payload = F.map_filter(F.create_map(*[x for k, v in (fixed | free).items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return out.join(known, "id", "left").select(F.col("id").alias("point_id"), "level", "text", payload.alias("payload"))


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """An offline stand-in for a model: word counts dealt to dimensions by hash, at length one. Any other embedder gives the same column type."""
    slots = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def search(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """Rank 1 to k by cosine, filtered before, ties by id; a least score cuts afterwards and leaves ranks as they were.

    vectors: (vec_id, embedding, ...). Each task keeps its own best k, so k rows for each task meet.
    """
    rows = vectors if where is None else vectors.filter(where)
    constant = F.array(*[F.lit(float(x)) for x in query])
    best = rows.withColumn("score", cosine(F.col("embedding"), constant)).orderBy(F.desc("score"), "vec_id").limit(k)
    ranked = best.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("h")).select(F.posexplode("h").alias("p", "h"))
    out = ranked.select("h.vec_id", (-F.col("h.s")).alias("score"), (F.col("p") + 1).alias("rank"))
    return out if min_score is None else out.filter(F.col("score") >= min_score)


def context(hits: DataFrame, edges: DataFrame, limit: int = CALLS) -> DataFrame:
    """(id, outgoing, incoming): the first neighbours of each hit in either direction."""
    near = lambda a, b, name: first_values(edges.join(hits.select(F.col("id").alias(a)), a, "left_semi"), a, b, limit, name).withColumnRenamed(a, "id")
    return hits.select("id").join(near("src", "dst", "outgoing"), "id", "left").join(near("dst", "src", "incoming"), "id", "left")


# Which links tell the context of a hit, by its level: from it, to it, and two steps from it.
CONTEXT = {
    "METHOD": {"out": ("CALLS", "PRODUCES_TO", "ACCESSES", "MAKES_EXTERNAL_CALL"), "in": ("HAS_METHOD",), "via": ()},
    "ENDPOINT": {"out": ("CALLS", "PRODUCES_TO", "MAKES_EXTERNAL_CALL"), "in": ("HAS_ENDPOINT",), "via": ()},
    "SERVICE": {"out": ("HAS_METHOD",), "in": (), "via": (("HAS_METHOD", "CALLS", "out"), ("HAS_METHOD", "CALLS", "in"))},
    "CONTROLLER": {"out": ("HAS_ENDPOINT",), "in": (), "via": (("HAS_ENDPOINT", "CALLS", "out"),)},
    "REPOSITORY": {"out": ("HAS_METHOD", "ACCESSES"), "in": (), "via": (("HAS_METHOD", "CALLS", "in"),)},
}


def typed_context(hits: DataFrame, edges: DataFrame, limit: int = CALLS) -> DataFrame:
    """(id, relation, n, neighbours): for each hit (id, level) what its level's links lead to: how many, and the first of them.

    A relation is a link's type, `<type` for one that leads to the hit, and `type/type` or `type/<type` for two steps.
    """
    at = lambda level: hits.filter(F.col("level") == level).select("id")
    found = None
    for level, ways in CONTEXT.items():
        own = at(level)
        steps = lambda kind, rows, way: (
            rows.join(edges.filter(F.col("type") == kind).select(F.col("src" if way == "out" else "dst").alias("mid"), F.col("dst" if way == "out" else "src").alias("other")), "mid")
        )
        start = own.withColumn("mid", F.col("id"))
        parts = [steps(k, start, way).select("id", F.lit(("<" if way == "in" else "") + k).alias("relation"), "other") for way in ("out", "in") for k in ways[way]]
        for first, second, way in ways["via"]:
            half = steps(first, start, "out").select("id", F.col("other").alias("mid"))
            parts.append(steps(second, half, way).select("id", F.lit(f"{first}/{'<' if way == 'in' else ''}{second}").alias("relation"), "other"))
        for part in parts:
            found = part if found is None else found.unionByName(part)
    found = found.distinct()
    counted_ = found.groupBy("id", "relation").agg(F.count("*").alias("n"))
    return counted_.join(first_values(found, ["id", "relation"], "other", limit, "neighbours"), ["id", "relation"])


def relocated(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks whose node id is stale get the node of equal label: by id, else the least id of that label."""
    by_label = nodes.groupBy(F.col("label").alias("l")).agg(F.min("id").alias("other"))
    known = nodes.select("id", F.col("id").alias("same"))
    out = chunks.join(known, "id", "left").join(by_label, chunks.label == by_label.l, "left")
    return out.select("id", F.coalesce("same", "other").alias("node_id"))
