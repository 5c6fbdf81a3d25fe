"""Matching outgoing calls to endpoints of other applications, and topics to their two sides.

Scored matching never compares all calls with all endpoints: URLs are led through tries of path segments (see routing.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import scalars
from archgraph.operators import routing
from archgraph.sources.shared import written

ACCEPT = 3


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_variable(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}")


def match_score(url: Column, path: Column) -> Column:
    """10 equal, 8 by template, 7 or 5 if one ends with the other, else n + 1 for n >= 2 equal or variable segments at the end, else 0."""
    # Java's split keeps the empty part before the first slash and drops those at the end.
    parts = lambda x: F.reverse(F.split(F.regexp_replace(x, "/+$", ""), "/"))
    u, p = parts(url), parts(path)
    n = F.least(F.size(u), F.size(p))
    same = F.zip_with(F.slice(u, 1, n), F.slice(p, 1, n), lambda a, b: (a == b) | is_variable(b))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]
    return (
        F.when(url == path, 10)
        .when(F.rlike(url, scalars.template_regex(path)), 8)
        .when(url.endswith(path), 7)
        .when(path.endswith(url), 5)
        .when((F.size(u) >= 2) & (F.size(p) >= 2) & (run >= 2), run + 1)
        .otherwise(0)
    )


def candidates(calls: DataFrame) -> DataFrame:
    """(call_id, candidate) for calls (call_id, url) that can be resolved at all."""
    usable = calls.filter(F.col("url").isNotNull() & (F.trim("url") != "") & (F.col("url") != scalars.DYNAMIC))
    return usable.select("call_id", F.explode(scalars.url_candidates(scalars.resolver_url("url"))).alias("candidate")).distinct()


def scored(calls: DataFrame, endpoints: DataFrame, match_verb: bool = False) -> DataFrame:
    """(call_id, endpoint_id, score): of every call the endpoints that may win, each with its best score over the URL's candidates.

    calls (call_id, url); endpoints (endpoint_id, path), whose paths are brought into the form of URLs; empty ones match nothing. URLs that are equal
    are led through the tries once.
    """
    by_verb = match_verb and "verb" in endpoints.columns
    verb = F.upper("verb") if by_verb else F.lit(None).cast("string")
    own = F.when(verb.isNull() | (verb == "REQUEST"), routing.OPEN).otherwise(verb)
    classes = F.array(F.lit(routing.ANY), own) if by_verb else F.array(F.lit(routing.ANY))
    ends = endpoints.filter(F.coalesce(F.col("path"), F.lit("")) != "").select("endpoint_id", scalars.resolver_url("path").alias("path"), F.explode(classes).alias("class")).filter("path <> ''")
    asked = written(candidates(calls), "candidates")
    found = routing.routed(asked.select("candidate").distinct(), routing.Registry(written(ends, "endpoints")), match_score)
    best = found.groupBy("candidate", "class").agg(F.min(F.struct((-F.col("score")).alias("s"), "endpoint_id")).alias("b")).select("candidate", "class", "b.endpoint_id", (-F.col("b.s")).alias("score"))
    served = calls.select("call_id", F.lit(routing.ANY).alias("class"))
    if by_verb:
        v = F.upper("verb")
        free = v.isNull() | v.isin("UNKNOWN", "REQUEST")
        served = calls.select("call_id", F.explode(F.when(free, F.array(F.lit(routing.ANY))).otherwise(F.array(v, F.lit(routing.OPEN)))).alias("class"))
    return asked.join(served, "call_id").join(best, ["candidate", "class"]).groupBy("call_id", "endpoint_id").agg(F.max("score").alias("score"))


def resolve(calls: DataFrame, endpoints: DataFrame, match_verb: bool = False, accept: int = ACCEPT) -> DataFrame:
    """(call_id, endpoint_id, score): the best endpoint of each call, the least id on ties, if its score is accepted.

    With `match_verb`, both sides carry `verb`, and a known verb must agree.
    """
    pairs = scored(calls, endpoints, match_verb)
    best = pairs.filter(F.col("score") >= accept).groupBy("call_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "endpoint_id")).alias("b"))
    return best.select("call_id", "b.endpoint_id", (-F.col("b.s")).alias("score"))


#: Templates of literal and whole variable segments, which equality joins can find.
REGULAR = r"^(/([^/{}<>*?]+|\{[^/{}]+\}))+$"


def first_match(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """(call_id, endpoint_id): the first endpoint by `ord` of equal verb whose path is the URL's or a prefix pattern of it.

    calls (call_id, verb, path); registry (endpoint_id, verb, path, ord). The templates of a verb have few shapes (which segments vary); a URL's beginning in each
    shape, with its variable segments blanked out, is a key that the first endpoint of that key is joined by. Only templates with wildcards or
    variables inside a segment are tried by their pattern, within the same verb and first segment.
    """
    left = calls.select("call_id", scalars.verb("verb").alias("verb"), F.col("path").alias("url"))
    right = registry.select("endpoint_id", scalars.verb("verb").alias("verb"), "path", "ord").withColumn("regular", F.coalesce(F.rlike("path", F.lit(REGULAR)), F.lit(False)))
    blank = lambda parts, varies: F.array_join(F.zip_with(parts, varies, lambda s, v: F.when(v, "{}").otherwise(s)), "/")
    parts = F.slice(F.split("path", "/"), 2, 1 << 20)
    shaped = right.filter("regular").withColumn("parts", parts).withColumn("varies", F.transform("parts", is_variable))
    first = shaped.groupBy("verb", blank(F.col("parts"), F.col("varies")).alias("key")).agg(F.min(F.struct("ord", "endpoint_id")).alias("e"))
    shapes = shaped.groupBy("verb").agg(F.collect_set("varies").alias("shapes"))
    begun = left.filter("url LIKE '/%'").withColumn("parts", F.slice(F.split("url", "/"), 2, 1 << 20)).join(shapes, "verb")
    begun = begun.select("call_id", "verb", "parts", F.explode("shapes").alias("varies")).filter(F.size("varies") <= F.size("parts"))
    begun = begun.withColumn("parts", F.slice("parts", F.lit(1), F.size("varies"))).filter(~F.exists(F.zip_with("parts", "varies", lambda s, v: v & (s == "")), lambda x: x))
    found = begun.select("call_id", "verb", blank(F.col("parts"), F.col("varies")).alias("key")).join(first, ["verb", "key"]).select("call_id", "e.ord", "e.endpoint_id")
    equal = left.join(right.groupBy("verb", F.col("path").alias("url")).agg(F.min(F.struct("ord", "endpoint_id")).alias("e")), ["verb", "url"]).select("call_id", "e.ord", "e.endpoint_id")

    head = lambda c: F.coalesce(F.try_element_at(segments(F.col(c)), F.lit(1)), F.lit(""))
    rest = right.filter("NOT regular").withColumn("key", F.when(head("path").rlike("[{<*?]"), "{}").otherwise(head("path")))
    tried = left.withColumn("key", F.explode(F.array(head("url"), F.lit("{}")))).join(rest, ["verb", "key"])
    tried = tried.filter(F.rlike("url", F.concat(F.lit("^"), scalars.path_pattern("path"), F.lit("(/.*)?$")))).select("call_id", "ord", "endpoint_id")
    return found.unionByName(equal).unionByName(tried).groupBy("call_id").agg(F.min_by("endpoint_id", F.struct("ord", "endpoint_id")).alias("endpoint_id"))


def merged_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones added where they are missing."""
    return edges.unionByName(new).dropDuplicates(["src", "dst", "type"])


def updated_calls(calls: DataFrame, resolved: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls with their resolution written into them; those without one keep what they had."""
    target = resolved.join(endpoints.select("endpoint_id", F.col("path").alias("target_endpoint"), F.col("owner").alias("target_service")), "endpoint_id").select("call_id", "target_endpoint", "target_service", F.concat(F.lit("score "), F.col("score")).alias("reason"))
    return calls.join(target, "call_id", "left").withColumn("resolved", F.col("target_endpoint").isNotNull())


def topic_pairs(producers: DataFrame, consumers: DataFrame, topic: str = "topic") -> DataFrame:
    """Producers and consumers of the same topic, each side made distinct before the join."""
    return producers.select(topic, "producer").distinct().join(consumers.select(topic, "consumer").distinct(), topic)


def producer_outcome(producers: DataFrame, consumers: DataFrame, topic: str = "topic") -> DataFrame:
    """Each producer with its topic's least consumer, or the reason why there is none."""
    first = consumers.groupBy(topic).agg(F.min("consumer").alias("consumer"))
    state = scalars.topic_state(topic)
    reason = F.when(state != "literal", F.concat(F.lit("topic is "), state)).when(F.col("consumer").isNull(), "no consumer").otherwise("matched")
    return producers.select(topic, "producer").distinct().join(first, topic, "left").withColumn("reason", reason)


def project_of_url(projects: DataFrame, clone_url: str, html_url: str) -> DataFrame:
    """The project of a repository URL: by clone URL, else page URL, else clone URL without `.git`; the least id on ties."""
    urls = [clone_url, html_url, clone_url.removesuffix(".git")]
    rank = F.array_min(F.array_compact(F.array(*[F.when(F.array_contains("github_urls", u), i) for i, u in enumerate(urls)])))
    found = projects.withColumn("rank", rank).filter("rank IS NOT NULL")
    return found.groupBy().agg(F.min_by("project_id", F.struct("rank", "project_id")).alias("project_id"))


def displayed_target(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call_id, endpoint_id, rule): where a call is drawn to: its stored path with its verb, else its stored path, else an endpoint with its last segment.

    calls (call_id, verb, target_path, url); endpoints (endpoint_id, verb, path). The first rule that hits counts, then the least id. Only the
    least endpoint of a path with a verb, of a path and of a segment can win, so each call meets one row for each rule, however many share its segment.
    """
    last = lambda c: F.coalesce(F.try_element_at(segments(F.col(c)), F.lit(-1)), F.lit(""))
    left = calls.select("call_id", F.upper("verb").alias("v"), "target_path", F.when(~last("url").contains("{"), F.nullif(last("url"), F.lit(""))).alias("segment"))
    right = endpoints.select("endpoint_id", F.upper("verb").alias("w"), "path")
    least = F.min("endpoint_id").alias("endpoint_id")
    spoken = right.groupBy(F.col("path").alias("target_path"), F.col("w").alias("v")).agg(least)
    stored = right.groupBy(F.col("path").alias("target_path")).agg(least)
    parts = right.select("endpoint_id", F.explode(F.array_distinct(segments(F.col("path")))).alias("segment")).groupBy("segment").agg(least)
    met = lambda found, keys, rule: left.join(found, keys).select("call_id", "endpoint_id", F.lit(rule).alias("rule"))
    hits = met(spoken, ["target_path", "v"], 0).unionByName(met(stored, ["target_path"], 1)).unionByName(met(parts, ["segment"], 2))
    best = hits.groupBy("call_id").agg(F.min(F.struct("rule", "endpoint_id")).alias("b"))
    return best.select("call_id", "b.endpoint_id", "b.rule")
