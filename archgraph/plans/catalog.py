"""Queries over the driver's tables, one or more for each operator family, each with SQL for comparison."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions import rules, scalars
from archgraph.operators import build, chunks, constants, cycles, diff, impact, neighbours, pattern, rebuild, render, resolve, substrings, summarize, traverse, typed
from archgraph.sources import driver_views as views
from archgraph.sources import extract, store
from archgraph.sources.shared import written
from archgraph.streaming import webhooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, graph: bool = False) -> Callable[[Query], Query]:
    """Registers a function under its name; `graph` puts the graph's table expressions before the SQL."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        # SQL with table expressions of its own goes on with them.
        ORACLE_SQL[fn.__name__] = sql if not graph else f"WITH {views.SQL}{sql.strip().replace('WITH ', ', ', 1)}" if sql.strip().startswith("WITH ") else f"WITH {views.SQL}\n{sql}"
        return fn

    return add


def recursive(sql: str) -> str:
    return f"WITH RECURSIVE {views.SQL.lstrip()}, {sql}"


# -- scans, filters, projections ---------------------------------------------------------------------------------------


@query("SELECT * FROM nodes WHERE id = 'c:17'", graph=True)
def point_lookup(spark, d):
    return pattern.lookup(views.nodes(spark, d), "c:17")


@query("SELECT * FROM nodes WHERE type IN ('Service', 'Repository', 'Application')", graph=True)
def type_filter(spark, d):
    return pattern.of_types(views.nodes(spark, d, ("Application", "Service", "Repository")), ["Service", "Repository"])


@query("SELECT * FROM nodes WHERE app_key = 'r:2' AND type <> 'DatabaseTable'", graph=True)
def application_scan(spark, d):
    return views.nodes(spark, d).filter("app_key = 'r:2' AND type <> 'DatabaseTable'")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, '.*00.*1')")
def glob_path_search(spark, d):
    return pattern.endpoints_where(views.table(spark, d, "customer"), pattern="*00*1", path_column="c_name").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def verb_beats_pattern(spark, d):
    return pattern.endpoints_where(views.table(spark, d, "customer"), "BUILDING", "*1", "c_mktsegment", "c_name").select("c_custkey")


@query("SELECT c_custkey, n.o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') n ON o_custkey = c_custkey")
def resolved_tristate(spark, d):
    calls = views.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("resolved"))
    return pattern.matching_calls(views.table(spark, d, "customer").select("c_custkey"), calls, "c_custkey", True).select("c_custkey", "o_orderkey")


@query(
    """SELECT id, label, type, lower(type) AS grp, CASE type WHEN 'Application' THEN '#2196F3' WHEN 'Endpoint' THEN '#8BC34A' WHEN 'Service' THEN '#FF9800' WHEN 'Method' THEN '#FFC107'
    WHEN 'Repository' THEN '#9C27B0' WHEN 'DatabaseTable' THEN '#673AB7' END AS colour, coalesce(owner, '-') AS owner_property FROM nodes""",
    graph=True,
)
def node_projection(spark, d):
    out = pattern.projected(views.nodes(spark, d))
    return out.select("id", "label", "type", "grp", "colour", F.coalesce(F.try_element_at("properties", F.lit("owner")), F.lit("-")).alias("owner_property"))


@query(
    """SELECT src || '-' || type || '-' || dst AS id, src AS source, dst AS target, type, lower(replace(type, '_', ' ')) AS label,
    CASE type WHEN 'CONTAINS_SERVICE' THEN '#FF9800' WHEN 'HAS_ENDPOINT' THEN '#8BC34A' WHEN 'CALLS' THEN '#2196F3' WHEN 'ACCESSES' THEN '#673AB7' ELSE '#9E9E9E' END AS colour FROM edges""",
    graph=True,
)
def edge_projection(spark, d):
    return pattern.projected_edges(views.edges(spark, d))


# -- pattern joins -----------------------------------------------------------------------------------------------------


@query("SELECT id, label FROM nodes WHERE type = 'Endpoint' AND EXISTS (SELECT 1 FROM edges WHERE src = id AND edges.type = 'CALLS')", graph=True)
def semi_sources(spark, d):
    return pattern.sources_with(views.nodes(spark, d, ("Endpoint",)), views.edges(spark, d, ("CALLS",)), "CALLS").select("id", "label")


@query("SELECT id, label FROM nodes WHERE type = 'Endpoint' AND id NOT IN (SELECT 'c:' || o_custkey FROM orders WHERE o_orderstatus = 'F')", graph=True)
def anti_sources(spark, d):
    done = views.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(views.key("c", "o_custkey").alias("src"), F.lit("CALLS").alias("type"))
    return pattern.without(views.nodes(spark, d, ("Endpoint",)), done, "CALLS").select("id", "label")


@query("SELECT src AS id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM edges WHERE type = 'ACCESSES' GROUP BY src", graph=True)
def expand_collect(spark, d):
    return pattern.expand(views.edges(spark, d, ("ACCESSES",)), "ACCESSES").select("id", F.array_join("targets", ",").alias("targets"))


@query("""SELECT DISTINCT a.src AS start, b.dst AS "end" FROM edges a JOIN edges b ON b.src = a.dst WHERE a.type = 'HAS_REPOSITORY' AND b.type = 'ACCESSES'""", graph=True)
def two_hop(spark, d):
    return pattern.hops(views.edges(spark, d, ("HAS_REPOSITORY", "ACCESSES")), "HAS_REPOSITORY", "ACCESSES")


@query("SELECT id, count(*) FILTER (edges.type = 'HAS_ENDPOINT') AS endpoints, count(*) FILTER (edges.type = 'HAS_REPOSITORY') AS repositories FROM nodes LEFT JOIN edges ON src = id WHERE nodes.type = 'Service' GROUP BY id", graph=True)
def optional_children(spark, d):
    found = pattern.with_counts(views.nodes(spark, d, ("Service",)), views.edges(spark, d, ("HAS_ENDPOINT", "HAS_REPOSITORY")), {"endpoints": "HAS_ENDPOINT", "repositories": "HAS_REPOSITORY"})
    return found.select("id", "endpoints", "repositories")


#: Events as topic links: user parity is the side; a topic is a type and a minute, so that some have one side only.
LINKS_SQL = "links AS (SELECT event_type || ':' || strftime(ts, '%d%H%M') AS topic, CASE WHEN user_id % 2 = 0 THEN 'producer' ELSE 'consumer' END AS side, user_id AS who, event_type || '.' || user_id AS detail FROM events)"


def links(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("user_id") % 2 == 0, "producer").otherwise("consumer")
    return views.table(spark, d, "events").select(F.concat("event_type", F.lit(":"), F.date_format("ts", "ddHHmm")).alias("topic"), side.alias("side"), F.col("user_id").alias("who"), F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("detail"))


@query(f"WITH {LINKS_SQL} SELECT topic FROM links GROUP BY topic HAVING count(*) FILTER (side = 'producer') > 0 AND count(*) FILTER (side = 'consumer') > 0")
def topic_both_sides(spark, d):
    return pattern.both_sides(links(spark, d), "topic", "side", "producer", "consumer")


@query(f"WITH {LINKS_SQL} SELECT topic FROM links GROUP BY topic HAVING count(*) FILTER (side = 'consumer') = 0")
def topics_without_consumers(spark, d):
    return pattern.orphans(links(spark, d), "topic", "side", "producer", "consumer")


@query(f"WITH {LINKS_SQL} SELECT topic FROM links GROUP BY topic HAVING count(*) FILTER (side = 'producer') = 0")
def topics_without_producers(spark, d):
    return pattern.orphans(links(spark, d), "topic", "side", "consumer", "producer")


@query(
    f"""WITH {LINKS_SQL} SELECT topic, coalesce(string_agg(DISTINCT detail, ',' ORDER BY detail) FILTER (side = 'producer'), '') AS producer_details, coalesce(string_agg(DISTINCT detail, ',' ORDER BY detail) FILTER (side = 'consumer'), '') AS consumer_details,
    count(DISTINCT who) FILTER (side = 'producer') AS n_producers, count(DISTINCT who) FILTER (side = 'consumer') AS n_consumers FROM links GROUP BY topic"""
)
def topic_flow(spark, d):
    flow = summarize.topic_flow(links(spark, d), "topic", "side", "who", "detail")
    return flow.select("topic", F.array_join("producer_details", ",").alias("producer_details"), F.array_join("consumer_details", ",").alias("consumer_details"), F.size("producer_whos").cast("bigint").alias("n_producers"), F.size("consumer_whos").cast("bigint").alias("n_consumers"))


@query(f"WITH {LINKS_SQL} SELECT DISTINCT p.topic, p.who AS producer, c.who AS consumer FROM links p JOIN links c ON p.topic = c.topic WHERE p.side = 'producer' AND c.side = 'consumer'")
def topic_pairing(spark, d):
    rows = links(spark, d)
    one = lambda s: rows.filter(F.col("side") == s).select("topic", F.col("who").alias(s))
    return resolve.topic_pairs(one("producer"), one("consumer"))


@query(
    f"""WITH {LINKS_SQL}, c AS (SELECT topic, min(who) AS consumer FROM links WHERE side = 'consumer' GROUP BY topic)
    SELECT DISTINCT l.topic, who AS producer, consumer, CASE WHEN consumer IS NULL THEN 'no consumer' ELSE 'matched' END AS reason FROM links l LEFT JOIN c ON c.topic = l.topic WHERE side = 'producer'"""
)
def topic_outcome(spark, d):
    rows = links(spark, d)
    one = lambda s: rows.filter(F.col("side") == s).select("topic", F.col("who").alias(s))
    return resolve.producer_outcome(one("producer"), one("consumer")).select("topic", "producer", "consumer", "reason")


@query(
    """SELECT DISTINCT e.src AS caller, a.owner AS caller_owner, a.type AS caller_type FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
    WHERE e.type = 'CALLS' AND b.owner = 'n:3' AND a.owner <> 'n:3'""",
    graph=True,
)
def callers_of_owner(spark, d):
    return pattern.callers_of_owner(views.edges(spark, d, ("CALLS",)), views.nodes(spark, d, ("Service", "Endpoint", "Method", "Repository")), "n:3")


@query("""SELECT DISTINCT p_partkey, w.word FROM part, (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part) w WHERE list_contains(regexp_split_to_array(p_name || ' ' || p_type, '[^A-Za-z0-9_]+'), w.word)""")
def signature_names(spark, d):
    part = views.table(spark, d, "part")
    words = part.select(F.explode(F.split("p_type", " ")).alias("word")).distinct()
    return pattern.containing(part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), "text", words, "word").select("p_partkey", "word")


@query(
    """WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS path FROM pages), p AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS prefix FROM u)
    SELECT page_id, prefix FROM u, p WHERE path <> '' AND prefix <> '' AND (starts_with(path, prefix) OR starts_with(prefix, path))"""
)
def prefix_consumers(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), r"[?#].*$", "")
    urls = views.table(spark, d, "pages").select("page_id", path.alias("path"))
    prefixes = urls.select(F.regexp_replace("path", "/[^/]*$", "").alias("prefix")).filter("prefix <> ''").distinct()
    return pattern.prefix_related(urls.filter("path <> ''"), "path", prefixes, "prefix").select("page_id", "prefix")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
def permitted_rows(spark, d):
    projects = views.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("user_id"), "c_name")
    rows = views.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"))
    return pattern.permitted(rows, projects, "MACHINERY").join(projects.select("project_id", "c_name"), "project_id").select("o_orderkey", "c_name")


# -- traversal ---------------------------------------------------------------------------------------------------------


@query(recursive("reached AS (SELECT 'p:5' AS id UNION SELECT e.src FROM edges e JOIN reached ON e.dst = reached.id WHERE e.type IN ('CALLS', 'ACCESSES')) SELECT id FROM reached WHERE id <> 'p:5'"))
def reach_callers(spark, d):
    start = spark.sql("SELECT 'p:5' AS id")
    return traverse.reach(views.edges(spark, d, ("CALLS", "ACCESSES")), start, reverse=True).select("id")


@query(recursive("reached AS (SELECT 'c:1' AS id UNION SELECT e.dst FROM edges e JOIN reached ON e.src = reached.id WHERE e.type IN ('CALLS', 'ACCESSES')) SELECT id FROM reached WHERE id <> 'c:1'"))
def reach_callees(spark, d):
    return traverse.reach(views.edges(spark, d, ("CALLS", "ACCESSES")), spark.sql("SELECT 'c:1' AS id")).select("id")


def rings(spark: SparkSession, d: str) -> DataFrame:
    """Calls of endpoints, methods and repositories with the callbacks that close cycles; grows with the tables."""
    return views.edges(spark, d, ("CALLS",)).unionByName(views.callbacks(spark, d)).select("src", "dst")


@query(recursive("reached AS (SELECT dst AS id FROM rings WHERE src = 'c:1' UNION SELECT e.dst FROM rings e JOIN reached ON e.src = reached.id) SELECT id FROM reached"))
def full_reach(spark, d):
    return traverse.reach(rings(spark, d), spark.sql("SELECT 'c:1' AS id")).select("id")


@query(recursive("""w AS (SELECT src AS start, dst AS "end", 1 AS depth, [src, dst] AS path FROM service_calls WHERE src = 'n:3' UNION ALL SELECT w.start, p.dst, depth + 1, list_append(path, p.dst) FROM w JOIN service_calls p ON p.src = w."end" WHERE depth < 3) SELECT start, "end", depth, array_to_string(path, '>') AS path FROM w"""))
def call_chain(spark, d):
    found = traverse.walks(views.service_calls(spark, d), spark.sql("SELECT 'n:3' AS id"), 3)
    return found.select("start", "end", "depth", F.array_join("path", ">").alias("path"))


@query(recursive("""w AS (SELECT dst AS start, src AS "end", 1 AS depth, [dst, src] AS path FROM rings WHERE starts_with(dst, 's:') UNION ALL SELECT w.start, p.src, depth + 1, list_append(path, p.src) FROM w JOIN rings p ON p.dst = w."end" WHERE depth < 3) SELECT start, "end", depth, array_to_string(path, '>') AS path FROM w"""))
def caller_chain(spark, d):
    starts = views.nodes(spark, d, ("Repository",)).select("id")
    return traverse.walks(rings(spark, d), starts, 3, reverse=True).select("start", "end", "depth", F.array_join("path", ">").alias("path"))


@query("""SELECT a.src AS start, b.dst AS "end", 2 AS depth, a.src || '>' || a.dst || '>' || b.dst AS path FROM edges a JOIN edges b ON b.src = a.dst WHERE a.type = 'CALLS' AND b.type = 'CALLS' AND b.dst = 's:1' AND starts_with(a.src, 'c:')""", graph=True)
def trails_to_method(spark, d):
    # From the target backwards, up to ten hops as asked for; what ends at an endpoint is a path from it.
    back = traverse.walks(views.edges(spark, d, ("CALLS",)), spark.sql("SELECT 's:1' AS id"), 10, trail=True, reverse=True)
    found = back.join(views.nodes(spark, d, ("Endpoint",)).select(F.col("id").alias("end")), "end", "left_semi")
    return found.select(F.col("end").alias("start"), F.col("start").alias("end"), "depth", F.array_join(F.reverse("path"), ">").alias("path"))


@query("SELECT src AS start, string_agg(DISTINCT dst, ',' ORDER BY dst) AS reached FROM (SELECT src, dst FROM edges WHERE type = 'CALLS' AND starts_with(src, 'c:') UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.type = 'CALLS' AND b.type = 'CALLS') WHERE starts_with(src, 'c:') GROUP BY src", graph=True)
def call_closure(spark, d):
    ends = views.nodes(spark, d, ("Endpoint",))
    return traverse.closure_collect(views.edges(spark, d, ("CALLS",)), ends, 5).select("start", F.array_join("reached", ",").alias("reached"))


@query(recursive("w AS (SELECT src AS start, dst AS id, 1 AS depth FROM service_calls UNION SELECT w.start, p.dst, depth + 1 FROM w JOIN service_calls p ON p.src = w.id WHERE depth < 3) SELECT start, string_agg(DISTINCT id, ',' ORDER BY id) AS reached FROM w GROUP BY start"))
def owner_dependencies_3(spark, d):
    links_ = views.service_calls(spark, d)
    return traverse.closure_collect(links_, views.nodes(spark, d, ("Service",)), 3).select("start", F.array_join("reached", ",").alias("reached"))


@query(recursive("""w AS (SELECT src AS start, dst AS "end", 1 AS depth, [src, dst] AS path FROM rings WHERE src = 'c:1' UNION ALL SELECT w.start, p.dst, depth + 1, list_append(path, p.dst) FROM w JOIN rings p ON p.src = w."end" WHERE depth < 5) SELECT start, "end", n.type, n.label, depth, array_to_string(path, '>') AS path FROM w JOIN nodes n ON n.id = w."end" """))
def call_tree(spark, d):
    return traverse.call_tree(rings(spark, d), views.nodes(spark, d, ("Endpoint", "Method", "Repository")), spark.sql("SELECT 'c:1' AS id"))


@query("""SELECT DISTINCT e3.src AS repository, e3.dst AS "table" FROM edges e1 JOIN edges e2 ON e2.src = e1.dst JOIN edges e3 ON e3.src = e2.dst WHERE e1.src = 'c:1' AND e1.type = 'CALLS' AND e2.type = 'CALLS' AND e3.type = 'ACCESSES'""", graph=True)
def database_access(spark, d):
    return traverse.accesses_reached(views.edges(spark, d, ("CALLS",)), views.edges(spark, d, ("ACCESSES",)), spark.sql("SELECT 'c:1' AS id"))


@query("SELECT DISTINCT src, dst, type FROM edges WHERE type <> 'ACCESSES'", graph=True)
def full_graph_depth(spark, d):
    return traverse.levels(views.nodes(spark, d), views.edges(spark, d, ("CONTAINS_SERVICE", "HAS_ENDPOINT", "HAS_REPOSITORY", "CALLS")), 3)


# -- counts ------------------------------------------------------------------------------------------------------------


@query("SELECT type AS metric, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'RepositoryWithTables', count(DISTINCT src) FROM edges WHERE type = 'ACCESSES'", graph=True)
def overview_totals(spark, d):
    return summarize.totals(views.nodes(spark, d), views.edges(spark, d, ("ACCESSES",)))


@query("SELECT coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def endpoints_by_method(spark, d):
    return summarize.grouped(views.table(spark, d, "customer"), "c_mktsegment", "UNKNOWN")


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def repositories_by_type(spark, d):
    return summarize.grouped(views.table(spark, d, "part"), "p_type")


@query("SELECT a.app_key, count(*) FILTER (n.type = 'Service') AS service, count(*) FILTER (n.type = 'Endpoint') AS endpoint, count(*) FILTER (n.type = 'Method') AS method, count(*) FILTER (n.type = 'Repository') AS repository FROM nodes a JOIN nodes n ON n.app_key = a.app_key WHERE a.type = 'Application' GROUP BY 1", graph=True)
def per_app_counts(spark, d):
    return summarize.per_application(views.nodes(spark, d, ("Application",)), views.nodes(spark, d), ("Service", "Endpoint", "Method", "Repository"))


@query("SELECT coalesce(owner, 'Unknown') AS owner, count(*) AS n, array_to_string(list_sort(list(DISTINCT label))[1:10], ',') AS \"values\" FROM nodes WHERE type = 'Endpoint' GROUP BY 1", graph=True)
def endpoints_grouped(spark, d):
    return summarize.lists_by(views.nodes(spark, d, ("Endpoint",)), "owner", "label", limit=10).withColumn("values", F.array_join("values", ","))


@query("SELECT 'node' AS part, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type", graph=True)
def graph_metadata(spark, d):
    return summarize.metadata(views.nodes(spark, d), views.edges(spark, d))


@query("SELECT count(DISTINCT type) AS depth FROM nodes", graph=True)
def graph_depth(spark, d):
    return views.nodes(spark, d).agg(F.countDistinct("type").alias("depth"))


@query("SELECT src, dst FROM service_calls", graph=True)
def owner_dependency_graph(spark, d):
    # The owner of a method is that of its customer; calls to repositories are what crosses owners here.
    calls = views.edges(spark, d, ("CALLS",))
    owners = views.nodes(spark, d, ("Method", "Repository", "Endpoint")).select("id", "owner")
    return summarize.owner_graph(calls, owners)


@query("SELECT app_key, count(*) AS table_accesses FROM edges JOIN nodes ON id = src WHERE edges.type = 'ACCESSES' GROUP BY 1", graph=True)
def table_accesses_per_app(spark, d):
    apps = views.nodes(spark, d, ("Repository",)).select(F.col("id").alias("src"), "app_key")
    return views.edges(spark, d, ("ACCESSES",)).groupBy("src").agg(F.count("*").alias("n")).join(apps, "src").groupBy("app_key").agg(F.sum("n").alias("table_accesses"))


@query("SELECT owner, count(*) AS n_methods, count(DISTINCT kind) AS n_kinds, max(id) AS last_id FROM nodes WHERE type = 'Method' GROUP BY 1", graph=True)
def analysis_totals(spark, d):
    return views.nodes(spark, d, ("Method",)).groupBy("owner").agg(F.count("*").alias("n_methods"), F.countDistinct("kind").alias("n_kinds"), F.max("id").alias("last_id"))


# -- order and first of key --------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def latest_snapshot(spark, d):
    return summarize.latest(views.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_key(spark, d):
    return summarize.top_per(views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_suppkey IS NOT NULL) WHERE k = 1")
def dedup_nodes(spark, d):
    return summarize.deduplicated(views.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), "l_suppkey", ["l_partkey", "l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_match(spark, d):
    return pattern.first_per(views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


# -- snapshots ---------------------------------------------------------------------------------------------------------


def part_snapshot(spark: SparkSession, d: str, status: str) -> DataFrame:
    """Parts that the lines of a snapshot name, with counts as properties."""
    line = views.table(spark, d, "lineitem").filter(F.col("l_linestatus") == status)
    return line.groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


SNAPSHOT_SQL = "WITH f AS (SELECT l_partkey AS name, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), o AS (SELECT l_partkey AS name, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), j AS (SELECT coalesce(f.name, o.name)::VARCHAR AS key, f.name AS fk, o.name AS ok, f.n AS fn, o.n AS ons, f.suppliers AS fs, o.suppliers AS os FROM f FULL JOIN o ON f.name = o.name), c AS (SELECT *, CASE WHEN fk IS NULL THEN 'ADDED' WHEN ok IS NULL THEN 'REMOVED' WHEN fn <> ons OR fs <> os THEN 'MODIFIED' END AS change FROM j)"


@query(f"{SNAPSHOT_SQL} SELECT key, change, CASE WHEN change = 'MODIFIED' THEN concat_ws(',', CASE WHEN fn <> ons THEN 'n' END, CASE WHEN fs <> os THEN 'suppliers' END) ELSE '' END AS changed FROM c WHERE change IS NOT NULL")
def snapshot_diff_nodes(spark, d):
    found = diff.node_diff(part_snapshot(spark, d, "F"), part_snapshot(spark, d, "O"), ("name",), ("n", "suppliers"))
    return found.select("key", "change", F.array_join("changed", ",").alias("changed"))


@query(f"{SNAPSHOT_SQL} SELECT key, 'n' AS property, fn::VARCHAR AS old_value, ons::VARCHAR AS new_value FROM c WHERE change = 'MODIFIED' AND fn <> ons UNION ALL SELECT key, 'suppliers', fs::VARCHAR, os::VARCHAR FROM c WHERE change = 'MODIFIED' AND fs <> os")
def snapshot_diff_props(spark, d):
    return diff.property_diff(diff.node_diff(part_snapshot(spark, d, "F"), part_snapshot(spark, d, "O"), ("name",), ("n", "suppliers")))


REL_SQL = "WITH f AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'F'), o AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'O'), r AS (SELECT *, 'REMOVED' AS change FROM (SELECT * FROM f EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'ADDED' FROM (SELECT * FROM o EXCEPT SELECT * FROM f))"


def accesses(spark: SparkSession, d: str, status: str) -> DataFrame:
    return views.table(spark, d, "lineitem").filter(F.col("l_linestatus") == status).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


@query(f"{REL_SQL} SELECT * FROM r")
def snapshot_diff_rels(spark, d):
    return diff.relation_diff(accesses(spark, d, "F"), accesses(spark, d, "O"), ["src", "dst"])


@query(f"{REL_SQL} SELECT r.* FROM r WHERE src IN (SELECT src FROM f) AND src IN (SELECT src FROM o)")
def snapshot_diff_common(spark, d):
    a, b = diff.within_common(accesses(spark, d, "F"), accesses(spark, d, "O"), "src")
    return diff.relation_diff(a, b, ["src", "dst"])


@query(f"{SNAPSHOT_SQL}, rf AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'F'), ro AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'O') SELECT 'node' AS part, 'Part' AS type, change, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY change UNION ALL SELECT 'relation', NULL, 'REMOVED', count(*) FROM (SELECT * FROM rf EXCEPT SELECT * FROM ro) UNION ALL SELECT 'relation', NULL, 'ADDED', count(*) FROM (SELECT * FROM ro EXCEPT SELECT * FROM rf)")
def diff_summary(spark, d):
    nodes = diff.node_diff(part_snapshot(spark, d, "F"), part_snapshot(spark, d, "O"), ("name",), ("n", "suppliers")).select(F.lit("Part").alias("type"), "change")
    return diff.summary(nodes, diff.relation_diff(accesses(spark, d, "F"), accesses(spark, d, "O"), ["src", "dst"]))


# -- cycles ------------------------------------------------------------------------------------------------------------

def of_status(status: str) -> str:
    """SQL of the service calls of one snapshot."""
    return f"""(SELECT DISTINCT 'n:' || c_nationkey AS src, 'n:' || s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey AND l_linestatus = '{status}')"""


def triangles(edges: str) -> str:
    """SQL of all simple cycles of two and three nodes, each from its least."""
    return f"""SELECT a.src || '>' || a.dst || '>' || b.dst AS signature, 2 AS length, 'ERROR' AS severity FROM {edges} a JOIN {edges} b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
 UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst, 3, 'ERROR' FROM {edges} a JOIN {edges} b ON b.src = a.dst JOIN {edges} c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst"""


@query(recursive("""w AS (SELECT src AS start, dst AS id, 1 AS depth FROM service_calls UNION SELECT w.start, p.dst, depth + 1 FROM w JOIN service_calls p ON p.src = w.id WHERE depth < 25), m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY ALL)
SELECT e.src, e.dst, m.depth + 1 AS length FROM service_calls e JOIN m ON m.start = e.dst AND m.id = e.src"""))
def owner_cycles(spark, d):
    """For each call between services on a cycle, how long a shortest one through it is."""
    return cycles.shortest_cycles(views.service_calls(spark, d)).select("src", "dst", "length")


@query(triangles("service_calls"), graph=True)
def owner_triangles(spark, d):
    return cycles.service_cycles(views.service_calls(spark, d), 3)


@query(f"SELECT signature, (i - 1)::INT AS position, string_split(signature, '>')[i] AS src, string_split(signature, '>')[i + 1] AS dst FROM ({triangles('service_calls')}) t, unnest(range(1, length + 1)) AS r(i)", graph=True)
def cycle_edges(spark, d):
    return cycles.cycle_edges(cycles.service_cycles(views.service_calls(spark, d), 3))


@query(f"SELECT a.*, a.signature NOT IN (SELECT signature FROM ({triangles(of_status('F'))})) AS new_in_shadow FROM ({triangles(of_status('O'))}) a")
def new_cycles(spark, d):
    """Cycles of the later of two snapshots, and which of them the earlier one lacks."""
    return cycles.marked_new(*(cycles.service_cycles(views.service_calls(spark, d, status), 3) for status in ("O", "F")))


def call_components(spark, d):
    """Nodes of the whole call graph that lie on cycles, with their component: tested against brute force, too slow in SQL."""
    return cycles.components(rings(spark, d))


QUERIES["call_components"] = call_components


# -- resolution --------------------------------------------------------------------------------------------------------

URL_SQL = r"""u AS (SELECT page_id, CASE WHEN contains(url, '://') AND regexp_replace(url, '^.*?://[^/]*', '') = '' THEN '' ELSE
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(url, '://') THEN regexp_replace(url, '^.*?://[^/]*', '') ELSE url END, '(.)[?].*$', '\1'), '(.)#.*$', '\1'), '/{2,}', '/', 'g'), '^(.+)/$', '\1') END AS path FROM (SELECT page_id, trim(url) AS url FROM pages))"""


@query(f"WITH {URL_SQL} SELECT page_id, path FROM u")
def normalize_url(spark, d):
    return views.table(spark, d, "pages").select("page_id", scalars.resolver_url("url").alias("path"))


@query(
    f"""WITH {URL_SQL}, s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u WHERE path <> '')
    SELECT page_id, path AS candidate FROM s UNION SELECT page_id, '/' || array_to_string(parts[2:], '/') FROM s WHERE len(parts) >= 2 UNION SELECT page_id, '/' || array_to_string(parts[3:], '/') FROM s WHERE len(parts) >= 3"""
)
def url_candidates(spark, d):
    return resolve.candidates(views.table(spark, d, "pages").select(F.col("page_id").alias("call_id"), "url")).select(F.col("call_id").alias("page_id"), "candidate")


#: Of every supplier (%) ten endpoints, the verb of each, a call that it answers, and the verb of the call: templates, equal paths, ends of paths either way, runs of 2, 3, 5 and 8 segments, wildcards.
ROUTES = (
    ("/svc%/orders/{id}", "GET", "/svc%/orders/7", "GET"), ("/svc%/items/list", "POST", "/svc%/items/list", "GET"), ("/svc%/short", "GET", "/a/b/c/svc%/short", "GET"), ("/api/v1/x/svc%/tail", "REQUEST", "/svc%/tail", "PUT"),
    ("/h%/u%/{x}", "GET", "/q/w/e/z/u%/9", "UNKNOWN"), ("/h%/u%/m/{x}", "PUT", "/q/w/e/z/u%/m/9", "PUT"), ("/h%/u%/m/n/o/{x}", "GET", "/q/w/e/z/u%/m/n/o/9", "GET"), ("/h%/u%/m/n/o/r/s/t/{x}", "PUT", "/q/w/e/z/u%/m/n/o/r/s/t/9", "GET"),
    ("/files%/**", "GET", "/files%/a/b/c", "GET"), ("/svc%/x{id}/{v}", "DELETE", "/svc%/x5/6", "DELETE"),
)
ROUTES_SQL = "routes AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, '{e}', '{v}', '{u}', '{w}')" for j, (e, v, u, w) in enumerate(ROUTES)) + ") AS t(j, template, verb, url, asked))"
#: The registry: all page paths, with variables for numbers, and the suppliers' endpoints. A path is its id. Calls: all pages, and the suppliers'.
ENDPOINTS_SQL = ROUTES_SQL + r""", ends AS (SELECT path AS endpoint_id, path, verb FROM (SELECT DISTINCT regexp_replace(path, '/[0-9]+', '/{id}', 'g') AS path, 'GET' AS verb FROM u WHERE path <> '' UNION ALL SELECT replace(template, '%', s_suppkey::VARCHAR), verb FROM supplier, routes)),
calls AS (SELECT 'p' || page_id AS call_id, path, 'GET' AS verb, NULL AS target FROM u WHERE path <> '' UNION ALL SELECT 's' || s_suppkey || '.' || j, replace(url, '%', s_suppkey::VARCHAR), asked, CASE WHEN j < 6 AND s_suppkey % 2 = 0 THEN replace(template, '%', s_suppkey::VARCHAR) END FROM supplier, routes)"""
SCORE_SQL = r"""cand AS (SELECT call_id, verb AS asked, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM calls),
cands AS (SELECT call_id, asked, path AS candidate FROM cand UNION SELECT call_id, asked, '/' || array_to_string(parts[2:], '/') FROM cand WHERE len(parts) >= 2 UNION SELECT call_id, asked, '/' || array_to_string(parts[3:], '/') FROM cand WHERE len(parts) >= 3),
pairs AS (SELECT call_id, asked, verb, endpoint_id, candidate, path, list_reverse(string_split(candidate, '/')) AS a, list_reverse(string_split(path, '/')) AS b FROM cands, ends),
runs AS (SELECT *, coalesce(list_position(list_transform(list_zip(a[1:least(len(a), len(b))], b[1:least(len(a), len(b))]), lambda z: z[1] = z[2] OR (starts_with(z[2], '{') AND suffix(z[2], '}'))), false) - 1, least(len(a), len(b))) AS run FROM pairs),
sc AS (SELECT call_id, asked, verb, endpoint_id, CASE WHEN candidate = path THEN 10 WHEN regexp_full_match(candidate, regexp_replace(replace(replace(replace(regexp_replace(path, '([.+?()\[\]^$|\\])', '\\\1', 'g'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*'), '\{[^}]+\}', '[^/]+', 'g')) THEN 8 WHEN suffix(candidate, path) THEN 7 WHEN suffix(path, candidate) THEN 5 WHEN len(a) >= 2 AND len(b) >= 2 AND run >= 2 THEN run + 1 ELSE 0 END AS score FROM runs)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' rows of ROUTES: number, template, verb, url, asked."""
    table = spark.createDataFrame([(j, *r) for j, r in enumerate(ROUTES)], "j int, template string, verb string, url string, asked string")
    k = F.col("s_suppkey").cast("string")
    return views.table(spark, d, "supplier").crossJoin(F.broadcast(table)).select("s_suppkey", "j", F.replace("template", F.lit("%"), k).alias("template"), "verb", F.replace("url", F.lit("%"), k).alias("url"), "asked")


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    paths = normalize_url(spark, d).filter("path <> ''").select(F.regexp_replace("path", "/[0-9]+", "/{id}").alias("path"), F.lit("GET").alias("verb")).distinct()
    return paths.union(routes(spark, d).select("template", "verb")).select(F.col("path").alias("endpoint_id"), "path", "verb")


def asked_calls(spark: SparkSession, d: str) -> DataFrame:
    pages = normalize_url(spark, d).filter("path <> ''").select(F.concat(F.lit("p"), "page_id").alias("call_id"), F.col("path").alias("url"), F.lit("GET").alias("verb"), F.lit(None).cast("string").alias("target_path"))
    target = F.when((F.col("j") < 6) & (F.col("s_suppkey") % 2 == 0), F.col("template"))
    return pages.union(routes(spark, d).select(F.concat(F.lit("s"), "s_suppkey", F.lit("."), "j"), "url", F.col("asked"), target))


BEST_SQL = "best AS (SELECT call_id, endpoint_id, max(score) AS score FROM sc WHERE {} GROUP BY ALL) SELECT call_id, endpoint_id, score FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, endpoint_id) AS k FROM best WHERE score >= 3) WHERE k = 1"


@query(f"WITH {URL_SQL}, {ENDPOINTS_SQL}, {SCORE_SQL}, {BEST_SQL.format('true')}")
def scored_resolution(spark, d):
    """Calls led through the tries of a registry that grows with the suppliers; every score from 3 to 10 wins somewhere."""
    return resolve.resolve(asked_calls(spark, d), endpoints(spark, d))


@query(f"WITH {URL_SQL}, {ENDPOINTS_SQL}, {SCORE_SQL}, " + BEST_SQL.format("asked IN ('UNKNOWN', 'REQUEST') OR verb = 'REQUEST' OR asked = verb"))
def verb_resolution(spark, d):
    """The same where verbs have to agree."""
    return resolve.resolve(asked_calls(spark, d), endpoints(spark, d), True)


@query(f"""WITH {URL_SQL}, {ENDPOINTS_SQL} SELECT call_id, min(endpoint_id) AS endpoint_id FROM calls, ends WHERE NOT contains(ends.path, '*') AND (calls.path = ends.path OR regexp_full_match(calls.path, regexp_replace(regexp_replace(ends.path, '([.+()\\[\\]^$|\\\\])', '\\\\\\1', 'g'), '\\{{[^}}]+\\}}', '[^/]+', 'g') || '(/.*)?')) GROUP BY 1""")
def first_match_resolution(spark, d):
    calls = asked_calls(spark, d).select("call_id", F.lit("GET").alias("verb"), F.col("url").alias("path"))
    # A registry of templates: wildcards are the scored resolution's.
    registry = endpoints(spark, d).filter("NOT contains(path, '*')").select("endpoint_id", F.lit("get").alias("verb"), "path", F.col("endpoint_id").alias("ord"))
    return resolve.first_match(calls, registry)


@query("SELECT DISTINCT src, dst, type FROM (SELECT src, dst, type FROM edges WHERE type = 'ACCESSES' UNION ALL SELECT 's:' || l_suppkey, 'p:' || (l_partkey + l_quantity::BIGINT % 2), 'ACCESSES' FROM lineitem)", graph=True)
def merged_edges(spark, d):
    # Half of the lines have an edge already, the other half name the part after theirs.
    part = F.concat(F.lit("p:"), F.col("l_partkey") + F.col("l_quantity").cast("bigint") % 2)
    new = views.table(spark, d, "lineitem").select(views.key("s", "l_suppkey").alias("src"), part.alias("dst"), F.lit("ACCESSES").alias("type"))
    return resolve.merged_edges(views.edges(spark, d, ("ACCESSES",)), new)


# -- scalar functions --------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN p = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(p, '\{[^}]+\}', '{*}', 'g'), '/\d+(/|$)', '/{*}\1', 'g'), '^(.+)/$', '\1') END AS path FROM (SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN CASE WHEN regexp_replace(url, '^https?://[^/]*', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '\?.*$', '') END ELSE regexp_replace(url, '\?.*$', '') END AS p FROM pages)""")
def normalize_path(spark, d):
    return views.table(spark, d, "pages").select("page_id", scalars.normalize_external_url("url").alias("path"))


@query("SELECT p_partkey, 'method:' || replace(p_brand, '#', '.') || '.' || p_name || '.find(' || string_split(p_type, ' ')[1] || ',int)' AS method, 'database_table:' || lower(p_name) AS \"table\", 'service:' || p_brand || '.' || p_name AS service, 'endpoint:GET:/' || p_partkey // 1 || '/x' AS endpoint FROM part")
def canonical_ids(spark, d):
    p = views.table(spark, d, "part")
    signature = F.concat(F.lit("Part find("), F.substring_index("p_type", " ", 1), F.lit(" name, int size)"))
    return p.select(
        "p_partkey", scalars.method_id(F.replace("p_brand", F.lit("#"), F.lit(".")), "p_name", F.lit("find"), signature).alias("method"), scalars.table_id("p_name").alias("table"), scalars.service_id("p_brand", "p_name").alias("service"),
        F.concat(F.lit("endpoint:GET:/"), F.col("p_partkey").cast("string"), F.lit("/x")).alias("endpoint"),
    )


@query("SELECT op, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(x, '^(find|get|read|select|query|count)') THEN 'READ' WHEN regexp_matches(x, '^(save|insert|create|add|persist)') THEN 'WRITE' WHEN regexp_matches(x, '^(update|modify|set)') THEN 'UPDATE' WHEN regexp_matches(x, '^(delete|remove)') THEN 'DELETE' ELSE 'UNKNOWN' END AS op FROM (SELECT lower(['findBy', 'saveAll', 'setName', 'removeOne', 'foo', 'countBy'][1 + event_id % 6] || event_type) AS x FROM events)) GROUP BY op")
def infer_operation(spark, d):
    names = F.array(*[F.lit(x) for x in ("findBy", "saveAll", "setName", "removeOne", "foo", "countBy")])
    name = F.concat(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")), F.col("event_type"))
    return views.table(spark, d, "events").select(rules.infer_operation(name).alias("op")).groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'fallback' ELSE '${name' || s_suppkey || '}' END AS value FROM supplier")
def placeholders(spark, d):
    k = F.concat(F.lit("name"), F.col("s_suppkey").cast("string"))
    text = F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("${"), k, F.lit(":fallback}"))).otherwise(F.concat(F.lit("${"), k, F.lit("}")))
    value = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name"))
    return views.table(spark, d, "supplier").select("s_suppkey", scalars.resolve_placeholder(text, value).alias("value"))


@query("SELECT doc_id, 'com.' || source || '.Doc' || doc_id AS class_name, 'com.' || source AS package FROM documents")
def file_to_class(spark, d):
    path = F.concat(F.lit("app/src/main/java/com/"), F.col("source"), F.lit("/Doc"), F.col("doc_id").cast("string"), F.lit(".java"))
    return views.table(spark, d, "documents").select("doc_id", scalars.class_of_file(path).alias("class_name"), scalars.package_of_file(path).alias("package"))


@query("SELECT p_partkey, lower(regexp_replace(replace(p_type, ' ', '') || 'Item', '([a-z])([A-Z])', '\\1_\\2', 'g')) AS table_name FROM part")
def snake_names(spark, d):
    return views.table(spark, d, "part").select("p_partkey", scalars.snake_case(F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("Item"))).alias("table_name"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, split_part(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.', 1) AS service FROM pages WHERE url LIKE 'http%'")
def service_of_url(spark, d):
    return views.table(spark, d, "pages").filter("url LIKE 'http%'").select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), scalars.service_of_url("url").alias("service"))


# -- impact and risk ---------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Controller' WHEN s_suppkey % 4 = 1 THEN 'Service' WHEN s_suppkey % 4 = 2 THEN 'Repository' ELSE 'Other' END AS component_type FROM supplier")
def file_component_map(spark, d):
    s = views.table(spark, d, "supplier")
    name = F.concat(F.lit("C"), F.col("s_suppkey").cast("string"))
    files = s.select("s_suppkey", F.concat(F.lit("m/src/main/java/a/b/"), name, F.lit(".java")).alias("filename"))
    kinds = F.array(F.array(F.lit("Service"), F.lit("Controller")), F.array(F.lit("Service")), F.array(F.lit("KafkaListener"), F.lit("Repository")))
    components = s.filter("s_suppkey % 4 < 3").select(name.alias("class_name"), F.explode(F.element_at(kinds, (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("type"))
    return impact.file_components(files, components).select("s_suppkey", "component_type")


@query(recursive("changed AS (SELECT 'n:3' AS owner UNION ALL SELECT 'n:8'), up AS (SELECT n.id FROM nodes n WHERE owner IN (SELECT owner FROM changed) UNION SELECT e.src FROM edges e JOIN up ON e.dst = up.id WHERE e.type = 'CALLS') SELECT id AS endpoint, owner, owner IN (SELECT owner FROM changed) AS directly_changed FROM nodes WHERE type = 'Endpoint' AND (owner IN (SELECT owner FROM changed) OR id IN (SELECT src FROM edges e JOIN up ON e.dst = up.id WHERE e.type = 'CALLS'))"))
def affected_endpoints(spark, d):
    changed = spark.sql("SELECT explode(array('n:3', 'n:8')) AS owner")
    return impact.affected_endpoints(views.edges(spark, d, ("CALLS",)), views.nodes(spark, d, ("Service", "Endpoint", "Method", "Repository")), changed)


@query(recursive("""w AS (SELECT src AS start, src AS id, 0 AS depth FROM service_calls UNION SELECT w.start, p.dst, depth + 1 FROM w JOIN service_calls p ON p.src = w.id WHERE depth < 3), m AS (SELECT start, id AS owner, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT start, string_agg(owner, '>' ORDER BY depth, owner) AS chain, arg_min(owner, (depth, owner)) FILTER (owner IN ('n:3', 'n:8')) AS affected_at FROM m GROUP BY start HAVING count(*) FILTER (owner IN ('n:3', 'n:8')) > 0"""))
def affected_flows(spark, d):
    links_ = views.service_calls(spark, d)
    starts = views.nodes(spark, d, ("Service",)).select(F.col("id").alias("start"), "id")
    reached = traverse.reach_of(links_, starts, 3)
    return impact.affected_flows(reached, views.nodes(spark, d, ("Service",)).select("id", "owner"), spark.sql("SELECT explode(array('n:3', 'n:8')) AS owner"))


#: For each page a patch that moves its path.
@query(f"WITH {URL_SQL} SELECT page_id, '/api' || path AS old_url, '/api/v2' || path AS new_url FROM u WHERE path <> '' AND NOT contains(path, '\"')")
def url_change_fold(spark, d):
    paths = normalize_url(spark, d).filter("path <> '' AND NOT contains(path, '\"')")
    patch = F.concat(F.lit('@@ -1 +1 @@\n-  get("/api'), F.col("path"), F.lit('")\n context\n+  get("/api/v2'), F.col("path"), F.lit('")\n+  x("/api/v2'), F.col("path"), F.lit('")'))
    return paths.select("page_id", F.inline(impact.url_changes(patch)))


@query(f"""WITH {URL_SQL}, c AS (SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN path || '/' WHEN 1 THEN path || '/more' WHEN 2 THEN regexp_replace(path, '^/[^/]*', '/other') ELSE regexp_replace(path, '/', '') END AS changed FROM u WHERE length(path) > 1),
  p AS (SELECT *, string_split(path, '/') AS a, string_split(regexp_replace(changed, '/+$', ''), '/') AS b FROM c)
  SELECT page_id, kind, CASE kind WHEN 'COMPLETE_REWRITE' THEN 35 WHEN 'MINOR_CHANGE' THEN 15 WHEN 'PATH_SEGMENT_CHANGE' THEN 25 ELSE 30 END AS points FROM (SELECT page_id, CASE WHEN NOT contains(changed, '/') THEN 'COMPLETE_REWRITE' WHEN len(a) <> len(b) THEN 'PATH_STRUCTURE_CHANGE' WHEN len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2])) = 0 THEN 'MINOR_CHANGE' WHEN len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2])) = 1 AND len(a) > 2 THEN 'PATH_SEGMENT_CHANGE' ELSE 'PATH_STRUCTURE_CHANGE' END AS kind FROM p)""")
def url_change_class(spark, d):
    k = F.col("page_id") % 4
    new = F.when(k == 0, F.concat("path", F.lit("/"))).when(k == 1, F.concat("path", F.lit("/more"))).when(k == 2, F.regexp_replace("path", "^/[^/]*", "/other")).otherwise(F.regexp_replace("path", "^/", ""))
    found = impact.change_class(F.col("path"), new)
    return normalize_url(spark, d).filter("length(path) > 1").select("page_id", found["kind"].alias("kind"), found["points"].alias("points"))


#: Counters of a change for each supplier, from its lines.
COUNTERS_SQL = """k AS (SELECT l_suppkey AS id, count(*) AS lines, (count(*) % 3)::INT AS url_changes, (count(*) % 3 * 25)::INT AS url_points, (count(*) % 5)::INT AS consumers, (count(*) % 4)::INT AS controllers, (count(*) % 2)::INT AS error_cycles, (count(DISTINCT l_partkey) % 7)::INT AS endpoints,
 (count(DISTINCT l_partkey) % 4)::INT AS flows, (count(*) % 2)::INT AS high_fan_in, (count(*) % 6)::INT AS services, (count(*) % 3)::INT AS listeners, (count(*) % 11)::INT AS components FROM lineitem GROUP BY 1),
s AS (SELECT *, least(40, least(40, url_points) + least(25, controllers * 10) + least(15, error_cycles * 10)) AS breaking, least(30, CASE WHEN url_changes = 0 THEN 0 WHEN consumers > 0 THEN least(20, consumers * 5) ELSE 5 END + least(15, endpoints * 3) + least(10, flows * 2) + least(5, high_fan_in * 3)) AS downstream,
 least(20, least(12, services * 4) + least(8, listeners * 8)) AS criticality, least(10, least(5, components // 2) + CASE WHEN lines > 500 THEN 5 WHEN lines > 250 THEN 3 WHEN lines > 100 THEN 2 ELSE 0 END) AS complexity FROM k),
t AS (SELECT *, breaking + downstream + criticality + complexity AS total FROM s), v AS (SELECT *, CASE WHEN total >= 70 THEN 'CRITICAL' WHEN total >= 50 THEN 'HIGH' WHEN total >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM t)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    n, parts = F.count("*"), F.countDistinct("l_partkey")
    zero = F.lit(0)
    counters = views.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        n.alias("lines"), (n % 3).alias("url_changes"), (n % 3 * 25).alias("url_points"), (n % 5).alias("consumers"), (n % 4).alias("controllers"), (n % 2).alias("error_cycles"), (parts % 7).alias("endpoints"), (parts % 4).alias("flows"),
        (n % 2).alias("high_fan_in"), (n % 6).alias("services"), (n % 3).alias("listeners"), (n % 11).alias("components"),
    )
    same = {"controllers_changed": F.col("controllers"), "controllers_modified": F.col("controllers"), "warning_cycles": zero, "repositories": zero, "warnings": zero, "nodes_removed": zero, "relations_removed": zero}
    return impact.risk(counters.withColumns(same))


@query(f"WITH {COUNTERS_SQL} SELECT id, breaking, downstream, criticality, complexity, total, level FROM v")
def risk_score(spark, d):
    return scored(spark, d).select("id", "breaking", "downstream", "criticality", "complexity", "total", "level")


@query(f"""WITH {COUNTERS_SQL} SELECT id, 'HIGH' AS severity, url_changes AS n, 'Service-to-service API endpoint URLs changed (' || url_changes || ' change(s))' || CASE WHEN consumers > 0 THEN ' affecting ' || consumers || ' downstream consumer(s)' ELSE ' (no consumers detected - may be dead code or external)' END || ' - WILL break integration' AS description FROM v WHERE url_changes > 0
 UNION ALL SELECT id, 'HIGH', url_changes, 'Graph relationship broken but not detected in diff - manual verification required' FROM v WHERE url_changes > 0
 UNION ALL SELECT id, 'HIGH', controllers, 'API signature likely changed in ' || controllers || ' controller(s)' FROM v WHERE breaking >= 20 AND controllers > 0 UNION ALL SELECT id, 'HIGH', error_cycles, 'Introduces ' || error_cycles || ' new circular dependency issues' FROM v WHERE error_cycles > 0 UNION ALL SELECT id, 'MEDIUM', endpoints, endpoints || ' API endpoints affected' FROM v WHERE endpoints >= 3
 UNION ALL SELECT id, 'MEDIUM', high_fan_in, high_fan_in || ' component(s) with multiple upstream callers modified' FROM v WHERE high_fan_in > 0 UNION ALL SELECT id, 'MEDIUM', flows, flows || ' request flows require coordination' FROM v WHERE flows >= 2""")
def risk_factors(spark, d):
    return impact.risk_factors(scored(spark, d), "id").select("id", "severity", "n", "description")


@query(f"""WITH {COUNTERS_SQL} SELECT id, CASE WHEN error_cycles > 0 THEN '⛔ Blocked - Circular dependency errors must be resolved' WHEN url_changes > 0 THEN '🚨 BLOCKED - Service integration will break - requires immediate coordination with affected teams' WHEN level = 'CRITICAL' THEN '⚠️ Requires architectural review and careful planning' WHEN level = 'HIGH' THEN '⚠️ Awaiting reviews from affected teams' WHEN level = 'MEDIUM' THEN '✅ Ready for review - moderate impact' ELSE '✅ Low risk - ready to merge after review' END AS merge_status,
 CASE WHEN url_changes > 0 THEN 'HALT - Coordinated deployment across all affected services required' WHEN level = 'CRITICAL' THEN 'Phased rollout with canary deployment' WHEN level = 'HIGH' AND endpoints >= 5 THEN 'Deploy behind feature flag with monitoring' WHEN level = 'HIGH' THEN 'Standard deployment with enhanced monitoring' WHEN level = 'MEDIUM' THEN 'Standard deployment with monitoring' ELSE 'Standard deployment' END AS recommendation,
 url_changes > 0 OR level = 'CRITICAL' OR (level = 'HIGH' AND endpoints >= 5) AS feature_flag, concat_ws(',', CASE WHEN controllers > 0 THEN '@api-team' END, CASE WHEN listeners > 0 THEN '@integration-team' END, CASE WHEN controllers = 0 AND listeners = 0 AND services > 0 THEN '@backend-team' END) AS teams FROM v""")
def merge_status(spark, d):
    plan = impact.deployment()
    return scored(spark, d).select("id", impact.merge_status().alias("merge_status"), plan["recommendation"].alias("recommendation"), plan["feature_flag"].alias("feature_flag"), F.array_join(impact.teams(), ",").alias("teams"))


#: The report of a change in SQL, from the counters alone.
REPORT_SQL = f"""WITH {COUNTERS_SQL}, w AS (SELECT *, url_changes > 0 OR level = 'CRITICAL' OR (level = 'HIGH' AND endpoints >= 5) AS flag, concat_ws(', ', CASE WHEN controllers > 0 THEN '@api-team' END, CASE WHEN listeners > 0 THEN '@integration-team' END, CASE WHEN controllers = 0 AND listeners = 0 AND services > 0 THEN '@backend-team' END) AS teams FROM v),
 x AS (SELECT *, concat_ws(chr(10), CASE WHEN url_changes > 0 THEN '- Service-to-service API endpoint URLs changed (' || url_changes || ' change(s))' || CASE WHEN consumers > 0 THEN ' affecting ' || consumers || ' downstream consumer(s)' ELSE ' (no consumers detected - may be dead code or external)' END || ' - WILL break integration' END,
   CASE WHEN url_changes > 0 THEN '- Graph relationship broken but not detected in diff - manual verification required' END, CASE WHEN breaking >= 20 AND controllers > 0 THEN '- API signature likely changed in ' || controllers || ' controller(s)' END, CASE WHEN error_cycles > 0 THEN '- Introduces ' || error_cycles || ' new circular dependency issues' END) AS high,
  concat_ws(chr(10), CASE WHEN endpoints >= 3 THEN '- ' || endpoints || ' API endpoints affected' END, CASE WHEN high_fan_in > 0 THEN '- ' || high_fan_in || ' component(s) with multiple upstream callers modified' END, CASE WHEN flows >= 2 THEN '- ' || flows || ' request flows require coordination' END) AS medium,
  concat_ws(chr(10), CASE WHEN endpoints > 0 AND teams <> '' THEN '- [ ] Request review from ' || teams END, CASE WHEN flows > 0 THEN '- [ ] Run integration tests for affected request flows' END, CASE WHEN controllers > 0 THEN '- [ ] Update API documentation for modified endpoints' END, CASE WHEN level IN ('HIGH', 'CRITICAL') THEN '- [ ] Coordinate deployment timeline with affected teams' END, CASE WHEN error_cycles > 0 THEN '- [ ] Review and resolve circular dependencies' END) AS steps FROM w)
 SELECT id, concat_ws(chr(10) || chr(10), '## 🏗️ Architecture Impact Report', '## 🎯 Risk Assessment', '**Overall Risk: ' || level || '** ' || CASE level WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END || '  ' || chr(10) || '**Risk Score: ' || total || '/100**',
  '### Score Breakdown' || chr(10) || '- 🔴 Breaking Changes: ' || breaking || '/40' || CASE WHEN breaking >= 20 THEN ' (High impact)' ELSE '' END || chr(10) || '- 🟡 Downstream Impact: ' || downstream || '/30' || CASE WHEN downstream >= 15 THEN ' (Significant)' ELSE '' END || chr(10) || '- 🟢 Service Criticality: ' || criticality || '/20' || CASE WHEN criticality >= 12 THEN ' (Critical services)' ELSE '' END || chr(10) || '- 🟢 Change Complexity: ' || complexity || '/10' || CASE WHEN complexity >= 7 THEN ' (Complex)' ELSE '' END, '---',
  CASE WHEN high <> '' OR medium <> '' THEN concat_ws(chr(10) || chr(10), '### ⚠️ Key Risk Factors', CASE WHEN high <> '' THEN '**HIGH SEVERITY**' || chr(10) || high END, CASE WHEN medium <> '' THEN '**MEDIUM SEVERITY**' || chr(10) || '@' END, '---') END,
  CASE WHEN steps <> '' THEN '### ✅ Recommended Actions' || chr(10) || chr(10) || '**Before Merging:**' || chr(10) || steps END,
  '**Deployment Strategy:**' || chr(10) || '- ' || CASE WHEN url_changes > 0 THEN 'HALT - Coordinated deployment across all affected services required' WHEN level = 'CRITICAL' THEN 'Phased rollout with canary deployment' WHEN level = 'HIGH' AND endpoints >= 5 THEN 'Deploy behind feature flag with monitoring' WHEN level = 'HIGH' THEN 'Standard deployment with enhanced monitoring' WHEN level = 'MEDIUM' THEN 'Standard deployment with monitoring' ELSE 'Standard deployment' END || chr(10)
   || CASE WHEN flag THEN '- Feature flag: **Required**' ELSE '- Feature flag: Not required' END || chr(10) || '- Reasoning: ' || CASE WHEN url_changes > 0 THEN 'Service-to-service API URLs changed - will break integration if not coordinated' WHEN level = 'CRITICAL' THEN 'High risk change requires gradual rollout' WHEN level = 'HIGH' THEN 'Significant architectural changes detected' WHEN level = 'MEDIUM' THEN 'Moderate impact on existing functionality' ELSE 'Low risk change with minimal impact' END,
  '**Merge Status:** ' || CASE WHEN error_cycles > 0 THEN '⛔ Blocked - Circular dependency errors must be resolved' WHEN url_changes > 0 THEN '🚨 BLOCKED - Service integration will break - requires immediate coordination with affected teams' WHEN level = 'CRITICAL' THEN '⚠️ Requires architectural review and careful planning' WHEN level = 'HIGH' THEN '⚠️ Awaiting reviews from affected teams' WHEN level = 'MEDIUM' THEN '✅ Ready for review - moderate impact' ELSE '✅ Low risk - ready to merge after review' END, '---',
  concat_ws(chr(10), '### Summary' || chr(10) || chr(10) || '| Metric | Count |' || chr(10) || '|--------|-------|', '| Architecture components changed | ' || components || ' |', '| Endpoints affected (in this service) | ' || endpoints || ' |', '| Request flows affected | ' || flows || ' |', '| New circular dependencies | ' || error_cycles || ' |', CASE WHEN url_changes > 0 THEN '| ⚠️ **API URL changes** | **' || url_changes || '** |' END, CASE WHEN url_changes > 0 THEN '| ⚠️ **Downstream consumers affected** | **' || consumers || '** |' END), '---') AS body FROM x"""


@query(REPORT_SQL.replace("chr(10) || '@'", "chr(10) || medium"))
def impact_reports(spark, d):
    return render.impact_report(scored(spark, d), "id")


#: For each service a change of its class: what that reaches.
@query(
    """WITH n AS (SELECT id, owner FROM nodes WHERE type = 'Service'), hit AS (SELECT n.owner, c.id FROM n JOIN nodes c ON c.owner = n.owner AND c.type = 'Endpoint' UNION SELECT s.owner, a.src FROM edges a JOIN edges b ON b.src = a.dst JOIN nodes s ON s.id = b.dst WHERE a.type = 'CALLS' AND b.type = 'CALLS' AND starts_with(a.src, 'c:')),
 e AS (SELECT owner, count(*) AS endpoints FROM hit GROUP BY owner), f AS (SELECT dst AS owner, count(*) AS callers FROM service_calls GROUP BY dst),
 k AS (SELECT n.owner AS change_id, coalesce(endpoints, 0) AS endpoints, (coalesce(callers, 0) >= 3)::INT AS high_fan_in FROM n LEFT JOIN e USING (owner) LEFT JOIN f USING (owner))
 SELECT change_id, endpoints, high_fan_in, least(30, least(15, endpoints * 3) + least(10, endpoints * 2) + least(5, high_fan_in * 3)) + 4 AS total FROM k""",
    graph=True,
)
def change_risk(spark, d):
    nodes = views.nodes(spark, d, ("Service", "Endpoint", "Method", "Repository")).select("id", F.col("type"), "label", "owner")
    services = nodes.filter("type = 'Service'")
    # A class name holds no space; the one file of a change has it as its name.
    named = F.regexp_replace("label", "[^A-Za-z0-9]", "_")
    files = services.select(F.col("owner").alias("change_id"), F.concat(F.lit("m/src/main/java/a/"), named, F.lit(".java")).alias("filename"), F.lit("").alias("patch"), F.lit("modified").alias("status"), F.lit(1).alias("lines"))
    components = nodes.withColumn("label", F.when(F.col("type") == "Service", named).otherwise(F.col("label"))).withColumn("type", F.when(F.col("type") == "Repository", "Store").otherwise(F.col("type")))
    none = lambda schema: spark.createDataFrame([], schema)
    found = impact.analyzed(files, components, views.edges(spark, d, ("CALLS",)), none("call_id string, url string"), none("change_id string, severity string"), none("change_id string, part string, change string, n bigint"))
    return found.select("change_id", "endpoints", "high_fan_in", "total")


# -- text and vectors --------------------------------------------------------------------------------------------------


@query("SELECT s.id, concat_ws(chr(10), 'Service: ' || s.label, 'Methods: ' || count(m.id), CASE WHEN count(m.id) > 0 THEN 'Method names: ' || array_to_string(list_sort(list(DISTINCT m.label))[1:10], ', ') END) AS text FROM nodes s LEFT JOIN nodes m ON m.owner = s.id AND m.type = 'Endpoint' WHERE s.type = 'Service' GROUP BY s.id, s.label", graph=True)
def chunk_text(spark, d):
    return chunks.service_text(views.nodes(spark, d, ("Service",)), views.nodes(spark, d, ("Endpoint",)))


@query("SELECT m.id, concat_ws(chr(10), 'Method: ' || m.owner || '.' || m.label, 'Type: ' || m.kind, CASE WHEN count(e.dst) > 0 THEN 'Calls: ' || array_to_string(list_sort(list(DISTINCT e.dst) FILTER (e.dst IS NOT NULL))[1:10], ', ') END) AS text FROM nodes m LEFT JOIN edges e ON e.src = m.id AND e.type = 'CALLS' WHERE m.type = 'Method' GROUP BY m.id, m.owner, m.label, m.kind", graph=True)
def method_chunks(spark, d):
    links_ = views.edges(spark, d, ("CALLS", "ACCESSES", "PRODUCES_TO")).filter("src LIKE 'o:%'").select("src", F.col("dst").alias("label"), "type")
    return chunks.method_text(views.nodes(spark, d, ("Method",)), links_)


@query("SELECT s.id, concat_ws(chr(10), 'Repository: ' || s.label, 'Package: ', 'Type: ', CASE WHEN count(e.dst) > 0 THEN 'Database Tables: ' || array_to_string(list_sort(list(DISTINCT e.dst)), ', ') END, 'Methods: 0') AS text FROM nodes s LEFT JOIN edges e ON e.src = s.id AND e.type = 'ACCESSES' WHERE s.type = 'Repository' GROUP BY s.id, s.label", graph=True)
def repository_chunks(spark, d):
    rows = views.nodes(spark, d, ("Repository",)).withColumn("package_name", F.lit(None).cast("string"))
    return chunks.repository_text(rows, views.edges(spark, d, ("ACCESSES",)).select("src", F.col("dst").alias("label"), "type"))


@query("SELECT s.id, concat_ws(chr(10), 'Controller: ' || s.label, 'Package: ', 'Base URL: /' || s.id, 'Endpoints: ' || count(c.id), CASE WHEN count(c.id) > 0 THEN 'Endpoint paths: ' || array_to_string(list_sort(list(DISTINCT c.kind || ' ' || c.label))[1:10], ', ') END) AS text FROM nodes s LEFT JOIN nodes c ON c.owner = s.id AND c.type = 'Endpoint' WHERE s.type = 'Service' GROUP BY s.id, s.label", graph=True)
def controller_chunks(spark, d):
    rows = views.nodes(spark, d, ("Service",)).select("id", "label", F.lit("").alias("package_name"), F.concat(F.lit("/"), F.col("id")).alias("base_url"))
    links_ = views.nodes(spark, d, ("Endpoint",)).select(F.col("owner").alias("src"), F.concat_ws(" ", "kind", "label").alias("label"), F.lit("HAS_ENDPOINT").alias("type"))
    return chunks.controller_text(rows, links_)


@query("SELECT c.id, concat_ws(chr(10), 'Endpoint: ' || c.kind || ' ' || c.label, 'Controller: ' || c.owner, 'Handler: h', 'Signature: h()', CASE WHEN count(e.dst) > 0 THEN 'Calls: ' || array_to_string(list_sort(list(DISTINCT e.dst))[1:10], ', ') END) AS text FROM nodes c LEFT JOIN edges e ON e.src = c.id AND e.type = 'CALLS' WHERE c.type = 'Endpoint' GROUP BY c.id, c.kind, c.label, c.owner", graph=True)
def endpoint_chunks(spark, d):
    rows = views.nodes(spark, d, ("Endpoint",)).withColumns({"handler": F.lit("h"), "signature": F.lit("h()")})
    return chunks.endpoint_text(rows, views.edges(spark, d, ("CALLS",)).filter("src LIKE 'c:%'").select("src", F.col("dst").alias("label"), "type"))


@query("SELECT id AS point_id, upper(type) AS level, 'p::' || upper(type) || '::' || id AS chunk_id, label AS class_name, app_key, CASE WHEN app_key IS NULL THEN 8 ELSE 9 END - 1 AS n FROM nodes WHERE type IN ('Service', 'Repository')", graph=True)
def chunk_payloads(spark, d):
    rows = views.nodes(spark, d, ("Service", "Repository"))
    text = lambda t: rows.filter(F.col("type") == t).select("id", F.col("label").alias("text"))
    found = chunks.chunked({"SERVICE": text("Service"), "REPOSITORY": text("Repository")}, rows.withColumns({"package_name": F.lit(None).cast("string"), "signature": F.lit(None).cast("string")}), "p")
    value = lambda k: F.try_element_at("payload", F.lit(k))
    return found.select("point_id", "level", value("chunkId").alias("chunk_id"), value("className").alias("class_name"), value("appKey").alias("app_key"), F.size("payload").alias("n"))


@query(
    """WITH r AS (SELECT n.id, 'CALLS' AS relation, dst AS other FROM nodes n JOIN edges e ON e.src = n.id AND e.type = 'CALLS' WHERE n.type = 'Endpoint' UNION SELECT n.id, '<HAS_ENDPOINT', src FROM nodes n JOIN edges e ON e.dst = n.id AND e.type = 'HAS_ENDPOINT' WHERE n.type = 'Endpoint' UNION SELECT n.id, 'ACCESSES', dst FROM nodes n JOIN edges e ON e.src = n.id AND e.type = 'ACCESSES' WHERE n.type = 'Repository'
 UNION SELECT n.id, 'HAS_ENDPOINT', dst FROM nodes n JOIN edges e ON e.src = n.id AND e.type = 'HAS_ENDPOINT' WHERE n.type = 'Service' UNION SELECT n.id, 'HAS_ENDPOINT/CALLS', f.dst FROM nodes n JOIN edges e ON e.src = n.id AND e.type = 'HAS_ENDPOINT' JOIN edges f ON f.src = e.dst AND f.type = 'CALLS' WHERE n.type = 'Service')
 SELECT id, relation, count(*) AS n, array_to_string(list_sort(list(other))[1:10], ',') AS neighbours FROM r GROUP BY ALL""",
    graph=True,
)
def typed_context(spark, d):
    level = F.when(F.col("type") == "Service", "CONTROLLER").otherwise(F.upper("type"))
    hits = views.nodes(spark, d, ("Service", "Endpoint", "Repository")).select("id", level.alias("level"))
    found = chunks.typed_context(hits, views.edges(spark, d, ("HAS_ENDPOINT", "CALLS", "ACCESSES")))
    return found.withColumn("neighbours", F.array_join("neighbours", ","))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in views.table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


VECTOR_SQL = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q)"


@query(f"WITH {VECTOR_SQL} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE label = 5 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    found = chunks.search(views.table(spark, d, "embeddings"), query_vector(spark, d), 10, F.col("label") == 5)
    return found.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {VECTOR_SQL} SELECT * FROM (SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10) WHERE score >= 0.1")
def vector_topk_min_score(spark, d):
    found = chunks.search(views.table(spark, d, "embeddings"), query_vector(spark, d), 10, min_score=0.1)
    return found.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("SELECT n.id, (SELECT array_to_string(list_sort(list(DISTINCT dst))[1:10], ',') FROM edges WHERE src = n.id) AS outgoing, (SELECT array_to_string(list_sort(list(DISTINCT src))[1:10], ',') FROM edges WHERE dst = n.id) AS incoming FROM nodes n WHERE type IN ('Service', 'Repository')", graph=True)
def context_expand(spark, d):
    found = chunks.context(views.nodes(spark, d, ("Service", "Repository")), views.edges(spark, d))
    return found.select("id", F.array_join("outgoing", ",").alias("outgoing"), F.array_join("incoming", ",").alias("incoming"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'c:' || c_custkey ELSE (SELECT min('c:' || d.c_custkey) FROM customer d WHERE d.c_name = customer.c_name) END AS node_id FROM customer")
def stale_chunks(spark, d):
    nodes = views.nodes(spark, d, ("Endpoint",))
    made = F.when(F.substring("id", 3, 20).cast("bigint") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("stale:"), F.substring("id", 3, 20)))
    found = chunks.relocated(nodes.select(made.alias("id"), "label"), nodes)
    return found.select(F.substring_index("id", ":", -1).cast("bigint").alias("id"), "node_id")


@query("SELECT c_custkey, 'Endpoint ' || c_name || ' of ' || n_name || ': {{OTHER}}' AS text FROM customer JOIN nation ON n_nationkey = c_nationkey")
def narrative(spark, d):
    rows = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", render.filled("Endpoint {{NAME}} of {{SERVICE}}: {{OTHER}}", {"NAME": F.col("c_name"), "SERVICE": F.col("n_name")}).alias("text"))


@query("SELECT a.app_key, a.label, string_agg(o.owner || ':' || o.e || ':' || o.m || ':' || o.r, ',' ORDER BY o.owner) AS services FROM nodes a LEFT JOIN (SELECT app_key, owner, count(*) FILTER (type = 'Endpoint') AS e, count(*) FILTER (type = 'Method') AS m, count(*) FILTER (type = 'Repository') AS r FROM nodes WHERE owner IS NOT NULL GROUP BY 1, 2) o ON o.app_key = a.app_key WHERE a.type = 'Application' GROUP BY 1, 2", graph=True)
def application_report(spark, d):
    found = render.application_report(views.nodes(spark, d, ("Application",)), views.nodes(spark, d))
    one = lambda s: F.concat_ws(":", s["owner"], s["endpoints"].cast("string"), s["methods"].cast("string"), s["repositories"].cast("string"))
    return found.select("app_key", "label", F.array_join(F.transform("services", one), ",").alias("services"))


# -- stores and events -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, 1 + (o_orderkey % 3 = 0)::INT AS version FROM orders")
def patched_rows(spark, d):
    old = views.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    update = old.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("status"))
    return store.patched(old, update, ["o_orderkey"])


@query("SELECT c_custkey AS id, coalesce(price, c_acctbal) AS price FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey UNION ALL SELECT -1 - o_custkey, max(o_totalprice) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def upserted_rows(spark, d):
    """Rows that stay, rows that are replaced and rows that are new."""
    orders = views.table(spark, d, "orders")
    best = lambda status, key: orders.filter(F.col("o_orderstatus") == status).groupBy(key.alias("id")).agg(F.max("o_totalprice").alias("price"))
    new = best("F", F.col("o_custkey")).unionByName(best("O", -1 - F.col("o_custkey")))
    return store.upserted(views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price")), new, ["id"])


@query("SELECT event_id FROM events WHERE ts + INTERVAL 24 HOURS < (SELECT max(ts) FROM events)")
def ttl_expired(spark, d):
    events = views.table(spark, d, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    return store.expired(store.with_ttl(events.withColumnRenamed("ts", "created_at")), F.lit(as_of)).select("event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    return webhooks.windowed_counts(views.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'opened' WHEN 1 THEN 'closed' ELSE 'labeled' END AS action, user_id AS pr_number, CASE event_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'clean' ELSE 'ignore' END AS todo FROM events")
def webhook_events(spark, d):
    action = F.element_at(F.array(F.lit("opened"), F.lit("closed"), F.lit("labeled")), (F.col("event_id") % 3 + 1).cast("int"))
    body = F.to_json(F.struct(action.alias("action"), F.col("user_id").alias("number")))
    form = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("payload="), F.url_encode(body))).otherwise(body)
    return webhooks.parsed(views.table(spark, d, "events").select("event_id", form.alias("body"))).select("event_id", "action", "pr_number", "todo")


# -- displays ----------------------------------------------------------------------------------------------------------


@query("WITH k AS (SELECT DISTINCT 'u:' || user_id AS id, event_type AS topic, user_id % 2 AS odd FROM events) SELECT id AS src, 'topic:' || topic AS dst, 'PRODUCES_TO' AS type FROM k WHERE odd = 0 UNION ALL SELECT 'topic:' || topic, id, 'CONSUMED_BY' FROM k WHERE odd = 1")
def topic_graph(spark, d):
    rows = views.table(spark, d, "events").select(views.key("u", "user_id").alias("id"), F.col("event_type").alias("topic"), (F.col("user_id") % 2).alias("odd"))
    return render.topic_graph(rows.filter("odd = 0"), rows.filter("odd = 1"))


@query("SELECT DISTINCT 'page' AS src, 'x:' || page_id AS dst, CASE WHEN page_id % 3 = 0 THEN 'UNKNOWN' ELSE 'GET' END || ' ' || url AS label, CASE WHEN page_id % 2 = 0 THEN '#4CAF50' ELSE '#F44336' END AS colour, page_id % 2 = 0 AS resolved FROM pages")
def external_graph(spark, d):
    k = F.col("page_id")
    calls = views.table(spark, d, "pages").select(F.lit("page").alias("node_id"), views.key("x", "page_id").alias("call_id"), F.when(k % 3 != 0, "GET").alias("verb"), "url", F.when(k % 2 == 0, True).alias("resolved"))
    return render.external_graph(calls)


@query("SELECT DISTINCT src, dst, type FROM edges WHERE type IN ('CONTAINS_SERVICE', 'HAS_ENDPOINT') OR (type = 'CALLS' AND starts_with(src, 'c:'))", graph=True)
def full_graph(spark, d):
    return traverse.full_graph(views.edges(spark, d), views.nodes(spark, d), 3)


@query("SELECT src AS id, CASE edges.type WHEN 'HAS_ENDPOINT' THEN 'endpoints' ELSE 'repositories' END AS section, row_number() OVER (PARTITION BY src, edges.type ORDER BY label, dst)::INT AS position, dst AS item, label FROM edges JOIN nodes ON id = dst WHERE edges.type IN ('HAS_ENDPOINT', 'HAS_REPOSITORY') UNION ALL SELECT dst, 'application', 1, src, label FROM edges JOIN nodes ON id = src WHERE edges.type = 'CONTAINS_SERVICE'", graph=True)
def service_details(spark, d):
    sections = {"endpoints": ("HAS_ENDPOINT", "out"), "repositories": ("HAS_REPOSITORY", "out"), "application": ("CONTAINS_SERVICE", "in")}
    return render.detail_report(views.nodes(spark, d, ("Service",)), views.nodes(spark, d), views.edges(spark, d), sections)


@query("SELECT 's:' || s_suppkey AS repository, (SELECT min('p:' || l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS \"table\" FROM supplier")
def access_graph(spark, d):
    return render.access_graph(views.nodes(spark, d, ("Repository",)), views.edges(spark, d, ("ACCESSES",)), first_only=True)


@query("SELECT app_key, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS producers, count(*) FILTER (user_id % 2 = 1) AS consumers FROM events JOIN customer ON c_custkey = user_id JOIN nodes ON id = 'c:' || c_custkey GROUP BY 1", graph=True)
def topic_sides_per_app(spark, d):
    links_ = views.table(spark, d, "events").select(views.key("c", "user_id").alias("id"), F.col("event_type").alias("topic"), F.when(F.col("user_id") % 2 == 0, "producer").otherwise("consumer").alias("side"))
    return summarize.sides_per_application(links_, views.nodes(spark, d, ("Endpoint",)))


@query(f"WITH {VECTOR_SQL} SELECT label, round(max(score), 6) AS most, round(min(score), 6) AS least, round(avg(score), 6) AS mean, count(*) AS n FROM s GROUP BY label")
def score_distribution(spark, d):
    constant = F.array(*[F.lit(x) for x in query_vector(spark, d)])
    found = summarize.scores(views.table(spark, d, "embeddings").select("label", chunks.cosine(F.col("embedding"), constant).alias("score")), "label")
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("most", "least", "mean")], "n")


@query(f"""WITH {URL_SQL}, {ENDPOINTS_SQL}, c AS (SELECT call_id, path AS url, target, verb, list_filter(string_split(path, '/'), lambda x: x <> '')[-1] AS last FROM calls),
  h AS (SELECT call_id, endpoint_id, CASE WHEN c.verb = ends.verb THEN 0 ELSE 1 END AS rule FROM c JOIN ends ON ends.path = c.target UNION ALL SELECT call_id, endpoint_id, 2 FROM c JOIN ends ON list_contains(string_split(ends.path, '/'), last) WHERE last <> '' AND NOT contains(last, '{{'))
  SELECT call_id, endpoint_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rule, endpoint_id) AS k FROM h) WHERE k = 1""")
def displayed_targets(spark, d):
    """Where calls are drawn to: the stored path with its verb, the stored path alone, an endpoint with the URL's last segment."""
    return resolve.displayed_target(asked_calls(spark, d), endpoints(spark, d))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'plain' ELSE s_name END AS value FROM supplier")
def field_constants(spark, d):
    k = F.col("s_suppkey").cast("string")
    fields = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.concat(F.lit("A.f"), k), F.col("s_name"), F.concat(F.lit("f"), k), F.lit("plain"))).otherwise(F.create_map(F.concat(F.lit("A.f"), k), F.col("s_name"), F.concat(F.lit("B.f"), k), F.lit("later")))
    return views.table(spark, d, "supplier").select("s_suppkey", scalars.field_value(fields, F.concat(F.lit("f"), k)).alias("value"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0 AND contains(lower(c_name), '#00')")
def project_search(spark, d):
    rows = views.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("user_id"), (F.col("c_acctbal") < 0).alias("archived"))
    return store.find_projects(rows, "BUILDING", True, "#00").select("c_custkey", F.col("name").alias("c_name"))


@query("SELECT config_type, count(*) AS n FROM (VALUES ('MAPPING_ANNOTATIONS', 6), ('REST_TEMPLATE_METHODS', 7), ('WEBCLIENT_HTTP_METHODS', 6), ('KAFKA_PRODUCER_METHODS', 2), ('KAFKA_PRODUCER_TYPES', 1), ('HTTP_URL_CONNECTION_METHODS', 5), ('REPOSITORY_WRITE_METHODS', 13), ('REPOSITORY_READ_METHODS', 8), ('ALLOWED_ANALYSIS_PACKAGES', 1)) AS t(config_type, k), range(k) GROUP BY 1")
def rule_tables(spark, d):
    return rules.rule_table(spark, {"KAFKA_PRODUCER_TYPES": ("KafkaTemplate",)}).groupBy("config_type").agg(F.count("*").alias("n"))


# -- construction ------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' WHEN 3 THEN 'Configuration' WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 'KafkaListener' ELSE 'Component' END ELSE CASE WHEN p_partkey % 3 = 0 THEN 'Repository' WHEN p_partkey % 2 = 0 THEN 'KafkaListener' END END AS kind FROM part
 WHERE p_size % 6 <> 5 OR p_partkey % 3 = 0 OR p_partkey % 2 = 0""")
def component_classification(spark, d):
    notes = F.array(*[F.array(F.lit(x)) for x in ("RestController", "Service", "Repository", "Configuration", "Component", "Data")])
    interfaces = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("JpaRepository"))).otherwise(F.array(F.lit("Runnable")))
    types = views.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("qualified_name"), F.element_at(notes, (F.col("p_size") % 6 + 1).cast("int")).alias("annotations"), interfaces.alias("interfaces"), (F.col("p_partkey") % 2 == 0).alias("has_listener"), F.lit(0).alias("ord"))
    return build.classified(types).select(F.col("qualified_name").cast("bigint").alias("p_partkey"), "kind")


@query("""WITH i AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 1000 AS t FROM lineitem), f AS (SELECT s_suppkey % 5 AS k, min(s_suppkey) AS first FROM supplier GROUP BY 1)
 SELECT DISTINCT 'm:' || s AS caller, CASE WHEN t % 5 = t % 7 AND x.s_suppkey IS NOT NULL THEN 'm:' || t ELSE 'm:' || first END AS callee FROM i LEFT JOIN supplier x ON x.s_suppkey = t LEFT JOIN f ON f.k = t % 7 WHERE (t % 5 = t % 7 AND x.s_suppkey IS NOT NULL) OR first IS NOT NULL""")
def call_resolution(spark, d):
    s = views.table(spark, d, "supplier")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    components = s.select(text("a.b.C", "s_suppkey").alias("qualified_name"), F.array().cast("array<string>").alias("interfaces"), F.col("s_suppkey").alias("ord"))
    methods = s.select(text("m:", "s_suppkey").alias("method_id"), text("a.b.C", "s_suppkey").alias("component_id"), F.concat(F.lit("run"), (F.col("s_suppkey") % 5).cast("string")).alias("method_name"), F.lit(None).cast("string").alias("signature"), F.col("s_suppkey").alias("ord"))
    injections = s.select(text("a.b.C", "s_suppkey").alias("component_id"), F.lit("unused").alias("field_name"), F.lit("Nothing").alias("declared"), F.lit(0).alias("ord"))
    pairs = views.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 1000).alias("t")).distinct()
    calls = pairs.select(
        F.concat_ws(":", "l_suppkey", "t").alias("invocation_id"), text("m:", "l_suppkey").alias("method_id"), text("a.b.C", "l_suppkey").alias("component_id"), F.lit(None).cast("string").alias("target_field"),
        text("C", "t").alias("declared"), F.concat(F.lit("run"), (F.col("t") % 7).cast("string")).alias("method_name"), F.lit(False).alias("self_call"),
    )
    return build.resolved_calls(calls, methods, injections, components)


@query("""SELECT event_id AS call, client, verb FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'RestTemplate' WHEN 1 THEN 'WebClient' WHEN 2 THEN 'HttpURLConnection' WHEN 3 THEN 'Feign' END AS client, CASE event_id % 5 WHEN 0 THEN 'PUT' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'GET' END AS verb FROM events) WHERE client IS NOT NULL""")
def external_call_classification(spark, d):
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % 5 + 1).cast("int"))
    calls = views.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("method_id"), pick("org.springframework.RestTemplate", "WebClient", "java.net.HttpURLConnection", "OrderClient", "KafkaTemplate").alias("declared"),
        pick("exchange", "post", "setRequestMethod", "fetch", "send").alias("method_name"), pick("HttpMethod.PUT", "x", "DELETE", "y", "topic").alias("argument"), F.lit("/u").alias("url"),
    )
    found = build.external_calls(calls, spark.sql("SELECT 'OrderClient' AS class_name"))
    return found.select(F.col("method_id").cast("bigint").alias("call"), F.col("client_type").alias("client"), F.col("http_method").alias("verb"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 't_' || s_suppkey ELSE 'order_item' || s_suppkey END AS table_name, CASE s_suppkey % 3 WHEN 0 THEN 'READ' WHEN 1 THEN 'DELETE,WRITE' ELSE 'DELETE,READ,WRITE' END AS operations FROM supplier""")
def repository_tables(spark, d):
    s = views.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    names = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("findAll"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("saveOne"), F.lit("removeAll"))).otherwise(F.array(F.lit("other")))
    repositories = s.select(k.alias("component_id"), F.concat(F.lit("OrderItem"), k).alias("entity"), F.lit("JpaRepository").alias("extends_class"), names.alias("method_names"))
    entities = s.select(F.concat(F.lit("a.b.OrderItem"), k).alias("qualified_name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("t_"), k)).alias("table_name"))
    found = build.repository_tables(repositories, entities)
    return found.select(F.col("component_id").cast("bigint").alias("s_suppkey"), "table_name", F.array_join("operations", ",").alias("operations"))


@query("SELECT DISTINCT coalesce(nullif(CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type END, ''), '<unknown>') AS name FROM events")
def topic_nodes(spark, d):
    return build.topics(views.table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("event_type")).alias("topic")))


@query("SELECT p_partkey, p_brand || '.' || p_size AS app FROM part")
def package_scoping(spark, d):
    part = views.table(spark, d, "part")
    base = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))
    types = part.select("p_partkey", F.concat(base, F.lit("_inner")).alias("package_name"))
    apps = part.select(F.concat(base, F.lit("_")).alias("base_package"), base.alias("app_key")).distinct()
    return build.scoped(types, apps).select("p_partkey", F.col("app_key").alias("app"))


#: A controller, a service, a repository with its entity and a client for each nation, as source text.
def sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    put = lambda text: F.replace(F.lit(text), F.lit("%"), k)
    text = put(
        'package a.b; @RestController @RequestMapping("/n%") class C% { private final S% svc; UserClient% users; KafkaTemplate kafka; static final String T = "topic" + ".%";\n'
        '  @GetMapping("/all") List<N%> all() { users.find("/users/%"); return svc.load("}"); } @PostMapping("/add") void add(@RequestBody N% n) { kafka.send(T, n); svc.store(n); } }\n'
        '@Service class S% { R% repo; List<N%> load(String s) { return repo.findAll(); } void store(N% n) { repo.save(n); load("x"); } }\n'
        '@Repository interface R% extends JpaRepository<N%, Long> { List<N%> findAll(); N% save(N% n); }\n'
        '@Entity class N% { } @FeignClient(name = "u") interface UserClient% { String find(String s); }'
    )
    return views.table(spark, d, "nation").select(F.concat(F.lit("src/main/java/a/b/C"), k, F.lit(".java")).alias("path"), text.alias("text"))


@query(
    """WITH n AS (SELECT n_nationkey::VARCHAR AS k FROM nation) SELECT replace(src, '%', k) AS src, replace(dst, '%', k) AS dst, type FROM n, (VALUES
 ('app', 'controller:a.b.C%', 'CONTAINS_CONTROLLER'), ('app', 'service:a.b.S%', 'CONTAINS_SERVICE'), ('app', 'repository:a.b.R%', 'CONTAINS_REPOSITORY'), ('controller:a.b.C%', 'endpoint:GET:/n%/all', 'HAS_ENDPOINT'), ('controller:a.b.C%', 'endpoint:POST:/n%/add', 'HAS_ENDPOINT'),
 ('service:a.b.S%', 'method:a.b.S%.load(String)', 'HAS_METHOD'), ('service:a.b.S%', 'method:a.b.S%.store(N%)', 'HAS_METHOD'), ('repository:a.b.R%', 'method:a.b.R%.findAll()', 'HAS_METHOD'), ('repository:a.b.R%', 'method:a.b.R%.save(N%)', 'HAS_METHOD'),
 ('endpoint:GET:/n%/all', 'method:a.b.S%.load(String)', 'CALLS'), ('endpoint:POST:/n%/add', 'method:a.b.S%.store(N%)', 'CALLS'), ('method:a.b.S%.load(String)', 'method:a.b.R%.findAll()', 'CALLS'), ('method:a.b.S%.store(N%)', 'method:a.b.R%.save(N%)', 'CALLS'), ('method:a.b.S%.store(N%)', 'method:a.b.S%.load(String)', 'CALLS'),
 ('endpoint:GET:/n%/all', 'external:REQUEST:{*}:resolved=false', 'MAKES_EXTERNAL_CALL'), ('endpoint:POST:/n%/add', 'kafka_topic:topic.%', 'PRODUCES_TO'), ('repository:a.b.R%', 'database_table:n%', 'ACCESSES')) AS t(src, dst, type)"""
)
def parsed_edges(spark, d):
    """From source text to edges."""
    return build.graph_of(extract.java_staging(sources(spark, d)), F.lit("app"))[1]


@query("SELECT replace(path, 'src/main/java/a/b/C', '') AS k, request_type, response_type FROM (SELECT 'src/main/java/a/b/C' || n_nationkey AS path, unnest([NULL, 'N' || n_nationkey]) AS request_type, unnest(['List<N' || n_nationkey || '>', NULL]) AS response_type FROM nation)")
def body_types(spark, d):
    methods = build.tables_of(extract.java_staging(sources(spark, d)), F.lit("app"))["methods"].filter("http_method IS NOT NULL")
    return build.body_types(methods).select(F.regexp_extract("component_id", r"(\d+)$", 1).alias("k"), "request_type", "response_type")


#: A forest of classes, one for each part: k extends k / 3 unless 5 divides k, has m0 to m3 with no or one parameter by a rule of k, and a field of the class k / 2 + 1.
#: Each declares a nested class of the same name, and run() calls through the field, results, a variable, itself and its superclass.
DECLARES = "(k * 3 + j * 5 + a * 7 + s) % 4 = 0"
#: How many sources a task parses at most, or so: the table of which they are made is far smaller than they, so its files are few tasks.
SOURCES_PER_TASK = 5_000


def class_sources(spark: SparkSession, d: str) -> DataFrame:
    part = views.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    part = part.repartition(part.count() // SOURCES_PER_TASK + 1, "k")
    put = lambda text, **v: functools.reduce(lambda t, kv: F.replace(t, F.lit("%" + kv[0]), F.expr(kv[1]).cast("string")), v.items(), F.lit(text))
    methods = [
        F.when(F.expr(DECLARES.replace("j", str(j)).replace("a", str(a))), put(f"C%r m{j}({'int x' if a else ''}) {{ }}\n", r=f"(k + {j} + {a} + 1) div 2")).otherwise("") for j in range(4) for a in (0, 1)
    ]
    head = F.concat(put("package p%p; import p0.*; import p1.*; import p2.*;\nclass C%k ", p="k % 3", k="k"), F.when(F.expr("k % 5 <> 0 AND k div 3 >= 1"), put("extends C%u ", u="k div 3")).otherwise(""), put("{ C%f f;\n", f="k div 2 + 1"))
    body = put(
        "void run() { f.m%a(1).m%b().m%c(2); C%f v = f; v.m%c(); this.m%b(3); super.m%a(); Inner i = new Inner(); i.go(); var w = f.m%b(4); w.m%a(5); f.list().stream().m0(); }\n"
        "static class Inner { C%f f; void go() { m%a(); } void list() { } } }",
        a="s % 4", b="(s + 1) % 4", c="(s + 2) % 4", f="k div 2 + 1",
    )
    return part.select(F.concat(F.lit("C"), F.col("k").cast("string"), F.lit(".java")).alias("path"), F.concat(head, *methods, body).alias("text"))


@query(
    f"""WITH RECURSIVE c AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 5 <> 0 AND p_partkey // 3 >= 1 THEN p_partkey // 3 END AS parent FROM part),
    up AS (SELECT k, k AS owner, 0 AS d FROM c UNION ALL SELECT up.k, c.parent, d + 1 FROM up JOIN c ON c.k = up.owner WHERE c.parent IS NOT NULL),
    has AS (SELECT k AS owner, j, a FROM c, range(4) AS t(j), range(2) AS u(a) WHERE {DECLARES}),
    defs AS (SELECT up.k, j, a, w, d, owner FROM up JOIN has USING (owner), range(2) AS x(w)),
    best AS (SELECT k, j, w, first(owner ORDER BY (a <> w)::INT, d) AS owner, first(a ORDER BY (a <> w)::INT, d) AS a FROM defs GROUP BY k, j, w),
    bestup AS (SELECT k, j, w, first(owner ORDER BY (a <> w)::INT, d) AS owner, first(a ORDER BY (a <> w)::INT, d) AS a FROM defs WHERE d > 0 GROUP BY k, j, w),
    -- calls on the field: m_a(1), then on its result m_b(), then m_c(2); m_b(4), then m_a(5)
    f1 AS (SELECT c.k, s, b.owner, b.j, b.a FROM c JOIN best b ON b.k = c.k // 2 + 1 AND b.j = s % 4 AND b.w = 1),
    f2 AS (SELECT f1.k, s, b.owner, b.j, b.a FROM f1 JOIN best b ON b.k = (f1.owner + f1.j + f1.a + 1) // 2 AND b.j = (s + 1) % 4 AND b.w = 0),
    f3 AS (SELECT f2.k, s, b.owner, b.j, b.a FROM f2 JOIN best b ON b.k = (f2.owner + f2.j + f2.a + 1) // 2 AND b.j = (s + 2) % 4 AND b.w = 1),
    w1 AS (SELECT c.k, s, b.owner, b.j, b.a FROM c JOIN best b ON b.k = c.k // 2 + 1 AND b.j = (s + 1) % 4 AND b.w = 1),
    w2 AS (SELECT w1.k, s, b.owner, b.j, b.a FROM w1 JOIN best b ON b.k = (w1.owner + w1.j + w1.a + 1) // 2 AND b.j = s % 4 AND b.w = 1),
    v AS (SELECT c.k, s, b.owner, b.j, b.a FROM c JOIN best b ON b.k = c.k // 2 + 1 AND b.j = (s + 2) % 4 AND b.w = 0),
    self AS (SELECT c.k, s, b.owner, b.j, b.a FROM c JOIN best b ON b.k = c.k AND b.j = (s + 1) % 4 AND b.w = 1),
    sup AS (SELECT c.k, s, b.owner, b.j, b.a FROM c JOIN bestup b ON b.k = c.k AND b.j = s % 4 AND b.w = 0),
    -- a nested class calls what the class around it has
    inn AS (SELECT c.k, s, b.owner, b.j, b.a FROM c JOIN best b ON b.k = c.k AND b.j = s % 4 AND b.w = 0),
    hit AS (SELECT k, 'run' AS caller, owner, j, a FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM v UNION ALL SELECT * FROM self UNION ALL SELECT * FROM sup)
      UNION ALL SELECT k, 'Inner.go', owner, j, a FROM inn)
    SELECT 'p' || k % 3 || '.C' || k AS class, caller, 'p' || owner % 3 || '.C' || owner || '.m' || j || '/' || a AS callee, count(*) AS calls FROM hit GROUP BY ALL
    UNION ALL SELECT 'p' || k % 3 || '.C' || k, 'run', 'p' || k % 3 || '.C' || k || '.Inner.go/0', 1 FROM c"""
)
def typed_calls(spark, d):
    """Every call of generated classes that differ, through fields, results, variables and what is inherited."""
    rows = written(extract.java_staging(class_sources(spark, d)), "staging")
    project = typed.Hierarchy(rows)
    calls = project.resolved(rows, names=False).filter("callee IS NOT NULL")
    named = project.methods.select("method_id", F.concat("type_id", F.lit("."), "name", F.lit("/"), F.col("arity").cast("string")).alias("method"), "type_id", "name")
    caller = named.select(F.col("method_id").alias("caller_id"), F.regexp_replace("type_id", r"\.Inner$", "").alias("class"), F.when(F.col("type_id").endswith(".Inner"), F.concat(F.lit("Inner."), "name")).otherwise(F.col("name")).alias("caller"))
    callee = named.select(F.col("method_id").alias("callee"), F.col("method").alias("called"))
    return calls.select(F.col("caller").alias("caller_id"), "callee").join(caller, "caller_id").join(callee, "callee").groupBy("class", "caller", F.col("called").alias("callee")).agg(F.count("*").alias("calls"))


#: A property for each order whose key 9 does not divide: the first few are texts, two in thirteen name each other, all others name that of half the key, with a default that has one itself.
@query(
    """WITH RECURSIVE o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey < 4 THEN 'text' WHEN o_orderkey % 13 > 1 THEN 'half' WHEN partner IN (SELECT o_orderkey FROM orders) AND partner % 9 <> 0 THEN 'ring' ELSE 'lost' END AS kind, partner
      FROM (SELECT *, o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE -1 END AS partner FROM orders) WHERE o_orderkey % 9 <> 0),
    t AS (SELECT k, k // 2 AS up, k AS last, 'v' || k || '.' AS said FROM o WHERE kind = 'half'
      UNION ALL SELECT t.k, o.k // 2, o.k, said || 'v' || o.k || '.' FROM t JOIN o ON o.k = t.up AND o.kind = 'half')
    SELECT 'c' || t.k AS symbol, CASE WHEN o.k IS NULL THEN said || 'd' || last % 7 WHEN o.kind = 'text' THEN said || 'end' || t.up WHEN o.kind = 'lost' THEN said || '${c' || o.partner || '}' ELSE 'v' || t.k || '.${c' || t.k // 2 || ':d' || t.k % 7 || '}' END AS value
    FROM t LEFT JOIN o ON o.k = t.up WHERE coalesce(o.kind, '') <> 'half'
    UNION ALL SELECT 'c' || k, CASE WHEN kind = 'text' THEN 'end' || k ELSE '${c' || partner || '}' END FROM o WHERE kind <> 'half'"""
)
def settled_properties(spark, d):
    """Every reference put in, as deep as it goes; circles and what depends on them stay as they are."""
    k = F.col("o_orderkey")
    text = F.when(k < 4, F.concat(F.lit("end"), k)).when(k % 13 == 0, F.concat(F.lit("${c"), k + 1, F.lit("}"))).when(k % 13 == 1, F.concat(F.lit("${c"), k - 1, F.lit("}")))
    half = F.concat(F.lit("v"), k, F.lit(".${c"), F.expr("o_orderkey div 2"), F.lit(":${none:d"), k % 7, F.lit("}}"))
    return constants.settled(views.table(spark, d, "orders").filter(k % 9 != 0).select(F.concat(F.lit("c"), k).alias("symbol"), F.coalesce(text, half).alias("value")))


@query("""WITH k AS (SELECT * FROM nodes WHERE app_key IS NOT NULL AND app_key NOT IN ('r:1', 'r:2')), used AS (SELECT DISTINCT dst FROM edges JOIN k ON k.id = src WHERE starts_with(dst, 'p:')),
  n AS (SELECT id FROM k UNION ALL SELECT dst FROM used), e AS (SELECT type FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
  SELECT 'node' AS part, left(id, 1) AS kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY ALL""", graph=True)
def deleted_applications(spark, d):
    """What stays of the whole graph when two applications are deleted, tables that others use included."""
    gone = spark.sql("SELECT explode(array('r:1', 'r:2')) AS app_key")
    nodes, edges = rebuild.without_applications(views.nodes(spark, d), views.edges(spark, d), gone)
    return nodes.groupBy(F.lit("node").alias("part"), F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("kind")).agg(F.count("*").alias("n")))


@query("""SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def vector_neighbours(spark, d):
    """Ten neighbours of every fiftieth vector among all, by blocks."""
    vectors = views.table(spark, d, "embeddings")
    return neighbours.nearest(vectors.filter("vec_id % 50 = 0"), vectors, 10, neighbours.centres(vectors), True)


def vector_cells(spark, d):
    """The same through an inverted file: tests hold its recall against all pairs."""
    vectors = views.table(spark, d, "embeddings")
    return neighbours.nearest(vectors.filter("vec_id % 50 = 0"), vectors, 10, neighbours.centres(vectors))


QUERIES["vector_cells"] = vector_cells


@query("""WITH t AS (SELECT p_partkey, p_name || '(' || p_type || ' ' || p_brand || ',' || p_size || ')' AS signature FROM part), n AS (SELECT DISTINCT substring(s_name, 12) AS name FROM supplier UNION SELECT DISTINCT c_mktsegment[2:5] FROM customer UNION SELECT DISTINCT p_name[4:8] FROM part UNION SELECT DISTINCT 'and#' || p_size FROM part UNION SELECT DISTINCT ',' || p_size FROM part)
    SELECT p_partkey, name FROM t JOIN n ON contains(signature, name) WHERE name <> ''""")
def signature_substrings(spark, d):
    """Names inside signatures at any place, not as whole words only."""
    part = views.table(spark, d, "part")
    text = F.concat("p_name", F.lit("("), "p_type", F.lit(" "), "p_brand", F.lit(","), "p_size", F.lit(")"))
    names = views.table(spark, d, "supplier").select(F.expr("substring(s_name, 12)").alias("name")).union(views.table(spark, d, "customer").select(F.expr("substring(c_mktsegment, 2, 4)")))
    names = names.union(part.select(F.expr("substring(p_name, 4, 5)"))).union(part.select(F.concat(F.lit("and#"), "p_size"))).union(part.select(F.concat(F.lit(","), "p_size"))).distinct()
    return substrings.containing(part.select("p_partkey", text.alias("signature")), "signature", names, "name").select("p_partkey", "name")


@query("SELECT o_custkey AS owner_id, o_orderkey AS member_id FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey % 2 = 1 OR c_custkey NOT IN (SELECT o_custkey FROM orders)")
def members_by_name(spark, d):
    owners = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("class_name"), F.lit("a").alias("app_key"))
    links_ = views.table(spark, d, "orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return build.with_members(owners, links_, owners.withColumn("id", -F.col("id")))


@query("SELECT event_type AS topic, 'Class' || user_id % 7 AS class_name, 'm' || user_id % 5 AS method_name, (user_id % 3)::INT AS line FROM events GROUP BY ALL")
def topic_registry(spark, d):
    u = F.col("user_id")
    text = F.concat(F.lit("Class"), (u % 7).cast("string"), F.lit(".m"), (u % 5).cast("string"), F.lit(" (line "), (u % 3).cast("string"), F.lit(")"))
    details = views.table(spark, d, "events").groupBy(F.col("event_type").alias("topic")).agg(F.collect_set(text).alias("detail"))
    return build.registry(details)


@query("SELECT l_suppkey AS snapshot_id, CASE WHEN l_suppkey % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, count(*) FILTER (l_linestatus = 'O' AND l_suppkey % 2 = 0) AS nodes_added, 0 AS nodes_modified, count(*) FILTER (l_linestatus = 'F' AND l_suppkey % 2 = 0) AS nodes_removed, 0 AS relations_added, 0 AS relations_removed FROM lineitem GROUP BY 1")
def shadow_rows(spark, d):
    line = views.table(spark, d, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("snapshot_id")).distinct().withColumns({"status": F.when(F.col("snapshot_id") % 2 == 0, "COMPLETED").otherwise("FAILED"), "diff_json": F.lit("{}")})
    change = F.when(F.col("l_linestatus") == "O", "ADDED").otherwise("REMOVED")
    counts = line.filter("l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("snapshot_id"), F.lit("node").alias("part"), change.alias("change")).agg(F.count("*").alias("n"))
    return diff.shown(rows, counts)


@query("SELECT o_orderkey, '## 🏗️ Architecture Impact Report' || chr(10) || chr(10) || CASE o_orderstatus WHEN 'F' THEN '> **Analysis failed** for branch `b' || o_custkey || '`' || chr(10) || chr(10) || '**Error:** ' || o_orderpriority || chr(10) || chr(10) || 'The shadow graph analysis could not be completed. This may be due to compilation issues in the branch or infrastructure problems.' ELSE '> **Analyzing** branch `b' || o_custkey || '` ...' || chr(10) || chr(10) || 'Shadow graph analysis is in progress. This comment will be updated with results.' END || chr(10) || chr(10) || '---' AS body FROM orders WHERE o_orderstatus IN ('F', 'O')")
def change_comments(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "ANALYZING").otherwise("COMPLETED")
    body = render.comment(state, F.concat(F.lit("b"), F.col("o_custkey").cast("string")), F.col("o_orderpriority"))
    return views.table(spark, d, "orders").select("o_orderkey", body.alias("body")).filter("body IS NOT NULL")
