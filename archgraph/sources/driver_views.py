"""The driver's star-schema tables seen as an architecture graph.

regions are applications, nations services, customers endpoints, orders methods, suppliers repositories, parts database
tables. nodes(id, type, label, owner, app_key, kind); edges(src, dst, type). An owner is the service a node belongs to.
Slices 'F' and 'O' of line status are two snapshots of the calls from methods to repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ("id", "type", "label", "owner", "app_key", "kind")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """All nodes, or those of some types: only the tables of those types are read."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")
    nation = t("nation")
    app = nation.select("n_nationkey", key("r", "n_regionkey").alias("app"))
    customer = t("customer")

    def row(df: DataFrame, ident: Column, kind: str, label: Column, owner: Column, app_key: Column, sort: Column) -> DataFrame:
        return df.select(ident.alias("id"), F.lit(kind).alias("type"), label.alias("label"), owner.alias("owner"), app_key.alias("app_key"), sort.alias("kind"))

    def methods() -> DataFrame:
        owned = customer.select("c_custkey", "c_nationkey").join(app, customer.c_nationkey == app.n_nationkey)
        orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        return row(orders.join(owned, orders.o_custkey == owned.c_custkey), key("o", "o_orderkey"), "Method", key("order", "o_orderkey"), key("n", "c_nationkey"), F.col("app"), F.col("o_orderpriority"))

    made = {
        "Application": lambda: row(t("region"), key("r", "r_regionkey"), "Application", F.col("r_name"), none, key("r", "r_regionkey"), none),
        "Service": lambda: row(nation, key("n", "n_nationkey"), "Service", F.col("n_name"), key("n", "n_nationkey"), key("r", "n_regionkey"), none),
        "Endpoint": lambda: row(customer.join(app, customer.c_nationkey == app.n_nationkey), key("c", "c_custkey"), "Endpoint", F.col("c_name"), key("n", "c_nationkey"), F.col("app"), F.col("c_mktsegment")),
        "Method": methods,
        "Repository": lambda: row(t("supplier").join(app, F.col("s_nationkey") == app.n_nationkey), key("s", "s_suppkey"), "Repository", F.col("s_name"), key("n", "s_nationkey"), F.col("app"), none),
        "DatabaseTable": lambda: row(t("part"), key("p", "p_partkey"), "DatabaseTable", F.col("p_name"), none, none, F.col("p_type")),
    }
    wanted = [k for k in made if types is None or k in types]
    out = made[wanted[0]]()
    for k in wanted[1:]:
        out = out.unionByName(made[k]())
    return out


def edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None, status: str | None = None) -> DataFrame:
    """All edges, or those of some types; `status` keeps the calls of one snapshot."""
    t = lambda name: table(spark, sf_dir, name)

    def lines() -> DataFrame:
        line = t("lineitem")
        return line.filter(F.col("l_linestatus") == status) if status else line

    def row(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))

    made = {
        "CONTAINS_SERVICE": lambda: row(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "CONTAINS_SERVICE"),
        "HAS_ENDPOINT": lambda: row(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "HAS_ENDPOINT"),
        "HAS_REPOSITORY": lambda: row(t("supplier"), key("n", "s_nationkey"), key("s", "s_suppkey"), "HAS_REPOSITORY"),
        "CALLS": lambda: row(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "CALLS").union(row(lines().select("l_orderkey", "l_suppkey").distinct(), key("o", "l_orderkey"), key("s", "l_suppkey"), "CALLS")),
        "ACCESSES": lambda: row(lines().select("l_suppkey", "l_partkey").distinct(), key("s", "l_suppkey"), key("p", "l_partkey"), "ACCESSES"),
    }
    wanted = [k for k in made if types is None or k in types]
    out = made[wanted[0]]()
    for k in wanted[1:]:
        out = out.union(made[k]())
    return out


def callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each repository back to the endpoint of its number, which close cycles of calls."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(known, "s_suppkey").select(key("s", "s_suppkey").alias("src"), key("c", "s_suppkey").alias("dst"), F.lit("CALLS_ENDPOINT").alias("type"))


def service_calls(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """(src, dst, weight): how many lines (of one snapshot, with `status`) of a service's orders another service's repositories fill. Pre-aggregated before each join."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem") if status is None else t("lineitem").filter(F.col("l_linestatus") == status)
    per = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    by_customer = per.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("n").alias("n"))
    joined = by_customer.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "l_suppkey").agg(F.sum("n").alias("n"))
    joined = joined.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.filter("c_nationkey <> s_nationkey").groupBy(key("n", "c_nationkey").alias("src"), key("n", "s_nationkey").alias("dst")).agg(F.sum("n").alias("weight"))


#: The same in SQL, as common table expressions for the oracle.
SQL = """
nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'Application' AS type, r_name AS label, NULL AS owner, 'r:' || r_regionkey AS app_key, NULL AS kind FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'Service', n_name, 'n:' || n_nationkey, 'r:' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'Endpoint', c_name, 'n:' || c_nationkey, 'r:' || n_regionkey, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'o:' || o_orderkey, 'Method', 'order:' || o_orderkey, 'n:' || c_nationkey, 'r:' || n_regionkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 's:' || s_suppkey, 'Repository', s_name, 'n:' || s_nationkey, 'r:' || n_regionkey, NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'p:' || p_partkey, 'DatabaseTable', p_name, NULL, NULL, p_type FROM part
), edges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'CONTAINS_SERVICE' AS type FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'HAS_ENDPOINT' FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'HAS_REPOSITORY' FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 's:' || l_suppkey, 'CALLS' FROM lineitem
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'ACCESSES' FROM lineitem
), callbacks AS (
  SELECT 's:' || s_suppkey AS src, 'c:' || c_custkey AS dst, 'CALLS_ENDPOINT' AS type FROM supplier JOIN customer ON c_custkey = s_suppkey
), rings AS (
  SELECT src, dst FROM edges WHERE type = 'CALLS' UNION ALL SELECT src, dst FROM callbacks
), service_calls AS (
  SELECT 'n:' || c_nationkey AS src, 'n:' || s_nationkey AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL
)"""
