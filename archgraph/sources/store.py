"""Snapshots, dimension rows, reports and vectors as partitioned tables; reading and atomic replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.sources.shared import removed, written


def save_snapshot(df: DataFrame, folder: str, snapshot_id: str, app_key: str | None = None) -> None:
    """Replaces one snapshot (or one application of it) and leaves all others: dynamic partition overwrite."""
    parts = ["snapshot_id"] + ["app_key"] * bool(app_key)
    rows = df.withColumn("snapshot_id", F.lit(snapshot_id))
    rows = rows.withColumn("app_key", F.lit(app_key)) if app_key else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)


def digests(df: DataFrame, partition: str) -> DataFrame:
    """(partition, rows, digest): the digest is the same for the same rows in any order, however often each."""
    parts = [c for c in df.columns if c != partition]
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in parts], *[F.col(c).isNull() for c in parts])
    return df.groupBy(partition).agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("digest"))


def save_changed(df: DataFrame, folder: str, partition: str) -> dict[str, int]:
    """Makes the table in a folder equal to the frame; only partitions whose rows changed are written, vanished ones are deleted. Returns how many of each.

    The frame is read twice, so it should be a table, and not one below the folder. The driver sees the values of changed partitions alone.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        df.write.partitionBy(partition).parquet(folder)
        return {"written": df.select(partition).distinct().count(), "deleted": 0}
    old = spark.read.schema(df.schema).parquet(folder).select(df.columns)
    now, was = digests(df, partition), digests(old, partition)
    # Null partitions are equal to each other.
    both = now.alias("n").join(was.alias("w"), F.col(f"n.{partition}").eqNullSafe(F.col(f"w.{partition}")), "full")
    changed = written(both.filter("n.rows IS NOT NULL AND NOT (n.rows <=> w.rows AND n.digest <=> w.digest)").select(F.col(f"n.{partition}").alias("__part")), "changed")
    gone = [r[0] for r in both.filter("n.rows IS NULL").select(f"w.{partition}").collect()]
    many = changed.count()
    if many:
        rows = written(df.join(changed, df[partition].eqNullSafe(changed["__part"]), "left_semi"), "changed_rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)
    for value in gone:
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, None if value is None else str(value))
        removed(spark, f"{folder.rstrip('/')}/{name}")
    return {"written": many, "deleted": len(gone)}


def read_snapshot(spark: SparkSession, folder: str, snapshot_id: str) -> DataFrame:
    """One snapshot: the partition filter prunes folders."""
    return spark.read.parquet(folder).filter(F.col("snapshot_id") == snapshot_id)


def shadow_id(project: str, shadow: str) -> str:
    return f"{project}::shadow::{shadow}"


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows with those of equal keys replaced by new ones. Both sides are reduced by key in one aggregation."""
    columns = [c for c in old.columns if c not in key]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(old.columns).withColumn("__new", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*columns), "__new").alias("v")).select(*key, *[F.col(f"v.{c}") for c in columns])


def patched(old: DataFrame, update: DataFrame, key: list[str]) -> DataFrame:
    """Old rows with the non-null fields of an update written over them and the version raised by one."""
    fields = [c for c in update.columns if c not in key]
    renamed = update.select(*key, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(1).alias("__hit"))
    out = old.join(renamed, key, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    if "version" in old.columns:
        out = out.withColumn("version", F.col("version") + F.coalesce("__hit", F.lit(0)))
    return out.select(old.columns)


def without_keys(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return df.join(gone.select(*key), key, "left_anti")


def expired(shadows: DataFrame, as_of: Column) -> DataFrame:
    """Shadow records past their time; a null time never expires."""
    return shadows.filter(F.col("expires_at") < as_of)


def with_ttl(shadows: DataFrame, hours: int = 24) -> DataFrame:
    return shadows.withColumn("expires_at", F.col("created_at") + F.make_interval(hours=F.lit(hours)))


def checked_vectors(df: DataFrame, dimensions: int) -> DataFrame:
    """Vectors of the wrong length raise while the job runs."""
    wrong = F.size("embedding") != dimensions
    return df.withColumn("embedding", F.when(~wrong, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("vector length "), F.size("embedding").cast("string")))))


def find_projects(projects: DataFrame, user: str | None = None, archived: bool | None = None, name: str | None = None, url: str | None = None) -> DataFrame:
    """Projects by owner, archive flag, part of a name in any case, and repository URL; what is not given doesn't count."""
    for wanted, test in ((user, F.col("user_id") == user), (archived, F.col("archived") == archived), (name, F.lower("name").contains((name or "").lower())), (url, F.array_contains("github_urls", url or ""))):
        projects = projects if wanted is None else projects.filter(test)
    return projects
