"""Pull-request events as a stream: parsed, latest state by key, expiry; and windowed counts of event tables.

The windowed counts are an extension beyond request handling: the event source itself has no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "action string, number bigint, repository struct<full_name: string, clone_url: string, html_url: string>, pull_request struct<head: struct<ref: string, sha: string>>"
BUILDING, CLOSING = ("opened", "synchronize", "reopened"), ("closed",)


def parsed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Events from JSON bodies or form bodies `payload=...`, with what to do: build, clean, pong or ignore. Broken JSON is ignored, with its body."""
    raw = F.when(F.col(body).startswith("payload="), F.url_decode(F.substring(F.col(body), F.lit(9), F.length(body)))).otherwise(F.col(body))
    event = F.from_json(raw, EVENT)
    todo = F.when(F.col("e.action").isin(*BUILDING), "build").when(F.col("e.action").isin(*CLOSING), "clean").when(raw.contains('"zen"'), "pong").otherwise("ignore")
    return bodies.withColumn("e", event).select("*", todo.alias("todo")).select(
        *[c for c in bodies.columns], F.col("e.action").alias("action"), F.col("e.number").alias("pr_number"), F.col("e.repository.full_name").alias("repository"), F.col("e.pull_request.head.sha").alias("sha"), "todo"
    )


def latest_state(events: DataFrame, at: str) -> DataFrame:
    """The last event of each pull request; of equal times the larger action."""
    return events.groupBy("repository", "pr_number").agg(F.max(F.struct(at, "action", "sha", "todo")).alias("v")).select("repository", "pr_number", "v.*")


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows; on a stream, rows later than `late` are left out and windows are emitted once."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total")


def run_available(stream: DataFrame, each_batch, checkpoint: str) -> None:
    """Handles all that has arrived, batch by batch, and ends; a restart goes on from the checkpoint."""
    stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
