"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str = "step") -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs in one process (tests), below one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="archgraph-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/archgraph-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """The frame as a written table: its lineage ends there, and no executor holds it."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._archgraph_folder = folder
    return table


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted as soon as it is written, not when the driver collects its garbage; then the session is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that `shared_folder` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a frame made by `written` that nothing will read any more."""
    if folder := getattr(df, "_archgraph_folder", None):
        removed(df.sparkSession, folder)


#: Bytes of a batch that a Python worker takes at once, so that its memory does not follow the length of texts.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that functions in it can be imported there; bounds their batches."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(context, "_archgraph_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="archgraph-package-")) / "archgraph.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._archgraph_shipped = True


#: Rows that a scan of long texts decodes at once: Spark's 4,096 are one array of all their bytes, which grows by doubling.
SCAN_ROWS = 128


@contextlib.contextmanager
def short_scans(spark: SparkSession) -> Iterator[None]:
    """Parquet scans that run inside decode SCAN_ROWS rows at once, so that an executor's heap follows long texts less; then the session is as before."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(SCAN_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)
