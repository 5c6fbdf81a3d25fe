"""From raw documents to batches: five stages, each on all that the one before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm import jaccard, language, lempelziv, linechain, packing
from archgraph.llm.common import table, written
from archgraph.sources.shared import ship

#: A prefix that no column of the input has, for what a stage adds and drops again.
OWN = "__stage_"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without a letter or with a narrow margin go."""
    found = language.identify(docs, language.dictionaries(docs), prefix=OWN)
    return found.filter(~F.col(f"{OWN}rejected")).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose words are mostly in content lines."""
    field = linechain.fitted(docs, table(spark, sf_dir, "labels"))
    return linechain.judge(docs, field, prefix=OWN).filter(f"{OWN}kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 0.8 or more of their five-word shingles: that of the smallest id, a null id last.

    SimHash fingerprints of those shingles are linked by covering LSH, and an exact join completes the links. Rows are numbered, so
    repeated and null ids are rows like others.
    """
    row = f"{OWN}row"
    held = written(docs.withColumn(row, F.monotonically_increasing_id()))
    of = jaccard.groups(held, row).withColumnRenamed("row", row)
    first = held.select(row, "doc_id").join(of, row).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    return held.join(first.select(f"first.{row}"), row, "left_semi").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text. A text that loses nothing stays as it is."""
    own = {c: f"{OWN}{c}" for c in docs.columns if c not in ("doc_id", "text")}
    kept = lempelziv.deduplicate(docs.withColumnsRenamed(own), keep=tuple(own.values()), intact=True)
    if "n_chars" in own:
        n = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
        kept = kept.withColumn(own["n_chars"], n)
    return kept.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches."""
    return packing.pack(docs)


def shipped(stage):
    """The stage, after the package has been sent to the executors."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", shipped(keep_languages)),
    ("quality_rules", shipped(keep_quality)),
    ("near_duplicates", shipped(drop_near_duplicates)),
    ("repeated_passages", shipped(drop_repeated_passages)),
    ("packing", shipped(pack)),
]

#: SQL cannot express a trained stage; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
