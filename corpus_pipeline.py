"""The corpus pipeline: toxic documents, near duplicates, repeated passages and benchmark leaks go, the rest is encoded.

Each stage takes (spark, docs, sf_dir), where docs is the table that the stage before has written, and works on all of it.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import bpe, decontamination, jaccard, suffixes, toxicity
from codestrata.llm.tables import remove, shared_folder, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 200
LEFT: dict[tuple[str, str], list[str]] = {}  # what the last stage over a folder has staged, by application and folder


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS texts at once between Spark and Python, from here on in this session."""
    now = int(spark.conf.get(BATCH_CONF))
    spark.conf.set(BATCH_CONF, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


def alone(stage: Stage) -> Stage:
    """The stage, with small batches, after the tables that the stage before it over the same documents has staged are removed.

    That stage's rows are written by then.  Tables that other operators have staged are not touched.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        key = (spark.sparkContext.applicationId, sf_dir)
        remove(spark, LEFT.pop(key, []))
        before = set(staged(spark))
        rows = stage(spark, docs, sf_dir)
        LEFT[key] = [path for path in staged(spark) if path not in before]
        return rows

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", alone(toxicity.stage)),
    ("ngram_jaccard", alone(jaccard.stage)),
    ("suffix_array_dedup", alone(suffixes.stage)),
    ("decontamination", alone(decontamination.stage)),
    ("bpe", alone(bpe.stage)),
]

#: Trained, aligned and encoded rows are not what SQL can express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; each stage's rows are written and read again.

    A stage's rows are removed once the next stage's are written.
    """
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, read)
        docs, read = spark.read.parquet(path), [path]
    remove(spark, LEFT.pop((spark.sparkContext.applicationId, sf_dir), []))
    return docs
