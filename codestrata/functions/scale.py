"""Helpers that keep hot groups spread out and long plans restartable."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Hashable
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 8_192  # of the order column: a repository is dealt over many tasks
STAGED: dict[str, list[str]] = {}  # folders that this process has written, by application
KEPT: dict[str, dict] = {}  # what is made once and stands on such folders, by application
Made = TypeVar("Made")


def position_in_key(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Zero-based position of each row in its key by an integer order column.

    Ranks inside blocks of the order column and adds the sizes of the blocks
    before it, so no task ever sorts a whole key.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(BLOCK)))
    sizes = blocked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        key, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(key, "_block").orderBy(order)
    ranked = blocked.withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [key, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_block", "_rank", "_offset")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str) -> DataFrame:
    """Top rows per key; Spark trims each partition to ``limit`` rows before it shuffles."""
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= limit)


def merge_on(key: str, base: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Left-join several tables with at most one row per key, in a single shuffle.

    All rows are stacked, each carrying its columns as one struct, and met again
    per key.  This takes one exchange of small rows where a chain of joins would
    plan, sort and adapt each join on its own.
    """
    tables = [base, *parts]
    packed = [
        t.select(key, F.struct(*(c for c in t.columns if c != key)).alias(f"_{i}")) for i, t in enumerate(tables)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    met = stacked.groupBy(key).agg(*(F.any_value(f"_{i}", True).alias(f"_{i}") for i in range(len(tables))))
    return met.where("_0 is not null").select(key, *(f"_{i}.*" for i in range(len(tables))))


def staging_folder(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, as named by the session."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = named or context.getCheckpointDir()
    if folder:
        return folder
    if context.master == "local" or context.master.startswith("local["):  # one machine: as in tests
        return os.path.join(tempfile.gettempdir(), "codestrata-staging")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the staging folder, which remove_staged removes."""
    target = f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"
    STAGED.setdefault(spark.sparkContext.applicationId, []).append(target)
    return target


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    The written table cuts the lineage, survives lost executors and lets every
    reader prune columns.
    """
    spark = df.sparkSession
    target = new_folder(spark, label)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def kept(spark: SparkSession, key: Hashable, make: Callable[[], Made]) -> Made:
    """What ``make`` gives, made once per application, and anew after its folders were removed."""
    values = KEPT.setdefault(spark.sparkContext.applicationId, {})
    if key not in values:
        values[key] = make()
    return values[key]


def remove_staged(spark: SparkSession) -> int:
    """Remove the intermediate tables this application has written; frames over them can't be read any more."""
    targets = STAGED.pop(spark.sparkContext.applicationId, [])
    KEPT.pop(spark.sparkContext.applicationId, None)
    for target in targets:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(targets)
