"""Tables of the queries, and cuts of long lineages in the folder that the cluster names."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; only a local session without that setting gets a folder here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="codestrata-checkpoint-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the folder that the cluster shares; remove() takes such tables away."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    context = spark.sparkContext
    context._codestrata_tables = [*getattr(context, "_codestrata_tables", []), path]
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this, shuffle files are removed when the query that wrote them ends, not when the driver collects its garbage.

    For DataFrames that are made and run here; one that is returned should be made after it.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def staged(spark: SparkSession) -> list[str]:
    """Folders that cut() has written in this application, in order."""
    return list(getattr(spark.sparkContext, "_codestrata_tables", []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that were written before; DataFrames that read them can't be used any more."""
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    context._codestrata_tables = [path for path in staged(spark) if path not in set(paths)]


def ship(spark: SparkSession) -> None:
    """Sends this subpackage to the executors' Python, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_codestrata_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="codestrata-code-"), "codestrata_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(top, "__init__.py"), "codestrata/__init__.py")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"codestrata/llm/{name}")
    context.addPyFile(path)
    context._codestrata_shipped = True


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow, with this subpackage on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def where(docs: DataFrame, column: str, test: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows whose value passes a test of Arrow arrays: one column goes to Python, one boolean a row comes back.

    Workers give memory back after each batch.
    """
    ship(docs.sparkSession)

    def passes(values: pa.Array) -> pa.Array:
        try:
            return test(values)
        finally:
            release()

    return docs.where(F.arrow_udf(passes, "boolean")(docs[column]))


def release() -> None:
    """Gives memory that this Python worker has freed back to the system; workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches that gives memory back before its first and after each of its results."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for found in run(batches):
            yield found
            release()

    return runs


def lean_group(run: Callable) -> Callable:
    """A function of groups that gives memory back after each."""

    def runs(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            release()

    return runs


def by_group(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """applyInArrow on groups of a bounded size, with this subpackage on the executors."""
    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(run, schema)


def by_groups(a: DataFrame, b: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """applyInArrow on groups of two tables."""
    ship(a.sparkSession)
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInArrow(run, schema)


def remainder(doc_id: str, m: int):
    """crc32 of the id as text, modulo m: the fold of a document (null for a null id)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(m))
