"""Checked-out trees as a table of files, and reading again only what has changed.

Folders are listed level by level, a job for each level, and the files of all folders are read in parallel.  (Spark's own
file source leaves out names that begin with a dot or an underscore, such as ``.gitignore`` and ``__init__.py``; analyses
need these.)  The folder must lie on a file system that all executors have mounted under the same path.  The first folder
below it is the repository.  Links are not followed; folders that never hold a repository's own files are not entered.

A store keeps what was read: ``index/run=N`` lists all files as of run N with the run that read them, ``files/run=N``
holds the files that run N read.  A file is read again when its size or time of change differs from the last index.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import stage
from ..operators.facts import ignore_rules
from .corpus import Corpus, text_of

C = F.col
NOT_ENTERED = [".git", ".hg", ".svn"]
ENTRY = "path string, folder boolean, size_bytes bigint, modified bigint"
BATCH_BYTES = 32 << 20
FILES_PER_TASK_BYTES = 128 << 20


def listed(folders: DataFrame, skip: list[str]) -> DataFrame:
    """Entries of folders: files and folders, without links and other kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "folder", "size_bytes", "modified"]
        types = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows: list[tuple] = []
        for batch in batches:
            for folder in batch["path"].to_pylist():
                with os.scandir(folder) as entries:
                    for entry in entries:
                        about = entry.stat(follow_symlinks=False)
                        is_folder = stat.S_ISDIR(about.st_mode)
                        if (is_folder and entry.name not in skip) or stat.S_ISREG(about.st_mode):
                            rows.append((entry.path, is_folder, 0 if is_folder else about.st_size, about.st_mtime_ns // 1000))
                        if len(rows) >= 10_000:
                            yield out(rows)
                            rows = []
        if rows:
            yield out(rows)

    return folders.select("path").mapInArrow(run, ENTRY)


def listing(spark: SparkSession, folder: str, skip: list[str] | None = None) -> DataFrame:
    """repo, path, place, size_bytes and modified (microseconds) of all files of the repositories below a folder."""
    top = os.path.abspath(folder)
    level = spark.createDataFrame([(top,)], "path string")
    levels = []
    while True:
        # folders are dealt anew, so that the children of one large folder are listed by many tasks
        found = stage(listed(level, NOT_ENTERED if skip is None else skip), "listing")
        levels.append(found.where("not folder"))
        level = found.where("folder").select("path").repartition("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionByName, levels).withColumn("below", F.substring("path", len(top.rstrip("/")) + 2, 1 << 30))
    inside = files.where(F.contains("below", F.lit("/")))
    return inside.select(
        F.substring_index("below", "/", 1).alias("repo"), F.expr("substring(below, instr(below, '/') + 1)").alias("path"),
        C("path").alias("place"), "size_bytes", "modified",
    )


def contents(files: DataFrame) -> DataFrame:
    """The files of a listing with their text; dealt by size, read whole, handed on in batches of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            places = batch["place"].to_pylist()
            for i, place in enumerate(places):
                with open(place, "rb") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == len(places):
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part["repo"], part["path"], part["modified"], pa.array(held, pa.binary())], ["repo", "path", "modified", "raw"])
                    start, held, size = i + 1, [], 0

    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(1, total // FILES_PER_TASK_BYTES, min(files.sparkSession.sparkContext.defaultParallelism, total >> 20))
    raw = files.repartition(int(tasks), "place").mapInArrow(run, "repo string, path string, modified bigint, raw binary")
    size = F.octet_length("raw").cast("bigint")
    return raw.select("repo", "path", size.alias("size_bytes"), text_of(C("raw")).alias("content"), "modified")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """repo, path, size_bytes and content of every file below a folder of checked-out repositories."""
    return contents(listing(spark, folder)).drop("modified")


def runs(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the runs that were finished, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/index")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [s.getPath() for s in system.listStatus(path)]
    done = [p for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def ingest(spark: SparkSession, folder: str, store: str) -> int:
    """Reads what is new or changed since the last run into the store, and gives the run's number.

    The index is written last: a run that fails has no index, is not a run, and is written over by the next one.
    """
    earlier = runs(spark, store)
    run = earlier[-1] + 1 if earlier else 0
    now = listing(spark, folder)
    if earlier:
        last = spark.read.parquet(f"{store}/index/run={earlier[-1]}")
        known = last.select("repo", "path", C("size_bytes").alias("old_size"), C("modified").alias("old_time"), "read_in")
        now = now.join(known, ["repo", "path"], "left")
        same = (C("size_bytes") == C("old_size")) & (C("modified") == C("old_time"))
        now = now.withColumn("read_in", F.when(same, C("read_in"))).drop("old_size", "old_time")
    else:
        now = now.withColumn("read_in", F.lit(None).cast("int"))
    now = stage(now, "tree")
    contents(now.where("read_in is null")).write.mode("overwrite").parquet(f"{store}/files/run={run}")
    index = now.withColumn("read_in", F.coalesce("read_in", F.lit(run))).drop("place")
    index.write.mode("overwrite").parquet(f"{store}/index/run={run}")
    return run


def stored_files(spark: SparkSession, store: str, run: int | None = None) -> DataFrame:
    """repo, path, size_bytes and content as of a run, by default the last; from whichever runs read them."""
    run = runs(spark, store)[-1] if run is None else run
    index = spark.read.parquet(f"{store}/index/run={run}").select("repo", "path", "read_in")
    needed = sorted(r[0] for r in index.select("read_in").distinct().collect())  # at most one row a run
    schema = "repo string, path string, size_bytes bigint, content string, modified bigint, run int"
    places = [f"{store}/files/run={r}" for r in needed]
    files = spark.read.schema(schema).option("basePath", f"{store}/files").parquet(*places) if places else spark.createDataFrame([], schema)
    return files.join(index, [files["repo"] == index["repo"], files["path"] == index["path"], files["run"] == index["read_in"]], "left_semi").drop("modified", "run")


def changes(spark: SparkSession, store: str, old: int, new: int) -> DataFrame:
    """repo, path and what happened to it between two runs: added, changed or removed."""
    before, after = (spark.read.parquet(f"{store}/index/run={r}").select("repo", "path", C("read_in").alias(n)) for r, n in ((old, "a"), (new, "b")))
    both = before.join(after, ["repo", "path"], "full").where("not a <=> b")
    change = F.when(C("a").isNull(), "added").when(C("b").isNull(), "removed").otherwise("changed")
    return both.select("repo", "path", change.alias("change"))


def corpus_of(files: DataFrame, commits: DataFrame, commit_files: DataFrame) -> Corpus:
    """A corpus over files that were read from trees, and a history from any other source."""
    return Corpus(files, commits, commit_files, stage(ignore_rules(files), "rules"))
