"""Extraction from files as they arrive: the batch operators on a stream, and running totals of each repository.

A stream of arrivals is read from a folder that grows (any other streaming source with the columns of ``ARRIVALS`` does as
well).  Extraction happens inside the row, before anything is shuffled, so what the stateful parts hold and move is narrow:

* a delivery that is repeated within the delay counts once: its key stays in state until the watermark has passed it;
* totals are kept by repository and day; a day leaves the state once the watermark has passed it.

Rows that come later than the delay are not counted, because their day may be closed; ``late_rows`` tells how many.
Findings go to an append-only folder, totals to one folder a batch, which a repeated batch overwrites; so after a restart
from the same checkpoint the results are those of one uninterrupted run, and of the batch operators over the same files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import api, debt, facts, security

C = F.col
ARRIVALS = "repo string, path string, size_bytes bigint, content string, arrived_at timestamp"
KEY = ["repo", "path", "arrived_at"]
DELAY = "6 hours"
DAY_SECONDS = 86_400
SUMS = ["files", "lines", "todos", "secrets", "routes"]

#: What can be extracted: the signals of a file it needs, and the operator on facts of walked files.
EXTRACTIONS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "todo_comments": (("todos",), debt.todo_comments),
    "secret_findings": (("secrets",), security.secret_findings),
    "endpoints": (tuple(api.ROUTE_KINDS), api.endpoints),
}


def read_arrivals(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, oldest first."""
    reader = spark.readStream.schema(ARRIVALS)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def delivered(arrivals: DataFrame, *signals: str, delay: str = DELAY) -> DataFrame:
    """Facts of the arrivals without their contents, each delivery once."""
    rows = facts.facts(arrivals.withWatermark("arrived_at", delay), *signals)
    return rows.dropDuplicatesWithinWatermark(KEY)


def extracted(name: str, arrivals: DataFrame, rules: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows of one extraction over the walked files of a stream; ``rules`` is a table, read anew for each batch."""
    signals, operator = EXTRACTIONS[name]
    return operator(facts.walked(delivered(arrivals, *signals, delay=delay), rules))


def daily_totals(arrivals: DataFrame, rules: DataFrame, delay: str = DELAY) -> DataFrame:
    """Files, lines, comments, secrets and routes of walked files by repository and day of arrival."""
    rows = facts.walked(delivered(arrivals, "todos", "secrets", *api.ROUTE_KINDS, delay=delay), rules)
    counts = {
        "files": F.lit(1),
        "lines": C("line_count"),
        # comments are looked for in code files only, where the signal is not empty
        "todos": F.size("todos"),
        "secrets": F.size("secrets"),
        "routes": reduce(lambda a, b: a + b, (F.size(k) for k in api.ROUTE_KINDS)),
    }
    sums = [F.sum(counts[name]).cast("bigint").alias(name) for name in SUMS]
    days = rows.groupBy("repo", F.window("arrived_at", f"{DAY_SECONDS} seconds").alias("day")).agg(*sums)
    day = F.floor(F.unix_seconds(C("day.start")) / DAY_SECONDS).cast("bigint")
    return days.select("repo", day.alias("day"), *SUMS)


def append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts to write the rows of all arrivals that are there; each exactly once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(folder)


def upsert(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts to write changed totals, a folder for each batch; a batch that is run again replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Of each repository and day the totals of the newest batch, and the running totals up to that day."""
    schema = ", ".join(["repo string", "day bigint", *(f"{name} bigint" for name in SUMS), "batch bigint"])
    rows = spark.read.schema(schema).parquet(folder)
    newest = rows.groupBy("repo", "day").agg(F.max(F.struct("batch", *SUMS)).alias("t")).select("repo", "day", *(f"t.{n}" for n in SUMS))
    # one row a day, so that a repository's window is small however many files it has
    until = W.partitionBy("repo").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return newest.select("*", *(F.sum(n).over(until).alias(f"{n}_so_far") for n in SUMS))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their day was closed, as far as the query still remembers its batches."""
    operators = (o for p in query.recentProgress for o in p["stateOperators"])
    return sum(int(o["numRowsDroppedByWatermark"]) for o in operators)


def finished(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def with_times(files: DataFrame) -> DataFrame:
    """The derived files as arrivals: one an hour in each repository, in their order, from the start of 2024 (UTC)."""
    time = F.timestamp_seconds(F.lit(1_704_067_200) + C("n") * 3600)
    return files.select("repo", "path", "size_bytes", "content", time.alias("arrived_at"))


def feed(files: DataFrame, folder: str, slices: int = 4) -> str:
    """Writes the derived files in slices of time, as if they came one after the other."""
    count = (files.agg(F.max("n")).first()[0] or 0) + 1
    for i in range(slices):
        inside = F.floor(C("n") * slices / count) == i
        with_times(files.where(inside)).write.mode("append").parquet(folder)
    return folder
