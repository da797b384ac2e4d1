"""The derived files as a stream, and what the streaming extraction makes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scale import kept, new_folder
from ..sources.corpus import Corpus
from ..streaming import extraction as E


def arrivals(corpus: Corpus, files_per_batch: int = 8) -> DataFrame:
    """A stream over the files of the corpus, which are written as slices of time once per application."""
    spark = corpus.files.sparkSession
    folder = kept(spark, ("arrivals", corpus), lambda: E.feed(corpus.files, new_folder(spark, "arrivals")))
    return E.read_arrivals(spark, folder, files_per_batch)


def extracted(corpus: Corpus, name: str) -> DataFrame:
    """What a stream has written of one extraction when all arrivals are read."""
    spark = corpus.files.sparkSession
    folder = new_folder(spark, f"stream-{name}")
    rows = E.extracted(name, arrivals(corpus), corpus.rules)
    E.finished(E.append(rows, f"{folder}/rows", f"{folder}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def totals(corpus: Corpus) -> DataFrame:
    """Totals by day, and running totals, when all arrivals are read."""
    spark = corpus.files.sparkSession
    folder = new_folder(spark, "stream-totals")
    E.finished(E.upsert(E.daily_totals(arrivals(corpus), corpus.rules), f"{folder}/totals", f"{folder}/checkpoint"))
    return E.latest_totals(spark, f"{folder}/totals")
