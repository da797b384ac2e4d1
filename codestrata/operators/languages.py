"""Corpus totals and languages per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.scale import first_rows

C = F.col


def corpus_totals(tree: DataFrame) -> DataFrame:
    return tree.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("line_count").alias("total_lines")
    )


def language() -> Column:
    return F.coalesce(
        T.lookup(R.SUFFIX_LANGUAGE, "suffix_lower"),
        T.lookup(R.SUFFIX_LANGUAGE, "suffix"),
        F.when(C("name") == "Dockerfile", "Dockerfile"),
        F.lit("Other"),
    )


def language_of(tree: DataFrame) -> DataFrame:
    return tree.select("repo", "path", language().alias("language"))


def language_stats(tree: DataFrame) -> DataFrame:
    return tree.groupBy("repo", language().alias("language")).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("line_count").alias("line_count")
    )


def language_breakdown(tree: DataFrame) -> DataFrame:
    """Share of files per recognised language; ``Other`` only where nothing is recognised."""
    in_repo = W.partitionBy("repo")  # over one row per language, not per file
    recognised = F.sum(F.when(C("language") != "Other", C("file_count")).otherwise(0)).over(in_repo)
    shown = language_stats(tree).withColumn("recognised", recognised)
    share = C("file_count").cast("double") / C("recognised") * 100
    return shown.where("language <> 'Other' or recognised = 0").select(
        "repo",
        "language",
        "file_count",
        "line_count",
        F.when(C("recognised") == 0, 100.0).otherwise(F.round(F.when(C("recognised") > 0, share), 2)).alias(
            "percentage"
        ),
    )


def top_languages(tree: DataFrame, limit: int = 10) -> DataFrame:
    order = [F.desc("percentage"), F.asc("language")]
    ranked = first_rows(language_breakdown(tree), ["repo"], order, limit, "rank")
    return ranked.select("repo", "rank", "language", "percentage")
