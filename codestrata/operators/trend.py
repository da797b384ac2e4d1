"""How technical debt moves over a log of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.snapshots import read_snapshots

C = F.col
DAY_SECONDS = 86_400


def scores(reports: DataFrame) -> DataFrame:
    """snapshot_id, repo, day, score, grade of stored reports that hold a debt section."""
    day = F.floor(F.unix_seconds("generated_at") / DAY_SECONDS).cast("bigint")
    found = reports.where(C("tech_debt.overall_score").isNotNull() & C("generated_at").isNotNull())
    return found.select(
        "snapshot_id", "repo", day.alias("day"), C("tech_debt.overall_score").alias("score"), C("tech_debt.grade").alias("grade")
    )


def debt_trend(scored: DataFrame) -> DataFrame:
    """One row for each repository and snapshot, in order of time: the change since the one before, and the whole trend.

    The slope is that of the least-squares line through all scores of a repository, in points a day; it is computed from
    whole numbers, so the order of rows does not matter.  One snapshot, or several on one day, have no slope.  A window
    holds one repository's snapshots, never its files.
    """
    whole = W.partitionBy("repo")
    order = whole.orderBy("day", "snapshot_id")
    rows = scored.withColumn("x", C("day") - F.min("day").over(whole))
    sums = {"n": F.lit(1), "sx": C("x"), "sy": C("score"), "sxy": C("x") * C("score"), "sxx": C("x") * C("x")}
    rows = rows.withColumns({k: F.sum(v.cast("bigint")).over(whole) for k, v in sums.items()})
    spread = C("n") * C("sxx") - C("sx") * C("sx")
    slope = (C("n") * C("sxy") - C("sx") * C("sy")).cast("double") / F.when(spread != 0, spread).cast("double")
    before = F.lag("score").over(order)
    direction = F.when(C("slope") > 0, "worsening").when(C("slope") < 0, "improving").when(C("slope") == 0, "steady")
    return rows.withColumn("slope", slope).select(
        "repo",
        F.row_number().over(order).cast("bigint").alias("position"),
        "snapshot_id",
        "day",
        "score",
        "grade",
        (C("score") - before).alias("change"),
        (C("score") - F.first("score").over(order)).alias("change_so_far"),
        "slope",
        F.coalesce(direction, F.lit("unknown")).alias("direction"),
    )


def stored_trend(spark, folder: str, ids: list[str] | None = None) -> DataFrame:
    """debt_trend over the snapshots stored below a folder, all of them or those named."""
    return debt_trend(scores(read_snapshots(spark, folder, ids)))
