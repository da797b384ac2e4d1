"""Differences between two snapshots of the same repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..sources.snapshots import read_items, read_snapshots

C = F.col


def changes(old: DataFrame, new: DataFrame, added: str, removed: str) -> DataFrame:
    """Distinct rows only one side has; nulls compare as values.

    Both sides are stacked and met once, instead of subtracting each from the other.
    """
    sides = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    met = sides.groupBy(*old.columns).agg(F.bool_or("_new").alias("_in_new"), F.bool_or(~C("_new")).alias("_in_old"))
    change = F.when(C("_in_new"), added).otherwise(removed)
    return met.where(C("_in_new") != C("_in_old")).withColumn("change", change).drop("_in_new", "_in_old")


def grade_rank(grade: str) -> Column:
    return F.coalesce(T.lookup(R.GRADE_RANK, grade), F.lit(0))


def diff_grade(old: DataFrame, new: DataFrame) -> DataFrame:
    """Grades and scores side by side, from debt scores of the two snapshots."""
    before = old.select("repo", C("grade").alias("old_grade"), C("score").alias("old_score"))
    after = new.select("repo", C("grade").alias("new_grade"), C("score").alias("new_score"))
    improved = grade_rank("new_grade") > grade_rank("old_grade")
    both = C("old_grade").isNotNull() & C("new_grade").isNotNull()
    return before.join(after, "repo", "full").select(
        "repo",
        "old_grade",
        "new_grade",
        F.when(both, improved).otherwise(False).alias("grade_improved"),
        (C("new_score") - C("old_score")).alias("score_change"),
    )


def diff_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    return changes(old, new, "new", "resolved")


def diff_key_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files that only one side has, among all that have a score."""
    return changes(old.select("repo", "path"), new.select("repo", "path"), "new", "deleted")


def diff_recommendations(old: DataFrame, new: DataFrame) -> DataFrame:
    return changes(old.select("repo", "recommendation"), new.select("repo", "recommendation"), "new", "resolved")


FINDING = "severity string, category string, file string, line int, description string"


class Snapshots:
    """Differences between two stored snapshots; nothing but these two is read."""

    def __init__(self, spark: SparkSession, folder: str, old: str, new: str):
        self.spark, self.folder, self.ids = spark, folder, (old, new)

    def both(self, rows: DataFrame) -> list[DataFrame]:
        return [rows.where(C("snapshot_id") == i).drop("snapshot_id") for i in self.ids]

    def reports(self) -> DataFrame:
        return read_snapshots(self.spark, self.folder, self.ids)

    def grade(self) -> DataFrame:
        columns = "snapshot_id", "repo", "tech_debt.grade", C("tech_debt.overall_score").alias("score")
        return diff_grade(*self.both(self.reports().select(*columns)))

    def findings(self) -> DataFrame:
        return diff_findings(*self.both(read_items(self.spark, self.folder, "findings", FINDING, self.ids)))

    def key_files(self) -> DataFrame:
        return diff_key_files(*self.both(read_items(self.spark, self.folder, "scored_files", "path string", self.ids)))

    def recommendations(self) -> DataFrame:
        rows = self.reports().select("snapshot_id", "repo", F.explode("tech_debt.recommendations").alias("recommendation"))
        return diff_recommendations(*self.both(rows))
