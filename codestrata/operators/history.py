"""Facts of the commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.scale import first_rows

C = F.col


def newest() -> list:
    return [F.desc("committed_at"), F.desc("commit_id")]


def head_commit(commits: DataFrame) -> DataFrame:
    latest = F.max(F.struct("committed_at", "commit_id"))
    return commits.groupBy("repo").agg(latest.alias("c")).select("repo", C("c.commit_id").alias("head_commit"))


def commit_count(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commit_count"))


def own_commits(commits: DataFrame, last: int | None, *columns: str) -> DataFrame:
    """Commits that are not merges; the newest ``last`` of each repository only, if that is given."""
    rows = commits.where(~C("is_merge")).select("repo", "committed_at", "commit_id", *columns)
    return rows if last is None else first_rows(rows, ["repo"], newest(), last, "age")


def contributors(commits: DataFrame, last: int | None = None) -> DataFrame:
    """Authors with their number of commits and the newest of these."""
    return authors(commits, last).select("repo", "name", "email", "commits", C("newest.commit_id").alias("newest_commit"))


def authors(commits: DataFrame, last: int | None = None) -> DataFrame:
    counted = own_commits(commits, last, "author_name", "author_email").groupBy(
        "repo", C("author_name").alias("name"), C("author_email").alias("email")
    )
    return counted.agg(F.count(F.lit(1)).alias("commits"), F.max(F.struct("committed_at", "commit_id")).alias("newest"))


def top_contributors(commits: DataFrame, limit: int = 10) -> DataFrame:
    """The authors with most commits; of equals the one with the newer commit leads."""
    ranked = first_rows(authors(commits), ["repo"], [F.desc("commits"), F.desc("newest")], limit, "rank")
    return ranked.select("repo", "rank", "name", "email", C("commits").alias("recent_commits"))


def recent_files(commits: DataFrame, commit_files: DataFrame, last: int | None = None) -> DataFrame:
    """Files with the newest commit that touched them; of the newest ``last`` commits only, if that is given."""
    rows = commit_files.join(own_commits(commits, last), ["repo", "commit_id"])
    touched = rows.groupBy("repo", "path").agg(F.max(F.struct("committed_at", "commit_id")).alias("newest"))
    return touched.select("repo", "path", C("newest.commit_id").alias("last_commit"))


def stale_files(
    files: DataFrame, commits: DataFrame, commit_files: DataFrame, days: int = R.STALE_DAYS
) -> DataFrame:
    """Each file with its last commit and how long that lies back, as of its repository's newest commit.

    ``status`` is ``stale`` for at least ``days`` full days without a commit, ``fresh`` for less, and ``untouched`` for a
    file that no commit names, about which the history says nothing.  Merges touch no file.  Both sides of the join are
    one narrow row a file; a repository's newest commit is one row a repository.
    """
    heads = commits.groupBy("repo").agg(F.max("committed_at").alias("head_at"))
    touched = commit_files.join(own_commits(commits, None), ["repo", "commit_id"])
    last = touched.groupBy("repo", "path").agg(F.max(F.struct("committed_at", "commit_id")).alias("last"))
    idle = F.timestamp_diff("DAY", C("last.committed_at"), C("head_at")).cast("bigint")
    status = F.when(C("last").isNull(), "untouched").when(C("idle_days") >= days, "stale").otherwise("fresh")
    rows = files.select("repo", "path").join(last, ["repo", "path"], "left").join(heads, "repo", "left")
    return rows.withColumn("idle_days", idle).select(
        "repo", "path", C("last.commit_id").alias("last_commit"), "idle_days", status.alias("status")
    )


def code_staleness(
    files: DataFrame, commits: DataFrame, commit_files: DataFrame, days: int = R.STALE_DAYS
) -> DataFrame:
    """Files of a repository by status, and the share of stale ones among those with a history."""
    rows = stale_files(files, commits, commit_files, days).groupBy("repo").agg(
        *(F.count_if(C("status") == s).alias(f"{s}_files") for s in ("fresh", "stale", "untouched"))
    )
    known = C("fresh_files") + C("stale_files")
    return rows.withColumn("stale_share", C("stale_files").cast("double") / F.when(known > 0, known))
