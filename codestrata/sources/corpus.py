"""The input tables: files, commits and the files each commit touched.

``files``         repo, path, size_bytes, content (and n, the position of a file in its repo)
``commits``       repo, commit_id, author_name, author_email, committed_at, subject, is_merge
``commit_files``  repo, commit_id, path
``rules``         repo, pattern: the ignore rules of each repository, derived from ``files``

They can be read from any Spark source, or derived from the ``documents`` and
``events`` tables as FIXTURES.md lays down.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import kept, position_in_key, stage
from ..operators.facts import ignore_rules


@dataclass(frozen=True)
class Corpus:
    files: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    rules: DataFrame


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    """Read files, commits and commit_files from Parquet folders below ``folder``."""
    files, commits, touched = (spark.read.parquet(f"{folder}/{t}") for t in ("files", "commits", "commit_files"))
    return Corpus(files, commits, touched, stage(ignore_rules(files), "rules"))


def text_of(raw):
    """Text of a binary column: bad bytes become U+FFFD, line ends become newlines."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def fixture_templates() -> list[tuple[int, int, str, str]]:
    source = resources.files(__package__).joinpath("fixture_templates.jsonl").read_text("utf-8")
    return [tuple(json.loads(row)) for row in source.splitlines()]


def placed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, text and n, the position of a document in its repository."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = documents.select(F.col("source").alias("repo"), "text", "doc_id")
    return position_in_key(chosen, "repo", "doc_id", "n").drop("doc_id")


def escaped(text: Column) -> Column:
    """A text as it stands in a JSON string."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def files_of(placed: DataFrame, shift: int = 0) -> DataFrame:
    """One file per placed document; ``shift`` moves every document to a later template.

    Two shifts of the same documents are two states of the same repositories.  Nothing is shuffled here.
    """
    # 60 rows whatever the data's size, so the broadcast is bounded
    templates = placed.sparkSession.createDataFrame(
        fixture_templates(), "arch int, k int, template_path string, body string"
    )
    slot = (
        placed.withColumn("k", ((F.col("n") + shift) % 12).cast("int"))
        .withColumn("arch", F.expr("cast(substr(repo, 4) as int) % 5"))
        .withColumn("copy", F.floor(F.col("n") / 12).cast("int"))
        .join(F.broadcast(templates), ["arch", "k"])
    )
    number = F.col("n").cast("string")
    folder = F.when(F.col("copy") == 0, "").otherwise(F.concat(F.lit("pkg"), F.col("copy").cast("string"), F.lit("/")))
    body = F.replace("body", F.lit("{nn}"), F.lpad((F.col("n") % 100).cast("string"), 2, "0"))
    text = F.coalesce("text", F.lit(""))
    inserted = {
        "{hashed}": F.replace(text, F.lit("\n"), F.lit("\n# ")),
        "{slashed}": F.replace(text, F.lit("\n"), F.lit("\n// ")),
        "{json}": escaped(text),
        "{text}": text,
        "{words}": F.concat(F.lit("# "), F.replace(text, F.lit(" "), F.lit("\n# "))),
    }
    rows = slot.withColumn("content", F.replace(body, F.lit("{n}"), number))
    for mark, value in inserted.items():  # a form of the text is made for the files only that hold its mark
        here = F.contains("content", F.lit(mark))
        rows = rows.withColumn("content", F.when(here, F.replace("content", F.lit(mark), value)).otherwise(F.col("content")))
    return rows.select(
        "repo", "n", F.concat(folder, "template_path").alias("path"), "content",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
    )


def derived_files(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """One file per document, as files_of gives them."""
    return files_of(placed_documents(spark, sf_dir), shift)


def derived_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    event = F.col("event_id").cast("string")
    subject = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("feat: add item "), event))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("fix(core): repair "), event))
        .when(F.col("event_type") == "view", F.concat(F.lit("chore: bump "), event))
        .when(F.col("event_type") == "click", F.concat(F.lit("update things "), event))
        .otherwise("Merge branch dev")
    )
    return events.select(
        F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("repo"),
        F.col("event_id").alias("commit_id"),
        user.alias("author_name"),
        F.concat(user, F.lit("@example.com")).alias("author_email"),
        F.col("ts").alias("committed_at"),
        subject.alias("subject"),
        (F.col("event_type") == "error").alias("is_merge"),
    )

def commit_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Two files per commit, picked by the position of a file in its repository."""
    counted = files.groupBy("repo").agg(F.count(F.lit(1)).alias("c"))
    step = F.floor(F.col("commit_id") / 20).cast("bigint")
    touched = commits.select("repo", "commit_id").join(counted, "repo").select(
        "repo",
        "commit_id",
        F.explode(F.array_distinct(F.array(step % F.col("c"), (step * 7 + 3) % F.col("c")))).alias("n"),
    )
    return touched.join(files.select("repo", "n", "path"), ["repo", "n"]).select("repo", "commit_id", "path")


def staged_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The derived corpus, written to the staging folder."""
    files, commits = stage(derived_files(spark, sf_dir), "files"), derived_commits(spark, sf_dir)
    touched = stage(commit_files(commits, files), "commit_files")
    return Corpus(files, commits, touched, stage(ignore_rules(files), "rules"))


def placed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placed documents, written once for all states that are projections of them."""
    return kept(spark, ("placed", sf_dir), lambda: stage(placed_documents(spark, sf_dir), "placed"))


def rules_of(files: DataFrame) -> DataFrame:
    """The ignore rules of files that are not written."""
    # the few root files that hold rules are written first, so that their patterns are not tested row by row in a join
    ignores = stage(files.where(F.col("path") == ".gitignore"), "ignores")
    return stage(ignore_rules(ignores), "rules")


def projected_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The derived corpus with files that are a projection of the placed documents, as those of later states are.

    Comparisons read contents once for each state, so that the files of none of them are worth another shuffle of all texts.
    """
    files, commits = files_of(placed_once(spark, sf_dir)), derived_commits(spark, sf_dir)
    touched = stage(commit_files(commits, files), "commit_files")
    return Corpus(files, commits, touched, rules_of(files))


def later_corpus(spark: SparkSession, sf_dir: str, earlier: Corpus, shift: int = 1) -> Corpus:
    """A later state of all repositories: every document some templates on, the history as before.

    Documents are placed once for all later states; a state's files are a projection of them, which is not written.
    """
    files = files_of(placed_once(spark, sf_dir), shift)
    return replace(earlier, files=files, rules=rules_of(files))
