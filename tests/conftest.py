from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codestrata.operators.facts import ignore_rules  # noqa: E402
from codestrata.plans.queries import Inputs  # noqa: E402
from codestrata.sources.corpus import Corpus  # noqa: E402

FILES = "repo string, path string, content string, size_bytes bigint"
COMMITS = (
    "repo string, commit_id bigint, author_name string, author_email string, committed_at timestamp, "
    "subject string, is_merge boolean"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.factory.idleWorkerMaxPoolSize", "16")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def corpus_from(spark, repos: dict[str, dict[str, str]], commits=(), touched=()) -> Corpus:
    rows = [
        (repo, path, text, len(text.encode()))
        for repo, files in repos.items()
        for path, text in files.items()
    ]
    files = spark.createDataFrame(rows, FILES)
    return Corpus(
        files,
        spark.createDataFrame(list(commits), COMMITS),
        spark.createDataFrame(list(touched), "repo string, commit_id bigint, path string"),
        ignore_rules(files),
    )


@pytest.fixture(scope="session")
def analyse(spark):
    """Rows of one operator over small repositories given as {repo: {path: text}}."""

    def run(plan, repos, commits=(), touched=(), signals=()):
        inputs = Inputs(corpus_from(spark, repos, commits, touched), tuple(signals))
        return [tuple(row) for row in plan(inputs).collect()]

    return run
