"""Trees on disk against the same files as a table, reading only changes, and the quantile sketch against exact quantiles."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions import sketch as S
from codestrata.operators import conventions
from codestrata.operators.facts import facts, walked
from codestrata.sources import trees
from codestrata.sources.corpus import read_corpus

from conftest import COMMITS

TREE = {
    "one/app.py": b"import os\r\nx = 1\r\n", "one/.gitignore": b"*.log\n", "one/pkg/__init__.py": b"", "one/pkg/_private.py": b"y\n",
    "one/pkg/deep/er/still.txt": "é".encode(), "one/bad.txt": b"\xff\xfe ok", "one/a.log": b"l\n", "one/.git/config": b"no",
    "two/.env": b"K=1\n", "two/name with space/%41.md": b"# T\n", "two/empty": b"", "loose.txt": b"belongs to no repository",
}


def write(top, files):
    for name, raw in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)


def as_rows(frame):
    return sorted((r.repo, r.path, r.size_bytes, r.content) for r in frame.collect())


def test_a_tree_equals_the_table_of_its_files(spark, tmp_path):
    write(tmp_path / "tree", TREE)
    os.symlink(tmp_path / "tree" / "one", tmp_path / "tree" / "one" / "again")
    files = trees.read_tree(spark, str(tmp_path / "tree"))
    expected = [
        (*name.split("/", 1), len(raw), raw.decode("utf-8", "replace").replace("\r\n", "\n"))
        for name, raw in TREE.items() if "/" in name and "/.git/" not in name
    ]
    assert as_rows(files) == sorted(expected)
    # the same through the reader of tables
    spark.createDataFrame([(r, p, c, s) for r, p, s, c in expected], "repo string, path string, content string, size_bytes bigint").write.parquet(str(tmp_path / "t" / "files"))
    for name, schema in (("commits", COMMITS), ("commit_files", "repo string, commit_id bigint, path string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "t" / name))
    tables = read_corpus(spark, str(tmp_path / "t"))
    made = trees.corpus_of(files, tables.commits, tables.commit_files)
    kept = [sorted(map(tuple, walked(facts(c.files, "imports"), c.rules).select("repo", "path", "line_count").collect())) for c in (made, tables)]
    assert kept[0] == kept[1] and ("one", "pkg/__init__.py", 0) in kept[0] and not any(p.endswith(".log") for _, p, _ in kept[0])


def test_only_changes_are_read_again(spark, tmp_path):
    top, store = tmp_path / "tree", str(tmp_path / "store")
    write(top, {"r/a.py": b"1\n", "r/b.py": b"2\n", "r/c/d.py": b"3\n"})
    assert trees.runs(spark, store) == [] and trees.ingest(spark, str(top), store) == 0
    assert trees.ingest(spark, str(top), store) == 1
    assert spark.read.parquet(f"{store}/files/run=1").count() == 0
    write(top, {"r/b.py": b"22\n", "r/new.py": b"4\n", "s/x.py": b"5\n"})
    (top / "r" / "a.py").rename(top / "r" / "moved.py")
    assert trees.ingest(spark, str(top), store) == 2
    read = {(r.repo, r.path) for r in spark.read.parquet(f"{store}/files/run=2").collect()}
    assert read == {("r", "b.py"), ("r", "new.py"), ("s", "x.py"), ("r", "moved.py")}
    assert as_rows(trees.stored_files(spark, store)) == as_rows(trees.read_tree(spark, str(top)))
    assert [(r[1], r[3]) for r in as_rows(trees.stored_files(spark, store, 0))] == [("a.py", "1\n"), ("b.py", "2\n"), ("c/d.py", "3\n")]
    told = {(r.repo, r.path): r.change for r in trees.changes(spark, store, 0, 2).collect()}
    assert told == {("r", "a.py"): "removed", ("r", "b.py"): "changed", ("r", "moved.py"): "added", ("r", "new.py"): "added", ("s", "x.py"): "added"}


def test_a_run_that_failed_is_no_run(spark, tmp_path):
    top, store = tmp_path / "tree", str(tmp_path / "store")
    write(top, {"r/a.py": b"1\n"})
    trees.ingest(spark, str(top), store)
    write(tmp_path, {"store/files/run=1/part-0.parquet": b"half written", "store/index/run=1/part-0.parquet": b"x"})
    assert trees.runs(spark, store) == [0]
    write(top, {"r/b.py": b"2\n"})
    assert trees.ingest(spark, str(top), store) == 1 and len(as_rows(trees.stored_files(spark, store))) == 2


def test_an_empty_tree(spark, tmp_path):
    (tmp_path / "tree" / "r").mkdir(parents=True)
    assert trees.read_tree(spark, str(tmp_path / "tree")).collect() == []
    assert trees.ingest(spark, str(tmp_path / "tree"), str(tmp_path / "store")) == 0
    assert trees.stored_files(spark, str(tmp_path / "store")).collect() == []


# --- the sketch


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    small = [rng.randrange(256) for _ in range(500)]
    wide = [int(10 ** rng.uniform(0, 17)) for _ in range(2000)] + [0, 255, 256, 257, 2**62, 2**63 - 1]
    return {"small": small, "wide": wide, "one": [7], "same": [300] * 50}


SHARES = {"low": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "all": 1.0}


def test_quantiles_keep_to_the_error_bound(spark, values):
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v bigint")
    whole = S.sketch(rows, ["k"], S.bucket(F.col("v")))
    parts = rows.randomSplit([0.2, 0.5, 0.3], 3)
    again = S.merged(["k"], *(S.sketch(p, ["k"], S.bucket(F.col("v"))) for p in parts))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))
    for r in S.quantiles(again, ["k"], SHARES).collect():
        ordered = sorted(values[r.k])
        assert r["count"] == len(ordered)
        for name, share in SHARES.items():
            exact = ordered[math.ceil(len(ordered) * share) - 1]
            assert exact <= r[name] <= (exact if exact < 256 else exact + exact / S.PARTS)


def test_buckets_are_ordered_and_end_where_they_say(spark):
    edges = sorted({max(0, 2**k + d) for k in range(62) for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(v,) for v in edges], "v bigint").withColumn("b", S.bucket(F.col("v"))).withColumn("top", S.largest(F.col("b")))
    found = rows.orderBy("v").collect()
    assert [r.b for r in found] == sorted(r.b for r in found) and all(r.v <= r.top < r.v + max(1, r.v / 128) for r in found)


def test_line_lengths_of_a_repository(analyse):
    text = "x" * 70 + "\n" + "y" * 30 + "\n"
    long = {"a.py": text * 99 + "z" * 85 + "\n" + "w" * 1000 + "\n", "b.md": "n" * 500, "c.js": ""}
    rows = analyse(lambda i: conventions.line_length(i.tree), {"r": long, "s": {"a.py": "a" * 130 + "\n"}, "t": {"a.md": "x"}}, signals=["manifest", "line_buckets"])
    assert sorted(rows) == [("r", 200, 70, 70, 70, 1003, 79), ("s", 1, 130, 130, 130, 130, None)]
