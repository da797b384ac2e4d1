"""No operator reads its input through a limit: one item more than any round number still counts."""

from datetime import datetime, timedelta

from codestrata.functions import scale
from codestrata.operators import conventions, debt, facts, history, security

START = datetime(2026, 1, 1)


def test_a_file_above_a_mebibyte_is_walked(analyse):
    big = "x = 1\n" * (1024 * 1024 // 6 + 1)
    assert len(big) > 1024 * 1024
    rows = analyse(lambda i: debt.hotspots(i.tree), {"r": {"big.py": big, "small.py": "y = 2\n"}}, signals=["manifest"])
    assert [r[2] for r in rows] == ["big.py"]


def test_the_walk_can_be_given_a_size(spark):
    files = spark.createDataFrame([("r", "a.py", "x" * 20, 20), ("r", "b.py", "x", 1)], "repo string, path string, content string, size_bytes bigint")
    assert [r.path for r in facts.facts(files, "imports", max_size=10).where("walkable").collect()] == ["b.py"]
    assert facts.facts(files, "imports").where("walkable").count() == 2


def test_all_source_files_vote(analyse):
    few = {f"a{n:02}.py": "def f():\n    pass\n" for n in range(50)}
    more = {f"z{n:02}.py": "def f():\n\tpass\n" for n in range(51)}
    rows = analyse(lambda i: conventions.indent_style(i.facts), {"r": few | more}, signals=["style"])
    assert rows == [("r", "tabs", None)]
    assert len(analyse(lambda i: conventions.indent_per_file(i.facts), {"r": few | more}, signals=["style"])) == 101


def test_all_commits_count(analyse):
    log = [("r", n, "ann", "a@x", START + timedelta(minutes=n), "feat: x" if n < 1001 else "no", False) for n in range(1052)]
    assert [p[3] for p in analyse(lambda i: history.contributors(i.commits), {}, commits=log)] == [1052]
    assert analyse(lambda i: conventions.commit_format(i.commits), {}, commits=log) == [("r", 1001, 1052, "conventional-commits")]
    assert analyse(lambda i: conventions.commit_format(i.commits, last=50), {}, commits=log) == [("r", 0, 50, "freeform")]


def test_findings_with_a_common_start_stay_two(analyse):
    key = "A" * 70
    text = f'password = "{key}1"; password = "{key}2"\n'
    rows = analyse(lambda i: security.secret_findings(i.facts), {"r": {"a.py": text}}, signals=["secrets"])
    assert len({r[-1] for r in rows if key in r[-1]}) == 2


def test_staged_tables_can_be_removed(spark):
    rows = scale.stage(spark.range(3), "three")
    assert rows.count() == 3 and scale.remove_staged(spark) >= 1
    assert scale.STAGED.get(spark.sparkContext.applicationId) is None
