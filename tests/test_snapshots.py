"""Snapshots on disk: strict reading, complete lists, differences between stored states."""

import json
from datetime import datetime

import pytest

from codestrata.functions import scale
from codestrata.operators import diff
from codestrata.operators.facts import facts, walked
from codestrata.plans import report
from codestrata.sources.corpus import read_corpus
from codestrata.sources.snapshots import read_items, read_snapshots, write_snapshot

from conftest import corpus_from

OLD = {"r": {"app.py": "import utils\npassword = 'abcdefgh1'\n", "utils.py": "x = 1\n", "gone.py": ""}, "same": {"a.py": "# TODO: x\n"}}
NEW = {"r": {"app.py": "import utils\n", "utils.py": "x = 1\n", "fresh.py": ""}, "same": {"a.py": "# TODO: x\n"}}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("snapshots"))
    return report.write_for_diff({"old": corpus_from(spark, OLD), "new": corpus_from(spark, NEW)}, target)


def test_stored_states_are_compared(spark, folder):
    stored = diff.Snapshots(spark, folder, "old", "new")
    assert sorted((r.repo, r.path, r.change) for r in stored.key_files().collect()) == [("r", "fresh.py", "new"), ("r", "gone.py", "deleted")]
    (row,) = stored.findings().collect()
    assert (row.repo, row.file, row.line, row.change) == ("r", "app.py", 2, "resolved")
    assert {r.repo: r.score_change for r in stored.grade().collect()}["same"] == 0


def test_a_state_does_not_differ_from_itself(spark, folder):
    same = diff.Snapshots(spark, folder, "new", "new")
    assert same.key_files().collect() == same.findings().collect() == same.recommendations().collect() == []
    assert all(r.score_change == 0 and not r.grade_improved for r in same.grade().collect())


@pytest.mark.parametrize(
    "section",
    [
        {"tech_debt": {"overall_score": 1, "bogus": 5}},
        {"architecture": {"key_files": [{"path": "a"}, {"path": "b", "bogus": 1}]}},
        {"tech_debt": {"dimensions": {"any name": {"score": 1, "bogus": 2}}}},
        {"setup": {"database_setup": {"command": "x", "bogus": None}}},
        {"bogus": 1},
    ],
)
def test_unknown_fields_at_any_level_are_errors(spark, tmp_path, section):
    place = tmp_path / "reports" / "snapshot_id=x"
    place.mkdir(parents=True)
    (place / "part-0.json").write_text(json.dumps({"repo": "r", "head_commit": 1} | section))
    with pytest.raises(ValueError, match="bogus"):
        read_snapshots(spark, str(tmp_path))


def test_all_lists_are_stored_with_a_report(spark, tmp_path):
    corpus = corpus_from(spark, OLD)
    write_snapshot(report.full_report(corpus, ["debt"]), str(tmp_path), "one", datetime(2026, 1, 1), report.report_items(corpus))
    rows = read_items(spark, str(tmp_path), "internal_deps", "from_module string, to_module string").collect()
    assert [tuple(r) for r in rows] == [("one", "r", "app.py", "utils.py")]


def test_tables_on_disk_are_read(spark, tmp_path):
    made = corpus_from(spark, {"r": {".gitignore": "*.log\n", "a.py": "x\n", "b.log": ""}}, [("r", 1, "ann", "a@x", datetime(2026, 1, 1), "s", False)])
    for name in ("files", "commits", "commit_files"):
        getattr(made, name).write.parquet(str(tmp_path / name))
    corpus = read_corpus(spark, str(tmp_path))
    kept = walked(facts(corpus.files, "manifest"), corpus.rules)
    assert sorted(r.path for r in kept.collect()) == [".gitignore", "a.py"] and corpus.commits.count() == 1


def test_a_report_extracts_and_computes_only_what_is_asked_for(spark):
    corpus = corpus_from(spark, OLD | {"web": {"package.json": '{"name": "w"}', "a.js": "app.get('/x', f)\n", "README.md": "# T\n\nA long enough text here.\n"}})
    whole = {r.repo: r for r in report.full_report(corpus).collect()}
    for analysis, section in report.SECTIONS.items():
        for r in report.full_report(corpus, [analysis]).collect():
            assert r[section] == whole[r.repo][section], analysis
    before = len(scale.STAGED.get(spark.sparkContext.applicationId, []))
    report.full_report(corpus, ["debt"])
    (written,) = scale.STAGED[spark.sparkContext.applicationId][before:]
    columns = set(spark.read.parquet(written).columns)
    assert set(report.SIGNALS["debt"]) <= columns and not columns & {"secrets", "sql_strings", "style", "flask", "terms", "auth"}
