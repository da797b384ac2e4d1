"""Onboarding, history, scorecard, differences and the full report."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from conftest import corpus_from

from codestrata import rules as R
from codestrata.operators import diff, history, onboarding, scorecard
from codestrata.plans import report
from codestrata.plans.queries import PLANS, Inputs
from codestrata.sources.snapshots import read_snapshots, write_snapshot

M = ["manifest", "reads_env", "terms"]


def test_readme_summary(analyse):
    repos = {
        "plain": {"README.md": "# Title\n\n[![b](x)](y)\n> A **small** service for [users](http://u)\nand *more*.\n\nNext paragraph that is long.\n"},
        "short": {"README.md": "# T\nshort\n"}, "empty": {"README.md": ""}, "none": {"a": ""},
        "rst": {"README.rst": "| t |\n![i](x)\n[only](link)\nThe first paragraph counts here.\n"},
        "long": {"README": "x" * 600}, "second": {"README.md": "Too short.\n\nLong enough to be shown here.\n"},
    }
    rows = dict(analyse(lambda i: onboarding.readme_summary(i.facts), repos, signals=M))
    assert rows == {
        "plain": "A small service for users and more.", "short": "# T\nshort", "empty": R.EMPTY_README, "none": R.NO_README,
        "rst": "The first paragraph counts here.", "long": "x" * 600, "second": "Long enough to be shown here.",
    }


def fenced_steps(text):
    """Plain reading of a README, line by line, for comparison."""
    found, reading, inside = [], False, False
    for line in text.splitlines():
        bare = line.strip()
        if inside:
            if bare.startswith("```"):
                inside = False
            elif bare:
                found.append(bare)
        elif re.match(R.SETUP_HEADING, line):
            reading = True
        elif reading and re.match(r"#+\s+", line):
            break
        elif reading and bare.startswith("```"):
            inside = True
    return found


def test_setup_steps_equal_a_plain_reading(analyse):
    pieces = ["# Intro", "## Install", "### Usage it", "## Other", "```", "```bash", "  ```", "cmd one", "  cmd two ", "", "# comment", "text", "#", "#\t", "##Run"]
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    repos = {f"r{n}": {"README.md": t} for n, t in enumerate(texts)}
    rows = analyse(lambda i: onboarding.readme_setup_steps(i.facts), repos, signals=M)
    got = {}
    for repo, _, position, command in sorted(rows, key=lambda r: (r[0], r[2])):
        got.setdefault(repo, []).append(command)
    expected = {f"r{n}": fenced_steps(t) for n, t in enumerate(texts) if fenced_steps(t)}
    assert len(expected) > 30 and got == expected


def test_setup_step_sources(analyse):
    repos = {
        "rst": {"README.md": "# none", "README.rst": "# Usage\n```\nrun it\n```\n"},
        "inferred": {"sub/requirements.txt": "", "package.json": "{}"}, "none": {"a": ""},
    }
    rows = analyse(lambda i: onboarding.setup_steps(i.tree, i.facts), repos, signals=M)
    assert sorted(rows) == [
        ("inferred", 1, "Install Python dependencies", "pip install -r requirements.txt"),
        ("inferred", 2, "Install Node.js dependencies", "npm install"), ("rst", 1, "Run: run it", "run it"),
    ]


def test_test_commands(analyse):
    repo = {
        "package.json": '{"scripts":{"test":"jest","test:unit":"j"}}', "pytest.ini": "",
        "README.md": "# x\n```\nno\n```\n## Testing it\n```bash\n# c\npytest\n make check\n```\n## After\n```\nnot this\n```\n",
        "Makefile": "test:\n\tx\ntest-fast: y\nlint:\n test-no:\n",
    }
    rows = sorted(analyse(lambda i: onboarding.test_commands(i.tree, i.facts), {"r": repo}, signals=M))
    assert [c for _, _, c in rows] == ["npm test", "npm run test:unit", "pytest", "make check", "make test", "make test-fast"]


def test_gotchas(analyse):
    repos = {
        "all": {"a.py": "os.getenv('X')", "requirements.txt": "", "package.json": ""},
        "none": {"tests/a.py": "os.environ", "sub/.env": "", "requirements.txt": "", "Makefile": ""},
    }
    rows = analyse(lambda i: onboarding.gotchas(i.tree), repos, signals=M)
    assert [g for r, _, g in sorted(rows) if r == "all"] == R.GOTCHAS and {r for r, _, _ in rows} == {"all"}


def test_glossary_has_all_names_and_a_report_the_first_ten(analyse):
    first = "".join(f'NAME_{i} = "value {i}"\n' for i in range(8)) + 'NAME_0 = "newer value"\nTODO = "not a term"\nshort = "x"\n'
    second = 'NAME_8 = "value 8"\nNAME_9 = "value 9"\nNAME_1 = "too late"\nNAME_10 = "never"\n'
    repos = {"r": {"a.py": first, "b.js": second}, "s": {"a.py": second}}
    every = {t: m for r, t, m in analyse(lambda i: onboarding.glossary(i.tree), repos, signals=M) if r == "r"}
    assert len(every) == 11 and every["NAME_10"] == "never" and every["NAME_1"] == "too late"
    rows = analyse(lambda i: onboarding.first_terms(i.tree), repos, signals=M)
    got = {t: m for r, _, t, m in rows if r == "r"}
    assert got == {f"NAME_{i}": f"value {i}" for i in range(1, 10)} | {"NAME_0": "newer value"}
    assert {t: m for r, _, t, m in rows if r == "s"}["NAME_1"] == "too late"


def log(repo, authors, start=datetime(2026, 1, 1)):
    return [(repo, n, a, f"{a}@x", start + timedelta(minutes=n), "s", a == "merge") for n, a in enumerate(authors)]


def test_history(analyse):
    rows = log("r", ["old"] * 5 + ["ann"] * 600 + ["bob"] * 400 + ["merge"] * 3) + log("s", ["x", "y"])
    touched = [("r", n, f"f{n % 70}.py") for n in range(900, 1005)] + [("s", 0, "b"), ("s", 1, "a"), ("s", 1, "c")]
    people = analyse(lambda i: history.contributors(i.commits), {}, commits=rows)
    assert sorted(people) == [
        ("r", "ann", "ann@x", 600, 604), ("r", "bob", "bob@x", 400, 1004), ("r", "old", "old@x", 5, 4), ("s", "x", "x@x", 1, 0), ("s", "y", "y@x", 1, 1),
    ]
    last = analyse(lambda i: history.contributors(i.commits, last=1000), {}, commits=rows)
    assert {p[1] for p in last if p[0] == "r"} == {"ann", "bob"}
    top = analyse(lambda i: history.top_contributors(i.commits), {}, commits=rows)
    assert sorted(top)[:3] == [("r", 1, "ann", "ann@x", 600), ("r", 2, "bob", "bob@x", 400), ("r", 3, "old", "old@x", 5)]
    assert [p[2] for p in sorted(top) if p[0] == "s"] == ["y", "x"]
    assert sorted(analyse(lambda i: history.commit_count(i.commits), {}, commits=rows)) == [("r", 1008), ("s", 2)]
    assert sorted(analyse(lambda i: history.head_commit(i.commits), {}, commits=rows)) == [("r", 1007), ("s", 1)]
    files = analyse(lambda i: history.recent_files(i.commits, i.commit_files), {}, commits=rows, touched=touched)
    assert sorted((p, c) for r, p, c in files if r == "s") == [("a", 1), ("b", 0), ("c", 1)]
    assert sorted(c for r, _, c in files if r == "r") == list(range(935, 1005))
    few = analyse(lambda i: history.recent_files(i.commits, i.commit_files, last=50), {}, commits=rows, touched=touched)
    assert sorted(c for r, _, c in few if r == "r") == list(range(955, 1005))


def test_colours(spark):
    df = spark.createDataFrame([(s,) for s in (0, 20, 21, 60, 80, 81, 100)], "score int")
    rows = df.select(scorecard.score_colour(df.score), scorecard.health_grade(df.score)).collect()
    assert [r[0] for r in rows] == ["#f85149", "#f0883e", "#f0883e", "#8b949e", "#3fb950", "#3fb950", "#3fb950"]
    assert [r[1] for r in rows] == ["F", "F", "F", "D", "B", "B", "A"]


def test_differences(spark):
    def grades(rows):
        return spark.createDataFrame(rows, "repo string, score int, grade string")

    old, new = grades([("up", 50, "C"), ("down", 10, "A"), ("gone", 1, "A")]), grades([("up", 30, "B"), ("down", 30, "B"), ("new", 0, "A")])
    assert sorted(map(tuple, diff.diff_grade(old, new).collect())) == [
        ("down", "A", "B", False, 20), ("gone", "A", None, False, None), ("new", None, "A", False, None), ("up", "C", "B", True, -20),
    ]
    kind = "repo string, severity string, category string, file string, line int, description string"
    same, gone, fresh = ("r", "high", "c", "f", None, "d"), ("r", "high", "c", "f", 1, "d"), ("r", "high", "c", "f", 2, "d")
    before, after = spark.createDataFrame([same, same, gone], kind), spark.createDataFrame([same, fresh, fresh], kind)
    rows = sorted((r.line, r.change) for r in diff.diff_findings(before, after).collect())
    assert rows == [(1, "resolved"), (2, "new")]
    assert diff.diff_findings(before, before).collect() == []


REPOS = {
    "web": {
        "app.py": '"""App."""\nimport utils\n@app.route("/a")\ndef a(): pass  # TODO x\n', "utils.py": "API_NAME = 'some value'\n",
        "requirements.txt": "flask==0.12\n", "README.md": "# Web\n\nA web service for everyone.\n\n## Usage\n```\nflask run\n```\n",
    },
    "lib": {"pyproject.toml": "[project]\nname = 'l'\n", "l.py": "x = 1\n"},
    "blank": {"x.bin": ""},
}


@pytest.fixture(scope="module")
def corpus(spark):
    return corpus_from(spark, REPOS, commits=log("web", ["ann", "bob"]), touched=[("web", 0, ".env")])


@pytest.fixture(scope="module")
def full(corpus):
    return {r.repo: r.asDict(recursive=True) for r in report.full_report(corpus).collect()}


def test_full_report(full):
    web = full["web"]
    assert web["head_commit"] == 1
    assert web["architecture"]["framework"] == "flask" and web["architecture"]["total_files"] == 4
    assert [k["path"] for k in web["architecture"]["key_files"]] == ["app.py", "utils.py", "README.md", "requirements.txt"]
    assert web["tech_debt"]["dimensions"]["documentation"]["score"] == 50
    assert web["onboarding"]["project_summary"] == "A web service for everyone."
    assert web["onboarding"]["glossary"] == {"API_NAME": "some value"}
    assert [c["name"] for c in web["onboarding"]["top_contributors"]] == ["bob", "ann"]
    assert web["dependencies"]["deps"] == [{"name": "flask", "current_version": "0.12", "license": None, "status": "outdated"}]
    assert web["security"]["risk_level"] == "high" and web["security"]["env_files_in_git"] == [".env"]
    assert web["api"]["total_routes"] == 1 and web["setup"]["run_commands"] == [{"label": "flask", "command": "flask run"}]
    assert full["lib"]["architecture"]["project_type"] == "library" and full["lib"]["api"]["api_type"] == "library"
    assert full["blank"]["architecture"]["total_files"] == 0 and full["blank"]["tech_debt"]["grade"] == "A"


def test_selected_analyses(corpus):
    rows = report.full_report(corpus, ["debt"]).collect()
    assert all(r.tech_debt is not None and r.architecture is None and r.setup is None for r in rows)
    rows = report.full_report(corpus, ["onboarding"]).collect()
    assert all(r.architecture is not None and r.onboarding is not None and r.api is None for r in rows)
    with pytest.raises(ValueError):
        report.full_report(corpus, ["nothing"])


def test_many_repositories_equal_single_ones(spark, full):
    for name in ("web", "lib"):
        alone = corpus_from(spark, {name: REPOS[name]}, commits=log("web", ["ann", "bob"]), touched=[("web", 0, ".env")])
        assert [r.asDict(recursive=True) for r in report.full_report(alone).collect()] == [full[name]]


def test_report_items(corpus):
    rows = report.report_items(corpus).collect()
    edges = [json.loads(r.item) for r in rows if r["list"] == "internal_deps"]
    assert edges == [{"from_module": "app.py", "to_module": "utils.py"}]
    assert [json.loads(r.item)["route"] for r in rows if r["list"] == "endpoints"] == ["/a"]


def test_scorecard(corpus):
    inputs = Inputs(corpus, PLANS["scorecard"].signals)
    rows = {(r.repo, r.analysis): (r.score, r.grade) for r in scorecard.scorecard(inputs.scores).collect()}
    assert rows[("web", "architecture")] == (80, "B") and rows[("web", "security")] == (30, "F")
    assert rows[("web", "dependencies")] == (60, "D") and rows[("web", "onboarding")] == (80, "B")
    assert rows[("blank", "onboarding")] == (50, "D") and rows[("blank", "tech_debt")] == (100, "A")
    health = {r.repo: r.overall for r in scorecard.overall_health(inputs.scores).collect()}
    assert health["web"] == sum(v[0] for (r, _), v in rows.items() if r == "web") // 8


def test_snapshots_are_read_strictly(spark, corpus, full, tmp_path):
    folder = str(tmp_path / "ok")
    write_snapshot(report.full_report(corpus), folder, "one", datetime(2026, 1, 1))
    back = {r.repo: r.asDict(recursive=True) for r in read_snapshots(spark, folder).collect()}
    assert {k: back["web"][k] for k in full["web"]} == full["web"] and back["web"]["snapshot_id"] == "one"
    bad = tmp_path / "bad" / "reports" / "snapshot_id=x"
    bad.mkdir(parents=True)
    (bad / "a.json").write_text('{"repo": "r", "surprise": 1}\n')
    with pytest.raises(ValueError, match="surprise"):
        read_snapshots(spark, str(tmp_path / "bad"))
    (bad / "a.json").write_text('{"repo": "r", "head_commit": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot be"):
        read_snapshots(spark, str(tmp_path / "bad")).collect()
