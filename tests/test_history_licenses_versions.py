"""Staleness, trends over stored snapshots, license expressions and version ranges, on small exact cases."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from codestrata.operators import history, licensing, trend, versions
from codestrata.operators.facts import facts
from codestrata.sources.snapshots import write_snapshot, SECTION_TYPES

from conftest import corpus_from

START = datetime(2026, 1, 1)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# --- staleness


def log(*entries):
    """Commits of (id, days after the start, is a merge) in one repository."""
    return [("r", i, "ann", "a@x", START + timedelta(days=d), "s", merge) for i, d, merge in entries]


def test_staleness_is_measured_at_the_newest_commit(spark):
    commits = log((1, 0, False), (2, 30.5, False), (3, 200, False), (4, 213, True))
    touched = [("r", 1, "old.py"), ("r", 2, "edge.py"), ("r", 3, "new.py"), ("r", 1, "new.py"), ("r", 4, "old.py"), ("r", 1, "gone.py")]
    corpus = corpus_from(spark, {"r": {p: "" for p in ("old.py", "edge.py", "new.py", "never.py")}, "bare": {"a.py": ""}}, commits, touched)
    found = rows_of(history.stale_files(corpus.files, corpus.commits, corpus.commit_files))
    assert found == [
        ("bare", "a.py", None, None, "untouched"), ("r", "edge.py", 2, 182, "fresh"), ("r", "never.py", None, None, "untouched"),
        ("r", "new.py", 3, 13, "fresh"), ("r", "old.py", 1, 213, "stale"),
    ]
    assert [r[4] for r in rows_of(history.stale_files(corpus.files, corpus.commits, corpus.commit_files, 182))][1] == "stale"
    shares = rows_of(history.code_staleness(corpus.files, corpus.commits, corpus.commit_files))
    assert shares == [("bare", 0, 0, 1, None), ("r", 2, 1, 1, 1 / 3)]


def test_staleness_without_commits_or_files(spark):
    corpus = corpus_from(spark, {"r": {"a.py": ""}})
    assert rows_of(history.stale_files(corpus.files, corpus.commits, corpus.commit_files)) == [("r", "a.py", None, None, "untouched")]
    assert rows_of(history.code_staleness(corpus.files.limit(0), corpus.commits, corpus.commit_files)) == []


# --- trends


def snapshot(spark, folder, name, day, **scores):
    """A stored snapshot of debt scores."""
    frame = spark.createDataFrame([(repo, score) for repo, score in scores.items()], "repo string, s int")
    debt = F.struct(
        F.col("s").alias("overall_score"), F.when(F.col("s") > 50, "C").otherwise("A").alias("grade"),
        *(F.lit(None).alias(n) for n in ("dimensions", "hotspots", "recommendations")),
    ).cast(SECTION_TYPES["tech_debt"])
    others = {n: F.lit(None).cast(k) for n, k in SECTION_TYPES.items() if n != "tech_debt"}
    report = frame.select("repo", F.lit(1).cast("bigint").alias("head_commit"), debt.alias("tech_debt")).withColumns(others)
    write_snapshot(report, folder, name, datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(days=day))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("log"))
    snapshot(spark, place, "c", 20, up=60, down=10, flat=5)
    snapshot(spark, place, "a", 0, up=10, down=40, flat=5, once=3)
    snapshot(spark, place, "b", 10, up=20, down=30, flat=5)
    snapshot(spark, place, "d", 30, up=55, flat=5)
    return place


def test_a_trend_follows_the_order_of_time_not_of_names_or_writing(spark, folder):
    found = {}
    for r in trend.stored_trend(spark, folder).collect():
        found.setdefault(r.repo, []).append(r)
    up = sorted(found["up"], key=lambda r: r.position)
    assert [(r.snapshot_id, r.score, r.change, r.change_so_far) for r in up] == [
        ("a", 10, None, 0), ("b", 20, 10, 10), ("c", 60, 40, 50), ("d", 55, -5, 45)
    ]
    # least squares through (0, 10), (10, 20), (20, 60), (30, 55)
    assert up[0].slope == pytest.approx(1.75) and {r.direction for r in up} == {"worsening"}
    assert {r.direction for r in found["down"]} == {"improving"} and found["down"][0].slope == pytest.approx(-1.5)
    assert {(r.slope, r.direction) for r in found["flat"]} == {(0.0, "steady")}
    assert [(r.position, r.change, r.slope, r.direction) for r in found["once"]] == [(1, None, None, "unknown")]


def test_a_trend_over_named_snapshots_reads_no_others(spark, folder):
    frame = trend.stored_trend(spark, folder, ["a", "b"])
    assert {r.snapshot_id for r in frame.collect()} == {"a", "b"}
    assert not any("snapshot_id=c" in f or "snapshot_id=d" in f for f in frame.inputFiles())


def test_snapshots_of_one_day_have_no_slope(spark, tmp_path):
    for name, score in (("x", 1), ("y", 9)):
        snapshot(spark, str(tmp_path), name, 0, r=score)
    found = trend.stored_trend(spark, str(tmp_path)).collect()
    assert {(r.slope, r.direction) for r in found} == {(None, "unknown")} and [r.change for r in sorted(found, key=lambda r: r.position)] == [None, 8]


# --- licenses

EXPRESSIONS = [  # expression, own license, as a package, inside
    ("MIT", "MIT", True, True),
    ("MIT", "Proprietary-X", None, None),
    ("GPL-3.0-only", "MIT", False, False),
    ("MIT OR GPL-3.0-only", "MIT", True, True),
    ("MIT AND GPL-3.0-only", "MIT", False, False),
    ("MIT OR ISC AND GPL-3.0-only", "MIT", True, True),  # AND binds before OR
    ("(MIT OR ISC) AND GPL-3.0-only", "MIT", False, False),
    ("((Apache-2.0))", "GPL-2.0-only", False, False),
    ("Apache-2.0", "GPL-3.0-only", True, True),
    ("Apache-2.0", "MIT", True, True),
    ("LGPL-2.1-only", "MIT", True, False),
    ("LGPL-2.1-only", "GPL-2.0-only", True, True),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "MIT", True, False),
    ("GPL-2.0-only with Unknown-exception", "MIT", False, False),
    ("GPL-2.0-or-later", "AGPL-3.0-only", True, True),
    ("GPL-2.0-only", "GPL-3.0-only", False, False),
    ("GPL-3.0-only", "MIT OR GPL-3.0-only", True, True),
    ("CC-BY-NC-4.0", "MIT", False, False),
    ("Strange-1.0", "MIT", None, None),
    ("Strange-1.0 OR MIT", "MIT", True, True),
    ("Strange-1.0 AND GPL-3.0-only", "MIT", False, False),
    ("apache license,  version 2.0", "Apache-2.0", True, True),
    ("mit or (apache-2 and gplv3)", "Apache-2.0", True, True),
    *((bad, "MIT", None, None) for bad in ("", " ", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT ISC", "()", "AND", "MIT () ISC", ")(")),
    (None, "MIT", None, None),
    ("MIT", None, None, None),
]


def test_expressions_are_read_with_brackets_and_precedence(spark):
    frame = spark.createDataFrame([(e, o) for e, o, _, _ in EXPRESSIONS], "e string, o string").coalesce(1)
    own, inner = licensing.normal(F.col("o")), licensing.normal(F.col("e"))
    found = frame.select("e", "o", licensing.fits(own, inner, F.lit(True)).alias("x"), licensing.fits(own, inner, F.lit(False)).alias("y"))
    assert [tuple(r) for r in found.collect()] == EXPRESSIONS


def test_the_order_is_closed(spark):
    into = licensing.INTO
    assert "AGPL-3.0-only" in into["CC0-1.0"] and "GPL-2.0-only" not in into["Apache-2.0"] and "MIT" in into["Apache-2.0"]
    assert "GPL-2.0-only" in into["MIT"] and into["CC-BY-NC-4.0"] == ["CC-BY-NC-4.0"]


REPOS = {
    "js": {
        "package.json": '{"license": "MIT", "dependencies": {"react": "1", "pyqt5": "2", "mystery": "3"}}',
        "a.js": "// SPDX-License-Identifier: GPL-2.0-only OR MIT\n",
        "b.js": "// SPDX-License-Identifier: GPL-2.0-only\n\n// Licensed under the Apache License, Version 2.0\n",
        "node_modules/c.js": "// SPDX-License-Identifier: GPL-2.0-only\n",
    },
    "py": {"pyproject.toml": '[project]\nlicense = {text = "GPLv2"}\ndependencies = ["requests>=2", "flask"]\n'},
    "rs": {"Cargo.toml": '[package]\nlicense = "GPL-3.0+"\n[dependencies]\nserde = "1"\n'},
    "md": {"README.md": "# X\n\n## License\n\nApache 2.0.\n", "x.py": "# This work is licensed under the GNU General Public License, version 3.\n"},
    "no": {"x.py": "# Released under the MIT License.\n"},
}


def test_conflicts_of_packages_and_files(analyse):
    signals = ["manifest", "notices"]
    found = sorted(analyse(lambda i: licensing.license_conflicts(i.facts), REPOS, signals=signals))
    assert found == [
        ("js", "file", "b.js", "GPL-2.0-only", "MIT"), ("js", "package", "pyqt5", "GPL-3.0-only", "MIT"),
        ("md", "file", "x.py", "GPL-3.0-only", "Apache-2.0"), ("py", "package", "requests", "Apache-2.0", "GPL-2.0-only"),
    ]
    verdicts = {(r[0], r[2]): r[5] for r in analyse(lambda i: licensing.license_verdicts(i.facts), REPOS, signals=signals)}
    assert verdicts[("js", "mystery")] == verdicts[("no", "x.py")] == "unknown"
    assert verdicts[("js", "a.js")] == verdicts[("rs", "serde")] == verdicts[("py", "flask")] == "fits"
    lines = sorted(analyse(lambda i: licensing.license_notices(i.facts), REPOS, signals=["notices"]))
    assert ("js", "b.js", 3, "Apache-2.0") in lines and not any("node_modules" in r[1] for r in lines)


def test_package_licenses_can_be_given(spark):
    packages = spark.createDataFrame([("Mystery", "AGPL-3.0-only"), ("mystery", "AGPL-3.0-only")], "package string, license string")
    known = facts(corpus_from(spark, REPOS).files, "manifest", "notices")
    found = {r.source: r.verdict for r in licensing.license_verdicts(known, packages).where("repo = 'js' and kind = 'package'").collect()}
    assert found == {"mystery": "conflict", "react": "unknown", "pyqt5": "unknown"}


# --- versions

ORDER = ["0", "0.0.1", "0.1.dev1", "0.1a1", "0.1-beta.2", "0.1.b3", "0.1rc1", "0.1", "0.1.post1", "0.1.1", "0.2", "0.10", "1.0.0-next.1", "v1", "1.0.1", "2", "10.0"]


def test_versions_are_totally_ordered(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(ORDER)], "i int, v string")
    assert [r.v for r in frame.orderBy(versions.version_key(F.col("v"))).collect()] == ORDER
    same = spark.createDataFrame([("1", "1.0.0"), ("v2.0", "2"), ("1.0-rc.1", "1rc1"), ("3.0a", "3alpha0")], "a string, b string")
    assert [r[0] for r in same.select(versions.version_key(F.col("a")) == versions.version_key(F.col("b"))).collect()] == [True] * 4
    none = spark.createDataFrame([("latest",), ("",), (None,)], "v string")
    assert [r[0] for r in none.select(versions.version_key(F.col("v"))).collect()] == [None] * 3


RANGES = [  # bare operator, alternatives, inside, outside
    ("=", [["^1.2.3"]], ["1.2.3", "1.9"], ["1.2.2", "2", "2.0.0-rc.1"]),
    ("=", [["^0.2.3"]], ["0.2.9"], ["0.3", "0.2.2"]), ("=", [["^0.0.3"]], ["0.0.3"], ["0.0.4"]), ("=", [["^0"]], ["0.9"], ["1"]),
    ("=", [["~1.2.3"]], ["1.2.9"], ["1.3", "1.2.2"]), ("=", [["~1"]], ["1.9"], ["2"]),
    ("==", [["~=1.4.5"]], ["1.4.9"], ["1.5"]), ("==", [["~=1.4"]], ["1.9"], ["2"]),
    ("=", [["~> 7.1"]], ["7.9"], ["8"]), ("=", [["~> 7.1.2"]], ["7.1.9"], ["7.2"]),
    ("==", [[">=2.28", "<3"]], ["2.28", "2.99.1"], ["3", "2.27.9"]), ("==", [[">1", "<=2"]], ["1.0.1", "2.0"], ["1.0", "2.0.1"]),
    ("==", [["1.4.*"]], ["1.4.0", "1.4.99"], ["1.5", "1.3"]), ("==", [["!=1.5", ">1"]], ["1.4", "1.6"], ["1.5.0"]),
    ("=", [["1.2.3"]], ["1.2.3"], ["1.2.4"]), ("^", [["1.2"]], ["1.9"], ["2", "1.1"]), ("major", [["v1.2.3"]], ["1.9"], ["2", "1.2"]),
    ("=", [["^1"], ["^3"]], ["1.5", "3.5"], ["2", "4"]), ("=", [["*"]], ["9"], []), ("=", [["1.x"]], ["1.7"], ["2", "0.9"]),
]


@pytest.mark.parametrize("bare,alternatives,within,without", RANGES)
def test_ranges(spark, bare, alternatives, within, without):
    frame = spark.createDataFrame([(alternatives, v) for v in within + without], "a array<array<string>>, v string")
    clauses = F.transform("a", lambda a: F.transform(a, lambda x: versions.clause_of(x, bare)))
    rows = frame.withColumn("intervals", F.transform(clauses, versions.intersection))
    key = versions.version_key(F.col("v"))
    found = rows.select("v", F.exists("intervals", lambda i: versions.inside(key, i)).alias("ok")).collect()
    assert {r.v for r in found if r.ok} == set(within)


MANIFESTS = {
    "a": {"requirements.txt": 'Flask[async]>=2,<3 ; python_version > "3"\nodd>3,<2\nsame==1.0,!=1.0\nfile @ http://x/y.zip\nweb==1.2rc1\n'},
    "b": {"requirements.txt": "flask==3.1\nweb~=1.1\n", "package.json": '{"dependencies": {"web": ">= 1.0 < 2 || ^3.0", "any": "latest"}}'},
    "c": {"Gemfile": "gem 'rails', '~> 7.0', '>= 7.0.4' # '~> 1'\ngem \"puma\"\n", "go.mod": "require github.com/a/b v1.2.3\n"},
    "d": {"Cargo.toml": '[dependencies]\nserde = "^1.0"\ntokio = { version = "1.5", features = ["full"] }\n'},
}


def test_the_newest_known_version_and_the_ranges_that_admit_it(analyse):
    found = {(r[0], r[2], r[3]): r[4:] for r in analyse(lambda i: versions.latest_version(i.facts), MANIFESTS, signals=["manifest"])}
    assert found == {
        ("a", "pypi", "Flask"): (">=2,<3", "3.1", False), ("b", "pypi", "flask"): ("==3.1", "3.1", True),
        ("a", "pypi", "odd"): (">3,<2", "3", False), ("a", "pypi", "same"): ("==1.0,!=1.0", "1.0", False),
        ("a", "pypi", "file"): ("", None, None), ("a", "pypi", "web"): ("==1.2rc1", "1.2rc1", True),
        ("b", "pypi", "web"): ("~=1.1", "1.2rc1", True), ("b", "npm", "web"): (">= 1.0 < 2 || ^3.0", "3.0", True),
        ("b", "npm", "any"): ("latest", None, None), ("c", "gem", "rails"): ("~> 7.0, >= 7.0.4", "7.0.4", True),
        ("c", "gem", "puma"): ("", None, None), ("c", "go", "github.com/a/b"): ("v1.2.3", "1.2.3", True),
        ("d", "cargo", "serde"): ("^1.0", "1.0", True), ("d", "cargo", "tokio"): ("1.5", "1.5", True),
    }
    ranges = {(r[0], r[3]): r[5] for r in analyse(lambda i: versions.version_ranges(i.facts), MANIFESTS, signals=["manifest"])}
    assert [k for k, ok in ranges.items() if not ok] == [("a", "odd"), ("a", "same")]
