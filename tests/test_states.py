"""Later states of the derived corpus: what is written and shuffled for them, and that their files are as laid down."""

from types import SimpleNamespace

import pytest

from codestrata.functions import scale
from codestrata.functions.scale import position_in_key
from codestrata.operators import facts
from codestrata.plans import queries, report
from codestrata.sources.corpus import files_of, fixture_templates, later_corpus, projected_corpus, staged_corpus

from conftest import corpus_from

TEXTS = ["plain text", 'a "q" \\ {words}\ttab\r\nx', "{json} {text}", None, "", "é # TODO: later\n{hashed} {n}"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    rows = [(i, TEXTS[i % len(TEXTS)], f"src{i % 5}") for i in range(130)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(path / "documents.parquet"))
    spark.sql(
        "select id as event_id, id % 7 as user_id, timestamp'2026-01-01' as ts, 'view' as event_type from range(60)"
    ).write.parquet(str(path / "events.parquet"))
    return str(path)


def labels(spark, build):
    """Labels of the folders that a function writes."""
    before = len(scale.STAGED.get(spark.sparkContext.applicationId, []))
    build()
    return [t.split("/")[-1].rsplit("-", 1)[0] for t in scale.STAGED[spark.sparkContext.applicationId][before:]]


def test_later_states_place_documents_once_and_write_no_files(spark, folder):
    now = staged_corpus(spark, folder)
    written = labels(spark, lambda: [later_corpus(spark, folder, now, shift) for shift in (1, 2, 3)])
    assert written.count("placed") == 1 and "files" not in written


def test_a_log_of_states_writes_no_files(spark, folder, monkeypatch):
    now = staged_corpus(spark, folder)
    monkeypatch.setattr(queries, "snapshots_for", lambda *_: SimpleNamespace(folder="none"))
    monkeypatch.setattr(queries, "corpus_for", lambda *_: now)
    monkeypatch.setattr(report, "write_debt", lambda corpus, *_: corpus.files.count())
    written = labels(spark, lambda: queries.log_for(spark, folder))
    assert written.count("rules") == 3 and "files" not in written


def test_compared_states_place_documents_once_and_write_no_files(spark, folder, monkeypatch):
    monkeypatch.setitem(scale.KEPT, spark.sparkContext.applicationId, {})
    written = labels(spark, lambda: queries.run("diff_recommendations", spark, folder))
    assert written.count("placed") == 1 and "files" not in written and written.count("facts") == 2


def test_a_projected_state_is_the_written_one(spark, folder):
    rows = lambda table: sorted(map(tuple, table.collect()))
    one, other = staged_corpus(spark, folder), projected_corpus(spark, folder)
    for name in ("files", "commits", "commit_files", "rules"):
        columns = getattr(one, name).columns
        assert rows(getattr(one, name)) == rows(getattr(other, name).select(columns))


def test_a_compared_state_is_read_once(spark, monkeypatch):
    corpus = corpus_from(spark, {"r": {"a.py": "import b\nx = 1\n", "b.py": "# TODO: x\n"}})
    monkeypatch.setattr(report, "write_snapshot", lambda *_: None)
    written = labels(spark, lambda: report.write_for_diff({"now": corpus}, "none"))
    assert written.count("facts") == 1


def expected(repo: str, n: int, text: str | None, shift: int) -> tuple[str, str]:
    body, path = next((b, p) for a, k, p, b in fixture_templates() if a == int(repo[3:]) % 5 and k == (n + shift) % 12)
    t = text or ""
    quoted = t
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = quoted.replace(plain, written)
    body = body.replace("{nn}", f"{n % 100:02d}").replace("{n}", str(n))
    body = body.replace("{hashed}", t.replace("\n", "\n# ")).replace("{slashed}", t.replace("\n", "\n// "))
    body = body.replace("{json}", quoted).replace("{text}", t).replace("{words}", "# " + t.replace(" ", "\n# "))
    return (f"pkg{n // 12}/" if n >= 12 else "") + path, body


@pytest.mark.parametrize("shift", [0, 5])
def test_files_are_templates_with_their_texts(spark, shift):
    rows = [(f"src{r}", n, TEXTS[(r + n) % len(TEXTS)]) for r in range(5) for n in range(26)]
    found = files_of(spark.createDataFrame(rows, "repo string, n long, text string"), shift).collect()
    assert {(r.repo, r.n, r.path, r.content) for r in found} == {(repo, n, *expected(repo, n, t, shift)) for repo, n, t in rows}
    assert all(r.size_bytes == len(r.content.encode()) for r in found)


def test_a_repository_is_ranked_in_many_small_blocks(spark):
    ids = [0, 5, 8_191, 8_192, 20_000, 70_000, 70_001]
    rows = spark.createDataFrame([("r", i) for i in ids], "k string, i long")
    assert scale.BLOCK <= 8_192
    assert [(r.i, r.p) for r in position_in_key(rows, "k", "i", "p").orderBy("i").collect()] == list(zip(ids, range(7)))


@pytest.mark.parametrize("text, lines", [("x\n#todo: a\n", [2]), ("#\nTODO x", []), ("# a\x0b#  Fixme b", [2]), ("# none", []), ("#\n#note", [2])])
def test_todos_with_and_without_a_mark(spark, text, lines):
    rows = spark.createDataFrame([("r", "a.py", text, len(text))], "repo string, path string, content string, size_bytes bigint")
    assert [t.line for t in facts.facts(rows, "todos").first().todos] == lines
    plan = facts.facts(rows, "todos")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?:TODO" in plan  # lines are told apart only behind a test of the whole text


@pytest.mark.parametrize(
    "text, n",
    [("q = \"select a \" % x", 1), ("q = F\"Select {a}\"", 1), ("'From'.FORMAT(a)", 1), ('"a" + b + " where"', 1), ("100 % done from", 0), ("'a' % b", 0)],
)
def test_sql_strings_behind_cheap_tests(spark, text, n):
    rows = spark.createDataFrame([("r", "a.py", text, len(text))], "repo string, path string, content string, size_bytes bigint")
    found = {s.line for s in facts.facts(rows, "sql_strings").first().sql_strings}
    assert found == ({1} if n else set())
