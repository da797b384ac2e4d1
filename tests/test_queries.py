"""All queries against their SQL, and what their plans may contain."""

import os
import re

import pytest

import __spark_entry__ as entry
from codestrata.plans.queries import PLANS, corpus_for
from oracles.compare import connect, differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {k: q for k, q in entry.queries().items() if k in PLANS}
SQL = {k: s for k, s in entry.oracle_sql().items() if k in PLANS}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"EvalPython|InPandas|InArrow|PythonUDF", plan)
    assert differences(frame, db, SQL[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def plan_of(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["todo_comments", "secret_findings", "sql_injection", "routes_flask", "cli_click", "py_imports"])
def test_extraction_needs_no_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"Exchange (hash|range|Round)", plan)


@pytest.mark.parametrize("name", ["top_contributors", "hotspots", "convention_sample", "key_files"])
def test_ranking_trims_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


def test_path_queries_do_not_read_contents(spark):
    plan = plan_of(spark, "entry_points")
    assert all("content" not in schema for schema in re.findall(r"ReadSchema: \S+", plan))


def test_every_text_is_in_its_file(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("source", "doc_id", "text").collect()
    files = corpus_for(spark, SF_DIR).files.select("repo", "n", "content").collect()
    texts = {}
    for source, _, text in sorted((d.source, d.doc_id, d.text or "") for d in documents):
        texts.setdefault(source, []).append(text)
    assert sum(len(f.content) for f in files) >= sum(len(t) for own in texts.values() for t in own)
    for f in files:
        text = texts[f.repo][f.n]
        shapes = [text, text.replace("\n", "\n# "), text.replace("\n", "\n// "), text.replace('"', '\\"').replace("\n", "\\n"), text.replace(" ", "\n# ")]
        assert any(shape in f.content for shape in shapes)
