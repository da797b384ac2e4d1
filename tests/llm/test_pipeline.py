import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from codestrata.llm.tables import staged
from codestrata.llm import jaccard, toxicity

from . import brute

ALL = {f"op{n}_" for n in range(1, 14)}


def test_all_operators_are_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert {n.split("_")[0] + "_" for n in names} == ALL and len(names) == 13 and "pipeline" in entry.queries()


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_array_dedup", "decontamination", "bpe"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(11)
    item, passage = brute.sentence(rng, 40, 9000), brute.sentence(rng, 80, 9000)
    rows = [(i, brute.sentence(rng, 130, 3000)) for i in range(60)]
    near = rows[5][1].split()
    near[60] = "changed"
    rows += [(100, rows[4][1]), (101, " ".join(near)), (102, f"{brute.sentence(rng, 60)} idiot scum moron {brute.sentence(rng, 60)}")]
    rows += [(103, f"{brute.sentence(rng, 99)} {passage}"), (104, f"{brute.sentence(rng, 77)} {passage} {brute.sentence(rng, 30)}")]
    rows += [(105, f"{brute.sentence(rng, 50)} {item} {brute.sentence(rng, 50)}"), (None, None), (106, "")]
    brute.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, passage


def test_planted_cases_go_and_clean_documents_stay(spark, folder):
    path, rows, passage = folder
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs.write.parquet(f"{path}/stage{n}")
        docs = spark.read.parquet(f"{path}/stage{n}")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {*range(60), 103, 104, 106, None}
    assert passage in left[103] and passage not in left[104] and all(left[i] == dict(rows)[i] for i in range(60))


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert {r.doc_id for r in rows} == {*range(60), 103, 104, 106, None} and {"n_tokens", "ids_sha256"} <= set(rows[0].asDict())


def test_near_duplicates_of_the_pipeline_take_five_words_and_80_percent():
    assert (jaccard.SHINGLE, jaccard.PERCENT, toxicity.THRESHOLD) == (5, 80, 0.7)


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(top, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": os.environ["PATH"]})
    assert said.stdout.split()[-1] == "False", said.stderr


def test_a_run_leaves_other_operators_tables_alone(spark, folder):
    from codestrata.llm import sharding

    before = sharding.query(spark, folder[0])
    count = before.count()
    kept = set(staged(spark))
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    assert set(staged(spark)) == kept and before.count() == count


@pytest.mark.parametrize("kind", ["empty", "repeated", "unlabelled"])
def test_awkward_documents(spark, folder, tmp_path, kind):
    """An empty table gives no rows; repeated rows are all encoded or all left out; without labels nothing is learned."""
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{folder[0]}/{name}.parquet")
        if (kind, name) in (("empty", "documents"), ("unlabelled", "labels")):
            rows = rows.limit(0)
        if (kind, name) == ("repeated", "documents"):
            rows = rows.unionAll(rows)
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert found == []
    else:
        ids = [r.doc_id for r in found]
        assert ids and all(ids.count(i) == (2 if kind == "repeated" else 1) for i in set(ids))
