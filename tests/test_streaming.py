"""Extraction on a stream: equal to the batch, once for each delivery, also after a restart and with late files."""

from datetime import datetime, timedelta

import pytest

from codestrata.functions.scale import remove_staged
from codestrata.operators import api, debt, facts, security
from codestrata.plans.queries import corpus_for, run
from codestrata.streaming import extraction as E

from conftest import corpus_from

START = datetime(2026, 3, 1)
TEXTS = {
    "a.py": "x = 1  # TODO one\ny = 2  # FIXME two\n",
    "b.py": 'password = "hunter2222"\n@app.route("/a")\ndef a(): pass  # HACK three\n',
    "c.py": "plain = 1\n",
    "skip/d.py": "z = 3  # TODO ignored\n",
    ".gitignore": "skip\n",
}


def arrival(path, hours, repo="r", text=None):
    body = TEXTS[path] if text is None else text
    return (repo, path, len(body), body, START + timedelta(hours=hours))


class Feed:
    """A folder of arrivals, and streams over it that can be stopped and started again."""

    def __init__(self, spark, folder, rules):
        self.spark, self.folder, self.rules = spark, str(folder), rules

    def push(self, *rows):
        frame = self.spark.createDataFrame(list(rows), E.ARRIVALS).coalesce(1)
        frame.write.mode("append").parquet(f"{self.folder}/in")

    def arrivals(self):
        return E.read_arrivals(self.spark, f"{self.folder}/in", 1)

    def extract(self, name):
        rows = E.extracted(name, self.arrivals(), self.rules)
        E.finished(E.append(rows, f"{self.folder}/{name}", f"{self.folder}/c-{name}"))
        return sorted(tuple(r) for r in self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}").collect())

    def totals(self):
        query = E.finished(E.upsert(E.daily_totals(self.arrivals(), self.rules), f"{self.folder}/t", f"{self.folder}/c-t"))
        rows = E.latest_totals(self.spark, f"{self.folder}/t").collect()
        return {(r.repo, r.day): tuple(r)[2:] for r in rows}, E.late_rows(query)


@pytest.fixture
def feed(spark, tmp_path):
    corpus = corpus_from(spark, {"r": TEXTS, "s": {"c.py": "plain = 1\n"}})
    return Feed(spark, tmp_path, corpus.rules)


def batch(spark, rules, name, rows):
    signals, _ = E.EXTRACTIONS[name]
    tree = facts.walked(facts.facts(spark.createDataFrame(rows, E.ARRIVALS), *signals), rules)
    operator = {"todo_comments": debt.todo_comments, "secret_findings": security.secret_findings, "endpoints": api.endpoints}[name]
    return sorted(tuple(r) for r in operator(tree).collect())


@pytest.mark.parametrize("name", sorted(E.EXTRACTIONS))
def test_rows_equal_the_batch_before_and_after_a_restart(spark, feed, name):
    first = [arrival("a.py", 0), arrival(".gitignore", 0), arrival("skip/d.py", 1)]
    feed.push(*first)
    assert feed.extract(name) == batch(spark, feed.rules, name, first)
    second = [arrival("b.py", 2), arrival("c.py", 3, "s")]
    feed.push(*second)
    feed.push(first[0])  # delivered again
    assert feed.extract(name) == batch(spark, feed.rules, name, first + second)
    assert feed.extract(name) == batch(spark, feed.rules, name, first + second)  # nothing new


def test_totals_run_on_over_days_restarts_and_repeated_deliveries(feed):
    day = (START - datetime(1970, 1, 1)).days
    feed.push(arrival("a.py", 1), arrival("c.py", 2, "s"))
    assert feed.totals()[0] == {("r", day): (1, 2, 2, 0, 0) * 2, ("s", day): (1, 1, 0, 0, 0) * 2}
    feed.push(arrival("b.py", 5), arrival("a.py", 1), arrival("skip/d.py", 5))
    feed.push(arrival("c.py", 30))
    totals, late = feed.totals()
    assert totals[("r", day)] == (2, 5, 3, 1, 1) * 2 and late == 0
    assert totals[("r", day + 1)] == (1, 1, 0, 0, 0, 3, 6, 3, 1, 1)


def test_files_after_the_delay_are_counted_as_late(feed):
    feed.push(arrival("a.py", 1))
    feed.push(arrival("c.py", 100))
    before, _ = feed.totals()
    feed.push(arrival("b.py", 2))
    after, late = feed.totals()
    assert after == before and late >= 1


def test_an_out_of_order_file_within_the_delay_counts(feed):
    feed.push(arrival("c.py", 5))
    feed.push(arrival("a.py", 1))
    totals, late = feed.totals()
    assert [t[:5] for t in totals.values()] == [(2, 3, 2, 0, 0)] and late == 0


def test_a_stream_of_nothing(feed):
    feed.push()
    assert feed.extract("todo_comments") == [] and feed.totals() == ({}, 0)


def test_state_and_shuffles_hold_no_contents(spark, feed):
    feed.push(arrival("a.py", 1))
    query = E.finished(E.upsert(E.daily_totals(feed.arrivals(), feed.rules), f"{feed.folder}/p", f"{feed.folder}/c-p"))
    plan = query._jsq.explainInternal(False)
    exchanges = [line for line in plan.splitlines() if "Exchange" in line or "StateStore" in line]
    assert exchanges and not any("content" in line for line in exchanges)


def test_queries_after_removal_are_made_anew(spark):
    sf = "/root/testdata/sf0.001"
    before = run("walked_files", spark, sf).count()
    folder = corpus_for(spark, sf).files.inputFiles()[0]
    assert remove_staged(spark) > 0
    assert run("walked_files", spark, sf).count() == before
    assert corpus_for(spark, sf).files.inputFiles()[0] != folder
