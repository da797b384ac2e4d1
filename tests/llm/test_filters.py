"""Quality rules, toxicity, decontamination and sharding."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm import decontamination, quality, sharding, toxicity

from . import brute


# --- quality rules ---------------------------------------------------------------


def counts(text):
    w = [x.decode() for x in brute.words(text)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated)


def test_quality_counts(spark):
    rows = brute.awkward() + [(200, "a b c d e f a b c d e\na b\na b\n \n \n#x# é|"), (201, "x\n\nx\n\nx")]
    found = quality.statistics(brute.table(spark, rows)).collect()
    want = sorted((i is None, i or 0, *counts(t)) for i, t in rows)
    assert sorted((r.id is None, r.id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_forest_rejects_odd_documents_and_keeps_good_ones(spark):
    rng = random.Random(4)
    good = [(i, ". ".join(brute.sentence(rng, 12).capitalize() for _ in range(rng.randint(3, 20)))) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in brute.sentence(rng, 80).split())) for i in range(60)]
    docs = brute.table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good[::2] + bad[::2]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r.id for r in quality.judge(docs, quality.train(docs, labels)).filter("kept").collect()}
    failed = {r.id for r in quality.statistics(docs).filter("base_failed").collect()}
    assert len({i for i, _ in good} - kept - failed) <= 4 and len(kept & {i for i, _ in bad}) <= 2


def test_quality_without_labels_keeps_what_the_rules_keep(spark):
    docs = brute.table(spark, brute.awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, quality.train(docs, none)).collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and len(rows) == docs.count()
    assert quality.judge(brute.table(spark, []), quality.train(docs, none)).collect() == []


# --- toxicity ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        w = brute.sentence(rng, rng.randint(20, 150), 900).split()
        bad = i % 7 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot,", "SCUM", "grobblex", "vexeldan", "vexelmor"]))
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, 1, int(bad)))
    docs = brute.table(spark, rows)
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_its_fold_and_finds_the_rest(spark, toxic):
    docs, labels = toxic
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    found = {r.id for r in rows if r.score >= toxicity.THRESHOLD}
    bad = {i for i in range(900) if i % 7 == 0}
    assert len(found & bad) >= 0.9 * len(bad) and len(found - bad) <= 5 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_ignores_labels_of_the_held_out_fold(spark, toxic):
    docs, labels = toxic
    held = toxicity.remainder("doc_id", 3) == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, other))
    assert a.voters.terms == b.voters.terms and np.allclose(a.weights, b.weights)


def test_toxicity_of_awkward_tables(spark, toxic):
    docs = brute.table(spark, brute.awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert "idiot" in model.voters.terms
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.without(docs, model).columns == docs.columns
    assert toxicity.score(brute.table(spark, []), model).collect() == []
    (row,) = toxicity.score(brute.table(spark, [(1, None)]), model).collect()
    assert 0 <= row.score < toxicity.THRESHOLD


def test_all_proven_terms_and_all_insults_vote(spark):
    rows, labels = [], []
    proven = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}zz" for i in range(120)]
    for i in range(1200):
        bad = i % 2 == 0
        words = [f"clean{i % 37}", f"word{i % 11}"]
        if bad:
            words += [*(proven[(i // 2 + j) % 120] for j in (0, 40, 80)), "scum" if i % 4 else "scumbag", "idiotic" if i % 8 else "idiots", "idiot", "clown" if i % 6 else "clownish"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = brute.table(spark, rows)
    own = toxicity.voters(toxicity.training_rows(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 1200))
    exact = {t for t, size in zip(own.terms, own.sizes) if size == 0}
    families = {t for t, size in zip(own.terms, own.sizes) if size}
    covered = {x for x in proven if any(x.startswith(f) for f in families)}
    assert set(proven) - covered <= exact and len(own) > 120 and set(toxicity.INSULTS) <= exact
    assert {"idiot", "scum", "clown"} <= exact
    for word in ("idiotic", "idiots", "scumbag", "clownish"):
        assert word in exact or any(word.startswith(f) for f in families)
    found, hits, _ = own.votes(pa.array(["nothing here", " ".join(proven), "worthless idiots", None]))
    assert found.counts()[1] >= 120 and hits.tolist()[0] == 0 == hits.tolist()[3] and found.counts()[2] >= 2
    assert toxicity.unpacked(found.packed()).voter.tolist() == found.voter.tolist()


def test_sparse_logistic_is_newtons(spark):
    rng = np.random.default_rng(3)
    dense = rng.random((200, 30)) < 0.1
    votes = toxicity.Votes(np.nonzero(dense)[1].astype(np.int32), np.append(0, np.cumsum(dense.sum(1))))
    x, y = np.concatenate([rng.random((200, 2)), np.ones((200, 1))], 1), rng.random(200)
    w = toxicity.logistic(votes, 30, x, y)
    full, keep = np.concatenate([dense, x], 1), np.append(np.full(32, 0.2), 1e-3)
    slope = full.T @ (y - 1 / (1 + np.exp(-full @ w))) - keep * w
    assert np.abs(slope).max() < 1e-5


# --- decontamination -----------------------------------------------------------------


def test_leaks_are_found_in_any_form(spark):
    rng = random.Random(6)
    items = [(i, brute.sentence(rng, 30, 9000)) for i in range(8)] + [(50, "too short"), (51, None), (None, "a b c d e f"), (52, "")]
    texts = dict(items[:8])
    clean = [(i, brute.sentence(rng, 200, 9000)) for i in range(30)]
    edited = texts[2].split()
    edited[4], edited[15] = "other", "words"
    del edited[22]
    leaks = [
        (100, f"{brute.sentence(rng, 90)} {texts[0]} {brute.sentence(rng, 40)}"), (101, texts[1].upper().replace(" ", "! ")),
        (102, f"{brute.sentence(rng, 50)} {' '.join(edited)}"), (103, (texts[3] + " ") * 40), (None, texts[4]), (104, texts[5]), (104, texts[5]),
    ]
    docs = brute.table(spark, clean + leaks + brute.awkward()[:3] + [(300, None), (301, "")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    found = Counter((r.id, r.item_id) for r in rows)
    assert found == Counter({(100, 0): 1, (101, 1): 1, (102, 2): 1, (103, 3): 40, (None, 4): 1, (104, 5): 2})
    (whole,) = [r for r in rows if r.id == 100]
    assert (whole.start, whole.end, whole.score, whole.matches) == (90, 120, 1.0, 30)
    left = decontamination.without(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len(leaks)


def test_edited_copies_without_a_verbatim_one_are_found(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    items = [(i, words((15, 38)[i % 2])) for i in range(6)]
    docs = [(i, words(60)) for i in range(20)]
    for i, text in items:
        edited = text.split()
        for k in range(3, len(edited) - 1, 4 if i % 2 == 0 else 5):
            edited[k] = f"other{k}"
        docs.append((100 + i, f"{words(30)} {' '.join(edited)} {words(30)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.id, r.item_id): r.score for r in decontamination.verdicts(brute.table(spark, docs), bench).collect()}
    assert found.keys() == {(100 + i, i) for i in range(6)} and found[100, 0] == 0.7
    assert {r.doc_id for r in decontamination.without(brute.table(spark, docs), bench).collect()} == set(range(20))


def test_items_in_blocks_and_without_items(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, brute.sentence(rng, 20, 9000)) for i in range(6)]
    docs = brute.table(spark, [(10 + i, f"x {t} y") for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 45)
    assert sorted((r.id, r.item_id) for r in decontamination.verdicts(docs, bench).collect()) == [(10 + i, i) for i in range(6)]
    assert decontamination.without(docs, bench).count() == 0
    assert decontamination.contaminated(docs, bench.filter("item_id < 0")).collect() == []
    assert decontamination.without(docs, bench.filter("item_id < 0")).count() == 6
    assert decontamination.contaminated(brute.table(spark, []), bench).collect() == []


# --- sharding ------------------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(1)
    rows = brute.awkward() + [(1000 + i, "the same text " * 9) for i in range(400)] + [(2000 + i, brute.sentence(rng, rng.randint(0, 60))) for i in range(600)]
    found = sharding.shards(brute.table(spark, rows)).collect()
    assert len(found) == len(rows)
    assert Counter((r.id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    total = sum(r.size for r in found)
    for s in range(8):
        own = [r for r in found if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= max(r.size for r in found)


def test_few_or_no_records(spark):
    assert sharding.shards(brute.table(spark, [])).collect() == []
    assert [(r.slot, r.size) for r in sharding.shards(brute.table(spark, [(None, None)])).collect()] == [(0, 1)]


def test_overfull_ranges_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_RANGES", 6)
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 2)
    docs = brute.table(spark, [(i, "copy") for i in range(300)] + [(900 + i, f"t{i}") for i in range(100)])
    rows = sharding.shards(docs).collect()
    assert Counter(r.shard for r in rows).keys() == set(range(8))


def test_splitters_are_searched_as_by_counting(spark):
    splitters = [(-5, 3), (0, 0), (0, 9), (7, 2)]
    keys = [(a, b) for a in (-6, -5, 0, 1, 7, 8) for b in (0, 2, 3, 9)]
    frame = spark.createDataFrame([((a, b),) for a, b in keys], "k struct<key:long,id:long>")
    got = [r[0] for r in frame.select(sharding.range_of(F.col("k"), splitters)).collect()]
    assert got == [sum(s <= k for s in splitters) for k in keys]
