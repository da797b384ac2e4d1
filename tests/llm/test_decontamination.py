"""Decontamination: seeds, recall against aligning every item with every text, shared wording, groups of edited copies."""

import datetime
import random
import time
from collections import Counter

import numpy as np

from codestrata.llm import decontamination
from codestrata.llm.align import occurrences
from codestrata.llm.decontamination import N, Items, Words

from . import brute

WORDS = [f"w{i}" for i in range(3000)]
WEIGHTS = [1 / (i + 1) for i in range(3000)]


def natural(rng, n):
    """Words with frequencies as in natural texts: the most common one is a tenth of all."""
    return rng.choices(WORDS, WEIGHTS, k=n)


def edited(rng, words, share):
    out = []
    for x in words:
        if rng.random() >= share:
            out.append(x)
        else:
            out += rng.choice([[], [f"e{rng.randrange(99)}"], [f"e{rng.randrange(99)}"], [x, "put"]])
    return out


def codes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), terms=True).h


def test_recall_against_full_alignment(spark):
    rng = random.Random(21)
    items = [(i, natural(rng, rng.randint(15, 45))) for i in range(30)]
    docs = []
    for i, words in items:
        for k in range(6):
            docs.append((10 * i + k, natural(rng, rng.randint(0, 60)) + edited(rng, words, 0.07 * k) + natural(rng, rng.randint(0, 60))))
    docs = [(i, " ".join(x)) for i, x in docs]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    found = {(r.id, r.item_id): r.score for r in decontamination.verdicts(brute.table(spark, docs), bench).collect()}
    want = {}
    for i, text in docs:
        for item, words in items:
            own = codes(" ".join(words))
            scores = [x.score for x in occurrences(own, codes(text), lambda x, own=own: x.score >= len(own), 1)]
            if scores:
                want[i, item] = max(scores) / (2 * len(own))
    assert len(want) > 150 and found.keys() <= want.keys()
    assert all(abs(score - want[k]) < 1e-9 for k, score in found.items())
    assert len(found) >= 0.97 * len(want)
    low = [k for k in want if want[k] < 0.65]
    assert len(low) > 20 and sum(k in found for k in low) >= 0.9 * len(low)


def test_a_preamble_of_many_items_is_no_seed(spark):
    rng = random.Random(5)
    preamble = " ".join(f"p{i}" for i in range(10))
    items = [(i, f"{preamble} {' '.join(f'i{i}x{k}' for k in range(10))}") for i in range(2000)]
    docs = [(1, " ".join([preamble, *natural(rng, 1)] * 200)), (2, f"{' '.join(natural(rng, 50))} {items[7][1]}"), (3, items[9][1].replace("x4", "x"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    block = Items([tuple(x) for x in items])
    counts = np.ones(len(block.vocabulary), np.int64)
    block.choose(counts, 10_000)
    w = Words(*(lambda d: (d, np.array([0, len(d)])))(np.frombuffer(docs[0][1].encode(), np.uint8)), terms=True)
    began = time.time()
    assert list(decontamination.passages(0, w, block, 0.5)) == [] and time.time() - began < 2
    found = {(r.id, r.item_id): r.score for r in decontamination.verdicts(brute.table(spark, docs), bench).collect()}
    assert found == {(2, 7): 1.0, (3, 9): (2 * 19 - 1) / 40}


def test_groups_of_edited_or_cut_copies_are_found_beside_verbatim_ones(spark):
    rng = random.Random(6)
    items = [(i, natural(rng, 30)) for i in range(3)]
    cut, other = items[0][1][:20], [x if k % 4 else f"o{k}" for k, x in enumerate(items[1][1])]
    docs = [(i, " ".join(natural(rng, 20) + (cut if i % 2 else other))) for i in range(400)]
    docs += [(900 + i, " ".join(natural(rng, 30) + words)) for i, words in items]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    found = Counter(r.item_id for r in decontamination.verdicts(brute.table(spark, docs), bench).collect())
    assert found == {0: 201, 1: 201, 2: 1}
    assert decontamination.without(brute.table(spark, docs), bench).count() == 0


def test_seeds_are_rare_and_cover_their_item():
    common = ["the of and to in a is it"] * 3
    block = Items([(0, " ".join(common)), (1, "the of and to in a rare word of its own the of and to in a is")])
    known = dict(zip(codes("rare word its own the of and to in a is it").tolist(), [1] * 4 + [3000, 2500, 2000, 1800, 1500, 1300, 1200, 1100]))
    counts = np.array([known[x] for x in block.vocabulary.tolist()])
    keep = block.seeds(counts, 10_000)
    item, place = block.item.copy(), block.place.copy()
    for i in (0, 1):
        stretches = {p // decontamination.STRETCH for k, p in zip(item, place) if k == i}
        assert {p // decontamination.STRETCH for k, p, s in zip(item, place, keep) if k == i and s} == stretches
    rare = {(1, p) for p in range(4, 10)}
    assert rare <= {(i, p) for i, p, s in zip(item, place, keep) if s}
    assert [p for i, p, s in zip(item, place, keep) if i == 1 and p < 4 and s] == [3]  # the rarest of common ones
    few = Items([(0, "a b c d")])
    assert few.seeds(np.zeros(4, int), 0).all() and len(few.gram) == 4 - N + 1


def test_items_with_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(12))
    for kind, value in [("string", "x"), ("date", datetime.date(2020, 1, 2)), ("short", 3), ("double", 0.5)]:
        bench = spark.createDataFrame([(value, text)], f"item_id {kind}, text string")
        rows = decontamination.contaminated(brute.table(spark, [(1, text), (2, None)]), bench).collect()
        assert [(r.id, r.item_id, r.score) for r in rows] == [(1, value, 1.0)]


def test_equal_alignments_give_the_first(spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "item_id long, text string")
    rows = decontamination.verdicts(brute.table(spark, [(5, "x a b c d e f y a b c d e f z")]), bench).collect()
    assert sorted((r.item_id, r.start, r.end, r.passages) for r in rows) == [(1, 1, 7, 2), (2, 1, 7, 2)]
