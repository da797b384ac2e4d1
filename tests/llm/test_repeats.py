"""Substring dedup and suffix-array dedup against the rule itself."""

import random

import numpy as np
import pytest

from codestrata.llm import passages, substrings, suffixes

from . import brute


def expected(rows, size=50):
    found = brute.without_repeats(rows, size)
    return sorted((i is None, i or 0, *found[i, t]) for i, t in rows)


def got(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in rows.collect())


@pytest.mark.parametrize("dedup", [substrings.dedup, suffixes.dedup, lambda d: suffixes.dedup(d, hot=1)])
def test_awkward_tables(spark, dedup):
    rows = brute.awkward()
    assert got(substrings.digest(dedup(brute.table(spark, rows)))) == expected(rows)


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_empty_tables(spark, module):
    assert module.dedup(brute.table(spark, [])).collect() == []
    assert [r.n_removed for r in module.dedup(brute.table(spark, [(None, None), (1, "")])).collect()] == [0, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_passages_in_small_blocks(spark, monkeypatch, seed):
    rng = random.Random(seed)
    pool = brute.sentence(rng, 300, 9000).split(" ")
    rows = []
    for i in range(40):  # pieces of one pool: matches that begin, end and overlap anywhere
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(250)
            parts += pool[a : a + rng.randint(20, 120)] + brute.sentence(rng, rng.randint(0, 3)).split()
        rows.append((rng.randrange(1000) * 50 + i, " ".join(parts)))
    monkeypatch.setattr(passages, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 300)  # so that prefixes get longer
    docs = brute.table(spark, rows)
    want = expected(rows)
    assert got(substrings.digest(substrings.dedup(docs))) == want
    assert got(substrings.digest(suffixes.dedup(docs))) == want
    assert got(substrings.digest(suffixes.dedup(docs, hot=6))) == want


def test_prefixes_are_divided_where_they_are_full():
    rng = np.random.default_rng(1)
    chunks = rng.integers(0, 1 << 60, (4000, 5)).astype(np.uint64)
    chunks[:2000, 0] = 7
    prefixes = substrings.Prefixes(4)
    full = int(prefixes.of(chunks[:1])[0])
    prefixes.divide({full: 8})
    sizes = np.bincount(prefixes.of(chunks))
    assert sizes[full] == 0 and sizes[4:].max() < 800 and sizes.sum() == 4000


def test_spans_text_and_layout(spark):
    rng = random.Random(3)
    passage = brute.sentence(rng, 60, 8000)
    rows = [(1, passage), (2, f"  Before\n\n{passage}\n\tafter  this"), (3, passage), (4, "clean\ttext ")]
    docs = brute.table(spark, rows)
    found = {r.id: r for r in suffixes.dedup(docs).collect()}
    assert [tuple(s) for s in found[2].spans] == [(1, 61)] and found[2].kept == "Before after this" and found[1].spans is None
    left = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert set(left) == {1, 2, 4} and left[2].text == "  Before\n\nafter  this" and left[2].n_chars == len(left[2].text)
    assert left[4].text == "clean\ttext " and suffixes.without_repeats(docs).columns == docs.columns


def test_blocks_have_one_order_whatever_the_shuffle_brings(spark):
    search = passages.Search(brute.table(spark, brute.awkward()), "doc_id", "text", 50)
    rows = search.candidates.toArrow()
    turned = rows.take(np.random.default_rng(1).permutation(rows.num_rows))
    assert rows.num_rows > 10
    for a, b in zip(passages.windows(rows, 50, 10), passages.windows(turned, 50, 10), strict=True):
        assert (a.ids == b.ids).all() and (a.start == b.start).all() and (a.place == b.place).all()


def test_suffixes_of_a_line_repeated_within_texts_are_one_row_each(spark):
    rng = random.Random(11)
    line = " ".join(f"v{rng.randrange(90000)}" for _ in range(30)) + "\n"
    own = [" ".join(f"u{rng.randrange(90000)}" for _ in range(60)) for _ in range(4)]
    rows = [(i, f"{own[i % 4]} {line * 40} {own[(i + 1) % 4]}") for i in range(4)] + [(9, own[0])]
    search = passages.Search(brute.table(spark, rows), "doc_id", "text", 50)
    parts = passages.windows(search.candidates.toArrow(), 50, 10)
    columns, places, ids, number = suffixes.questions(parts, 50, 10)
    assert sum(map(len, places)) == len(number) > 4 * 40 and len(columns[0]) < len(number) / 4
    assert got(substrings.digest(suffixes.dedup(brute.table(spark, rows)))) == expected(rows)
    assert got(substrings.digest(suffixes.dedup(brute.table(spark, rows), hot=30))) == expected(rows)


def test_hot_counts_places_and_not_copies(spark):
    rng = random.Random(12)
    passage = " ".join(f"v{rng.randrange(90000)}" for _ in range(55))

    def hot(rows):
        found = passages.Search(brute.table(spark, rows), "doc_id", "text", 50, hot=12).candidates.select("hot").collect()
        return any(r.hot for r in found)

    assert hot([(i, f"{i} " + f"{passage} " * 10) for i in range(2)])
    assert not hot([(i, f"same {passage}") for i in range(30)] + [(50, f"other {passage}")])
