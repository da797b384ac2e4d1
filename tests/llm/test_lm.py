import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import lm
from codestrata.llm.tables import remainder

from . import brute


def test_elias_fano_gives_back_its_values():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (5, 3), (1000, 10), (3000, 10**6), (200, 2**31)):
        values = np.sort(rng.integers(0, top + 1, n))
        packed = lm.EliasFano(values)
        assert (packed.get(np.arange(n)) == values).all()
    sparse = lm.EliasFano(np.arange(100_000) * 7)
    assert sparse.low.nbytes + sparse.high.nbytes + sparse.before.nbytes < 100_000 * 3


def test_codes_bound_counts():
    counts = np.concatenate([np.arange(0, 5000), [10**6, 10**9]])
    codes = lm.code_of(counts)
    assert (lm.count_of(codes) <= counts).all() and (lm.count_of(codes, up=True) >= counts).all()
    assert (lm.count_of(codes) >= counts * 0.985 - 1e-9).all() and (lm.count_of(codes[:40]) == counts[:40]).all()


def test_trie_finds_what_it_stores():
    rng = np.random.default_rng(3)
    context, word = rng.integers(0, 60, 4000).astype(np.uint64), rng.integers(0, 90, 4000).astype(np.uint64)
    count = rng.integers(0, 3, 4000)
    want = Counter()
    for c, w, n in zip(context.tolist(), word.tolist(), count.tolist()):
        want[c, w] += n
    trie = lm.Trie(context, word, count)
    asked = sorted((c, w) for c in range(62) for w in range(92))
    at = trie.find(np.array([c for c, _ in asked], np.uint64), np.array([w for _, w in asked], np.uint64))
    assert [int(trie.total[i]) if i >= 0 else 0 for i in at] == [want[k] for k in asked]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_counts(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(lm, "SHARD_BYTES", 9000)
    rows, prior = brute.awkward(), 5.0
    tokens = {(i, t): [*(w.lower() for w in brute.words(t)), "end"] for i, t in rows}
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    grams = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if learn(i):
            padded = ["start"] * (order - 1) + tokens[i, t]
            for k in range(1, order + 1):
                for p in range(order - 1, len(padded)):
                    grams[k][tuple(padded[p - k + 1 : p + 1])] += 1
    n, v, texts = sum(grams[1].values()), len(grams[1]), sum(learn(i) for i, _ in rows)
    found = lm.scores(brute.table(spark, rows), remainder("doc_id", 7) != 2, order=order, prior=prior).collect()
    assert len(found) == len(rows)
    want = []
    for i, t in rows:
        own = tokens[i, t]
        padded = ["start"] * (order - 1) + own
        score = 0.0
        for p in range(order - 1, len(padded)):
            chance = (grams[1][(padded[p],)] + 1) / (n + v + 1)
            for k in range(2, order + 1):
                before = tuple(padded[p - k + 1 : p])
                total = texts if set(before) == {"start"} else grams[k - 1][before]
                chance = (grams[k][tuple(padded[p - k + 1 : p + 1])] + prior * chance) / (total + prior)
            score += math.log10(chance)
        base = sum(math.log10((grams[1][(x,)] + 1) / (n + v + 1)) for x in own)
        want.append((i is None, i or 0, len(own), sum(grams[1][(x,)] > 0 for x in own), base, score))
    got = sorted((r.id is None, r.id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in found)
    for a, b in zip(got, sorted(want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], abs=0.02 * b[2])
    assert {r.train_tokens for r in found} == {n}


def test_empty_and_unlearnt_tables(spark):
    assert lm.scores(brute.table(spark, []), F.lit(True)).collect() == []
    (row,) = lm.scores(brute.table(spark, [(1, "a b")]), F.lit(None).cast("boolean")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
