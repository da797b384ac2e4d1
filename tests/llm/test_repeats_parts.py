"""The pipeline's repeats are the same whatever the size of blocks and buckets."""

import random

from codestrata.llm import passages, suffixes

from . import brute


def test_small_parts_give_the_same_texts(spark):
    rng = random.Random(5)
    shared = [brute.sentence(rng, 60) for _ in range(4)]
    rows = [(i, " ".join([brute.sentence(rng, 30), shared[i % 4], brute.sentence(rng, 30)])) for i in range(40)]
    docs = brute.table(spark, rows)
    whole, parts = (sorted(suffixes.without_repeats(docs, part_bytes=n).select("doc_id", "text").collect()) for n in (1 << 23, 2_000))
    assert whole == parts and sum(t != dict(rows)[i] for i, t in whole) >= 30
    assert suffixes.SMALL <= passages.BLOCK_BYTES // 2
