"""The quality forest is fitted and calibrated on every labelled row."""

import numpy as np
import pytest

from codestrata.llm import quality


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(0.3, 0.05, (9_000, len(quality.STATISTICS))))
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, statistics array<double>")


def test_every_row_is_in_every_tree(rows):
    x, table = rows
    forest = quality.fit(table.repartition(5), trees=4)
    found = quality.spans(forest, x)
    for root in forest.roots:
        leaves, sizes = np.unique(forest.leaves(root, x), return_counts=True)
        assert sizes.sum() == len(x)
        for leaf, n in zip(leaves, sizes):
            assert found[leaf][0] == n
            assert forest.depth[leaf] == pytest.approx(forest.depth[leaf] // 1 if n < 3 else forest.depth[leaf])
    assert forest.usual == pytest.approx(float(quality.usual_path(len(x))))


def test_a_forest_does_not_depend_on_partitions(rows):
    _, table = rows
    one, two = (quality.fit(table.repartition(n), trees=3) for n in (1, 7))
    assert all(np.array_equal(getattr(one, c), getattr(two, c)) for c in ("column", "value", "child", "depth", "roots"))


def test_the_threshold_counts_all_labelled_rows(spark):
    """Seven thousand good rows, more than once made up a sample, and few bad ones that tell where the threshold lies."""
    scores = [(True, 0.2 + i / 100_000) for i in range(7_000)] + [(False, 0.9)] * 3
    table = spark.createDataFrame(scores, "good boolean, anomaly double")
    forest = quality.Forest(*(np.zeros(1),) * 5, 1.0)
    threshold = quality.calibrated(forest, table).threshold
    assert 0.2 + 6_999 / 100_000 < threshold < 0.9 and threshold == pytest.approx((0.26999 + 0.9) / 2)
