"""Connected components of edges between long ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import cut, map_batches

EDGES = 500_000  # edges that a task gets, and merges at once


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around each component's smallest node, for at most about twice EDGES nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent[top]) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    def stars() -> pa.RecordBatch:
        v = np.array([x for x, up in parent.items() if up != x], np.int64)
        u = np.array([root(x) for x in v.tolist()], np.int64)
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 2 * EDGES:
            yield stars()
    yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all nodes that have an edge to another node; component is the smallest id reachable.

    Each round merges edges within partitions, links every node's larger neighbours to its smallest neighbour, and then
    its smaller ones, until all edges lead to the smallest node of their component.  The number of rounds grows with the
    logarithm of the longest path; no more than EDGES edges need one round in one task.  Aggregations and joins are ones
    that Spark can split where a node has very many neighbours; no neighbourhood is gathered.
    """
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()
    while True:
        links = cut(links)
        tasks = max(1, -(-links.count() // EDGES))
        links = map_batches(links.coalesce(tasks), merged, "u long, v long")
        if tasks == 1:  # no more edges than one task may merge: its stars are the components
            break
        links = cut(links.distinct())
        ends = links.select(F.col("v").alias("node"), F.lit(1).alias("low")).unionAll(
            links.select(F.col("u").alias("node"), F.lit(0).alias("low"))
        )
        ends = ends.groupBy("node").agg(F.sum("low").alias("up"), F.min("low").alias("top"))
        if not ends.filter("up > 1 or (up = 1 and top = 0)").limit(1).count():
            break
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("m", "u", "v")
        links = small.select(F.col("m").alias("u"), "v").unionAll(
            small.filter("m < u").select(F.col("m").alias("u"), F.col("u").alias("v"))
        )
        links = links.distinct()
    links = cut(links)
    members = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return members.unionAll(members.select(F.col("component").alias("node"), "component").distinct())
