"""A mergeable sketch of whole numbers: counts in buckets whose width grows with the number.

Numbers below 256 have a bucket each; above, each power of two is divided into 128 buckets.  So a quantile read from the
sketch is exact below 256 and else too large by less than one part in ``PARTS``, whatever the numbers are and however the
sketch was put together: merging is adding counts.  A sketch has at most some 7,000 rows for each key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 128
C = F.col


def bucket(value: Column) -> Column:
    """The bucket of a whole number that is not negative; buckets are ordered like their numbers."""
    whole = value.cast("bigint")
    shift = F.greatest(F.length(F.bin(whole)) - 8, F.lit(0))
    return (shift * PARTS + F.call_function("shiftright", whole, shift)).cast("int")


def largest(of: Column) -> Column:
    """The largest number of a bucket."""
    shift = F.greatest((of / PARTS).cast("int") - 1, F.lit(0))
    upper = F.call_function("shiftleft", (of - shift * PARTS).cast("bigint"), shift)
    return upper + (F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1)


def sketch(rows: DataFrame, keys: list[str], of: Column) -> DataFrame:
    """keys, bucket, n: how many rows fall into each bucket ``of``; summed up within tasks first."""
    return rows.groupBy(*keys, of.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(keys: list[str], *sketches: DataFrame) -> DataFrame:
    """One sketch of everything that the given ones hold."""
    return reduce(DataFrame.unionByName, sketches).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(of: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys, count, and for each name the smallest bucket's bound that at least the given share of rows keeps to."""
    until = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = of.withColumns({"_until": F.sum("n").over(until), "_all": F.sum("n").over(W.partitionBy(*keys))})
    first = {name: F.min(F.when(C("_until") >= F.ceil(C("_all") * share), C("bucket"))) for name, share in shares.items()}
    found = counted.groupBy(*keys).agg(F.max("_all").alias("count"), *(b.alias(name) for name, b in first.items()))
    return found.select(*keys, "count", *(largest(C(name)).alias(name) for name in shares))
