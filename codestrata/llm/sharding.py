"""Sharding by sampled splitters: shards of near equal bytes, with gapless slots.

Records are ordered by (hash of the text, id).  A size-weighted sample of these keys gives quantile boundaries; records
are put into the ranges between them by binary search, ranges that come out too large get boundaries of their own from a
sample of just these ranges, and running sums within ranges plus the sums of the ranges before them place every record
exactly.  Shard borders thus depend on all sizes, not on the sample, which only decides how evenly tasks are loaded.

Everything is DataFrame code.  What the driver sees is bounded: `ranges` boundaries and one row of totals per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.tables import cut, table

SHARDS = 8
RANGE_ROWS = 1_000_000  # records that one task orders
LEAST_RANGES = 64
SAMPLES_PER_RANGE = 24
OVERFULL = 2.0  # ranges above this multiple of the mean are divided
ROUNDS = 4


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per record; a null text has no bytes, a null id is ordered before all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(key.alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id")).alias("k"),
        # a number in [0, 1) that the record alone decides, so that a repeated task draws the same sample
        ((F.xxhash64(F.col(id_col), key, F.lit("sample")).bitwiseAND((1 << 52) - 1)) / float(1 << 52)).alias("u"),
    )


def range_of(k: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters that are at most k, by binary search."""
    if not splitters:
        return F.lit(0)
    found = F.array(*[F.struct(F.lit(a).cast("long").alias("key"), F.lit(b).cast("long").alias("id")) for a, b in splitters])
    start = F.struct(F.lit(0).alias("low"), F.lit(len(splitters)).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        over = F.get(found, middle) <= k
        done = state["low"] >= state["high"]
        return F.struct(
            F.when(~done & over, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(~done & ~over, middle).otherwise(state["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def boundaries(rows: DataFrame, weight: float, wanted: int) -> list[tuple[int, int]]:
    """Quantile boundaries of the keys, from about wanted * SAMPLES_PER_RANGE keys drawn in proportion to size."""
    if wanted < 2 or weight <= 0:
        return []
    rate = wanted * SAMPLES_PER_RANGE / weight
    drawn = rows.select("k", F.floor(F.col("size") * rate + F.col("u")).alias("n")).filter("n > 0")
    drawn = drawn.groupBy("k").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    step = F.floor(F.coalesce(upto, F.lit(0)) / SAMPLES_PER_RANGE)
    return [tuple(r["k"]) for r in drawn.select("k", step.alias("s")).groupBy("s").agg(F.min("k").alias("k")).collect()]


def shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every record, repeated ones included.

    size is the text's bytes in UTF-8 plus 1.  Shards are runs of the order by (text hash, id), so equal texts are
    neighbours; shard s has the records whose middle byte lies in its s-th part of all bytes, so sizes differ from the
    mean by less than the largest record.  Slots count from 0 in each shard.  An empty table gives no rows.
    """
    rows = cut(records(docs, id_col, text_col))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    wanted = max(LEAST_RANGES, -(-total["n"] // RANGE_ROWS))
    splitters: list[tuple[int, int]] = []
    pending, weight, parts = rows, total["bytes"], wanted
    for _ in range(ROUNDS):
        splitters = sorted({*splitters, *boundaries(pending, weight, parts)})
        ranged = rows.withColumn("range", range_of(F.col("k"), splitters))
        most = OVERFULL * total["bytes"] / wanted
        full = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        full = full.filter((F.col("bytes") > most) & (F.col("n") > 1)).collect()
        if not full:
            break
        weight = sum(r["bytes"] for r in full)
        parts = int(weight / (total["bytes"] / wanted)) + len(full)
        pending = ranged.filter(F.col("range").isin([r["range"] for r in full]))
    ranged = rows.drop("u").withColumn("range", range_of(F.col("k"), splitters))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
    )
    order = W.partitionBy("range").orderBy("k", "size", "text_crc32")
    placed = ranged.select(
        "*",
        (F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("byte"),
        (F.row_number().over(order) - 1).alias("row"),
    )
    placed = placed.join(F.broadcast(sums), "range")  # one row per range
    middle = F.col("bytes_before") + F.col("byte") + F.floor(F.col("size") / 2)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(total["bytes"], 1)))).cast("int")
    placed = placed.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("n_before") + F.col("row")).alias("row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    placed = placed.join(F.broadcast(first), "shard")  # one row per shard
    return placed.select("id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def query(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
