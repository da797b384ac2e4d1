"""Substring dedup by prefix-partitioned suffix trees.

Every suffix that may begin a repeated window is a path of chunk hashes, CHUNK words each.  Suffixes are split into
buckets by the hash of their first chunk; a bucket with too many suffixes is split by the next chunk, and so on, so that
prefixes get longer just where text repeats and each bucket fits a task.  In a bucket the suffixes are sorted, which lays
out the subtree: neighbours with all chunks in common hang below one internal node of the wanted depth.  Its smallest
document id owns the window; other documents lose the words it covers.

A block of texts asks for each different suffix once and gets the owners in the same order, so a window that a third
of all documents have is one row for each block.  Blocks and buckets have bounded sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.passages import (
    BUCKET_BYTES, GRAM, REMOVED, SIZE, Part, Search, covered, packed, removed, unpacked, windows, with_verdicts,
)
from codestrata.llm.tables import by_group, by_groups, table
from codestrata.llm.text import mix

CHUNK = GRAM
OVERFULL = 3.0


class Prefixes:
    """The bucket of a suffix: by its first chunk, and by further ones where a bucket is divided."""

    def __init__(self, first: int) -> None:
        self.parts = np.ones(first, np.int64)
        self.base = np.zeros(first, np.int64)
        self.first, self.level = first, 0

    def divide(self, full: dict[int, int]) -> None:
        """Gives each bucket that many buckets of its own, by the next chunk."""
        for bucket, parts in sorted(full.items()):
            self.parts[bucket], self.base[bucket] = parts, len(self.parts)
            self.parts = np.append(self.parts, np.ones(parts, np.int64))
            self.base = np.append(self.base, np.zeros(parts, np.int64))
        self.level += 1

    def of(self, chunks: np.ndarray) -> np.ndarray:
        bucket = (mix(chunks[:, 0]) % np.uint64(self.first)).astype(np.int64)
        for level in range(1, min(self.level + 1, chunks.shape[1])):
            parts = self.parts[bucket]
            own = self.base[bucket] + (mix(chunks[:, level] + np.uint64(level)) % parts.astype(np.uint64)).astype(np.int64)
            bucket = np.where(parts > 1, own, bucket)
        return bucket


def suffixes(parts: list[Part], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all windows, and their documents' ids."""
    at = [min(k, size - CHUNK) for k in range(0, size, CHUNK)]
    chunks = [np.stack([p.grams[p.start + k] for k in at], 1) for p in parts]
    return np.concatenate([np.zeros((0, len(at)), np.uint64), *chunks]), np.concatenate([np.zeros(0, np.int64), *(p.owner_ids() for p in parts)])


def questions(parts: list[Part], size: int, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, chunks, smallest id) of each different suffix, in a fixed order, and the number of each window's suffix."""
    chunks, ids = suffixes(parts, size)
    bucket = prefixes.of(chunks)
    order = np.lexsort((ids, *chunks.T[::-1], bucket))
    new = np.ones(len(order), bool)
    new[1:] = (chunks[order[1:]] != chunks[order[:-1]]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    own = order[new]
    return bucket[own], chunks[own], ids[own], number


def owners(chunks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id below the deep node of each suffix, from the sorted suffixes of a subtree."""
    order = np.lexsort(chunks.T[::-1])
    common = (chunks[order[1:]] == chunks[order[:-1]]).all(1)  # neighbours below one node of full depth
    node = np.append(0, np.cumsum(~common)) if len(order) else np.zeros(0, int)
    begin = np.flatnonzero(np.append(True, ~common)) if len(order) else np.zeros(0, int)
    out = np.empty(len(order), np.int64)
    if len(order):
        out[order] = np.minimum.reduceat(ids[order], begin)[node]
    return out


def dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept, all_sha256): words of windows that start in a document with a smaller id go.

    A window is `size` (at least CHUNK) consecutive words of one document; all windows are judged on the input.  spans
    are the removed runs of words, kept the other words joined by one space (null where all stay).  One row for each
    input row: equal rows get equal results; of several texts with one id, none removes words of another; a null id
    neither loses nor removes words; null and empty texts have no words.
    """
    search = Search(docs, id_col, text_col, size)
    gram, width = search.gram, -(-size // CHUNK)
    prefixes = Prefixes(search.buckets)
    table = search.candidates
    for _ in range(width - 1):  # longer prefixes where too many suffixes share one

        def count(group: pa.Table) -> pa.Table:
            bucket, *_ = questions(windows(group, size, gram), size, prefixes)
            some, n = np.unique(bucket, return_counts=True)
            return pa.table({"bucket": pa.array(some, pa.int64()), "n": pa.array(n.astype(np.int64))})

        if search.buckets == 1:
            break
        sizes = by_group(table, "block", count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        most = OVERFULL * BUCKET_BYTES / 6
        full = {r["bucket"]: int(2 * r["n"] / most) + 2 for r in sizes.filter(F.col("n") > most).collect()}
        full = {b: parts for b, parts in full.items() if prefixes.parts[b] == 1}
        if not full:
            break
        prefixes.divide(full)

    def ask(group: pa.Table) -> pa.Table:
        bucket, chunks, ids, _ = questions(windows(group, size, gram), size, prefixes)
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        end = np.append(begin[1:], len(bucket)) if len(begin) else begin
        return pa.table(
            {
                "block": pa.array([group["block"][0].as_py()] * len(begin), pa.int64()),
                "bucket": pa.array(bucket[begin], pa.int64()),
                "chunks": pa.array([packed(chunks[a:b]) for a, b in zip(begin, end)], pa.binary()),
                "ids": pa.array([packed(ids[a:b]) for a, b in zip(begin, end)], pa.binary()),
            }
        )

    def answer(group: pa.Table) -> pa.Table:
        chunks = [unpacked(x, "<u8").reshape(-1, width) for x in group["chunks"].to_pylist()]
        ids = [unpacked(x, "<i8") for x in group["ids"].to_pylist()]
        found = owners(np.concatenate(chunks), np.concatenate(ids))
        ends = np.cumsum([len(x) for x in ids])
        return pa.table(
            {
                "block": group["block"], "bucket": group["bucket"],
                "owners": pa.array([packed(found[b - len(x) : b]) for x, b in zip(ids, ends)], pa.binary()),
            }
        )

    def apply(group: pa.Table, replies: pa.Table) -> pa.Table:
        parts = windows(group, size, gram)
        *_, number = questions(parts, size, prefixes)
        replies = replies.sort_by("bucket")
        found = np.concatenate([np.zeros(0, np.int64), *(unpacked(x, "<i8") for x in replies["owners"].to_pylist())])[number]
        out, at = [], 0
        for part in parts:
            later = found[at : at + len(part.start)] < part.owner_ids()
            at += len(part.start)
            out.append((part, covered(part.words, part.start[later], size)))
        return removed(out, layout=False)

    asked = by_group(table, "block", ask, "block long, bucket long, chunks binary, ids binary")
    answers = by_group(asked, "bucket", answer, "block long, bucket long, owners binary")
    changed = by_groups(table, answers, "block", apply, REMOVED)
    return with_verdicts(docs, search, changed, id_col, text_col)


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of dedup()'s rows."""
    kept = F.when(F.col("kept").isNull(), F.col("all_sha256")).otherwise(F.sha2("kept", 256))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", kept.alias("kept_sha256"))


def query(spark, sf_dir):
    return digest(dedup(table(spark, sf_dir, "documents")))
