"""Suffix-array dedup with sparse suffix arrays.

Only suffixes at content-selected places are kept: the minimisers of `gram`-word runs, and of these only those whose run
another text has as well.  Each keeps the words after it and, for extension to the left, the words before it, as far as a
window can reach.  A bucket of suffixes is sorted into a suffix array; neighbours are compared for the length of their
common beginning; and for each way to lay a window over the minimiser, suffixes with enough in common to the right are one
run of the array, in which those with the same words to the left have the same window.  The smallest document id in such a
group owns it, and other documents lose the words it covers.

A block of texts sends suffixes that are equal to both sides once, with their smallest id; it knows by itself that its
larger ids repeat them.  A minimiser at more than passages.HOT places could still fill a bucket by itself.  Its windows are
looked up one by one instead, by two hashes of all their words; a block asks for each different one once.  The results are
the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.passages import (
    HOT, REMOVED, SIZE, Part, Search, all_changes, covered, packed, removed, unpacked, windows, with_verdicts,
)
from codestrata.llm.tables import by_group, by_groups, lean_group, table
from codestrata.llm.text import BASE, mix, window_hashes

STEP = 1 << 14  # places whose contexts are built at once
SMALL = 3 << 20  # bytes of text in blocks and buckets where other stages' memory is held as well


def context(part: Part, size: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each minimiser of ordinary windows, STEP at a time: place, run's hash, words after it, words before it, ways to lay a window.

    Words are 32-bit hashes, 0 beyond the text; way j has j words before the minimiser.
    """
    w, reach = part.words, size - gram
    ordinary = ~part.hot
    every, number = np.unique(part.place[ordinary], return_inverse=True)
    ways = np.zeros((len(every), reach + 1), bool)
    ways[number, every[number] - part.start[ordinary]] = True
    short = (w.h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    text = w.text_of()
    for first in range(0, len(every), STEP):
        place = every[first : first + STEP]
        low, high = w.off[text[place]][:, None], w.off[text[place] + 1][:, None]
        right = place[:, None] + gram + np.arange(reach)
        left = place[:, None] - 1 - np.arange(reach)
        after = np.where(right < high, short[np.minimum(right, len(short) - 1)], 0).astype(np.uint32)
        before = np.where(left >= low, short[np.maximum(left, 0)], 0).astype(np.uint32)
        yield place, part.grams[place], after, before, ways[first : first + STEP]


def different(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of bytes, sorted, and the number of each row's."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return rows[order[new]], number


def questions(parts: list[Part], size: int, gram: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """A block's different suffixes (run, after, before, ways, smallest id) in a fixed order, and the minimisers they come from.

    The latter are, for each part, their places and ids, and for all of them the number of their suffix.
    """
    reach = size - gram
    wide = np.cumsum([0, 8, 4 * reach, 4 * reach, reach + 1])
    rows, numbers, places, ids = [np.zeros((0, wide[-1]), np.uint8)], [np.zeros(0, np.int64)], [], []
    total = 0
    for part in parts:
        place = [np.zeros(0, np.int64)]
        for at, run, after, before, ways in context(part, size, gram):
            own = [run.astype("<u8")[:, None], after.astype("<u4"), before.astype("<u4"), ways]
            some, number = different(np.concatenate([np.ascontiguousarray(x).view(np.uint8) for x in own], 1))
            rows.append(some), numbers.append(number + total), place.append(at)
            total += len(some)
        places.append(np.concatenate(place))
        ids.append(part.ids[part.words.text_of()[places[-1]]])
    some, number = different(np.concatenate(rows))
    number = number[np.concatenate(numbers)]
    least = np.full(len(some), np.iinfo(np.int64).max)
    np.minimum.at(least, number, np.concatenate([np.zeros(0, np.int64), *ids]))
    cell = [np.ascontiguousarray(some[:, a:b]) for a, b in zip(wide, wide[1:])]
    columns = [cell[0].view("<u8").ravel(), cell[1].view("<u4"), cell[2].view("<u4"), cell[3].view(bool), least]
    return columns, places, ids, number


def repeated(run: np.ndarray, after: np.ndarray, before: np.ndarray, ways: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each suffix and way: whether its window is also at a suffix of a smaller id."""
    n, reach = after.shape
    out = np.zeros((n, reach + 1), bool)
    if not n:
        return out
    rows = np.concatenate([run.astype(">u8").view(np.uint8).reshape(n, 8), after.astype(">u4").view(np.uint8).reshape(n, 4 * reach)], 1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    run, after, before, ways, ids = run[order], after[order], before[order], ways[order], ids[order]
    same = run[1:] == run[:-1]
    common = np.where(same, np.cumprod(after[1:] == after[:-1], axis=1, dtype=np.int32).sum(1), -1)
    left = np.zeros(n, np.uint64)  # hash of the words before, as far as the present way reaches
    for way in range(reach + 1):
        # suffixes that agree in reach - way words after the run lie together
        together = np.append(0, np.cumsum(common < reach - way)).astype(np.uint64)
        some = np.flatnonzero(ways[:, way])
        if len(some):
            group, number = np.unique(mix(mix(together[some] + np.uint64(1)) ^ left[some]), return_inverse=True)
            least = np.full(len(group), np.iinfo(np.int64).max)
            np.minimum.at(least, number, ids[some])
            out[order[some], way] = least[number] < ids[some]
        if way < reach:
            left = mix(left * BASE + before[:, way].astype(np.uint64))
    return out


def hot_windows(parts: list[Part], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes, smallest id) of each different window at a hot minimiser, sorted, and the number of each such window."""
    keys, ids = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
    for part in parts:
        at = part.start[part.hot]
        keys.append(np.stack([window_hashes(part.words.h, size)[at], mix(window_hashes(part.words.h[::-1], size)[::-1][at])], 1) if len(at) else keys[0])
        ids.append(part.owner_ids()[part.hot])
    key, own = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((own, key[:, 1], key[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return key[order[new]], own[order[new]], number


ASKED = "block long, bucket long, run binary, after binary, before binary, ways binary, ids binary, hot binary, hot_ids binary"


def changes(search: Search, layout: bool) -> DataFrame:
    """REMOVED rows of the texts that lose words."""
    size, gram, buckets = search.size, search.gram, search.buckets
    reach = size - gram

    def of(h: np.ndarray) -> np.ndarray:
        return (mix(h + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)

    def ask(group: pa.Table) -> pa.Table:
        parts = windows(group, size, gram)
        columns, *_ = questions(parts, size, gram)
        bucket = of(columns[0])
        order = np.argsort(bucket, kind="stable")
        hot, hot_ids, _ = hot_windows(parts, size)
        hot_bucket = of(hot[:, 0])
        rows = []
        for b in np.union1d(bucket, hot_bucket):
            own = order[np.searchsorted(bucket[order], b) : np.searchsorted(bucket[order], b, "right")]
            hots = np.flatnonzero(hot_bucket == b)
            rows.append([int(group["block"][0].as_py()), int(b), *(packed(c[own]) for c in columns), packed(hot[hots]), packed(hot_ids[hots])])
        names = [x.split(" ")[0] for x in ASKED.split(", ")]
        kinds = [pa.int64()] * 2 + [pa.binary()] * 7
        return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})

    def answer(group: pa.Table) -> pa.Table:
        def every(name: str, kind: str, width: int = 0) -> list[np.ndarray]:
            out = [unpacked(x, kind) for x in group[name].to_pylist()]
            return [x.reshape(-1, width) for x in out] if width else out

        ids, hot_ids = every("ids", "<i8"), every("hot_ids", "<i8")
        found = repeated(
            np.concatenate(every("run", "<u8")), np.concatenate(every("after", "<u4", reach)),
            np.concatenate(every("before", "<u4", reach)), np.concatenate(every("ways", "?", reach + 1)), np.concatenate(ids),
        )
        key, own = np.concatenate(every("hot", "<u8", 2)), np.concatenate(hot_ids)
        order = np.lexsort((own, key[:, 1], key[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]).any(1)
        least = np.empty(len(order), np.int64)
        if len(order):
            least[order] = own[order[new]][np.cumsum(new) - 1]
        ends, hot_ends = np.cumsum([len(x) for x in ids]), np.cumsum([len(x) for x in hot_ids])
        return pa.table(
            {
                "block": group["block"], "bucket": group["bucket"],
                "repeated": pa.array([packed(found[b - len(x) : b]) for x, b in zip(ids, ends)], pa.binary()),
                "owners": pa.array([packed(least[b - len(x) : b]) for x, b in zip(hot_ids, hot_ends)], pa.binary()),
            }
        )

    def apply(group: pa.Table, replies: pa.Table) -> pa.Table:
        parts = windows(group, size, gram)
        columns, places, ids, suffix_of = questions(parts, size, gram)
        order = np.argsort(of(columns[0]), kind="stable")
        hot, _, number = hot_windows(parts, size)
        hot_order = np.argsort(of(hot[:, 0]), kind="stable")
        replies = replies.sort_by("bucket")
        found = np.zeros((len(order), reach + 1), bool)
        owner = np.zeros(len(hot), np.int64)
        if replies.num_rows:
            found[order] = np.concatenate([unpacked(x, "?").reshape(-1, reach + 1) for x in replies["repeated"].to_pylist()])
            owner[hot_order] = np.concatenate([unpacked(x, "<i8") for x in replies["owners"].to_pylist()])
        owner = owner[number]
        out, at, hot_at = [], 0, 0
        for part, place, own in zip(parts, places, ids):
            mine = suffix_of[at : at + len(place)]
            # a smaller id of another block, or of this one
            suffix, way = np.nonzero(found[mine] | (columns[3][mine] & (columns[4][mine] < own)[:, None]))
            at += len(place)
            start = part.start[part.hot]
            later = owner[hot_at : hot_at + len(start)] < part.owner_ids()[part.hot]
            hot_at += len(start)
            out.append((part, covered(part.words, np.concatenate([place[suffix] - way, start[later]]), size)))
        return removed(out, layout)

    asked = by_group(search.candidates, "block", lean_group(ask), ASKED)
    answers = by_group(asked, "bucket", lean_group(answer), "block long, bucket long, repeated binary, owners binary")
    return by_groups(search.candidates, answers, "block", apply, REMOVED)


def dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, spans, kept, all_sha256): passages of at least `size` words that repeat stay once.

    A word goes if a passage of `size` words around it, of one document, also occurs in a document with a smaller id; all
    is judged on the input.  Columns and cases (nulls, repeated rows and ids, short texts) are those of substrings.dedup.
    """
    search = Search(docs, id_col, text_col, size, hot=hot)
    return with_verdicts(docs, search, changes(search, layout=False), id_col, text_col)


def without_repeats(docs: DataFrame, size: int = SIZE, part_bytes: int = SMALL) -> DataFrame:
    """The documents with their columns, repeated passages cut from the text and n_chars brought up to date.

    What stays keeps its white space.  A document all of whose words go is dropped; others stay, null texts and ids too.
    """
    search = Search(docs, "doc_id", "text", size, block_bytes=part_bytes, bucket_bytes=part_bytes)
    found = all_changes(search, changes(search, layout=True)).select(
        F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("kept").alias("_kept"), F.lit(True).alias("_changed")
    )
    rows = docs.join(found, (docs["doc_id"] == found["_id"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left")
    rows = rows.filter(found["_kept"].isNull() | found["_kept"].rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(found["_changed"], found["_kept"]).otherwise(docs["text"])
    columns = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        size_of = F.when(found["_changed"], F.length(found["_kept"])).otherwise(docs["n_chars"])
        columns["n_chars"] = size_of.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*(columns.get(c, docs[c]) for c in docs.columns))


def query(spark, sf_dir):
    from codestrata.llm.substrings import digest

    return digest(dedup(table(spark, sf_dir, "documents")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup of the pipeline: repeated passages stay in the document with the smallest id."""
    return without_repeats(docs)
