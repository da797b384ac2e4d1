"""Repeated passages: what the substring operators share.

A window is `size` consecutive words of one document.  Both operators look for windows that also start in a document with
a smaller id, and first narrow the corpus down to places where that is possible: a window's anchor is the smallest hash
of the `gram`-word runs in it, so equal windows have equal anchors, and about one place in (size - gram) / 2 is one.
Anchors that occur in one document only can't lie in a repeated window.

Documents whose words are all the same as those of a document with a smaller id are settled at once (all their windows are
repeated) and take no part in the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import cut, map_batches
from codestrata.llm.text import Words, lists, mix, slices, window_hashes

SIZE = 50
GRAM = 10
HOT = 20_000  # places of one anchor in different texts from which on its windows are looked up one by one
BLOCK_BYTES = 6 << 20  # text of one block, which a task holds
BUCKET_BYTES = 8 << 20  # text whose suffixes a task sorts


def anchor_places(h: np.ndarray, inside: np.ndarray, width: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, place) of each window of `width` hashes of one text: place has the smallest, of equal ones the last."""
    n = len(h)
    if n < width:
        return np.zeros(0, int), np.zeros(0, int)
    value, place, span = h, np.arange(n), 1
    while span < width:  # the smallest of twice as many, until it is width
        step = min(span, width - span)
        kept = len(value) - step
        later = value[step:] <= value[:kept]
        value, place = np.where(later, value[step:], value[:kept]), np.where(later, place[step:], place[:kept])
        span += step
    start = np.flatnonzero(inside[width - 1 :] & inside[: len(value)] & (text[width - 1 : n] == text[: len(value)]))
    return start, place[start]


def anchors(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(id, key, whole, n_words, anchor, places): a row for each text and anchor hash; whole is a hash of all its words.

    docs has id, key (a hash that tells an id's texts apart) and text.  Texts with fewer than `size` words have no anchor and one row without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, w in slices(batch["text"]):
                h, text = window_hashes(w.h, gram), w.text_of()
                at = np.unique(anchor_places(h, w.inside(gram), size - gram + 1, text)[1])
                whole = digests(w)
                own = text[at]
                key = mix(h[at] ^ mix(own.astype(np.uint64)))
                order = np.lexsort((at, key))
                at, own, key = at[order], own[order], key[order]
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
                counts = np.diff(np.append(begin, len(key)))
                bare = np.setdiff1d(np.arange(len(w)), own)
                rows = np.concatenate([own[begin], bare])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(pa.array(first + rows)), batch["key"].take(pa.array(first + rows)), pa.array(whole[rows].view(np.int64)), pa.array(w.counts()[rows]),
                        pa.array(
                            np.concatenate([h[at[begin]].view(np.int64), np.zeros(len(bare), np.int64)]),
                            mask=np.arange(len(rows)) >= len(begin),
                        ),
                        lists((at - w.off[own]).astype(np.int32), np.concatenate([counts, np.zeros(len(bare), int)]), pa.int32()),
                    ],
                    ["id", "key", "whole", "n_words", "anchor", "places"],
                )

    return map_batches(docs, run, "id long, key long, whole long, n_words long, anchor long, places array<int>")


def digests(w: Words) -> np.ndarray:
    """A hash of all words of each text."""
    order = w.h * mix(np.arange(len(w.h), dtype=np.uint64) - np.repeat(w.off[:-1], w.counts()).astype(np.uint64) + np.uint64(7))
    total = np.zeros(len(w.h) + 1, np.uint64)
    np.cumsum(mix(order), dtype=np.uint64, out=total[1:])
    return mix((total[w.off[1:]] - total[w.off[:-1]]) ^ mix(w.counts().astype(np.uint64)))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


class Search:
    """The documents and places in which a repeated window may lie.

    whole: (id, key, n_words, owner): for each text of an id, the smallest id with the same words.
    candidates: (id, key, text, places, hot, block): texts with anchors that other texts have too, the places of these
    anchors, and those of them that are at more than `hot` places, copies counting once.  A repeated row may be there more than once.  Rows
    without an id take no part: nothing is smaller or larger than they are.
    """

    def __init__(
        self, docs: DataFrame, id_col: str, text_col: str, size: int, gram: int = GRAM, hot: int = HOT,
        block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
    ) -> None:
        self.size, self.gram = size, gram
        named = identified(docs, id_col, text_col).filter("id is not null")
        found = cut(anchors(named, size, gram))
        texts = found.select("id", "key", "whole", "n_words").distinct()
        owners = texts.groupBy("whole").agg(F.min("id").alias("owner"))
        self.whole = cut(texts.join(owners, "whole").select("id", "key", "n_words", "owner"))
        shared = found.filter("anchor is not null").groupBy("anchor", "whole").agg(F.max(F.size("places")).alias("n")).groupBy("anchor")
        shared = shared.agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.sum("n").alias("n")).filter("a < b")
        places = found.join(shared.select("anchor", (F.col("n") > hot).alias("hot")), "anchor")
        places = places.join(self.whole.filter("id > owner").select("id", "key"), ["id", "key"], "left_anti")
        # a text has at most as many places as words
        place = F.explode("places").alias("place")
        places = places.select("id", "key", "hot", place).groupBy("id", "key").agg(
            F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot")
        )
        joined = cut(named.join(places, ["id", "key"]))
        total = joined.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.blocks = max(1, -(-total // block_bytes))
        self.buckets = max(1, -(-total // bucket_bytes))
        self.candidates = joined.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(self.blocks)))


class Part(NamedTuple):
    """Some texts of a block, and their windows at shared anchors that are hot or not."""

    words: Words
    grams: np.ndarray
    start: np.ndarray  # of each window, and its anchor's place
    place: np.ndarray
    hot: np.ndarray
    ids: np.ndarray  # of each text
    keys: np.ndarray

    def owner_ids(self) -> np.ndarray:
        return self.ids[self.words.text_of()[self.start]]


def windows(table: pa.Table, size: int, gram: int) -> list[Part]:
    """A block's texts, always in the same order, as a shuffle may bring them in another one each time."""
    table = table.sort_by([("id", "ascending"), ("key", "ascending")])
    rows = {c: table[c].combine_chunks() for c in ("id", "key", "text", "places", "hot")}
    ids, keys = rows["id"].to_numpy(zero_copy_only=False), rows["key"].to_numpy(zero_copy_only=False)
    parts = []
    for first, w in slices(rows["text"]):
        h, text = window_hashes(w.h, gram), w.text_of()
        start, place = anchor_places(h, w.inside(gram), size - gram + 1, text)
        marked = {}
        for name in ("places", "hot"):
            column = rows[name].slice(first, len(w))
            marked[name] = np.zeros(len(w.h) + 1, bool)
            marked[name][np.repeat(w.off[:-1], np.diff(column.offsets)) + column.flatten().to_numpy(zero_copy_only=False)] = True
        keep = marked["places"][place]
        start, place = start[keep], place[keep]
        parts.append(Part(w, h, start, place, marked["hot"][place], ids[first : first + len(w)], keys[first : first + len(w)]))
    return parts


def covered(w: Words, start: np.ndarray, size: int) -> np.ndarray:
    """The words in the windows that begin at start."""
    step = np.zeros(len(w.h) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    return np.cumsum(step[:-1]) > 0


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


REMOVED = "id long, key long, n_removed long, spans array<struct<start:int,end:int>>, kept string"


def removed(parts: list[tuple[Part, np.ndarray]], layout: bool) -> pa.Table:
    """REMOVED rows of texts with marked words; with layout, kept words keep the white space that follows them."""
    rows: dict[str, list] = {"id": [], "key": [], "n_removed": [], "spans": [], "kept": []}
    for part, marks in parts:
        w = part.words
        for i in np.unique(w.text_of()[marks]):
            a, b = w.off[i], w.off[i + 1]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], marks[a:b].astype(np.int8), [0]])))
            runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
            rows["id"].append(int(part.ids[i])), rows["key"].append(int(part.keys[i]))
            rows["n_removed"].append(int(marks[a:b].sum()))
            rows["spans"].append([{"start": x, "end": y} for x, y in runs])
            if layout:
                kept, at = b"", w.at[i]
                for x, y in runs:
                    kept += w.data[at : w.start[a + x]].tobytes()
                    at = w.start[a + y] if a + y < b else w.at[i + 1]
                kept += w.data[at : w.at[i + 1]].tobytes()
            else:
                kept = w.joined(i, ~marks[a:b])
            rows["kept"].append(kept.decode("utf-8", "replace"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = {"id": pa.int64(), "key": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept": pa.string()}
    return pa.table({c: pa.array(rows[c], kinds[c]) for c in rows})


def all_changes(search: Search, changed: DataFrame) -> DataFrame:
    """REMOVED rows of each text once, with those of copies, which lose everything if they have a window at all."""
    copies = search.whole.filter(f"id > owner and n_words >= {search.size}").select(
        "id", "key", F.col("n_words").alias("n_removed"),
        F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"),
        F.lit("").alias("kept"),
    )
    return changed.dropDuplicates(["id", "key"]).unionByName(copies)


def with_verdicts(docs: DataFrame, search: Search, changed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_removed, spans, kept, all_sha256): a row for each row of docs.

    kept is the words that stay, joined by one space, or null where all stay; all_sha256 is the digest of all words,
    joined by one space.  A null text has no words; a null id loses nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = [], []
            for x in batch["text"].cast(pa.large_binary()):  # one text at a time
                words = (x.as_py() or b"").split()
                sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], pa.array(n, pa.int64()), pa.array(sums, pa.string())], names)

    names = ["id", "key", "n_words", "all_sha256"]
    base = map_batches(identified(docs, id_col, text_col), run, "id long, key long, n_words long, all_sha256 string")
    return base.join(all_changes(search, changed), ["id", "key"], "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "spans", "kept", "all_sha256"
    )
