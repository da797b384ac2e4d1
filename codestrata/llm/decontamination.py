"""Benchmark decontamination: rare n-gram seeds find passages that resemble a test item, Smith-Waterman scores them.

A first pass counts the items' words in all texts.  An n-gram's chance is the product of its words' shares of the corpus:
how often unrelated texts hit it.  (Counts of the n-grams themselves would not do: a large group of copies makes the very
n-grams common by which it is found.)  Seeds are the n-grams that are rare by chance, so rare that all seeds together are
hit by less than CHANCE_HITS of the words, and the rarest of every STRETCH neighbours, so that seeds cover the whole item.
Wording that many items share, such as a common preamble, is no seed of an item that has wording of its own.

A second pass looks every n-gram of every text up among the seeds, groups hits of one item that lie close together into
passages, leaves out passages with too few words of the item to reach the score, and aligns the others with their item.
Only items are sent to the tasks, in blocks of at most BLOCK_WORDS words; more items mean more blocks and passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codestrata.llm.align import MATCH, Alignment, throughout
from codestrata.llm.tables import map_batches, table, where
from codestrata.llm.text import Words, slices, window_hashes

N = 3
LEAST_SCORE = 0.5
STRETCH = 4  # neighbouring n-grams of an item of which the rarest is a seed in any case
SHARED = 8  # wording in so many times more items than an item's own is common to items
CHANCE_HITS = 0.01  # a word
BLOCK_WORDS = 2_000_000  # of test items in one block: some 50 MB with their index
MOST_SLOTS = 1 << 24


class Lookup:
    """Places of hashes in a sorted list without repeats."""

    def __init__(self, known: np.ndarray) -> None:
        slots = 1 << 10
        while slots < min(16 * len(known), MOST_SLOTS):
            slots *= 2
        self.known, self.mask = known, np.uint64(slots - 1)
        self.some = np.zeros(slots, bool)
        self.some[known & self.mask] = True

    def __call__(self, h: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(which of h are known and inside, their places in the list)"""
        maybe = self.some[h & self.mask]
        found = np.flatnonzero(maybe if inside is None else maybe & inside)
        at = np.searchsorted(self.known, h[found])
        same = at < len(self.known)
        same[same] = self.known[at[same]] == h[found[same]]
        return found[same], at[same]


class Items:
    """A block of test items: word hashes, and their seeds in the order of the hash (all n-grams until some are chosen)."""

    def __init__(self, rows: list[tuple[object, str]]) -> None:
        self.ids = [i for i, _ in rows]
        self.words = []
        for _, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            self.words.append(Words(data, np.array([0, len(data)]), terms=True).h)
        self.sizes = np.array([len(x) for x in self.words])
        self.vocabulary = np.unique(np.concatenate(self.words)) if rows else np.zeros(0, np.uint64)
        grams = [window_hashes(w, N) for w in self.words]
        sizes = [len(g) for g in grams]
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(rows)), sizes)
        self.place = np.concatenate([np.arange(k) for k in sizes]) if sizes else np.zeros(0, int)
        self.keep(np.ones(len(self.gram), bool))

    def keep(self, some: np.ndarray) -> None:
        gram, item, place = self.gram[some], self.item[some], self.place[some]
        order = np.lexsort((place, item, gram))
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        distinct, self.first = np.unique(self.gram, return_index=True)
        self.many = np.diff(np.append(self.first, len(self.gram)))
        self.lookup = Lookup(distinct)

    def choose(self, counts: np.ndarray, total: int) -> None:
        """Keeps the seeds, given each vocabulary word's count and the count of all words."""
        self.keep(self.seeds(counts, total))

    def seeds(self, counts: np.ndarray, total: int) -> np.ndarray:
        share = counts / max(total, 1)
        own = [share[np.searchsorted(self.vocabulary, w)] for w in self.words]
        chance = np.array([own[i][p : p + N].prod() for i, p in zip(self.item, self.place)])
        _, number = np.unique(self.gram, return_inverse=True)
        pairs = np.unique(np.stack([number, self.item]), axis=1)[0] if len(number) else number
        items = np.bincount(pairs)[number] if len(number) else number
        order = np.lexsort((items, self.item))
        begin = np.searchsorted(self.item[order], np.arange(len(self.ids)))
        size = np.bincount(self.item, minlength=len(self.ids))
        quarter = items[order][np.minimum(begin + size // 4, max(len(order) - 1, 0))] if len(order) else size
        free = items <= SHARED * quarter[self.item]
        hits = np.where(free, chance * items, np.inf)
        # the least of each stretch, of all that are equal
        stretch = self.item.astype(np.int64) * (int(self.sizes.max(initial=0)) + 1) + self.place // STRETCH
        _, group = np.unique(stretch, return_inverse=True)
        least = np.full(len(stretch), np.inf)
        np.minimum.at(least, group, hits)
        return free & ((hits <= CHANCE_HITS / max(len(hits), 1)) | (hits == least[group]))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places in w, numbers of seeds) for all n-grams of w's texts that are seeds."""
        found, at = self.lookup(window_hashes(w.h, N), w.inside(N))
        low, count = self.first[at], self.many[at]
        first = np.repeat(np.cumsum(count) - count, count)
        return np.repeat(found, count), np.repeat(low, count) + np.arange(len(first)) - first


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Test items with at least N words, in blocks."""
    rows: list[tuple[int, str]] = []
    words = 0
    for r in items.select(id_col, text_col).dropna().distinct().orderBy(id_col, text_col).toLocalIterator():
        rows.append((r[0], r[1]))
        words += len(r[1].split())
        if words >= BLOCK_WORDS:
            yield Items(rows)
            rows, words = [], 0
    if rows:
        yield Items(rows)


def seeded(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str) -> Iterator[Items]:
    """Blocks of items whose seeds are chosen by the words of all texts; a block's counts, one a word, come to the driver."""
    for block in blocks(items, item_id, item_text):
        known = Lookup(block.vocabulary)

        def run(batches: Iterator[pa.RecordBatch], known: Lookup = known) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(known.known) + 1, np.int64)  # the last is that of all words
            for batch in batches:
                for _, w in slices(batch["text"], terms=True):
                    counts += np.append(np.bincount(known(w.h)[1], minlength=len(known.known)), len(w.h))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["word", "n"])

        rows = map_batches(docs.select(docs[text_col].alias("text")), run, "word long, n long")
        found = rows.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(known.known) + 1, np.int64)
        counts[found["word"].to_numpy()] = found["n"].to_numpy()
        block.choose(counts[:-1], int(counts[-1]))
        yield block


def contaminated(
    docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item_id, score, matches, item_words, start, end): passages whose alignment has at least least_score.

    score is the alignment's share of the score of a verbatim copy; start and end count words (runs of letters and
    digits) of the document.  A document has a row for each item and passage.  Null texts have no words; items with
    fewer than N words and null items match nothing; repeated documents have their rows each.  Of equal alignments the
    first is taken.  A text of any length is searched whole; its task holds some 40 bytes for each byte of it.
    """
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    item_kind, item_arrow = items.schema[item_id].dataType.simpleString(), to_arrow_type(items.schema[item_id].dataType)
    schema = f"id {kind}, item_id {item_kind}, score double, matches int, item_words int, start int, end int"
    found = None
    for block in seeded(docs, items, text_col, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [x for first, w in slices(batch["text"], terms=True) for x in passages(first, w, block, least_score)]
                at = pa.array([x[0] for x in rows], pa.int64())
                columns = [batch["id"].take(at), pa.array([x[1] for x in rows], item_arrow)]
                columns += [pa.array([x[2] for x in rows], pa.float64())]
                columns += [pa.array([x[k] for x in rows], pa.int32()) for k in range(3, 7)]
                yield pa.RecordBatch.from_arrays(columns, schema_names)

        part = map_batches(kept, run, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found


schema_names = ["id", "item_id", "score", "matches", "item_words", "start", "end"]


def passages(first: int, w: Words, block: Items, least_score: float) -> Iterator[tuple]:
    """Aligned passages of the texts of w, which begin at number first of their batch."""
    place, gram = block.hits(w)
    if not len(place):
        return
    text, item = w.text_of()[place], block.item[gram]
    sizes = block.sizes
    at = place - block.place[gram]  # where the item would begin
    group = text.astype(np.int64) * len(block.ids) + item
    order = np.lexsort((at, group))
    at, group, text, item = at[order], group[order], text[order], item[order]
    # stretches in which the item may lie: where it would begin, with room for words left out or put in; those of one
    # item that overlap are one stretch
    room = sizes[item] // 2 + 2
    low = np.maximum(w.off[text], at - room)
    high = np.minimum(w.off[text + 1], at + sizes[item] + room)
    reach = np.maximum.accumulate(high + (group - group[0]) * (len(w.h) + 1))  # a later group lies beyond all earlier ones
    new = np.ones(len(low), bool)
    new[1:] = (group[1:] != group[:-1]) | (low[1:] + (group[1:] - group[0]) * (len(w.h) + 1) > reach[:-1])
    begins = np.flatnonzero(new)
    for a, b in zip(begins, [*begins[1:], len(low)]):
        i, t, size = int(item[a]), int(text[a]), int(sizes[item[a]])
        start, end = int(low[a]), int(high[a:b].max())
        # no alignment has more matches than the stretch has words of the item
        if MATCH * np.isin(w.h[start:end], block.words[i]).sum() < least_score * MATCH * sizes[i]:
            continue
        whole = MATCH * size

        def good(x: Alignment, whole: int = whole) -> bool:
            return x.score >= least_score * whole

        for x in throughout(block.words[i], w.h[start:end], good, least_score * size):
            at = start - int(w.off[t])
            yield first + t, block.ids[i], x.score / whole, x.matches, size, at + x.b_start, at + x.b_end


def verdicts(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(id, item_id, score, ...): the best passage of each document and item."""
    rows = contaminated(docs, items, **options)
    best = F.struct("score", "matches", (-F.col("start")).alias("first"), "item_words", "start", "end")
    rows = rows.groupBy("id", "item_id").agg(F.max(best).alias("best"), F.count("*").alias("passages"))
    return rows.select("id", "item_id", "best.score", "best.matches", "best.item_words", "best.start", "best.end", "passages")


def query(spark, sf_dir):
    rows = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumnRenamed("id", "doc_id")


def without(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that have no passage of an item; seeds are chosen by the words of all of them."""
    for block in list(seeded(docs, items, text_col, "item_id", "text")):

        def clean(text: pa.Array, block: Items = block) -> pa.Array:
            keep = np.ones(len(text), bool)
            for first, w in slices(text, terms=True):
                for x in passages(first, w, block, least_score):
                    keep[x[0]] = False
            return pa.array(keep)

        docs = where(docs, text_col, clean)
    return docs


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of the pipeline: documents with a passage of a test item go."""
    return without(docs, table(spark, sf_dir, "benchmark"))
