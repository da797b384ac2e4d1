"""Quality rules: statistics of whole texts, two fixed rules, and an isolation forest for what rules don't foresee.

The forest is fitted on the statistics of all good labelled documents, so a long path over its random splits means "like
a good document".  The threshold comes from the scores of all labelled documents.  No row is left out of either: every
tree splits the whole set, a level at a time, and asks Spark only for the size and span of each of its nodes.  A tree's
depth is bounded, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import cut, map_batches, ship, table
from codestrata.llm.text import SPACE, mix, slices, window_hashes

TREES = 100
DEPTH = 8  # levels of splits in a tree
BINS = 1 << 16  # of scores from 0 to 1, in which labelled rows are counted
MOST_LOST = 0.005  # share of good labelled documents that the threshold may reject
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_UPPER, _DIGIT, _STOP, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".?!:;\"')"]] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share"]
#: Of each statistic, what counts as a large difference.
SCALES = np.array([4.0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5])
MARGIN = 0.4


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of marks in each text."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[at])


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    seen, n, again = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            n += 1
            again += line in seen
            seen.add(line)
    return n, again


def counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and STATISTICS of each text; all 0 for a text without words."""
    whole, shares = [], []
    for _, w in slices(column):
        n, data, at = w.counts(), w.data, w.at
        word = ~SPACE[data]
        chars = per_text(word & _LEAD[data], at)
        text = w.text_of()
        # words in windows that occur twice in their text
        h, inside = window_hashes(w.h, WINDOW), w.inside(WINDOW)
        place = np.flatnonzero(inside)
        key = mix(h[place] + mix(text[place].astype(np.uint64) + np.uint64(1)))
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        step = np.zeros(len(w.h) + 1, np.int64)
        twice = place[size[group] > 1] if len(place) else place
        step[twice] += 1
        step -= np.bincount(twice + WINDOW, minlength=len(step))[: len(step)]
        covered = np.cumsum(step[:-1]) > 0
        repeat = np.bincount(text[covered], minlength=len(w))
        distinct = np.unique(mix(w.h + mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
        distinct = np.bincount(text[distinct], minlength=len(w))
        lines = np.array([duplicate_lines(data[a:b].tobytes()) for a, b in zip(at, at[1:])], np.int64).reshape(-1, 2)
        symbols = per_text(_SYMBOL[data], at)
        one, ones = np.maximum(n, 1), np.maximum(chars, 1)
        whole.append(np.stack([n, chars, symbols, lines[:, 1], repeat], 1))
        marked = np.bincount(text[_MARK[data[w.end - 1]] & ~_STOP[data[w.end - 1]] & (data[w.end - 1] != 44)], minlength=len(w)) if len(w.h) else n
        shares.append(
            np.stack(
                [
                    np.minimum(chars / one, 50), np.minimum(symbols / one, 2), lines[:, 1] / np.maximum(lines[:, 0], 1),
                    repeat / one, per_text(_UPPER[data], at) / ones, per_text(_DIGIT[data], at) / ones, marked / one,
                    # the share of distinct words falls with length in any text, so it is taken relative to that
                    distinct / one ** 0.85,
                ], 1,
            )
        )
    if not whole:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(STATISTICS)))
    return np.concatenate(whole).astype(np.int64), np.concatenate(shares).astype(float)


def usual_path(n: np.ndarray | int) -> np.ndarray:
    """The mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.maximum(n, 2)
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: split column (-1 at leaves), value, children, and the path length at a leaf."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    usual: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus (mean path length over the usual one): near 1 for anomalies, near 0.5 or less for others."""
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for root in self.roots:
            total += self.depth[self.leaves(root, x)]
        return 2.0 ** (-total / len(self.roots) / self.usual)

    def leaves(self, root: int, x: np.ndarray) -> np.ndarray:
        """The leaf of a tree that each row comes to."""
        node = np.full(len(x), root)
        while True:
            inner = np.flatnonzero(self.column[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = self.child[at, (x[inner, self.column[at]] >= self.value[at]).astype(int)]


def spans(forest: Forest, x: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf with rows: their number, lowest and highest values."""
    found = {}
    for root in forest.roots:
        node = forest.leaves(root, x)
        order = np.argsort(node, kind="stable")
        leaf, first, n = np.unique(node[order], return_index=True, return_counts=True)
        rows = x[order]
        low, high = np.minimum.reduceat(rows, first), np.maximum.reduceat(rows, first)
        found.update((int(k), (int(c), lo, hi)) for k, c, lo, hi in zip(leaf, n, low, high))
    return found


SPAN = "node long, n long, low array<double>, high array<double>"


def spans_of(rows: DataFrame, forest: Forest) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """spans() of all rows' statistics: a partition sends a row for each leaf, however many rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                for node, (n, low, high) in spans(forest, matrix(batch["statistics"])).items():
                    c, lo, hi = total.get(node, (0, low, high))
                    total[node] = (c + n, np.minimum(lo, low), np.maximum(hi, high))
        if total:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = [list(total), *([v[i] if i == 0 else v[i].tolist() for v in total.values()] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "n", "low", "high"])

    ends = [F.array(*(f(F.col(c)[i]) for i in range(len(STATISTICS)))).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    met = map_batches(rows.select("statistics"), run, SPAN).groupBy("node").agg(F.sum("n").alias("n"), *ends)
    return {r["node"]: (r["n"], np.array(r["low"]), np.array(r["high"])) for r in met.collect()}  # TREES * 2**DEPTH rows at most


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """An isolation forest over all rows' statistics; with no rows, one whose trees are single leaves."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.full(trees, -1), np.zeros(trees), np.zeros((trees, 2), int), np.zeros(trees), np.arange(trees), 1.0)
    level_of, leaves, size = np.zeros(trees, int), np.arange(trees), 0
    for level in range(depth + 1):
        found = spans_of(rows, forest)
        size = size or sum(n for n, *_ in found.values()) // trees
        column, value, child, fresh = [], [], [], len(forest.column)
        for node in leaves:
            n, low, high = found.get(int(node), (0, None, None))
            forest.depth[node] = level_of[node] + (float(usual_path(n)) if n > 2 else float(n == 2))
            if level < depth and n > 1:
                c = int(rng.integers(len(low)))
                # the split may fall outside the rows' span, so that what lies beyond it is set apart too, also where
                # the rows have one value only
                forest.column[node], forest.value[node] = c, rng.uniform(low[c] - MARGIN * SCALES[c], high[c] + MARGIN * SCALES[c])
                at = fresh + len(column)
                forest.child[node] = [at, at + 1]
                column += [-1, -1]
                value += [0.0, 0.0]
                child += [[0, 0], [0, 0]]
        if not column:
            break
        leaves = fresh + np.arange(len(column))
        forest.column, forest.value = np.append(forest.column, column), np.append(forest.value, value)
        forest.child = np.concatenate([forest.child, np.array(child, int)])
        level_of = np.append(level_of, np.full(len(column), level + 1))
        forest.depth = np.append(forest.depth, np.full(len(column), level + 1.0))
    forest.usual = float(usual_path(max(size, 2)))
    return forest


def calibrated(forest: Forest, scored: DataFrame, most_lost: float = MOST_LOST) -> Forest:
    """The threshold that separates bad from good rows best while it rejects at most most_lost of the good ones.

    scored has good and anomaly for each labelled row.  All rows are counted, in BINS of their score; a threshold lies
    between the scores of two neighbouring bins with rows.
    """
    at = F.floor(F.col("anomaly") * BINS).alias("bin")
    ends = [f("anomaly").alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    counted = scored.groupBy(at).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), *ends)
    bins = sorted(counted.collect(), key=lambda r: r["bin"])  # BINS + 1 rows at most
    good, bad = (np.array([r[c] for r in bins], np.int64) for c in ("good", "bad"))
    if not good.sum() or not bad.sum():
        forest.threshold = bins[-1]["high"] + 0.05 if bins else 1.0
        return forest
    lost, found = good.sum() - np.cumsum(good), bad.sum() - np.cumsum(bad)
    allowed = good.sum() - 1 - int((good.sum() - 1) * (1 - most_lost))
    gain = np.where(lost <= allowed, found / bad.sum() - lost / good.sum(), -2.0)
    best = int(np.argmax(gain))
    above = bins[best + 1]["low"] if best + 1 < len(bins) else bins[best]["high"] + 0.02
    forest.threshold = float((bins[best]["high"] + above) / 2)
    return forest


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed, statistics).  One row for each input row."""
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, shares = counts(batch["text"])
            failed = (whole[:, 0] < 10) | (100 * whole[:, 4] > 20 * whole[:, 0])
            columns = [pa.array(whole[:, i]) for i in range(len(COUNTS))]
            values = pa.array(list(shares), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["id"], *columns, pa.array(failed), values], ["id", *COUNTS, "base_failed", "statistics"])

    kind = kept.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in COUNTS)
    return map_batches(kept, run, f"id {kind}, {columns}, base_failed boolean, statistics array<double>")


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows with anomaly, the forest's score of their statistics."""

    def score(values: pa.Array) -> pa.Array:
        return pa.array(forest.score(matrix(values)))

    ship(rows.sparkSession)
    return rows.withColumn("anomaly", F.arrow_udf(score, "double")("statistics"))


def train_on(rows: DataFrame, labels: DataFrame) -> Forest:
    """train() on documents whose statistics() are there."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("quality")).dropna()
    known = known.groupBy("id").agg((F.max("quality") == 1).alias("good"))
    learned = cut(rows.filter("not base_failed").select("id", "statistics").join(known, "id").select("good", "statistics"))
    good = learned.filter("good")
    forest = fit(learned if good.isEmpty() else good)
    return calibrated(forest, scored(learned, forest))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """A calibrated forest from all labelled documents (quality 1 is good); without any, one that rejects nothing."""
    return train_on(statistics(docs), labels)


def judged(rows: DataFrame, forest: Forest) -> DataFrame:
    """statistics() with anomaly and kept: false where a base rule fails or the anomaly passes the forest's threshold."""
    return scored(rows, forest).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= forest.threshold))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    return judged(statistics(docs), forest)


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = cut(statistics(docs))  # texts are read once, for training and verdicts
    found = judged(rows, train_on(rows, labels))
    return found.select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept", "anomaly")
