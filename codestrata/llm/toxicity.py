"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Labelled training rows (at most FIT_ROWS, those with the smallest hash of their id) tell which terms occur mostly in
   toxic documents.  All of them become lexicon voters, with the fixed insults; families of terms with a common beginning
   and the number of different hits become pattern voters.
2. Every document's votes are the numbers of its voters.  A two-class model of independent voters is fitted by expectation
   maximisation to the votes of all documents, counted by Spark; labelled rows keep their labels with a weight that says
   how far they are trusted.  From the joint counts under the model, voters that agree beyond what their accuracies explain
   get less weight each (a correlated group counts like fewer voters).
3. A logistic classifier on votes and hit rates is fitted to the posterior labels of the labelled training rows, its
   threshold to their labels, and it scores every document.

Scores depend on the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import cut, map_batches, remainder, table, where
from codestrata.llm.text import lowered, mix, slices

FIT_ROWS = 20_000  # labelled rows for lexicon, trust and calibration, at most
LEAST_DOCS = 3  # toxic documents that a lexicon term must occur in
LEAST_PRECISION = 0.6
FAMILIES = (5, 6, 7, 8)  # bytes of beginnings that may vote
ROUNDS = 6
CORRELATED = 0.6  # voters that agree more than this in toxic documents share their weight
PAIRS = 1 << 21  # pairs of votes that are held at once
THRESHOLD = 0.7
COST = 4.0  # toxic documents that one clean document called toxic weighs against

#: Fixed: insults that vote whether or not labelled rows contain them.
INSULTS = ["bastard", "disgusting", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]


@dataclass
class Voters:
    """Terms (size 0) and beginnings of terms (size in bytes) that vote, by their hash."""

    terms: list[str]
    hashes: np.ndarray
    sizes: np.ndarray

    def __len__(self) -> int:
        return len(self.terms)

    def votes(self, column: pa.Array) -> tuple[Votes, np.ndarray, np.ndarray]:
        """Per text: the voters with a hit, the number of hits, and the number of terms."""
        found, hits, counts = [no_votes(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, w in slices(column, terms=True):
            pairs, n, text = [np.zeros(0, np.int64)], np.zeros(len(w), np.int64), w.text_of()
            for size in np.unique(self.sizes):
                own = np.flatnonzero(self.sizes == size)
                own = own[np.argsort(self.hashes[own])]
                known = self.hashes[own]
                words, h = w.beginnings(int(size)) if size else (np.arange(len(w.h)), w.h)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                some = np.flatnonzero(known[at] == h)
                where = text[words[some]]
                pairs.append(where * len(self) + own[at[some]])
                n += np.bincount(where, minlength=len(w))
            pair = np.unique(np.concatenate(pairs))
            off = np.searchsorted(pair, np.arange(len(w) + 1) * len(self))
            found.append(Votes((pair % max(1, len(self))).astype(np.int32), off)), hits.append(n), counts.append(w.counts())
        return joined(found), np.concatenate(hits), np.concatenate(counts)


class Votes(NamedTuple):
    """The voters of some documents, one document after the other: document i has voter[off[i]:off[i + 1]]."""

    voter: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Each document's sum of its voters' weights."""
        total = np.append(0.0, np.cumsum(weight[self.voter]))
        return total[self.off[1:]] - total[self.off[:-1]]

    def totals(self, weight: np.ndarray, k: int) -> np.ndarray:
        """Each of k voters' sum of its documents' weights."""
        return np.bincount(self.voter, weight[self.documents()], k)

    def packed(self) -> pa.Array:
        """A row of bytes for each document."""
        return pa.Array.from_buffers(
            pa.binary(), len(self), [None, pa.py_buffer((4 * self.off).astype(np.int32)), pa.py_buffer(self.voter.astype("<i4"))]
        )

    def with_patterns(self, k: int) -> Votes:
        """With the pattern voters: k for at least two, and k + 1 for at least three different hits."""
        n = self.counts()
        two, three = np.flatnonzero(n >= 2), np.flatnonzero(n >= 3)
        text = np.concatenate([self.documents(), two, three])
        voter = np.concatenate([self.voter, np.full(len(two), k), np.full(len(three), k + 1)])
        order = np.argsort(text, kind="stable")
        return Votes(voter[order], np.append(0, np.cumsum(n + (n >= 2) + (n >= 3))))


def no_votes(n: int) -> Votes:
    return Votes(np.zeros(0, np.int32), np.zeros(n + 1, np.int64))


def joined(parts: list[Votes]) -> Votes:
    off = np.append(0, np.cumsum(np.concatenate([x.counts() for x in parts])))
    return Votes(np.concatenate([x.voter for x in parts]), off)


def unpacked(rows: pa.Array) -> Votes:
    rows = [x or b"" for x in rows.to_pylist()]
    return Votes(np.frombuffer(b"".join(rows), "<i4"), np.append(0, np.cumsum([len(x) // 4 for x in rows])).astype(np.int64))


def hashes_of(terms: list[str]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(w.h[w.off[:-1]] for _, w in slices(pa.array(terms, pa.string()), terms=True))])


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(id, toxic, text) of labelled rows outside the held-out fold; at most fit_rows ids, which may be broadcast."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(remainder("id", 3) != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id")


def candidates(rows: DataFrame) -> DataFrame:
    """(h, size, term, bad, good): toxic and clean labelled documents with each term and beginning of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array([x or 0 for x in batch["toxic"].to_pylist()], bool)
            for first, w in slices(batch["text"], terms=True):
                text = w.text_of()
                for size in (0, *FAMILIES):
                    words, h = w.beginnings(size) if size else (np.arange(len(w.h)), w.h)
                    pair = np.unique(mix(h ^ mix(text[words].astype(np.uint64))), return_index=True)[1]
                    h, words = h[pair], words[pair]
                    bad = toxic[first + text[words]]
                    some, at, group = np.unique(h, return_index=True, return_inverse=True)
                    start, end = w.start[words[at]], w.end[words[at]]
                    letters = lowered(w.data)
                    terms = [letters[a : a + size if size else b].tobytes().decode("utf-8", "replace") for a, b in zip(start, end)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some.view(np.int64)), pa.array(np.full(len(some), size, np.int32)), pa.array(terms, pa.string()),
                            pa.array(np.bincount(group, bad, len(some)).astype(np.int64)),
                            pa.array(np.bincount(group, ~bad, len(some)).astype(np.int64)),
                        ],
                        ["h", "size", "term", "bad", "good"],
                    )

    counted = map_batches(rows.select("toxic", "text"), run, "h long, size int, term string, bad long, good long")
    return counted.groupBy("h", "size").agg(F.min("term").alias("term"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def voters(rows: DataFrame) -> Voters:
    """All terms and beginnings that labelled rows prove, the strongest first, and the fixed insults."""
    found = candidates(rows).filter(
        (F.col("bad") >= LEAST_DOCS) & (F.col("bad") >= LEAST_PRECISION * (F.col("bad") + F.col("good")))
    )
    strength = F.col("bad") * F.col("bad") / (F.col("bad") + 3 * F.col("good") + 2)
    terms, hashes, sizes, families = [], [], [], set()
    for r in found.orderBy(strength.desc(), "size", "term", "h").toLocalIterator():
        # a stronger beginning matches all that a longer beginning or term matches
        letters = r["term"].encode()
        if "\ufffd" in r["term"] or not any(letters[:n] in families for n in FAMILIES if n < len(letters)):
            terms.append(r["term"]), hashes.append(r["h"]), sizes.append(r["size"])
            if r["size"] and "\ufffd" not in r["term"]:
                families.add(letters)
    exact = {t for t, size in zip(terms, sizes) if not size}
    more = [x for x in INSULTS if x not in exact]
    return Voters(
        terms + more,
        np.concatenate([np.array(hashes, np.int64).view(np.uint64), hashes_of(more)]),
        np.array(sizes + [0] * len(more), np.int64),
    )


def masks(docs: DataFrame, own: Voters) -> DataFrame:
    """(id, votes, hits, size) of every document."""
    kept = docs.select(F.col("doc_id").alias("id"), "text")
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, hits, size = own.votes(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["id"], votes.packed(), pa.array(hits), pa.array(size)], ["id", "votes", "hits", "size"])

    return map_batches(kept, run, f"id {kind}, votes binary, hits long, size long")


@dataclass
class LabelModel:
    """Chances of a vote in clean and toxic documents, the share of toxic ones, and each voter's weight."""

    clean: np.ndarray
    toxic: np.ndarray
    share: float
    weight: np.ndarray

    def posterior(self, votes: Votes) -> np.ndarray:
        for_vote = np.log(self.toxic / self.clean) * self.weight
        for_none = np.log((1 - self.toxic) / (1 - self.clean)) * self.weight
        odds = np.log(self.share / (1 - self.share)) + for_none.sum() + votes.sums(for_vote - for_none)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def label_model(counted: DataFrame, k: int, known: tuple[Votes, np.ndarray], rounds: int = ROUNDS) -> LabelModel:
    """Fits the model to (votes, n) of all documents and to the labelled votes.

    Each round is one Spark job that adds up, over all votes, the expected votes in either class; the driver sees only
    these sums.  The labelled rows enter as prior counts.
    """
    votes, toxic = known
    width = k + 2
    prior = np.stack([0.5 + votes.totals((toxic == c).astype(float), width) for c in (0, 1)])
    prior_n = np.array([1.0 + (toxic == 0).sum(), 1.0 + (toxic == 1).sum()])
    chance = np.clip(prior / prior_n[:, None], 1e-5, 0.999)
    model = LabelModel(chance[0], chance[1], float(np.clip(prior_n[1] / prior_n.sum(), 1e-4, 0.5)), np.ones(width))
    for _ in range(rounds):
        before = model

        def expected(batches: Iterator[pa.RecordBatch], model: LabelModel = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width + 1))
            for batch in batches:
                v, n = unpacked(batch["votes"]).with_patterns(k), batch["n"].to_numpy(zero_copy_only=False).astype(float)
                p = model.posterior(v)
                total += np.stack([np.append(v.totals(x, width), x.sum()) for x in (n * (1 - p), n * p)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

        sums = map_batches(counted.select("votes", "n"), expected, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
        found = np.zeros(2 * (width + 1))
        for r in sums.collect():  # as many rows as the model has numbers
            found[r["i"]] = r["x"]
        total = found.reshape(2, width + 1)
        n = total[:, -1]
        # labelled rows weigh as much as all others together, so that the classes keep their meaning
        trust = max(1.0, n.sum() / max(prior_n.sum(), 1))
        chance = (total[:, :-1] + trust * prior) / (n + trust * prior_n)[:, None]
        share = (n[1] + trust * prior_n[1]) / (n.sum() + trust * prior_n.sum())
        chance = np.clip(chance, 1e-6, 0.999)
        model = LabelModel(chance[0], chance[1], float(np.clip(share, 1e-4, 0.5)), model.weight)
    p = np.clip(model.toxic, 1e-6, 0.999)
    model.weight = 1 / (1 + correlations(counted, k, before, p, max(1.0, float(np.median(total[1, :-1] / p)))))
    return model


def correlations(counted: DataFrame, k: int, model: LabelModel, p: np.ndarray, toxic_n: float) -> np.ndarray:
    """Each voter's sum of correlations above CORRELATED, in toxic documents and beyond independence, with other voters.

    Pairs of voters are added up by Spark; the driver sees one number a voter.
    """
    width = k + 2

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = unpacked(batch["votes"]).with_patterns(k), batch["n"].to_numpy(zero_copy_only=False).astype(float)
            own = n * model.posterior(v)
            # each vote meets all votes of its document, in runs of votes with about PAIRS pairs
            text = v.documents()
            ends = np.cumsum(v.counts()[text])
            first = 0
            while first < len(text):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                t = text[first:last]
                size = v.counts()[t]
                other = np.arange(size.sum()) + np.repeat(v.off[t] - np.append(0, np.cumsum(size)[:-1]), size)
                a, b = np.repeat(v.voter[first:last].astype(np.int64), size), v.voter[other]
                half = a < b
                pair, number = np.unique(a[half] * width + b[half], return_inverse=True)
                x = np.bincount(number, np.repeat(own[t], size)[half], len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(x)], ["pair", "x"])
                first = last

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, x = batch["pair"].to_numpy(zero_copy_only=False), batch["x"].to_numpy(zero_copy_only=False)
            a, b = pair // width, pair % width
            spread = np.sqrt(p[a] * (1 - p[a]) * p[b] * (1 - p[b]))
            value = np.clip((x / toxic_n - p[a] * p[b]) / np.maximum(spread, 1e-9), 0, 1)
            some = value > CORRELATED
            voter = np.concatenate([a[some], b[some]])
            yield pa.RecordBatch.from_arrays([pa.array(voter), pa.array(np.tile(value[some], 2))], ["i", "x"])

    joint = map_batches(counted.select("votes", "n"), pairs, "pair long, x double").groupBy("pair").agg(F.sum("x").alias("x"))
    sums = map_batches(joint, correlated, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(width)
    for r in sums.collect():  # one row a voter at most
        out[r["i"]] = r["x"]
    return out


def features(hits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the classifier sees besides votes: the number of hits and their rate, and 1."""
    rate = np.minimum(hits / np.maximum(size, 1), 0.2)
    return np.stack([np.log1p(hits), rate * 10, np.ones(len(hits))], 1)


def logistic(votes: Votes, width: int, x: np.ndarray, y: np.ndarray, ridge: float = 0.2, steps: int = 40) -> np.ndarray:
    """Weights of votes and features x in a ridge logistic regression on soft labels.

    Newton's method, its steps by conjugate gradients, as the matrix of all voters' pairs is never built.
    """
    w = np.zeros(width + x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3

    def rows(v: np.ndarray) -> np.ndarray:
        return votes.sums(v[:width]) + x @ v[width:]

    def columns(r: np.ndarray) -> np.ndarray:
        return np.concatenate([votes.totals(r, width), x.T @ r])

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows(w), -30, 30)))
        bend = p * (1 - p) + 1e-6
        scale = np.concatenate([votes.totals(bend, width), (x * x).T @ bend]) + keep
        rest = columns(y - p) - keep * w
        step, z = np.zeros(len(w)), rest / scale
        way, size = z.copy(), rest @ z
        goal = 1e-18 * max(size, 1e-12)
        for _ in range(1000):
            if size <= goal:
                break
            bent = columns(bend * rows(way)) + keep * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            z = rest / scale
            way, size = z + (rest @ z) / size * way, rest @ z
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray

    def score(self, votes: Votes, hits: np.ndarray, size: np.ndarray) -> np.ndarray:
        width = len(self.voters) + 2
        z = votes.with_patterns(width - 2).sums(self.weights[:width]) + features(hits, size) @ self.weights[width:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Voters, label model and classifier; without labelled rows the fixed insults vote and count as toxic."""
    rows = training_rows(docs, labels, fit_rows)
    own = voters(rows)
    k = len(own)
    votes = masks(rows.withColumnRenamed("id", "doc_id"), own).join(
        F.broadcast(rows.select("id", "toxic").distinct()), "id"  # at most fit_rows rows
    )
    found = sorted((bytes(r["votes"]), r["hits"], r["size"], r["toxic"]) for r in votes.drop("id").collect())
    hits, size, toxic = (np.array([r[i] for r in found], np.int64) for i in (1, 2, 3))
    known = unpacked(pa.array([r[0] for r in found], pa.binary()))
    if not len(found) or not toxic.any():  # nothing to learn from: one document for each voter, and a clean one
        known = Votes(np.arange(k, dtype=np.int32), np.append(np.arange(k + 1), k))
        hits = np.append(np.ones(k, np.int64), 0)
        size, toxic = np.full(k + 1, 50), hits.copy()
    known = known.with_patterns(k)
    counted = cut(masks(docs, own).groupBy("votes").agg(F.count("*").alias("n")))
    model = label_model(counted, k, (known, toxic))
    # the classifier learns posteriors; a known label moves its row's posterior by the trust of the label model
    y = 0.5 * model.posterior(known) + 0.5 * toxic
    x = features(hits, size)
    weights = logistic(known, k + 2, x, y)
    weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(known.sums(weights[: k + 2]) + x @ weights[k + 2 :], toxic)
    return Model(own, model, weights)


def best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The value that separates toxic from clean labelled rows best, a clean row above it counting COST times."""
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(np.where(toxic[order] == 1, 1.0, -COST))
    last = np.append(np.diff(z[order]) < -1e-9, True)  # rows of equal value stay together
    gain = np.where(last, gain, -np.inf)
    best = int(np.argmax(gain))
    below = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    return float(z[order[best]] + below) / 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score, hits): one row for each input row; a null or empty text has no votes."""
    kept = docs.select(F.col("doc_id").alias("id"), "text")
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, hits, size = model.voters.votes(batch["text"])
            scores = model.score(votes, hits, size)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores), pa.array(hits)], ["id", "score", "hits"])

    return map_batches(kept, run, f"id {kind}, score double, hits long")


def without(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""

    def clean(text: pa.Array) -> pa.Array:
        return pa.array(model.score(*model.voters.votes(text)) < threshold)

    return where(docs, "text", clean)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select(
        F.col("id").alias("doc_id"), (remainder("id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity of the pipeline: documents that the classifier finds toxic go."""
    return without(docs, train(docs, table(spark, sf_dir, "labels")))
