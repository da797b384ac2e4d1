"""Language-model scoring with Elias-Fano n-gram tries.

The model is spread over shards, as it grows with the corpus.  A shard holds, for each level, the contexts whose hash
belongs to it, monotone pointers to their continuations in Elias-Fano form, the continuations in ascending order within
their context, and the quantised probabilities of the n-grams, all in one memory map.  A query finds its context, reads the
two pointers and searches the continuations between them for the first that is not smaller.

Scoring moves n-grams, not texts: a block of documents sends each different n-gram once to its shard, with the number of
times it occurs in training documents, and gets the code of its probability back in the same order.  Shards split a context
by the continuation as well, so one very common context is not one task's work.  Smoothing is that of a Dirichlet prior:

    P1(w)   = (c(w) + 1) / (N + V + 1)
    Pk(w|h) = (c(h w) + PRIOR * Pk-1(w|h')) / (c(h) + PRIOR)

Codes round counts of n-grams down where they are numerators and up where they are denominators, so probabilities never
add up to more than 1.  Unigram counts are exact.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.passages import packed, unpacked
from codestrata.llm.tables import by_group, by_groups, cut, remainder, table
from codestrata.llm.text import BASE, mix, slices

ORDER = 2
PRIOR = 400.0
BLOCK_BYTES = 8 << 20  # text that a task turns into n-grams at once
SHARD_BYTES = 24 << 20  # text whose n-grams one shard holds
START, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
STEPS = 64  # codes for each doubling of a count
SPLIT = 16  # parts of a context


class EliasFano:
    """A non-decreasing sequence: low bits as they are, high bits as gaps in unary, and the ones before each 64 bits."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        self.kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        self.bits = np.uint64(bits)
        values = values.astype(np.uint64)
        self.low = (values & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(self.kind)
        ones = (values >> self.bits).astype(np.int64) + np.arange(self.n)
        flags = np.zeros((int(ones[-1]) // 64 + 1) * 64 if self.n else 64, np.uint8)
        flags[ones] = 1
        self.high = np.packbits(flags, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(1, dtype=np.int64))]).astype(np.uint32)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i: the place of the i-th one, less i, is the high part."""
        out = np.empty(len(i), np.int64)
        words = self.high.reshape(-1, 8)
        for a in range(0, len(i), 1 << 16):
            want = i[a : a + (1 << 16)]
            word = np.searchsorted(self.before, want, "right") - 1
            inside = np.unpackbits(words[word], axis=1, bitorder="little")
            rank = np.cumsum(inside, axis=1, dtype=np.uint8)
            bit = np.argmax(rank > (want - self.before[word])[:, None], axis=1)
            high = (word * 64 + bit - want).astype(np.uint64)
            out[a : a + (1 << 16)] = ((high << self.bits) | self.low[want]).astype(np.int64)
        return out


def code_of(count: np.ndarray) -> np.ndarray:
    """Codes of counts: 0 for 0, then STEPS for each doubling, rounded down."""
    count = np.asarray(count, float)
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1)) * STEPS + 1e-6), 0).astype(np.uint16)


def count_of(code: np.ndarray, up: bool = False) -> np.ndarray:
    """The smallest whole count with a code, or the largest."""
    code = code.astype(float)
    if up:
        return np.where(code > 0, np.maximum(np.ceil(2 ** (code / STEPS) - 1e-6) - 1, 1), 0)
    return np.where(code > 0, np.ceil(2 ** ((code - 1) / STEPS) - 1e-6), 0)


class Trie:
    """One level of a shard: n-grams as (context, continuation) and the codes of their probabilities."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> None:
        order = np.lexsort((word, context))
        context, word, count = context[order], word[order], count[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(count, begin) if len(begin) else count
        kept = total > 0  # n-grams of held-out documents only are asked for, not stored
        context, word, self.total = context[begin][kept], word[begin][kept], total[kept]
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, int)
        self.pointers = EliasFano(np.append(first, len(context)))
        parts = [context[first], word, code_of(self.total), self.pointers.low, self.pointers.high, self.pointers.before]
        self.map = mmap.mmap(-1, max(1, sum((p.nbytes + 7) // 8 * 8 for p in parts)))
        at, views = 0, []
        for p in parts:
            self.map[at : at + p.nbytes] = p.tobytes()
            views.append(np.frombuffer(self.map, p.dtype, len(p), at))
            at += (p.nbytes + 7) // 8 * 8
        self.contexts, self.words, self.codes, self.pointers.low, self.pointers.high, self.pointers.before = views

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where each n-gram is stored, or -1; n-grams of one context follow each other."""
        out = np.full(len(context), -1, np.int64)
        if not len(context) or not len(self.contexts):
            return out
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        own = context[first]
        at = np.minimum(np.searchsorted(self.contexts, own), len(self.contexts) - 1)
        known = self.contexts[at] == own
        low, high = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        low[known], high[known] = self.pointers.get(at[known]), self.pointers.get(at[known] + 1)
        size = np.diff(np.append(first, len(context)))
        low, high = np.repeat(low, size), np.repeat(high, size)
        end, active = high.copy(), np.flatnonzero(low < high)
        while len(active):  # successor search between the context's pointers
            middle = (low[active] + high[active]) >> 1
            smaller = self.words[middle] < word[active]
            low[active[smaller]] = middle[smaller] + 1
            high[active[~smaller]] = middle[~smaller]
            active = active[low[active] < high[active]]
        found = np.flatnonzero(low < end)
        found = found[self.words[low[found]] == word[found]]
        out[found] = low[found]
        return out


class Block:
    """The tokens of a block's documents: each text's words in small letters, then one end."""

    def __init__(self, texts: pa.ChunkedArray, order: int) -> None:
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, w in slices(texts, lower=True):
            hashes.append(w.h), counts.append(w.counts())
        words, self.sizes = np.concatenate(hashes), np.concatenate(counts) + 1
        n = len(words) + len(self.sizes)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.token = np.full(n, END)
        ends = np.zeros(n, bool)
        ends[self.end - 1] = True
        self.token[~ends] = words
        place = np.arange(n) - self.begin[self.text]
        # level k: a hash of the k - 1 tokens before; before the first come starts
        self.context = [self.token]
        history = np.zeros(n, np.uint64)
        for k in range(2, order + 1):
            back = np.arange(n) - (k - 1)
            older = np.where(place >= k - 1, self.token[np.maximum(back, 0)], START)
            history = mix(history * BASE + older + np.uint64(k))
            self.context.append(history)

    def keys(self, level: int, shards: int) -> tuple[np.ndarray, ...]:
        """(shard, context, continuation) of each different n-gram, in a fixed order, and the number of each token's.

        A unigram is a context without continuation; continuations are 48-bit hashes.
        """
        context = mix(self.context[level - 1] + np.uint64(level))
        word = np.zeros(len(context), np.uint64) if level == 1 else self.token >> np.uint64(16)
        shard = (mix(context + (word % np.uint64(SPLIT)) * BASE) % np.uint64(shards)).astype(np.int64)
        both = mix(context ^ mix(word)) if level > 1 else context
        _, first, number = np.unique(both, return_index=True, return_inverse=True)
        order = np.lexsort((word[first], context[first], shard[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = first[order]
        return shard[own], context[own], word[own], rank[number]


ASKED = "block long, shard long, level int, context binary, size binary, low binary, high binary, count binary"
ANSWERED = "block long, shard long, level int, codes binary, tokens long, vocabulary long"


def asked(group: pa.Table, shards: int, order: int) -> pa.Table:
    """A block's different n-grams and how often training documents have them, by shard."""
    own = Block(group["text"], order)
    learn = group["learn"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)[own.text]
    rows: list[list] = [[] for _ in range(8)]
    block = group["block"][0].as_py()
    for level in range(1, order + 1):
        shard, context, word, number = own.keys(level, shards)
        count = np.bincount(number[learn], minlength=len(shard)).astype(np.uint32)
        begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for a, b in zip(begin, [*begin[1:], len(shard)]):
            c, w = context[a:b], word[a:b]
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(first, len(c))).astype(np.uint32)
            values = (block, int(shard[a]), level, packed(c[first]), packed(size), packed((w & np.uint64(0xFFFF)).astype(np.uint16)),
                      packed((w >> np.uint64(16)).astype(np.uint32)), packed(count[a:b]))
            for column, value in zip(rows, values):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 5
    return pa.table({x.split()[0]: pa.array(r, k) for x, r, k in zip(ASKED.split(", "), rows, kinds)})


def answered(group: pa.Table) -> pa.Table:
    """A shard's tries, and their answers to all blocks: exact counts of unigrams, codes of others."""
    rows = group.to_pylist()
    out: list[list] = [[] for _ in range(6)]
    for level in sorted({r["level"] for r in rows}):
        own = [r for r in rows if r["level"] == level]
        context, word, count = [], [], []
        for r in own:
            low, high = unpacked(r["low"], "<u2").astype(np.uint64), unpacked(r["high"], "<u4").astype(np.uint64)
            context.append(np.repeat(unpacked(r["context"], "<u8"), unpacked(r["size"], "<u4")))
            word.append((high << np.uint64(16)) | low)
            count.append(unpacked(r["count"], "<u4").astype(np.int64))
        trie = Trie(np.concatenate(context), np.concatenate(word), np.concatenate(count))
        for k, r in enumerate(own):
            at = trie.find(context[k], word[k])
            stored = trie.total if level == 1 else trie.codes
            found = np.where(at >= 0, stored[np.maximum(at, 0)], 0) if len(stored) else np.zeros(len(at), stored.dtype)
            tokens = int(count[k].sum()) if level == 1 else 0
            # a shard's vocabulary is told once
            values = (r["block"], r["shard"], level, packed(found.astype("<i8" if level == 1 else "<u2")), tokens, len(trie.total) if level == 1 and not k else 0)
            for column, value in zip(out, values):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({x.split()[0]: pa.array(r, k) for x, r, k in zip(ANSWERED.split(", "), out, kinds)})


def scored(group: pa.Table, replies: pa.Table, shards: int, order: int, n: int, v: int, texts: int, prior: float) -> pa.Table:
    own = Block(group["text"], order)
    before = np.maximum(np.arange(len(own.token)) - 1, 0)
    first = np.zeros(len(own.token), bool)
    first[own.begin] = True
    by_level: dict[int, list] = {}
    for r in sorted(replies.select(["level", "shard", "codes"]).to_pylist(), key=lambda r: (r["level"], r["shard"])):
        by_level.setdefault(r["level"], []).append(r["codes"])
    p, sums, upper = None, [], None
    for level in range(1, order + 1):
        number = own.keys(level, shards)[3]
        found = np.concatenate([unpacked(x, "<i8" if level == 1 else "<u2") for x in by_level[level]])[number]
        if level == 1:
            c = found.astype(float)
            p, upper = (c + 1) / (n + v + 1), c
            sums = [np.add.reduceat(x, own.begin) for x in (np.log10(c + 1) - np.log10(n + v + 1), (c > 0).astype(np.int64))]
        else:
            total = np.where(first, texts, upper[before])
            p = (count_of(found) + prior * p) / (total + prior)
            upper = count_of(found, up=True)
    score = np.add.reduceat(np.log10(p), own.begin)
    return pa.table(
        {
            "id": group["id"], "n_tokens": pa.array(own.sizes), "n_known": pa.array(sums[1]),
            "base_score": pa.array(sums[0]), "score": pa.array(score),
        }
    )


def scores(docs: DataFrame, learn, order: int = ORDER, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): every whole text under a model of the texts with learn.

    learn is a boolean column; null counts as false.  Tokens are the words in small letters (A-Z) and one end for each
    text, so an empty or null text is one token.  base_score takes P1 of all tokens, score their probabilities under the
    n-gram model; both are log10.  One row for each input row, equal rows alike; nothing is learned from an empty table.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)), F.coalesce(F.sum(F.col("learn").cast("int")), F.lit(0))).first()
    blocks, shards, texts = max(1, -(-total[0] // BLOCK_BYTES)), max(1, -(-total[0] // SHARD_BYTES)), total[1]
    kind = kept.schema["id"].dataType.simpleString()
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    questions = by_group(dealt, "block", lambda group: asked(group, shards, order), ASKED)
    answers = cut(by_group(questions, "shard", answered, ANSWERED))
    sums = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    n, v = sums[0], sums[1]

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        return scored(group, replies, shards, order, n, v, texts, prior)

    schema = f"id {kind}, n_tokens long, n_known long, base_score double, score double"
    rows = by_groups(dealt, answers.select("block", "shard", "level", "codes"), "block", score, schema)
    return rows.select("id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 7)
    rows = scores(docs, fold != 2).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
