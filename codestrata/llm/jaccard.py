"""N-gram Jaccard join with several global token orders.

If two sets are similar enough, the first few of their tokens in any global order must have one in common.  Documents are
compared only if that holds in all of several orders:

* rare:  shingles with a rare word first, by the counts of the words in all documents;
* hash:  by the hash alone;
* mixed: shingles whose words are rare on the whole first.

Copies (equal sets) are one representative.  Sharing a prefix token and having sizes that fit puts representatives into
one family.  Nothing is paired up to get there: the members of a token are linked one to the next, in the order of their
sizes, after each task has linked its own and kept one of them; families are connected components.

Such families hang together by chance the more, the larger the corpus is, so they are divided before any text moves: each
set has a bitmap with the parity of its tokens in each slot, two bitmaps differ in no more bits than their sets differ in
tokens, and a family keeps together what pairs within that bound connect.  Families that are still too large to compare
at once are divided by the second order.  Texts move as compressed bytes.  Within a family (large ones in blocks by size,
each pair of blocks whose sizes fit once) inverted indexes over the prefixes of all orders are intersected for the
candidates, and those not yet connected are verified on their whole sets.

The join's result is the components of all links.  No link between representatives is lost: a pair is left out only if a
filter rules it out or the two are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.graph import components
from codestrata.llm.passages import packed, unpacked
from codestrata.llm.tables import brief_shuffles, by_group, cut, lean, lean_group, map_batches, table
from codestrata.llm.text import BASE, Words, lists, mix, slices

SHINGLE, PERCENT = 5, 80
SLOT_BITS = 24  # word counts take a byte for each of so many slots: 16 MB in each task
UNIT_SHINGLES = 250_000  # in texts that a task compares at once
SLICE = 1 << 18  # bytes of text whose sets a task holds at once, or one longer text
MEMBER_BITS = 26  # a filter of ids is a bit for each of so many slots: 8 MB in each task
BLOCK = 800  # members of a large family in one block
BLOCK_SHINGLES = 2_000_000  # and the shingles of a block, about, if its texts are long
BITMAP = 128  # bits of a set's bitmap, at least
NEAR_UNIT, NEAR_BLOCK, NEAR_SHINGLES = 1_000_000, 8192, 16_000_000  # UNIT_SHINGLES, BLOCK and BLOCK_SHINGLES where bitmaps are compared
HEADS = 1 << 19  # prefix tokens that a task links at once
ORDERS = ("rare", "hash", "mixed")
SEEDS = {"rare": 11, "hash": 23, "mixed": 37}


class Counts:
    """How often words occur, by SLOTS hashes: a level of 0 for 0 and 1, exact up to 8, then by doublings.

    Slots are shared once a corpus has more different words than slots; the orders then tell rare words apart less well,
    which costs candidates but no link.
    """

    def __init__(self, level: np.ndarray) -> None:
        self.level = level

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.level[h >> np.uint64(64 - SLOT_BITS)]


def levels(n: np.ndarray) -> np.ndarray:
    doubled = 6 + np.floor(np.log2(np.maximum(n, 1)) + 1e-9)
    return np.where(n <= 8, np.maximum(n - 1, 0), np.minimum(doubled, 63)).astype(np.uint8)


def word_counts(docs: DataFrame) -> Counts:
    """Counts the words of all documents by slot; the driver gets one byte for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w.h >> np.uint64(64 - SLOT_BITS) for _, w in slices(batch["text"], lower=True, size=SLICE)]
            slot, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], ["slot", "n"])

    def packed_levels(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        level = np.zeros(1 << 16, np.uint8)
        level[group["slot"].to_numpy() & 0xFFFF] = levels(group["n"].to_numpy())
        return pa.table({"part": pa.array([part], pa.int32()), "level": pa.array([packed(level)], pa.binary())})

    counted = map_batches(docs.select("text"), lean(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counted = counted.select(F.shiftright("slot", 16).alias("part"), "slot", "n")
    level = np.zeros((1 << (SLOT_BITS - 16), 1 << 16), np.uint8)
    for r in by_group(counted, "part", lean_group(packed_levels), "part int, level binary").collect():
        level[r["part"]] = unpacked(r["level"], "u1")
    return Counts(level.ravel())


def some_of(ids: DataFrame) -> np.ndarray:
    """A filter of the ids in a column `node`, a bit for each slot; the driver gets at most 8 MB.

    It passes all of these ids and few others, as long as there are fewer ids than slots; in a larger corpus it passes
    more, which costs rows that a join then drops, but no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot_of(batch["node"])).astype(np.int32))], ["slot"])

    def packed_bits(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[group["slot"].to_numpy() & 0xFFFF] = 1
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "bits": pa.array([packed(np.packbits(bits))], pa.binary())})

    slots = map_batches(ids.select("node"), run, "slot int").distinct().select(F.shiftright("slot", 16).alias("part"), "slot")
    bits = np.zeros((1 << (MEMBER_BITS - 16), 1 << 13), np.uint8)
    for r in by_group(slots, "part", packed_bits, "part int, bits binary").collect():
        bits[r["part"]] = unpacked(r["bits"], "u1")
    return bits.ravel()


def slot_of(ids: pa.Array) -> np.ndarray:
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return mix(values + BASE) >> np.uint64(64 - MEMBER_BITS)


class Sets:
    """The shingle sets of some texts: text i has the tokens token[off[i]:off[i + 1]], in ascending order."""

    def __init__(self, w: Words, k: int, words: Counts | None) -> None:
        n, count = len(w.h), w.counts()
        text = w.text_of()
        size = np.minimum(count, k)[text] if n else np.zeros(0, int)  # a shorter text is one shingle
        last = w.off[1:][text] if n else np.zeros(0, int)
        at = np.flatnonzero(np.arange(n) + size <= last)
        h = np.zeros(len(at), np.uint64)
        level = words.of(w.h) if words is not None else np.zeros(n, np.uint8)
        least, total = np.full(len(at), 255, np.uint8), np.zeros(len(at), np.int32)
        for j in range(k):
            inside = j < size[at]
            place = np.minimum(at + j, max(n - 1, 0))
            h = np.where(inside, h * BASE + w.h[place], h)
            least = np.where(inside, np.minimum(least, level[place]), least)
            total += np.where(inside, level[place], 0)
        h = mix(h + size[at].astype(np.uint64))
        own = text[at]
        order = np.lexsort((h, own))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
        keep = order[new]
        self.token, self.text, self.least, self.total = h[keep], own[keep], least[keep], total[keep]
        self.off = np.searchsorted(self.text, np.arange(len(w) + 1))

    def sizes(self) -> np.ndarray:
        return np.diff(self.off)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each set."""
        out = []
        for seed in (1, 2):
            total = np.zeros(len(self.token) + 1, np.uint64)
            np.cumsum(mix(self.token + np.uint64(seed)), dtype=np.uint64, out=total[1:])
            out.append(mix((total[self.off[1:]] - total[self.off[:-1]]) + self.sizes().astype(np.uint64)))
        return out[0], out[1]

    def bitmaps(self, percent: int) -> pa.Array:
        """Each set's bitmap: a bit for each slot, set if an odd number of its tokens have that slot.

        The slots are the lowest bits of a hash, so a bitmap is folded to half as many by the parity of its halves.
        """
        bits = bitmap_sizes(self.sizes(), percent)
        start = np.concatenate([[0], np.cumsum(bits)])
        slot = mix(self.token + np.uint64(3)) & (bits[self.text] - 1).astype(np.uint64)
        at, n = np.unique(start[self.text] + slot.astype(np.int64), return_counts=True)
        odd = np.zeros(start[-1], np.uint8)
        odd[at] = n & 1
        data = np.packbits(odd, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(data)])

    def prefixes(self, order: str, percent: int, shared: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each set's prefix under an order, and how many each set has.

        With shared, those are left out that hold a word which occurs once in all documents: no other set has them.
        """
        rank = mix(self.token ^ np.uint64(SEEDS[order]))
        first = {"rare": self.least, "hash": np.zeros(len(rank), np.uint8), "mixed": self.total // 4}[order]
        by = np.lexsort((rank, first, self.text))
        n = self.sizes()
        most = np.where(n > 0, n + (-percent * n // 100) + 1, 0)  # n - ceil(percent * n / 100) + 1
        place = np.arange(len(by)) - self.off[:-1][self.text[by]]
        keep = place < most[self.text[by]]
        if shared:
            keep &= self.least[by] > 0
            most = np.bincount(self.text[by[keep]], minlength=len(n))
        return self.token[by[keep]], most


def bitmap_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Bits of the bitmaps of sets of n tokens: the power of two from four times the tokens that a similar set may differ in."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(8 * (100 - percent) * n // (100 + percent), BITMAP))).astype(np.int64)


def signatures(docs: DataFrame, k: int, percent: int, words: Counts) -> DataFrame:
    """(id, n, a, b, bits, prefix): size, two hashes, bitmap and of the first order's prefix what other sets may have, for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, w in slices(batch["text"], lower=True, size=SLICE):
                sets = Sets(w, k, words)
                a, b = sets.digests()
                token, count = sets.prefixes("rare", percent, shared=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].slice(first, len(w)), pa.array(sets.sizes().astype(np.int64)), pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)), sets.bitmaps(percent), lists(token.view(np.int64), count, pa.int64()),
                    ],
                    ["id", "n", "a", "b", "bits", "prefix"],
                )

    return map_batches(docs, lean(run), "id long, n long, a long, b long, bits binary, prefix array<long>")


def linked(token: np.ndarray, level: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """One head for each token and level, and for each node that shares them the link to that head.

    Links have a token of their own and no level, so that they are no task's work either.
    """
    by = np.lexsort((node, level, token))
    new = np.ones(len(by), bool)
    new[1:] = (token[by[1:]] != token[by[:-1]]) | (level[by[1:]] != level[by[:-1]])
    head = node[by[new]][np.cumsum(new) - 1]
    other = node[by] != head
    links = np.unique(np.stack([node[by][other], head[other]]), axis=1)
    own = mix(links[0].view(np.uint64) ^ mix(links[1].view(np.uint64))).view(np.int64)
    first = np.sort(by[new])  # in the order of the rows: one node's tokens side by side are smaller in a shuffle
    n, none = len(first), np.zeros(links.shape[1], np.int16)
    link = np.arange(n + len(none)) >= n
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([token[first], own])),
            pa.array(np.concatenate([level[first], none]), mask=link),
            pa.array(np.concatenate([node[first], links[0]])),
            pa.array(np.concatenate([np.zeros(n, np.int64), links[1]]), mask=~link),
        ],
        ["token", "level", "node", "head"],
    )


def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of (node, level, tokens) rows, linked for about HEADS of them at a time."""
    held, n = [], 0
    for batch in batches:
        tokens = batch["tokens"]
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = tokens.flatten().to_numpy(zero_copy_only=False)
        node, level = (np.repeat(batch[c].to_numpy(zero_copy_only=False), sizes) for c in ("node", "level"))
        for at in range(0, len(flat), HEADS):
            held.append((flat[at : at + HEADS], level[at : at + HEADS], node[at : at + HEADS]))
            n += len(held[-1][0])
            if n >= HEADS:
                yield linked(*(np.concatenate(part) for part in zip(*held)))
                held, n = [], 0
    if n:
        yield linked(*(np.concatenate(part) for part in zip(*held)))


def families(sets: DataFrame) -> DataFrame:
    """(node, family) of nodes that share a token with a node of a fitting size; sets has node, level, tokens.

    Sizes that fit are in the same class of sizes (level) or in neighbouring ones.  The members of a token are linked in the
    order of their levels, each to the one before it unless a level lies between them.  A token that very many sets
    have is a row for each task that has met it and each level.
    """
    rows = map_batches(sets.select("node", "level", "tokens"), lean(heads), "token long, level short, node long, head long")
    before = Window.partitionBy("token").orderBy("level", "node")  # links have no level: they come first
    near = F.col("level") - F.lag("level").over(before) <= 1
    other = F.coalesce("head", F.when(near, F.lag("node").over(before)))
    return components(rows.select(F.col("node").alias("a"), other.alias("b")).filter("a != b")).withColumnRenamed("component", "family")


def near(members: DataFrame, percent: int) -> DataFrame:
    """(node, family) of the members of families that have near bitmaps, each family divided into what these connect.

    members has node, n, family, blocks, bits.  No similar pair is divided.  Of the pairs of a unit only those that connect
    are returned, so there are fewer links than members in it.
    """

    def run(group: pa.Table) -> pa.Table:
        found = near_within(group, percent)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    dealt = dealt_out(members, percent, NEAR_UNIT, NEAR_BLOCK, NEAR_SHINGLES).select("node", "n", "family", "bits", "unit", "side")
    return components(by_group(dealt, "unit", lean_group(run), "a long, b long")).withColumnRenamed("component", "family")


def near_within(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of each family in the group whose bitmaps are near, as few as connect them.

    Sides are as in links_within.
    """
    node, n, family, side = (group[c].to_numpy() for c in ("node", "n", "family", "side"))
    by = np.lexsort((node, n, family))
    node, n, family, side = node[by], n[by], family[by], side[by]
    maps = group["bits"].combine_chunks().take(pa.array(by))
    out = [], []
    for first, last in zip(*runs(family)):
        if last - first > 1:
            own = slice(first, last)
            for x, y in connected(n[own], side[own], maps[first:last], percent):
                if node[own][x] != node[own][y]:
                    out[0].append(node[own][x])
                    out[1].append(node[own][y])
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins and ends."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])


def connected(n: np.ndarray, side: np.ndarray, maps: pa.Array, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that connect all of one family with near bitmaps; n is in ascending order, and so are the bitmaps' sizes."""
    label = np.arange(len(n))
    both = side.min() != side.max()
    bits = bitmap_sizes(n, percent)
    rows = [
        (x, y, np.frombuffer(b"".join(maps[x:y].to_pylist()), np.uint64).reshape(y - x, -1)) for x, y in zip(*runs(bits))
    ]  # of one size each
    for k, (begin, end, own) in enumerate(rows):
        folded = [(begin, own)]
        for first, last, others in rows[k + 1 :]:
            if percent * n[first] > 100 * n[end - 1]:
                break
            while others.shape[1] > own.shape[1]:
                others = others[:, : others.shape[1] // 2] ^ others[:, others.shape[1] // 2 :]
            folded.append((first, others))
        for x in range(begin, end):
            fits = np.searchsorted(n, 100 * n[x] // percent, "right")
            for first, others in folded:
                after, last = max(first, x + 1), min(first + len(others), fits)
                if after >= last:
                    continue
                some = label[after:last] != label[x]
                if both:
                    some &= side[after:last] != side[x]
                some = np.flatnonzero(some) + after
                if not len(some):
                    continue
                there = others[after - first : last - first] if len(some) == last - after else others[some - first]
                differ = np.bitwise_count(there ^ own[x - begin]).sum(axis=1, dtype=np.int64)
                some = some[(100 + percent) * differ <= (100 - percent) * (n[some] + n[x])]
                if len(some):
                    labels, one = np.unique(label[some], return_index=True)
                    label[np.isin(label, labels)] = label[x]
                    yield from ((x, y) for y in some[one].tolist())


def moved(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The documents whose id passes a filter, with compressed texts; a null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slot = slot_of(batch["id"])
            passes = (bits[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 > 0
            batch = batch.filter(pa.array(passes))
            texts = [squeeze.compress(x.as_buffer() if x.is_valid else b"") for x in batch["text"].cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.binary())], ["id", "text"])

    return map_batches(docs.select("id", "text"), lean(run), "id long, text binary")


def whole(column: pa.Array | pa.ChunkedArray, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Compressed texts as they were, some of about `size` bytes at a time, with the place of their first."""
    expand = zstandard.ZstdDecompressor()
    first, held, n = 0, [], 0
    for i, x in enumerate(column):
        held.append(expand.decompress(x.as_buffer()))
        n += len(held[-1])
        if n >= size:
            yield first, pa.array(held, pa.large_binary())
            first, held, n = i + 1, [], 0
    if held:
        yield first, pa.array(held, pa.large_binary())


def words_of(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, Words]]:
    """Slices of compressed texts."""
    for start, texts in whole(column, SLICE):
        for first, w in slices(texts, lower=True, size=SLICE):
            yield start + first, w


def links_within(group: pa.Table, k: int, percent: int, words: Counts) -> list[tuple[int, int]]:
    """Links that connect similar members of each family in the group, as few as connect them.

    Rows with side 0 and 1 are two blocks of a family; pairs within a block are compared in the block's own unit.
    """
    rows = {c: group[c].combine_chunks() for c in ("node", "a", "family", "side", "text")}
    node, digest, family, side = (rows[c].to_numpy(zero_copy_only=False) for c in ("node", "a", "family", "side"))
    tokens, prefixes = [], {order: [] for order in ORDERS}
    for first, w in words_of(rows["text"]):
        sets = Sets(w, k, words)
        own = sets.digests()[0].view(np.int64) == digest[first : first + len(w)]  # an id with several texts: the right one
        tokens += [sets.token[x:y] if ok else None for x, y, ok in zip(sets.off, sets.off[1:], own)]
        for order in ORDERS:
            token, count = sets.prefixes(order, percent)
            prefixes[order] += np.split(token, np.cumsum(count)[:-1])
    out = []
    usable = np.array([t is not None and len(t) > 0 for t in tokens], bool)
    by = np.lexsort((node, family))
    by = by[usable[by]]
    new = np.ones(len(by), bool)
    new[1:] = (family[by[1:]] != family[by[:-1]]) | (node[by[1:]] != node[by[:-1]])  # a repeated row once
    by = by[new]
    cuts = np.flatnonzero(np.diff(family[by])) + 1
    for members in np.split(by, cuts):
        if len(members) > 1:
            out += connect(
                node[members], side[members], [tokens[i] for i in members],
                {order: [prefixes[order][i] for i in members] for order in ORDERS}, percent,
            )
    return out


def postings(prefix: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members by token: token t's are member[begin[t]:begin[t + 1]], where t numbers the tokens of flat."""
    token = np.concatenate(prefix)
    member = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix])
    _, number = np.unique(token, return_inverse=True)
    order = np.argsort(number, kind="stable")
    begin = np.searchsorted(number[order], np.arange(number.max() + 2))
    return number, begin, member[order]


def connect(node: np.ndarray, side: np.ndarray, tokens: list[np.ndarray], prefixes: dict, percent: int) -> list[tuple[int, int]]:
    n = np.array([len(t) for t in tokens])
    indexes = []
    for order in ORDERS:
        number, begin, member = postings(prefixes[order])
        off = np.concatenate([[0], np.cumsum([len(p) for p in prefixes[order]])])
        indexes.append((number, begin, member, off))
    label = np.arange(len(node))
    both = side.min() != side.max()
    out = []
    for x in range(len(node) - 1):
        candidate = (np.arange(len(node)) > x) & (label != label[x])
        candidate &= (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if both:
            candidate &= side != side[x]
        for number, begin, member, off in indexes:
            if not candidate.any():
                break
            found = np.zeros(len(node), bool)
            for t in number[off[x] : off[x + 1]]:
                found[member[begin[t] : begin[t + 1]]] = True
            candidate &= found
        for y in np.flatnonzero(candidate):
            if label[y] == label[x]:
                continue
            common = len(np.intersect1d(tokens[x], tokens[y], assume_unique=True))
            if 100 * common >= percent * (n[x] + n[y] - common):
                out.append((int(node[x]), int(node[y])))
                label[label == label[y]] = label[x]
    return out


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id that links lead to, the document's own included.

    Sets are the distinct runs of `shingle` words of the text with A-Z lower-cased; a shorter text is one run, and one
    without words has an empty set and no links.  Two documents link when 100 * common >= percent * all of their shingles.
    One row for each input row.  Rows with one id are one document, whatever their texts; a null id links with nothing
    and its component_id is null.
    """
    with brief_shuffles(docs.sparkSession):
        named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        words = word_counts(named)
        signed = cut(signatures(named, shingle, percent, words))
        usable = signed.filter("n > 0 and id is not null")
        sets = usable.groupBy("a", "b").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits"))

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, w in words_of(batch["text"]):
                    found, own = Sets(w, shingle, words), batch.slice(first, len(w))
                    token, count = found.prefixes("hash", percent, shared=True)
                    right = found.digests()[0].view(np.int64) == own["a"].to_numpy(zero_copy_only=False)  # of an id's texts
                    family = mix(own["family"].to_numpy(zero_copy_only=False).view(np.uint64))
                    token = mix(token ^ np.repeat(family, count))[np.repeat(right, count)]
                    tokens = lists(token.view(np.int64), np.where(right, count, 0), pa.int64())
                    yield pa.RecordBatch.from_arrays([own["node"], own["n"], tokens], ["node", "n", "tokens"])

        level = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / percent) + 1e-6)).cast("short").alias("level")
        close = families(usable.select(F.col("id").alias("node"), level, F.col("prefix").alias("tokens")))
        members = cut(with_size(sets.join(close.hint("merge"), "node"), NEAR_BLOCK, NEAR_SHINGLES))
        close = near(members, percent)  # divides families before any text moves
        members = cut(with_size(members.select("node", "a", "n").join(close.hint("merge"), "node"), BLOCK, BLOCK_SHINGLES))
        named = moved(named, some_of(members))  # only texts with a family
        # the second order divides families that are still too large to compare at once
        large = members.filter(F.col("blocks") > 1)
        texts = named.join(large.select("node", "a", "n", "family"), named["id"] == large["node"]).drop("id")
        finer = families(map_batches(texts, lean(second), "node long, n long, tokens array<long>").select("node", level, "tokens"))
        divided = with_size(large.select("node", "a", "n").join(finer, "node"), BLOCK, BLOCK_SHINGLES)
        placed = cut(members.filter(F.col("blocks") <= 1).unionByName(divided))
        dealt = dealt_out(placed, percent, UNIT_SHINGLES, BLOCK, BLOCK_SHINGLES).select("node", "a", "family", "unit", "side").hint("merge")
        members = named.join(dealt, named["id"] == dealt["node"]).drop("id")

        def verify(group: pa.Table) -> pa.Table:
            found = links_within(group, shingle, percent, words)
            return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

        links = by_group(members, "unit", lean_group(verify), "a long, b long")
        # an id with several texts connects their sets
        several = usable.join(sets.select("a", "b", "node"), ["a", "b"]).select("id", "node")
        several = several.filter("id != node").groupBy("id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y")
        ends = several.select(F.col("id").alias("a"), F.col("x").alias("b"))
        same = several.select(F.col("x").alias("a"), F.col("y").alias("b")).unionAll(ends)
        found = components(links.unionAll(same))
    of = sets.select("a", "b", "node").join(found, "node", "left").select("a", "b", F.coalesce("component", "node").alias("component"))
    rows = signed.select("id", "n", "a", "b").join(of.hint("merge"), ["a", "b"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return rows.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def with_size(members: DataFrame, block: int, shingles: int) -> DataFrame:
    """Members of families of at least two, with the number of blocks that their family is compared in."""
    sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("mass")).filter("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("mass") / shingles)).cast("int").alias("blocks")
    own = [c for c in ("node", "a", "n", "bits", "family") if c in members.columns]
    return members.join(sizes.select("family", blocks), "family").select(*own, "blocks")


def dealt_out(members: DataFrame, percent: int, unit_shingles: int, block: int, shingles: int) -> DataFrame:
    """The members with the units that they are compared in, and their side there; with_size has given them their blocks.

    Small families share units.  A large family is laid out in blocks by size, and each pair of blocks with sizes that fit is
    a unit of its own, with sides 0 and 1; a member is a row for each of them.
    """
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    units = max(1, -(-total // unit_shingles))
    small = members.filter("blocks = 1").withColumns({"unit": F.pmod(F.xxhash64("family"), F.lit(units)), "side": F.lit(0)})
    large = members.filter("blocks > 1")
    weight = F.greatest(F.lit(1 / block), F.col("n") / shingles)
    before = Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = large.groupBy("family", "n").agg(F.count("*").alias("same"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum(F.col("same") * weight).over(before), F.lit(0.0)))
    place = F.floor(F.col("before") + weight * F.pmod(F.xxhash64("node"), F.col("same"))).cast("int")
    large = large.join(sizes.hint("merge"), ["family", "n"]).withColumn("block", place)
    bounds = large.groupBy("family", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = bounds.select("family", F.col("block").alias("other"), F.col("least").alias("from"))
    pairs = bounds.join(other.hint("merge"), "family")
    pairs = pairs.filter((F.col("block") <= F.col("other")) & (100 * F.col("most") >= percent * F.col("from")))
    ends = F.when(F.col("block") == F.col("other"), F.array("block")).otherwise(F.array("block", "other"))
    pairs = pairs.select("family", F.xxhash64("family", "block", "other").alias("unit"), F.posexplode(ends).alias("side", "block"))
    large = large.join(pairs.hint("merge"), ["family", "block"])
    return small.unionByName(large.select(*small.columns))


def representatives(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, of which no document with a smaller id is in the same component."""
    found = join(docs, shingle, percent).filter("component_id < id").select(F.col("id").alias("_id")).distinct()
    return docs.join(found.hint("merge"), docs["doc_id"] == found["_id"], "left_anti")


def query(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"), 3, 90).withColumnRenamed("id", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join of the pipeline: of each group of near duplicates the smallest id stays."""
    return representatives(docs)
