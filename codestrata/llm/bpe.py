"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word's prefix is the encoding of a shorter prefix plus one last token, and that token is the only one
whose pair with the shorter prefix's last token is stable (the merges leave the two as they are).  So each trie node needs
only its last token.  The distinct words of a slice are walked in sorted order, which is the depth-first order of their
trie: the states of the current path are a stack, and words with a common prefix share the states of that prefix.
Finished words are remembered by the Python worker, up to a bound, and reused for later batches.

All else is array passes over a slice of texts: the split into words, the distinct words, and the ids and bytes of every
occurrence of a word.  Python sees a distinct word once a slice.

Documents stay where they are read; nothing is shuffled, and memory does not grow with the table.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import lean, map_batches, table

SLICE_BYTES = 2 << 20  # texts are encoded in slices of about this size, a longer text alone
#: Fixed: the split of byte-level BPE before its merges tells these apart, and other characters (0).
LETTER, NUMBER, SPACE = 1, 2, 3
CLASSES = {LETTER: r"\p{L}+", NUMBER: r"\p{N}+", SPACE: r"\p{White_Space}+"}
#: Fixed: what may follow an apostrophe at the start of a word and ends that word.
ONE_LETTER = np.array([ord(x) for x in "stmd"], "<u4")
TWO_LETTERS = np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
NEVER = 1 << 40  # a rank after all others
REMEMBERED = 160_000  # words whose encodings a worker keeps: half of them of late, half from before
PAIRS = 240_000  # judged pairs that a worker keeps, in halves as well
LONG = 400  # longer words are encoded but not kept


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def kinds() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, run in CLASSES.items():
        for found in regex.finditer(run, every):
            out[found.start() : found.end()] = kind
    return out


def word_starts(codes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which code points start a word, and True for the end; edge: where the pieces of text begin, and the end of the last.

    A word is a run of one class with the space before it.  White space gives its last character to what follows, or
    leaves it alone if that is no space.  An apostrophe and s, t, m, d, re, ve or ll are a word where one can start.
    """
    n, kind = len(codes), kinds()[codes]
    start, fence = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    fence[edge] = True
    start[1:n] = (kind[1:] != kind[:-1]) | fence[1:n]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fence[1:n])
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    mark = np.flatnonzero((codes == 0x27) & start[:n])
    mark = mark[~fence[mark + 1]]
    one = np.isin(codes[mark + 1], ONE_LETTER)
    ends = mark[one] + 2
    mark = mark[~one]
    mark = mark[~fence[mark + 2]]
    two = mark[np.isin(codes[mark + 1].astype(np.int64) << 32 | codes[mark + 2], TWO_LETTERS)]
    start[ends - 1] = start[two + 1] = False
    start[ends] = start[two + 3] = True
    return start


def taken(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + counts[i] - 1, for one i after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """A byte-level BPE vocabulary, read from a tokenizer's JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        letters, model = byte_letters(), described["model"]
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        raw = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = [raw.get(i, b"") for i in range(max([*raw, *self.special.values()]) + 1)]
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.tokens = pa.array(self.bytes_of, pa.large_binary())
        self.sizes = [len(x) for x in self.bytes_of]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.made.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # what was used lately, and what was used before that and goes next
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stable: dict[int, bool] = {}  # by a << 32 | b
        self.judged: dict[int, bool] = {}
        # a token that its own merges don't arrive at is never the encoding of its bytes
        self.whole = {i for i in raw if i not in self.made or self.together(*self.made[i][1:]) is False}
        self.automaton(raw)

    def automaton(self, raw: dict[int, bytes]) -> None:
        """Which tokens end at a byte, by one step for each byte: the states are the tokens' prefixes."""
        self.move: dict[int, int] = {}  # state and byte to state
        token_at = {}
        for i in self.whole:
            state = 0
            for byte in raw[i]:
                state = self.move.setdefault(state << 8 | byte, len(self.move) + 1)
            token_at[state] = (len(raw[i]), i)
        edges: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.move.items():
            edges.setdefault(key >> 8, []).append((key & 255, state))
        self.fail = [0] * (len(self.move) + 1)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * (len(self.move) + 1)  # (length, token), the longest first
        level = [0]
        while level:
            below = []
            for state in level:
                for byte, to in edges.get(state, ()):
                    self.fail[to] = self.after(self.fail[state], byte) if state else 0
                    own = (token_at[to],) if to in token_at else ()
                    self.ending[to] = own + self.ending[self.fail[to]]
                    below.append(to)
            level = below

    def after(self, state: int, byte: int) -> int:
        """The longest token prefix at the end of a text with this state and this byte."""
        passed = []
        while (to := self.move.get(state << 8 | byte)) is None and state:
            passed.append(state)
            state = self.fail[state]
        to = to or 0
        for state in passed:
            self.move[state << 8 | byte] = to
        return to

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one end of a token while it is merged, each with the rank of the merge that takes it up."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            made = self.made.get(token)
            if made is None:
                return out
            until, token = made[0], made[1 + side]

    def together(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a, b as they are.

        Merges happen in the order of their ranks.  The two are joined if a piece at the end of a and a piece at the
        start of b have a merge that comes before the one that takes up either piece; of equal ranks the left is first.
        """
        pair = a << 32 | b
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) >= PAIRS // 2:  # walk() holds on to this dictionary
                self.judged = dict(self.stable)
                self.stable.clear()
            known = self.judged.get(pair)
            if known is not None:
                self.stable[pair] = known
                return known
            known = not self.joined(a, b)
            self.stable[pair] = known
        return known

    def joined(self, a: int, b: int) -> bool:
        rank, starts = self.rank, self.spine(b, 0)
        for x, x_until in self.spine(a, 1):
            for y, y_until in starts:
                at = rank.get((x, y))
                if at is not None and at < x_until and at <= y_until:
                    return True
        return False

    def walk(self, words: list[str]) -> None:
        """Encodes new words over their trie and remembers them."""
        move, after, ending, stable, together = self.move, self.after, self.ending, self.stable, self.together
        sizes, known = self.sizes, self.known
        path, states, last = b"", [0], []  # for each prefix of path: its state and last token
        for word in sorted(words):  # the order of their UTF-8 bytes
            raw = word.encode()
            shared = 0
            for a, b in zip(path, raw):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], last[shared:]
            state, end = states[-1], shared
            for byte in raw[shared:]:
                end += 1
                to = move.get(state << 8 | byte)
                state = after(state, byte) if to is None else to
                for size, token in ending[state]:
                    if size == end:
                        break
                    fits = stable.get(last[-size] << 32 | token)
                    if together(last[-size], token) if fits is None else fits:
                        break
                states.append(state)
                last.append(token)
            path, out = raw, []
            while end:
                token = last[end - 1]
                out.append(token)
                end -= sizes[token]
            out.reverse()
            known[word] = array("I", out).tobytes()

    def pieces(self, text: str) -> list[str]:
        """Texts between special tokens, and these, in turn."""
        return [text] if self.marks is None or not self.marks.search(text) else self.marks.split(text)

    def distinct(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for word in words:
            if word not in known:
                ids = older.pop(word, None)
                if ids is None:
                    new.append(word)
                else:
                    known[word] = ids
        self.walk(new)
        found = [known[w] for w in words]
        for word in new:
            if len(word) > LONG:
                del known[word]
        return found

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end of the last."""
        pieces, first = [], [0]
        for text in texts:
            pieces += self.pieces(text)
            first.append(len(pieces))
        whole = "".join(pieces)
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        edge = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(x) for x in pieces], out=edge[1:])
        start = word_starts(codes, edge) if len(codes) else np.ones(1, bool)
        special = [i for a, b in zip(first, first[1:]) for i in range(a + 1, b, 2)]
        for i in special:
            start[edge[i] + 1 : edge[i + 1]] = False
        at, data = np.flatnonzero(start), whole.encode()
        del codes, start
        places = at
        if len(data) > len(whole):
            places = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            places = np.append(places, len(data))[at]
        words = pa.Array.from_buffers(
            pa.large_string(), len(at) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        which = np.array(words.indices)
        found = self.distinct(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        if special:
            which[np.searchsorted(at, edge[special])] = np.arange(len(found), len(found) + len(special))
            found += [self.special[pieces[i]].to_bytes(4, "little") for i in special]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begins, counts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(counts) - counts, counts[which]
        total = np.zeros(len(at), np.int64)
        np.cumsum(counts, out=total[1:])
        return ids[taken(begins[which], counts)], total[np.searchsorted(at, edge[first])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        ids, at = self.encoded(texts)
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        tokens = self.tokens.take(pa.array(ids))
        ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][at]
        raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends), tokens.buffers()[2]])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def decode(self, ids: bytes) -> str:
        """The text of one text's ids."""
        return self.decoded(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))[0].as_py()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker reads a vocabulary once."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): every whole text's ids as little-endian 32-bit integers, and their decoded text.

    A null text counts as empty and has no ids; null and repeated ids are passed on, one row for each input row.
    """
    wanted = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0)
            ends, done = np.cumsum(np.array(sizes, np.int64)), 0
            while done < batch.num_rows:  # slices bound what is held beside the batch
                before = ends[done - 1] if done else 0
                upto = max(done + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
                part, done = batch.slice(done, upto - done), upto
                ids, at = own.encoded([x or "" for x in part["text"].to_pylist()])
                found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(np.diff(at), pa.int64()), found.cast(pa.binary()), own.decoded(ids, at)],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    kind = wanted.schema["id"].dataType.simpleString()
    return map_batches(wanted, lean(run), f"id {kind}, n_tokens long, ids binary, decoded string")


def query(spark, sf_dir):
    import public_tokenizers

    rows = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding of the pipeline: (doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = encode(docs.withColumn("_row", F.struct("doc_id", "lang", "source")), path, "_row")
    return rows.select(
        "id.doc_id", "id.lang", "id.source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
