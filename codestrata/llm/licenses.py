"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment reports what matches.

Fingerprints are hashes of N consecutive terms (runs of letters and digits, in small letters), of which every window of
WINDOW neighbours keeps its smallest, in templates as in documents: any run of N + WINDOW - 1 terms that both have in
common shares one.  Hits of one template on nearby diagonals are a candidate, and aligning the template with that stretch
of the document gives matched terms and span.

A match is as similar as its matched terms are to all terms of template and span: terms left out, put in and replaced
count alike.  In short templates (notices) the terms that name licenses and versions must be the same in template and
span, so the notice of one license is none of its relatives.  Of matches that overlap the one with most matched terms
after deducting the others stands.

Templates go to the tasks in blocks of at most BLOCK_WORDS terms, so their number is not limited; documents stay where
they are read.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codestrata.llm.align import Alignment, near, throughout
from codestrata.llm.license_texts import NAMING, TEMPLATES
from codestrata.llm.tables import map_batches, table
from codestrata.llm.text import Words, slices, window_hashes

N = 3
WINDOW = 3
BAND = 8  # steps that an alignment may leave the diagonal of its first hit
LEAST_SIMILARITY = 0.8
NOTICE_TERMS = 60  # templates up to this length are notices
BLOCK_WORDS = 1_000_000


class Match(NamedTuple):
    """A template's place in a document: words and bytes of the document, the end excluded."""

    template: str
    similarity: float
    coverage: float
    matched: int
    template_terms: int
    word_start: int
    word_end: int
    byte_start: int
    byte_end: int

    def weight(self) -> int:
        return 3 * self.matched - self.template_terms - (self.word_end - self.word_start)


def standing(found: list[Match]) -> list[Match]:
    """Of matches that overlap the heaviest, in the document's order; of equal ones the most similar, first, least name."""
    places: list[tuple[int, int]] = []
    out = []
    for x in sorted(found, key=lambda x: (-x.weight(), -x.similarity, x.word_start, x.template)):
        k = bisect(places, (x.word_start, x.word_end))
        if (k == 0 or places[k - 1][1] <= x.word_start) and (k == len(places) or x.word_end <= places[k][0]):
            insort(places, (x.word_start, x.word_end))
            out.append(x)
    return sorted(out, key=lambda x: x.word_start)


def terms_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), terms=True).h


def similarity(x: Alignment, size: int) -> float:
    """Matched terms as a share of all terms of the template (size) and the aligned span, matched ones counted once."""
    return x.matches / (size + (x.b_end - x.b_start) - x.matches)


def winnowed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the hashes that are the smallest of some WINDOW neighbours in their text, or of a shorter text."""
    keep = np.zeros(len(h), bool)
    for before in range(WINDOW):  # the window that begins `before` places earlier
        least = np.ones(len(h), bool)
        for step in range(-before, WINDOW - before):
            if step == 0:
                continue
            other = np.arange(len(h)) + step
            inside = (other >= 0) & (other < len(h))
            at = np.where(inside, other, 0)
            inside &= text[at] == text
            # of equal hashes the last counts; a window that the text cuts short counts as it is
            least &= ~inside | (h < h[at]) | ((h == h[at]) & (step < 0))
        keep |= least
    return np.flatnonzero(keep)


class Index:
    """A block of templates, and the templates and places of each of their fingerprints."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.ids, self.words = [i for i, _ in rows], [terms_of(text) for _, text in rows]
        self.names = np.unique(terms_of(NAMING))
        self.named = [self.naming(w) for w in self.words]
        self.sizes = np.array([len(x) for x in self.words])
        hashes, owners, places = [], [], []
        for k, w in enumerate(self.words):
            h = window_hashes(w, N)
            at = winnowed(h, np.zeros(len(h), int))
            hashes.append(h[at]), owners.append(np.full(len(at), k)), places.append(at)
        h, owner, place = (np.concatenate(x) if x else np.zeros(0, int) for x in (hashes, owners, places))
        order = np.lexsort((place, owner, h))
        self.h, self.owner, self.place = h[order].astype(np.uint64), owner[order], place[order]

    def naming(self, terms: np.ndarray) -> np.ndarray:
        """The terms that name licenses or versions, in order of their hash."""
        return np.sort(terms[np.isin(terms, self.names)])

    def candidates(self, w: Words) -> list[tuple[int, int, int, int]]:
        """(text, template, lowest and highest diagonal) of hits that lie together."""
        h, inside = window_hashes(w.h, N), w.inside(N)
        at = np.flatnonzero(inside)
        text = w.text_of()
        at = at[winnowed(h[at], text[at])]
        low = np.searchsorted(self.h, h[at], "left")
        some = np.flatnonzero(low < len(self.h))
        some = some[self.h[low[some]] == h[at[some]]]
        at, low = at[some], low[some]
        count = np.searchsorted(self.h, h[at], "right") - low
        first = np.repeat(np.cumsum(count) - count, count)
        hit = np.repeat(low, count) + np.arange(len(first)) - first
        at = np.repeat(at, count)
        diagonal, group = at - self.place[hit], text[at].astype(np.int64) * len(self.ids) + self.owner[hit]
        order = np.lexsort((diagonal, group))
        diagonal, group = diagonal[order], group[order]
        run = near(diagonal, group, BAND)
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        end = np.append(begin[1:], len(run)) - 1 if len(run) else begin
        return [
            (int(group[a]) // len(self.ids), int(group[a]) % len(self.ids), int(diagonal[a]), int(diagonal[b]))
            for a, b in zip(begin, end)
        ]

    def matches(self, w: Words, least: float) -> Iterator[tuple[int, Match]]:
        """(text, match) for every template in the texts of w, overlapping ones included."""
        for t, k, low, high in self.candidates(w):
            size = int(self.sizes[k])
            begin = max(int(w.off[t]), low - BAND)
            stretch = w.h[begin : min(int(w.off[t + 1]), high + size + BAND)]
            # no alignment matches more terms than the stretch has of the template, or names that the stretch lacks
            if np.isin(stretch, self.words[k]).sum() < least * size:
                continue
            notice = size <= NOTICE_TERMS
            if notice and not np.isin(self.named[k], stretch).all():
                continue

            def good(x: Alignment, size: int = size) -> bool:
                return similarity(x, size) >= least

            for x in throughout(self.words[k], stretch, good, least * size, low - begin, BAND + high - low):
                if notice and not np.array_equal(self.naming(stretch[x.b_start : x.b_end]), self.named[k]):
                    continue
                a, b, at, first = begin + x.b_start, begin + x.b_end, int(w.at[t]), int(w.off[t])
                span = a - first, b - first, int(w.start[a]) - at, int(w.end[b - 1]) - at
                yield t, Match(self.ids[k], similarity(x, size), x.matches / size, x.matches, size, *span)


def blocks(templates: list[tuple[str, str]] | DataFrame) -> Iterator[Index]:
    rows, words = [], 0
    if isinstance(templates, DataFrame):
        templates = (tuple(r) for r in templates.dropna().distinct().orderBy(*templates.columns).toLocalIterator())
    for name, text in templates:
        rows.append((name, text))
        words += len(text.split())
        if words >= BLOCK_WORDS:
            yield Index(rows)
            rows, words = [], 0
    if rows:
        yield Index(rows)


FIELDS = {
    "template": ("string", pa.string()), "similarity": ("double", pa.float64()), "coverage": ("double", pa.float64()),
    **{c: ("long", pa.int64()) for c in Match._fields[3:]},
}
MATCHES = pa.list_(pa.struct([(c, kind) for c, (_, kind) in FIELDS.items()]))


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, least: float = LEAST_SIMILARITY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, template, similarity, coverage, matched, template_terms, word_start, word_end, byte_start, byte_end): what stands.

    similarity counts the terms left out, put in and replaced; coverage is the share of the template's terms that are
    matched.  Spans count terms and UTF-8 bytes of the document, the end excluded.  Templates are (name, text) pairs or a
    DataFrame of these two columns; each needs at least N + WINDOW - 1 terms, and an occurrence is found if so many of
    them stand together unchanged and no more than BAND are put in or left out at one place.  A null or empty text
    matches nothing; repeated documents have their rows each; of equal matches the template of least name stands.  A text
    of any length is searched whole; its task holds some 40 bytes for each byte of it.
    """
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    fields = ", ".join(f"{c} {sql}" for c, (sql, _) in FIELDS.items())
    indexes = list(blocks(TEMPLATES if templates is None else templates))
    if not indexes:
        return docs.sparkSession.createDataFrame([], f"id {kind}, {fields}")
    nested = "array<struct<" + ", ".join(f"{c}: {sql.replace('long', 'bigint')}" for c, (sql, _) in FIELDS.items()) + ">>"
    for index in indexes[:-1]:
        # every block adds to the matches of its forerunners, as what stands is known after the last one only
        kept = map_batches(kept, adding(index, least), f"id {kind}, text {kept.schema['text'].dataType.simpleString()}, found {nested}")
    return map_batches(kept, reporting(indexes[-1], least), f"id {kind}, {fields}")


def with_found(batch: pa.RecordBatch, index: Index, least: float) -> list[list[Match]]:
    """The matches of each text of a batch, those of earlier blocks included."""
    found: list[list[Match]] = [[] for _ in range(batch.num_rows)]
    if "found" in batch.schema.names:
        found = [[Match(**x) for x in known] for known in batch["found"].to_pylist()]
    for first, w in slices(batch["text"], terms=True):
        for t, x in index.matches(w, least):
            found[first + t].append(x)
    return found


def adding(index: Index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x._asdict() for x in own] for own in with_found(batch, index, least)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text"], pa.array(found, MATCHES)], ["id", "text", "found"])

    return run


def reporting(index: Index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, x) for i, own in enumerate(with_found(batch, index, least)) for x in standing(own)]
            columns = [batch["id"].take(pa.array([i for i, _ in rows], pa.int64()))]
            columns += [pa.array([x[k] for _, x in rows], kind) for k, (_, kind) in enumerate(FIELDS.values())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *FIELDS])

    return run


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
