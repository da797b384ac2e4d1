"""Local alignment of two word sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1
PIECE = 64  # lengths of a that are searched at once


class Alignment(NamedTuple):
    score: int
    matches: int
    a_start: int  # first aligned word of a, and one past the last
    a_end: int
    b_start: int
    b_end: int


def local(a: np.ndarray, b: np.ndarray, diagonal: int = 0, band: int | None = None) -> Alignment:
    """The best Smith-Waterman alignment of a and b; within band steps of b index - a index = diagonal, if given.

    Row by row: along a row, the best way through gaps is a running maximum.  Of equal scores the first is taken.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return Alignment(0, 0, 0, 0, 0, 0)
    h = np.zeros((n + 1, m + 1), np.int32)
    steps = -GAP * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        same = np.where(b == a[i - 1], MATCH, MISMATCH)
        np.maximum(h[i - 1, :-1] + same, h[i - 1, 1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        if band is not None:
            row[: max(0, i + diagonal - band)] = 0
            row[max(0, i + diagonal + band + 1) :] = 0
        row = np.maximum.accumulate(row + steps) - steps
        if band is not None:
            row[max(0, i + diagonal + band + 1) :] = 0
        h[i] = row
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, a_end, b_end, matches = int(h[i, j]), int(i), int(j), 0
    while h[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return Alignment(score, matches, int(i), a_end, int(j), b_end)


def occurrences(
    a: np.ndarray, b: np.ndarray, good: Callable[[Alignment], bool], least: float, diagonal: int = 0, band: int | None = None
) -> list[Alignment]:
    """Alignments of a in b that don't overlap: the best, then the best before and after it, and so on, while they are good.

    Stretches of b with fewer than `least` words are left alone.
    """
    out, todo = [], [(0, len(b))]
    while todo:
        low, high = todo.pop()
        if high - low < max(least, 1):
            continue
        x = local(a, b[low:high], diagonal - low, band)
        if good(x):
            out.append(x._replace(b_start=x.b_start + low, b_end=x.b_end + low))
            todo += [(low, low + x.b_start), (low + x.b_end, high)]
    return sorted(out, key=lambda x: x.b_start)


def throughout(
    a: np.ndarray, b: np.ndarray, good: Callable[[Alignment], bool], least: float, diagonal: int = 0, band: int | None = None
) -> Iterator[Alignment]:
    """The occurrences of a in a b of any length, in order.

    A long b is taken in pieces that overlap by more than a good alignment can span; the piece in which an alignment
    begins reports it.
    """
    step, done = PIECE * len(a), 0
    for at in range(0, len(b), max(step, 1)):
        for x in occurrences(a, b[at : at + step + 3 * len(a)], good, least, diagonal - at, band):
            if done <= at + x.b_start < at + step:
                done = at + x.b_end
                yield x._replace(b_start=at + x.b_start, b_end=done)


def near(place: np.ndarray, group: np.ndarray, gap: int) -> np.ndarray:
    """For entries sorted by (group, place): the number of their run, where runs end at a larger gap."""
    new = np.ones(len(place), bool)
    new[1:] = (group[1:] != group[:-1]) | (place[1:] - place[:-1] > gap)
    return np.cumsum(new) - 1
