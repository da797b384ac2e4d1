import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import text as T
from codestrata.llm.align import local

TEXT = st.text(st.sampled_from("ab É \n\t\x0b\x1c<#1"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT | st.none(), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    found, hashes = [], {}
    for first, w in T.slices(pa.array(texts, pa.string())):
        for i in range(len(w)):
            own = re.findall(rb"[^\x20\x09-\x0D]+", (texts[first + i] or "").encode())
            assert len(w.of(i)) == len(own)
            for word, h in zip(own, w.of(i).tolist()):
                assert hashes.setdefault(word, h) == h
            found.append(own)
            assert w.joined(i) == b" ".join(own)
    assert len(found) == len(texts) and len(set(hashes.values())) == len(hashes)


def test_slices_do_not_change_hashes(monkeypatch):
    texts = pa.array([" ".join(f"w{i * j % 50}" for j in range(60)) for i in range(20)])
    whole = np.concatenate([w.h for _, w in T.slices(texts)])
    monkeypatch.setattr(T, "SLICE_BYTES", 100)
    parts = [w.h for _, w in T.slices(texts)]
    assert len(parts) > 5 and (np.concatenate(parts) == whole).all()


def test_window_hashes_depend_on_the_window_only():
    a = np.array([5, 6, 7, 8] * 40, np.uint64)
    for k in (3, 8, 9, 50):
        h = T.window_hashes(a, k)
        assert len(h) == len(a) - k + 1 and (h[4:] == h[:-4]).all() and len(set(h.tolist())) == 4
    assert len(T.window_hashes(a[:3], 9)) == 0


def test_terms_ignore_case_and_marks():
    (_, w), = T.slices(pa.array(["The IDIOT!! état, ÉTAT"]), terms=True)
    (_, v), = T.slices(pa.array(["the idiot état état"]), terms=True)
    assert (w.h == v.h).all()
    some, h = w.beginnings(3)
    assert [int(x) for x in some] == [1, 2, 3] and h[1] == h[2]


def test_alignment_finds_edited_copies():
    a = np.arange(1, 41)
    b = np.concatenate([np.arange(100, 120), a[:10], [500], a[11:20], a[22:], np.arange(200, 230)])
    x = local(a, b)
    assert (x.a_start, x.a_end, x.b_start, x.b_end) == (0, 40, 20, 20 + 38) and x.matches == 37
    assert local(a, b, diagonal=20, band=4) == x and local(a, np.arange(900, 950)).score == 0
    assert local(a[:0], b).score == 0
