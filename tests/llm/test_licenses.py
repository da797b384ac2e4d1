"""License scans: each notice and text gives its own license, as aligning every template with every text does."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import licenses
from codestrata.llm.align import occurrences
from codestrata.llm.license_texts import NAMING, TEMPLATES

from . import brute


def test_license_spans_and_edits(spark):
    rng = random.Random(2)
    mit = dict(licenses.TEMPLATES)["MIT-permission"]
    edited = mit.replace("free of charge", "at no charge").replace(" and/or sell", " or sell").replace("\"", "“")
    rows = [
        (1, f"É {brute.sentence(rng, 30)}\nReleased under the MIT License. {brute.sentence(rng, 9)}"), (2, edited.upper()),
        (3, "# " + mit.replace(" ", "\n# ")), (4, "license mit under released"), (5, None), (6, ""), (None, "Licensed under CC BY-NC 4.0"),
        (7, "Licensed under the Apache License, Version 2.0. " * 3),
    ]
    found = licenses.scan(brute.table(spark, rows)).collect()
    by = Counter((r.id, r.template) for r in found if r.similarity >= 0.95)
    assert by[1, "MIT"] == 1 and by[3, "MIT-permission"] == 1 and by[None, "CC-BY-NC-4.0"] == 1 and by[7, "Apache-2.0"] == 3
    assert any((r.id, r.template) == (2, "MIT-permission") and r.coverage > 0.9 for r in found)
    assert not {r.id for r in found} & {4, 5, 6}
    (one,) = [r for r in found if r.id == 1]
    assert rows[0][1].encode()[one.byte_start : one.byte_end] == b"Released under the MIT License"


def test_license_templates_as_a_table_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK_WORDS", 1)
    templates = spark.createDataFrame([("a", "one two three four five six"), ("b", "x y"), ("c", None)], "name string, text string")
    docs = brute.table(spark, [(1, "zero ONE two, three four five six seven")])
    assert [(r.template, r.coverage) for r in licenses.scan(docs, templates).collect()] == [("a", 1.0)]
    assert licenses.scan(docs, templates.filter("name = 'z'")).collect() == [] == licenses.scan(brute.table(spark, [])).collect()


def test_winnowing_keeps_the_least_of_each_window():
    rng = np.random.default_rng(5)
    h, text = rng.integers(0, 6, 200).astype(np.uint64), np.repeat([0, 1, 2, 3], [90, 2, 8, 100])
    want = set()
    for t in range(4):
        own = np.flatnonzero(text == t)
        for a in range(max(1, len(own) - licenses.WINDOW + 1)):
            window = own[a : a + licenses.WINDOW]
            want.add(int(max(window, key=lambda i: (-int(h[i]), i))))
    assert want <= set(licenses.winnowed(h, text).tolist())


def test_each_template_is_its_own_license_only(spark):
    rng = random.Random(3)
    docs = [(i, f"{brute.sentence(rng, 20)}\n{text}\n{brute.sentence(rng, 20)}") for i, (_, text) in enumerate(TEMPLATES)]
    found = licenses.scan(brute.table(spark, docs)).collect()
    assert sorted((r.id, r.template, r.similarity) for r in found) == [(i, name, 1.0) for i, (name, _) in enumerate(TEMPLATES)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("licensed under cc-by-nc-sa-3.0", ["CC-BY-NC-SA-3.0"]),
        ("This is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("Licensed under the GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("Licensed under the GNU General Public License version 9", []),
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", ["Apache-2.0", "MIT"]),
        ("Released under the MIT License. " * 400, ["MIT"] * 400),
    ],
)
def test_related_licenses_are_told_apart(text, want):
    index, data = licenses.Index(TEMPLATES), np.frombuffer(text.encode(), np.uint8)
    w = licenses.Words(data, np.array([0, len(data)]), terms=True)
    assert [x.template for x in licenses.standing([x for _, x in index.matches(w, 0.8)])] == want


def by_hand(text, templates, least=0.8):
    """Every template aligned with the whole text, then the heaviest of those that overlap."""
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    number: dict = {}
    code = lambda ws: np.array([number.setdefault(x, len(number)) for x in ws])
    names, words, found = set(NAMING.split()), split(text), []
    for name, t in templates:
        own = split(t)
        share = lambda x: x.matches / (len(own) + x.b_end - x.b_start - x.matches)  # noqa: E731,B023
        for x in occurrences(code(own), code(words), lambda x: share(x) >= least, 1):
            span = words[x.b_start : x.b_end]
            if len(own) > licenses.NOTICE_TERMS or sorted(names & {*own}) == sorted(names & {*span}):
                found.append((3 * x.matches - len(own) - len(span), share(x), -x.b_start, name, x.b_end))
    out = []
    for x in sorted(found, key=lambda x: (-x[0], -x[1], -x[2], x[3])):
        if all(x[4] <= -y[2] or y[4] <= -x[2] for y in out):
            out.append(x)
    return sorted((-x[2], x[4], x[3], round(x[1], 9)) for x in out)


def test_as_aligning_every_template_with_every_text(spark):
    rng = random.Random(9)
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 2) if len(words) > 9 else 0):
                at = rng.randrange(8, len(words))
                words[at : at + rng.randint(0, 1)] = ["edited"] * rng.randint(0, 2)
            parts += [brute.sentence(rng, 12), " ".join(words)]
        docs.append((i, " ".join(parts)))
    found: dict = {i: [] for i, _ in docs}
    for r in licenses.scan(brute.table(spark, docs)).collect():
        found[r.id].append((r.word_start, r.word_end, r.template, round(r.similarity, 9)))
    assert sum(map(len, found.values())) > 50
    for i, text in docs:
        assert sorted(found[i]) == by_hand(text, TEMPLATES)


def test_ties_blocks_and_repeated_documents(spark, monkeypatch):
    text = "zero one two three four five six seven"
    docs = brute.table(spark, [(1, text), (1, text), (None, text), (2, None), (3, "")])
    templates = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "two three four five six"), ("d", "one")]
    whole = sorted((r.id or 0, r.template, r.word_start) for r in licenses.scan(docs, templates).collect())
    assert whole == [(0, "a", 1), (1, "a", 1), (1, "a", 1)]
    monkeypatch.setattr(licenses, "BLOCK_WORDS", 1)
    assert sorted((r.id or 0, r.template, r.word_start) for r in licenses.scan(docs, templates).collect()) == whole


def test_a_very_long_text_is_searched_whole(spark):
    rng = random.Random(1)
    text = " ".join([brute.sentence(rng, 150_000), "Released under the MIT License.", brute.sentence(rng, 150_000), dict(TEMPLATES)["ISC-text"]])
    found = licenses.scan(brute.table(spark, [(1, text)])).collect()
    assert [(r.template, r.similarity) for r in found] == [("MIT", 1.0), ("ISC-text", 1.0)]
