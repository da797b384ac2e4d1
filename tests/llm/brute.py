"""Plain versions of what the operators compute, and small tables that hold the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, block long, n long, node long, family long, h long, _id string"


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def table(spark, rows):
    """Documents of (doc_id, text), with further columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", len(t or ""), 7, "k", 1, 2, 3, 4, 5, "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Null and repeated ids, null, empty and long texts, exact and near copies, shared passages."""
    rng = random.Random(seed)
    passage = sentence(rng, 70, 5000)
    long = sentence(rng, 6000)
    base = [sentence(rng, 120, 3000) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        parts = t.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        rows.append((20 + i, " ".join(parts)))
        rows.append((40 + i, t.replace(" ", "\n ")))
    rows += [(60 + i, f"{sentence(rng, 30 * i)} {passage}\t{sentence(rng, 10 * i)}") for i in range(1, 5)]
    rows += [(70, passage + " " + passage), (71, passage), (72, " ".join(passage.split(" ")[:49]))]
    rows += [(80, long), (81, "start " + long[: len(long) // 2] + " end"), (82, "a " * 300), (83, "a " * 200)]
    rows += [(90, None), (91, ""), (92, " \n\t"), (93, "one"), (93, "two words"), (94, "One"), (95, "ONE"), (None, passage), (None, None)]
    rows += [(3, base[3]), (3, base[3]), (97, "ÉTÉ x y \x1c z \x0b q"), (98, "É" * 50)]
    return rows


def without_repeats(rows, size=50):
    """{(id, text): (n_words, n_removed, sha256)} under the rule of the substring operators."""
    owner: dict[tuple, int] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                owner[tuple(w[k : k + size])] = min(i, owner.get(tuple(w[k : k + size]), i))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and owner[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, percent):
    """{id: smallest id reachable}; rows with one id are one document."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in parent}
