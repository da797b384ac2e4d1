import random
import time

import numpy as np
import pyarrow as pa
import pytest

from codestrata.llm import graph, jaccard, tables
from codestrata.llm.text import slices

from . import brute


def check(spark, rows, k, percent):
    want = brute.classes(rows, k, percent)
    found = jaccard.join(brute.table(spark, rows), k, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == (None if r.id is None else want[r.id]), (r, want.get(r.id))
    sizes = sorted((i is None, i or 0, len(brute.shingles(t, k))) for i, t in rows)
    assert sorted((r.id is None, r.id or 0, r.n_shingles) for r in found) == sizes


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_awkward_tables(spark, k, percent):
    check(spark, brute.awkward(), k, percent)


def test_large_group_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = brute.sentence(rng, 150, 5000).split(" ")
    rows = []
    for i in range(70):  # around one text, most of them not similar enough to each other
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**6) * 100 + i, " ".join(own)))
    monkeypatch.setattr(jaccard, "BLOCK", 15)
    check(spark, rows, 3, 90)


def test_empty_tables(spark):
    assert jaccard.join(brute.table(spark, [])).collect() == []
    assert [r.component_id for r in jaccard.join(brute.table(spark, [(5, None), (5, "")])).collect()] == [5, 5]


def test_representatives_keep_all_columns(spark):
    rows = brute.awkward()
    docs = brute.table(spark, rows)
    left = jaccard.representatives(docs)
    want = brute.classes(rows, 5, 80)
    assert left.columns == docs.columns
    assert sorted(x.doc_id for x in left.filter("doc_id is not null").collect()) == sorted(
        i for i, _ in rows if i is not None and want[i] == i
    )
    assert left.filter("doc_id is null").count() == 2


@pytest.mark.parametrize("edges_of_a_task", [10**6, 20])
def test_components_of_long_paths_and_hubs(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(graph, "EDGES", edges_of_a_task)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (2003, 3000)]
    random.Random(1).shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    found = {r.node: r.component for r in graph.components(frame).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 1000 for i in [1000, 3000, *range(2000, 2050)]}
    assert graph.components(frame.filter("a < 0")).collect() == []


def test_components_when_tasks_merge_little(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES", 7)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(5)
    assert {r.component for r in graph.components(edges).collect()} == {0}


@pytest.mark.parametrize("held", [1 << 19, 3])
def test_families_follow_tokens_and_sizes(spark, monkeypatch, held):
    monkeypatch.setattr(jaccard, "HEADS", held)
    rng = random.Random(5)
    sets = [(node, rng.randrange(9), [rng.randrange(40) for _ in range(rng.randrange(4))]) for node in range(60)]
    sets.append((7, sets[7][1], sets[7][2]))  # a repeated row
    top = {node: node for node, _, _ in sets}
    for _ in sets:  # until nothing changes
        for a, la, ta in sets:
            for b, lb, tb in sets:
                if abs(la - lb) <= 1 and set(ta) & set(tb):
                    top[a] = top[b] = min(top[a], top[b])
    frame = spark.createDataFrame(sets, "node long, level short, tokens array<long>").repartition(3)
    found = {r.node: r.family for r in jaccard.families(frame).collect()}
    alone = {node for node in top if list(top.values()).count(top[node]) == 1}
    assert found == {node: family for node, family in top.items() if node not in alone}


def chained(rng, n, words=200):
    """Texts of which each shares a passage of rare words with the next and nothing else; the last two are near copies."""
    shared = [brute.sentence(rng, 30, 10**6) for _ in range(n)]
    rows = [(i, f"{shared[i]} {brute.sentence(rng, words, 50)} {shared[i + 1]}") for i in range(n - 1)]
    return [*rows, (n - 1, f"{rows[-1][1]} end")]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_texts_of_loose_families_do_not_move(spark, monkeypatch, k, percent):
    rows = chained(random.Random(3), 60)
    moved, some_of = [], jaccard.some_of
    monkeypatch.setattr(jaccard, "some_of", lambda ids: moved.extend(r.node for r in ids.select("node").collect()) or some_of(ids))
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    check(spark, rows, k, percent)
    assert sorted(moved) == [58, 59]


def sets_of(rng, k, percent):
    """Texts around a few others, of 1 to 900 words, with their node, size, bitmap and set."""
    texts = []
    for size in (1, 2, 4, 9, 30, 70, 150, 300, 700, 900):
        base = brute.sentence(rng, size, 4000).split(" ")
        for _ in range(6):
            rate = rng.choice((0, 0.004, 0.02))
            own = [w for w in base if rng.random() >= rate]
            for _ in range(rng.randrange(1 + int(2 * rate * len(own)))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(1 + size // 12))]) or "z")
    found, maps = [], []
    for _, w in slices(pa.array(texts), lower=True, size=1000):
        sets = jaccard.Sets(w, k, None)
        found += [set(sets.token[a:b].tolist()) for a, b in zip(sets.off, sets.off[1:])]
        maps += sets.bitmaps(percent).to_pylist()
    return found, maps


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 45)])
@pytest.mark.parametrize("sides", [1, 2])
def test_near_bitmaps_connect_all_similar_sets(k, percent, sides):
    rng = random.Random(percent)
    found, maps = sets_of(rng, k, percent)
    node, n = rng.sample(range(10**6), len(found)), [len(x) for x in found]
    side = [rng.randrange(sides) for _ in found]
    family = [x % 2 for x in range(len(found))]
    columns = [pa.array(x, pa.int64()) for x in (node, n, family, side)]
    group = pa.table([*columns, pa.array(maps, pa.binary())], ["node", "n", "family", "side", "bits"])
    links = list(zip(*(x.tolist() for x in jaccard.near_within(group, percent))))
    label = {x: x for x in node}
    for a, b in links:
        label = {x: label[a] if y == label[b] else y for x, y in label.items()}
    similar = 0
    for x in range(len(found)):
        for y in range(x):
            if family[x] == family[y] and (sides == 1 or side[x] != side[y]):
                common = len(found[x] & found[y])
                if 100 * common >= percent * len(found[x] | found[y]):
                    similar += 1
                    assert label[node[x]] == label[node[y]], (n[x], n[y], common)
    assert similar > 5
    assert len(links) < len(found)
    where = {x: i for i, x in enumerate(node)}
    assert all(family[where[a]] == family[where[b]] and (sides == 1 or side[where[a]] != side[where[b]]) for a, b in links)
    # and little else: a linked pair has half of its tokens in common
    assert all(percent < 80 or 2 * len(found[where[a]] & found[where[b]]) >= max(n[where[a]], n[where[b]]) for a, b in links)


def test_a_bitmap_is_no_farther_than_its_set():
    found, maps = sets_of(random.Random(1), 3, 80)
    bits = [np.frombuffer(x, np.uint8) for x in maps]
    for x in range(len(found)):
        for y in range(x):
            if len(bits[x]) == len(bits[y]):
                assert np.bitwise_count(bits[x] ^ bits[y]).sum() <= len(found[x] ^ found[y])
    assert [len(x) * 8 for x in bits] == jaccard.bitmap_sizes(np.array([len(x) for x in found]), 80).tolist()


def test_blocks_by_size_meet_where_sizes_fit(spark):
    rng = random.Random(4)
    members = [(i, rng.randrange(50, 400), 1) for i in range(300)] + [(i, 77, 2) for i in range(300, 350)] + [(400, 9, 3), (401, 9, 3)]
    frame = jaccard.with_size(spark.createDataFrame(members, "node long, n long, family long"), 20, 6000).persist()
    rows = jaccard.dealt_out(frame, 90, 1000, 20, 6000).collect()
    met, units = set(), {}
    for r in rows:
        units.setdefault(r.unit, []).append(r)
    for unit in units.values():
        sides = {r.side for r in unit}
        assert len({r.family for r in unit}) == 1 and len(unit) <= 2 * 45
        for x in unit:
            met |= {(min(x.node, y.node), max(x.node, y.node)) for y in unit if len(sides) == 1 or x.side != y.side}
    for i, n, family in members:
        for j, m, other in members:
            if i < j and family == other and 100 * min(n, m) >= 90 * max(n, m):
                assert (i, j) in met
    blocks = {r.node: r.blocks for r in frame.collect()}
    assert len(rows) < 0.5 * sum(blocks.values())  # most pairs of blocks don't fit


def test_shuffle_files_of_a_join_do_not_stay(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        files = env.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before, key = left(), spark.conf.get(tables.SHUFFLE_CLEANUP)
    jaccard.join(brute.table(spark, brute.awkward()), 3, 90)
    until = time.time() + 30
    while (stay := {x for x in left() - before if x.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.5)
    assert not stay
    assert spark.conf.get(tables.SHUFFLE_CLEANUP) == key
