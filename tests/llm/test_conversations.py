"""Conversation repair against a search over all edits, with nulls, ties, repeated rows and very long conversations."""

import hashlib
import random
import re
import time
import zlib

import pytest

from codestrata.llm import conversations as V

SCHEMA = "conv_id long, turn long, role string, text string, cost long, digest string, fold long"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fold = zlib.crc32(key.encode()) % 20
        if fold == 0:
            continue
        text = "" if fold == 1 else re.sub("[.!?]", "", text) if fold == 2 else text
        out += [(conv, turn, "user" if fold == 4 else role, text)] * (2 if fold == 3 else 1)
    return out


def plain(rows, ids):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} by a table over positions and endings."""
    result = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, turns = set(), [], [r[1] for r in own if r[1] is not None]
        for _, _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        # best[ending] = (cost, audit, lines); an ending is what the repaired conversation ends with
        after = {"": "su", "s": "u", "u": "a", "a": "u"}

        def inserted(best):
            for _ in range(3):
                for end, (cost, audit, lines) in list(best.items()):
                    for x in after[end].replace("s", ""):
                        new = (cost + 5, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[x]])
                        if x not in best or new[:2] < best[x][:2]:
                            best[x] = new
            return best

        best = inserted({"": (0, "", [])})
        for (_, _, role, text), fault in zip(own, faults):
            step = {}

            def offer(end, cost, audit, lines):
                if end not in step or (cost, audit) < step[end][:2]:
                    step[end] = (cost, audit, lines)

            for end, (cost, audit, lines) in best.items():
                offer(end, cost + 2, audit + "D", lines)
                if fault in ("b", "d"):
                    continue
                more = 5 if fault == "t" else 0
                for x in after[end]:
                    if x == role[:1]:
                        offer(x, cost + more, audit + "K", [*lines, f"{role}:{text}"])
                    if x != "s":
                        offer(x, cost + more + 1, audit + "R", [*lines, {"u": "user:", "a": "assistant:"}[x] + text])
            best = inserted(step)
        cost, audit, lines = min((best[e] for e in ("", "a") if e in best), key=lambda v: v[:2])
        assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha, lines)
    return result


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 3) for r in rows], SCHEMA)


def found(frame):
    rows = frame.collect()
    out = {r.conv_id: tuple(r)[1:8] + (r.repaired_sha256,) for r in rows}
    assert len(out) == len(rows)
    return out


def awkward(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Same again.", "ÉTÉ 雪.", "x. \t"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "admin"]
    rows = []
    for conv in range(60):
        n = rng.choice([1, 2, 3, 5, 9])
        for i in range(n):
            turn = None if rng.random() < 0.1 else rng.choice([i, i, i, rng.randrange(n), i * 3])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    rows += [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (None, 2, None, None)]
    rows += [rows[5]] * 3
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_are_the_cheapest(spark, seed):
    rows = awkward(seed)
    expected = plain(after_damage(rows), {r[0] for r in rows})
    assert found(V.reports(V.damaged(table(spark, rows)))) == {c: v[:8] for c, v in expected.items()}


def test_long_conversations_run_in_stretches(spark):
    rng = random.Random(3)
    rows = []
    for conv, roles in enumerate([["user", "assistant"], ["user"], ["system", "tool", "user"], ["assistant", "user"]]):
        for i in range(400):
            text = rng.choice(["Fine.", "cut", ""]) if conv % 2 else f"Turn {i}."
            rows.append((conv, i, rng.choice(roles) if conv else roles[i % 2], text + (str(i) + rng.choice([".", ""]) if text else "")))
    expected = plain(after_damage(rows), set(range(4)))
    frame = V.damaged(table(spark, rows))
    assert found(V.reports(frame)) == {c: v[:8] for c, v in expected.items()}
    turns = {}
    for r in sorted(V.repaired(frame).collect(), key=lambda r: (r.conv_id, r.position)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert turns == {c: v[8] for c, v in expected.items() if v[8]}


def test_rows_as_they_are_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Good day."), (2, 0, "assistant", "Good day.")]
    assert found(V.reports(V.as_read(table(spark, rows))))[1][5:7] == (0, "KK")
    assert found(V.reports(V.as_read(table(spark, rows))))[2][5:7] == (2, "D")
    assert V.reports(V.damaged(table(spark, []))).collect() == []
    assert V.repaired(V.as_read(table(spark, []))).collect() == []


def test_a_conversation_of_a_hundred_thousand_turns_stays_small():
    """Stretches are written out as soon as the items agree, whatever the turns are."""
    rng = random.Random(4)
    for texts in (["Fine.", "cut"], ["cut"], ["Fine."]):
        c, most, start = V.Conversation(1, False), 0, time.time()
        for i in range(100_000):
            text = f"{rng.choice(texts)[:-1]}{i}" + ("." if rng.random() < 0.5 and texts != ["cut"] else "")
            c.feed(i, rng.choice(["user", "assistant", "tool"]), text, V.CLEAN if text.endswith(".") else V.TRUNCATED)
            most = max(most, sum(len(p.stretches) for p in c.paths.values()))
        c.finish()
        assert most <= 8 and time.time() - start < 60


def test_given_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = plain(after_damage(rows), {r[0] for r in rows})
    assert found(V.query(spark, sf)) == {c: v[:8] for c, v in expected.items()}
