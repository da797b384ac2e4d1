import hashlib
import time

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import bpe

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(st.sampled_from("etaoin  \n'sll09<|endoftext|>é😀"), max_size=80))
def test_any_text_is_encoded_and_decoded_as_the_library_does(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    (found,) = own.encode([text])
    assert np.frombuffer(found, "<u4").tolist() == ids
    assert own.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_long_words_and_runs_of_space(library, own):
    for text in ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b  ", "x" * 5000, " " * 700 + "y", "\n\n \n z", "ab" * 3000, ""]:
        (found,) = own.encode([text])
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("stmdrvel''  \n\tA1.\u3000\x85é中😀²"), max_size=30), max_size=5))
def test_words_start_where_the_pattern_finds_them(texts):
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    edge = np.cumsum([0, *map(len, texts)])
    words = [x for text in texts for x in SPLIT.findall(text)]
    if len(codes):
        assert np.flatnonzero(bpe.word_starts(codes, edge)).tolist() == np.cumsum([0, *map(len, words)]).tolist()


def test_words_that_occur_again_are_array_passes(library, own):
    """taking the words one by one out of the text alone costs more than encoding and decoding all of it."""
    texts = ["The word's place in a line, once more.\n" * 50] * 500
    found = own.encode(texts)
    assert np.frombuffer(found[-1], "<u4").tolist() == library.encode(texts[-1], add_special_tokens=False).ids
    took = []
    for run in (lambda: own.decoded(*own.encoded(texts)), lambda: [SPLIT.findall(text) for text in texts]):
        begin = time.process_time()
        run()
        took.append(time.process_time() - begin)
    assert took[0] < 0.7 * took[1]


def test_slices_of_a_batch_keep_rows_and_order(spark, own, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"<|endoftext|> row {i} it's é" * (i % 5)) for i in range(60)]
    whole = [own.encode([t or ""])[0] for _, t in rows]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 100)
    caught = {}
    monkeypatch.setattr(bpe, "map_batches", lambda df, run, schema: caught.update(run=run))
    bpe.encode(brute.table(spark, rows), PATH)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"id": i, "text": t} for i, t in rows], pa.schema([("id", pa.int64()), ("text", pa.string())]))
    parts = list(caught["run"](iter([batch])))
    out = pa.Table.from_batches(parts).to_pylist()
    assert len(parts) > 5 and [(r["id"], r["ids"], r["decoded"]) for r in out] == [(i, w, t or "") for (i, t), w in zip(rows, whole)]


def test_forgetting_words_changes_nothing(own, monkeypatch):
    texts = [f"word{i} other{i} thing" for i in range(50)]
    whole = own.encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    assert [x for t in texts for x in own.encode([t])] == whole


def test_words_used_of_late_stay_and_others_go(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "PAIRS", 40)
    own = bpe.Codec(PATH)
    for i in range(60):
        own.encode([f"often new{i} more{i}"])
        words, pairs = [*own.known, *own.older], [*own.stable, *own.judged]
        assert len(words) == len(set(words)) <= 20 + 2 * 5 and "often" in words  # five new words a call
    assert len(pairs) <= 40 + 2 * 20 and " new0" not in words


def test_a_worker_remembers_little():
    """Several workers share an executor with its heap: words and pairs of each are some 50 MB at most."""
    assert bpe.REMEMBERED <= 160_000 and bpe.PAIRS <= 240_000
    assert not {"ends", "starts"} & set(vars(bpe.Codec(PATH)))


def test_awkward_tables(spark, library):
    rows = brute.awkward()
    found = bpe.encode(brute.table(spark, rows), PATH).collect()
    want = sorted((i is None, i or 0, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in rows)
    assert sorted((r.id is None, r.id or 0, bytes(r.ids)) for r in found) == want
    assert sorted(r.decoded for r in found) == sorted(t or "" for _, t in rows)
    assert bpe.encode(brute.table(spark, []), PATH).collect() == []


def test_query_digests(spark, library, tmp_path):
    brute.table(spark, [(1, "Hello world"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in bpe.query(spark, str(tmp_path)).collect()}
    ids = np.array(library.encode("Hello world", add_special_tokens=False).ids, "<u4").tobytes()
    assert rows[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and rows[1].n_tokens == len(ids) // 4
    assert rows[2].n_tokens == 0 and rows[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
