import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kgspark.llm import bpe as B
from kgspark.llm import tokens as K
from kgspark.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    return B.Bpe(vocabulary()), Tokenizer.from_file(vocabulary())


PIECES = st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "漢", "²", "😀", "'s", "'ll", "<|endoftext|>", "!", "12", " ", "\0"]) | st.text(max_size=4), max_size=25)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_like_the_library(both, pieces):
    text = "".join(pieces).encode("utf-8", "ignore").decode()
    own, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_long_runs(both):
    own, lib = both
    for text in ("ab" * 20_000 + "a" * 10_000, "x" * 30_000, " " * 5000):
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(B, "REMEMBERED", 3)
    for text in ("one two three four five six", "six five four three two one", "seven one"):
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_rows(both, odd, empty):
    lib = both[1]
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    got = B.round_trip(odd, vocabulary()).collect()
    assert len(got) == odd.count() and B.round_trip(empty, vocabulary()).count() == 0
    for r in got:
        if r.doc_id is not None:
            ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_encode_and_decode_columns(odd):
    coded = B.encode(odd, vocabulary())
    assert coded.columns == [c for c in odd.columns if c != "ids"] + ["ids"]
    back = B.decode(coded, vocabulary())
    assert back.where("NOT (coalesce(text, '') <=> decoded)").count() == 0
    checked = B.encode_checked(odd, vocabulary())
    assert checked.columns == [c for c in odd.columns if c not in ("text", "ids")] + ["ids", "n_tokens"] and checked.count() == odd.count()


def test_token_counts(both, odd, empty):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    got = K.token_counts(odd, vocabulary()).collect()
    assert len(got) == odd.count() and K.token_counts(empty, vocabulary()).count() == 0
    plain = Tokenizer.from_file(vocabulary())
    plain.encode_special_tokens = True
    assert all(r.n_tokens == len(plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in got if r.doc_id is not None)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.sampled_from([2, 4, 6, 64]), st.sampled_from([2, 4]))
def test_scan_like_a_loop(spark, tmp_path_factory, ids, block, width):
    path = tmp_path_factory.mktemp("flat") / "f.bin"
    path.write_bytes(np.array(ids, f"<u{width}").tobytes())
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 3:
            want.append((start, i - start))
            start = i + 1
    if start < len(ids):
        want.append((start, len(ids) - start))
    files = spark.createDataFrame([(f"file://{path}", len(ids) * width)], "file string, bytes long")
    got = K.scan(files, 3, width, block * width // 2 if block * width // 2 % width == 0 else block * width).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens) for r in got] == want and [r.ordinal for r in got] == list(range(len(want)))


def test_scan_refuses_broken_files(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole ids"):
        K.scan(spark.createDataFrame([(f"file://{tmp_path}/f.bin", 3)], "file string, bytes long"), 1).collect()


def test_both_forms_of_the_tree_give_the_same_ids():
    own = B.Bpe(vocabulary())
    draw = random.Random(3)
    for _ in range(2000):
        piece = bytes(draw.choice(b"thenation ab\xc3\xa9\xffxyz0") for _ in range(draw.randint(2, 40)))
        ids = [own.of_byte[b] for b in piece]
        ranks = [own.ranks.get(a * own.size + b, B.NONE) for a, b in zip(ids, ids[1:])]
        assert own._one_node(list(ids), list(ranks)) == own._tree(list(ids), list(ranks))
