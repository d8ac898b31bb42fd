import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kgspark.llm import pieces as P
from kgspark.llm import queries as Q


@pytest.fixture(scope="module")
def both():
    path = Q.vocabulary(Q.PIECE_MODEL)
    return P.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


PARTS = st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "▁", "▁▁", "é", "漢", "Ａ", "ﬁ", "😀", "<s>", "</s>", "<0x0A>", "<unk>", "!", "12", "é", "\0", "aaaa", "\t"]) | st.text(max_size=4), max_size=25)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_like_the_library(both, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    own, lib = both
    want = lib.encode(text)
    assert own.encode(text) == want
    assert own.decode(want) == lib.decode(want)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="the▁ino=é ", min_size=1, max_size=18))
def test_table_like_merging(both, text):
    own, _ = both
    word = P.MARK + text.replace(" ", "").replace(P.MARK, "")
    assert [own.names[i] for i in own.word(word)] == own.merged(word)


def test_ids_of_any_kind_decode_like_the_library(both):
    own, lib = both
    draw = random.Random(3)
    for _ in range(2000):
        ids = [draw.randrange(len(own.names)) if draw.random() < 0.6 else draw.randrange(260) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids)


def test_long_runs(both):
    own, lib = both
    for text in ("ab" * 20_000 + "a" * 10_000, "x" * 30_000, " " * 5001 + "x", "😀" * 3000, "Ａ" * 3000):
        assert own.encode(text) == lib.encode(text)


def test_forgetting_changes_nothing(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(P, "REMEMBERED", 3)
    monkeypatch.setattr(P, "PAIRS", 2)
    for text in ("one two three four five six", "six five four three two one", "seven one", "y" * 70 + " one"):
        assert own.encode(text) == lib.encode(text)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "x.model").write_bytes(b"")
    with pytest.raises(ValueError):
        P.Pieces(str(tmp_path / "x.model"))


def test_rows(both, odd, empty):
    own, lib = both
    path = Q.vocabulary(Q.PIECE_MODEL)
    coded = P.encode(odd, path)
    assert set(odd.columns) == set(coded.columns) and coded.count() == odd.count()
    for r in coded.collect():
        assert r.ids == lib.encode(r.text or "")
    for r in P.decode(coded, path).collect():
        assert r.decoded == (r.text or "")
    got = sorted(map(tuple, P.round_trip(odd, path).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, len(ids := lib.encode(r.text or "")), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for r in odd.collect()]
    assert got == sorted(want, key=str)
    assert P.encode(empty, path).count() == P.round_trip(empty, path).count() == 0


def test_query_like_the_library(spark, both, sf):
    _, lib = both
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op13_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = lib.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
