"""Encoding by the merge agenda gives the library's ids; decoding gives the library's text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from lodgemetrics.llm import piece_codec
from lodgemetrics.llm.piece_codec import Vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def words():
    with open(MODEL, "rb") as f:
        return Vocabulary(f.read())


def ids_of(words, text):
    pieces = words.encode(words.library.normalize(text))
    return np.concatenate([np.zeros(0, np.int32), *pieces]).tolist(), pieces


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="  ▁aeinrst\n0139ü你<>s/", max_size=60))
def test_same_ids_and_text_as_the_library(words, text):
    ids, pieces = ids_of(words, text)
    assert ids == words.library.encode(text)
    assert words.decode(pieces) == words.library.decode(ids)


CASES = ["", " ", "   ", "▁", "a▁▁b", "<s>x</s>", "<0x41>", "a\x00b", "�", "🙂🙂", "word" * 40,
         "0123456789" * 30, " " * 100 + "x" + " " * 37, "\r\n\t  x"]


@pytest.mark.parametrize("text", CASES)
def test_odd_texts(words, text):
    ids, pieces = ids_of(words, text)
    assert ids == words.library.encode(text)
    assert words.decode(pieces) == words.library.decode(ids)


def test_long_texts_go_through_in_pieces(words, monkeypatch):
    monkeypatch.setattr(piece_codec, "PIECE", 50)
    rng = random.Random(1)
    text = "".join(rng.choice(["the ", "  ", "▁x", "ab ", "é", "🙂 ", "Zusammenhang ", "q" * 70, "\n"]) for _ in range(600))
    ids, pieces = ids_of(words, text)
    assert len(pieces) > 10 and ids == words.library.encode(text)
    assert words.decode(pieces) == words.library.decode(ids)


def test_long_text_without_spaces(words):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij你好") for _ in range(200_000))
    assert ids_of(words, text)[0] == words.library.encode(text)


def test_kept_segments_are_bounded(words, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT", 10)
    for i in range(50):
        assert ids_of(words, f"w{i} x{i} y{i}")[0] == words.library.encode(f"w{i} x{i} y{i}")
    assert len(words.kept) <= 10
    text = " ".join(f"w{i}" for i in range(40))
    assert ids_of(words, text)[0] == words.library.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=30) | st.text(alphabet="aeinrstlo▁", min_size=1, max_size=30), min_size=1, max_size=12))
def test_lockstep_is_the_agenda(words, segments):
    ids, n = words.together(segments)
    assert n.sum() == len(ids)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [words._one(s) for s in segments]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" abcde▁é🙂\n", max_size=40), max_size=6))
def test_many_texts_at_once(words, texts):
    got = words.encode_all([words.library.normalize(t) for t in texts])
    assert [x.tolist() for x in got] == [words.library.encode(t) for t in texts]


class Counted(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


def test_repeated_segments_are_not_looked_up_again(words, monkeypatch):
    kept = Counted(words.kept)
    monkeypatch.setattr(words, "kept", kept)
    texts = ["the cat " * 500, "the  dog the", "", " the cat"] * 3
    got = words.encode_all([words.library.normalize(t) for t in texts])
    assert [x.tolist() for x in got] == [words.library.encode(t) for t in texts]
    assert kept.asked <= 8  # of about 3,000 segments; those of texts with runs of spaces are told apart on their own


@pytest.mark.parametrize("lot", [1, 3, 7])
def test_segments_are_learned_in_lots(words, monkeypatch, lot):
    monkeypatch.setattr(piece_codec, "LOT", lot)
    words._forget()
    text = " ".join(["a", "Zusammenhang", "é", "🙂x", "b" * 31, "c" * 32, "d" * 33, "0a1", *(f"learn{i}" for i in range(20))])
    assert ids_of(words, text)[0] == words.library.encode(text)


def test_every_pair_is_found_and_no_other(words):
    one = words.nothing + 1
    rng = np.random.default_rng(3)
    key = np.concatenate([words.pair[:-1], rng.integers(0, one * one, 50_000), words.nothing * one + np.arange(50)])
    a, b = (x.astype(np.int32) for x in (key // one, key % one))
    there = {int(k): (int(r), int(i)) for k, r, i in zip(words.pair[:-1], words.pair_rank, words.pair_id)}
    assert list(zip(*(x.tolist() for x in words._offers(a, b)))) == [there.get(int(k), (-1, -1)) for k in key]


def test_rows(spark, words):
    rows = [(1, "hello  world", 5), (None, "x", 6), (2, None, 7), (3, "", 8), (1, "hello  world", 9), (4, " é<s>\n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    found = piece_codec.encoded(df, MODEL, decode=True)
    got = sorted(piece_codec.digest(found).collect(), key=str)
    want = []
    for d, t, _ in rows:
        ids = words.library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(words.library.decode(ids).encode()).hexdigest(), True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = {(r["doc_id"], r["text"]) for r in piece_codec.decoded(found, MODEL).collect()}
    assert (1, "hello  world") in back and (2, "") in back and (4, " é<s>\n") in back
    assert piece_codec.encoded(df.limit(0), MODEL).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert piece_codec.decoded(nothing, MODEL).first()["text"] == ""
