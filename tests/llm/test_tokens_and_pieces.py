import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.pieces import ONE_IN, WINDOW, Cutter, landmarks, pieces, rolling
from shelfmark.llm.tokens import LEAF, TOKENIZER, Encoder, stable, texts_of, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the public rank file")
TEXT = st.text(st.sampled_from(" \n\t'slldre  ，。a1é中文　😀<|>éá\r.-"), max_size=120)


@pytest.fixture(scope="module")
def small():
    return Encoder(open(TOKENIZER, "rb").read(), leaf=7)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_tree_is_exact(small, text):
    assert small.encode(text) == (small.core.encode_ordinary(text) if text else [])


def test_tree_on_long_texts(small):
    rnd = random.Random(3)
    for text in ["中" * 5000, "ab" * 4000, " " * 3000, "a\n" * 2000, "".join(rnd.choice("ab c，\n中1'") for _ in range(20_000)), "don't we'll " * 900]:
        assert small.encode(text) == small.core.encode_ordinary(text)
        assert small.core.decode(small.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 119))
def test_stable_places_are_boundaries_of_every_split(small, text, at):
    if at < len(text) and stable(text, at):
        assert small.core.encode_ordinary(text) == small.core.encode_ordinary(text[:at]) + small.core.encode_ordinary(text[at:])


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_decoding_gives_the_text_back(small, text):
    assert small.decode(small.encode(text)) == text


def test_texts_beyond_a_leaf_go_through_the_tree():
    encoder, joins = Encoder(open(TOKENIZER, "rb").read()), []
    join = encoder.join
    encoder.join = lambda *a: joins.append(1) or join(*a)
    text = prose(random.Random(2), 200)
    assert encoder.encode(text) == encoder.core.encode_ordinary(text) and len(joins) >= len(text) // LEAF - 1


def test_ids_and_texts_there_and_back(spark):
    rows = [(1, "a <|endoftext|> b"), (2, None), (3, ""), (4, "中文😀é " * 3000)]
    got = texts_of(token_ids(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {r.doc_id: r.text for r in got.collect()} == {k: t or "" for k, t in rows}
    assert texts_of(spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")).where("text = ''").count() == 2


def test_ids_of_rows(spark, small):
    rows = [(1, "a <|endoftext|> b", 9), (2, None, 9), (3, "", 9), (4, "中文" * 5000, 9), (5, "a <|endoftext|> b", 9)]
    got = {r.doc_id: r.ids for r in token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect()}
    assert got[2] == got[3] == [] and got[1] == got[5] == small.core.encode_ordinary(rows[0][1]) and 50256 not in got[1]
    assert small.core.decode(got[4]) == rows[3][1]
    assert token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids int").limit(0)).count() == 0


@given(st.text(st.sampled_from("ab中 \n"), max_size=90))
def test_landmarks_hash_the_characters_before_them_and_no_others(text):
    def is_mark(window):
        total = 0
        for k, c in enumerate(reversed(window)):
            m = (ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64
            total += (m ^ m >> 29) * (2 * k + 3)
        total %= 2**64
        return ((total ^ total >> 31) * 0xBF58476D1CE4E5B9 % 2**64 >> 40) % ONE_IN == 0

    assert landmarks(rolling(text)).tolist() == [i + 1 for i in range(len(text)) if is_mark(text[max(0, i + 1 - WINDOW) : i + 1])]


def check(text, cut, encoder, limit=512, overlap=64):
    assert "".join(text[s + o : e] for s, e, o, _, _ in cut) == text
    for k, (s, e, o, r, n) in enumerate(cut):
        assert n <= limit and r <= overlap and n == len(encoder.core.encode_ordinary(text[s:e])) and e > s + o
        assert k or not o
        if k:
            assert s + o == cut[k - 1][1] and s >= cut[k - 1][0]


def prose(rnd, n):
    return "".join("".join(rnd.choice("甲乙丙丁戊己庚辛") for _ in range(rnd.randint(5, 30))) + rnd.choice("，。！\n") for _ in range(n))


def test_pieces_hold_the_text_and_end_at_breaks():
    encoder = Encoder(open(TOKENIZER, "rb").read())
    rnd = random.Random(1)
    for text in [prose(rnd, 400), "word " * 3000, "x" * 9000, "😀" * 2000, "A sentence of words. " * 800, "a\r\n" * 2500, "中" * 5000, " " * 60_000, "一句话。" + "z" * 8000]:
        cut = Cutter(encoder).cut(text)
        check(text, cut, encoder)
        assert len(cut) > 1
    # Sentences are short enough that one ends between any bounds.
    text = prose(rnd, 600).replace("，", "。")
    assert all(text[e - 1] in "。！\n" for _, e, *_ in Cutter(encoder).cut(text)[:-1])


@settings(max_examples=60, deadline=None)
@given(TEXT.map(lambda t: t * 5))
def test_small_limits(small, text):
    check(text, Cutter(small, 40, 8, 10).cut(text), small, 40, 8)


def test_an_edit_alters_only_pieces_near_it():
    encoder = Encoder(open(TOKENIZER, "rb").read())
    text = prose(random.Random(5), 3000)
    parts = lambda t: {t[s + o : e] for s, e, o, _, _ in Cutter(encoder).cut(t)}
    a, b = parts(text), parts(text[:9000] + "改动" + text[9000:])
    assert len(a) > 40 and len(a - b) <= 6


def test_an_edit_moves_no_far_cut_without_landmarks(monkeypatch):
    """Where no landmark falls, the cut still depends on the text around it alone."""
    monkeypatch.setattr("shelfmark.llm.pieces.landmarks", lambda rolled: np.zeros(0, np.int64))
    encoder = Encoder(open(TOKENIZER, "rb").read())
    text = prose(random.Random(9), 3000)
    parts = lambda t: {t[s + o : e] for s, e, o, _, _ in Cutter(encoder).cut(t)}
    a, b = parts(text), parts(text[:9000] + "改动" + text[9000:])
    assert len(a) > 40 and len(a - b) <= 8


def test_rows_of_pieces(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "short", "k"), (4, "A sentence here. " * 500, "k"), (4, "A sentence here. " * 500, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece_no string")
    got = pieces(df).collect()
    assert {r.doc_id for r in got} == {3, 4} and [(r.piece_no, r.text, r.overlap_chars) for r in got if r.doc_id == 3] == [(1, "short", 0)]
    assert len({tuple(r) for r in got if r.doc_id == 4}) * 2 == len([r for r in got if r.doc_id == 4])
    assert pieces(df.limit(0)).count() == 0 and landmarks(rolling("")).size == 0
