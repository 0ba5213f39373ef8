import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.leaks import SuffixArray, even, leaks, matches, passage, without_leaks, words

RND = random.Random(11)
ENGLISH = [" ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(60)) for _ in range(3)]
CHINESE = ["".join(RND.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉") for _ in range(90)) for _ in range(3)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=6), st.lists(st.integers(0, 4), max_size=14), st.integers(1, 7))
def test_suffix_array_finds_every_verbatim_row(docs, test, depth):
    sizes = np.array([len(d) for d in docs])
    stream = np.array([x for d in docs for x in d], np.int64)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(stream.size)
    if not stream.size:
        return
    array = SuffixArray(stream, room, 4, depth)
    t = np.array([x if x < 4 else -1 for x in test], np.int64)
    starts, lo, hi = array.intervals(t, t.size - np.arange(t.size))
    got = {(int(s), int(p)) for s, a, b in zip(starts, lo, hi, strict=True) for p in array.order[a:b]}
    want = {(i, j) for i in range(len(test) - depth + 1) for j in range(stream.size) if room[j] >= depth and (t[i : i + depth] == stream[j : j + depth]).all() and (t[i : i + depth] >= 0).all()}
    assert got == want


def test_texts_are_evened():
    assert even("> Ａ b\r\n- c\n1. d\n  * e") == "a b\nc\nd\ne"
    assert words(even("The night-shift, it's 12.")) == ["the", "nightshift", "its", "12"]
    assert passage("Do this.\nP one. P two.\nWhat?") == "P one. P two." and passage("P.\nQ?") == "P." and passage("P.") == "P." and passage("") == ""


def row(text, a, n, sep):
    return sep.join(text.split(sep)[a : a + n]) if sep else text[a : a + n]


def test_leaks(spark):
    items = spark.createDataFrame(
        [(1, "en", f"Read this.\n{ENGLISH[0]}\nWho?", "x"), (2, "en", f"{ENGLISH[0]}\nWhat?", "x"), (3, "zh", f"{CHINESE[0]}\n谁？", "x"), (4, "en", f"Read this.\n{ENGLISH[1]}\nWho?", "x"), (5, "zh", None, "x"), (6, "en", "too short\nq", "x"), (7, None, f"{CHINESE[1]}\n谁？", "x")],
        "item_id bigint, lang string, text string, doc_id string",
    )
    pad = "Some other words stand here. "
    swap = lambda t, k: " ".join("zzz" if i == k else w for i, w in enumerate(t.split(" ")))
    docs = {
        1: pad + row(ENGLISH[0], 5, 24, " "), 2: pad + row(ENGLISH[0], 5, 23, " "), 3: pad + row(swap(ENGLISH[0], 17), 5, 24, " ").upper() + " " + pad, 4: row(swap(swap(ENGLISH[0], 17), 22), 5, 24, " "),
        5: "其他" + row(CHINESE[0], 10, 40, ""), 6: "其他" + row(CHINESE[0], 10, 39, "") + "其他", 7: "。".join(row(CHINESE[0], 10, 40, "")), 8: row(CHINESE[0], 10, 20, "") + "某" + row(CHINESE[0], 31, 19, ""), 9: row(CHINESE[0], 10, 20, "") + row(CHINESE[0], 31, 20, ""),
        10: "\n> ".join(row(ENGLISH[1], 0, 24, " ").split(" ")), 11: None, 12: "", 13: "Read this.", 14: row(CHINESE[1], 0, 45, "") + ENGLISH[1], 15: swap(row(ENGLISH[0], 5, 24, " "), 0), 16: "长" * 3000 + CHINESE[0] + "文" * 3000, 17: swap(row(ENGLISH[0], 5, 25, " "), 0),
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id bigint, text string, item_id string")
    # A replaced word at the end of a row isn't part of it.
    want = {(1, 1), (1, 2), (3, 1), (3, 2), (5, 3), (7, 3), (8, 3), (10, 4), (14, 4), (14, 7), (16, 3), (17, 1), (17, 2)}
    for options in ({}, {"shard": 500}, {"block_chars": 200}):
        assert {tuple(r) for r in leaks(df, items, **options).collect()} == want, options
    rows = {(r.doc_id, r.item_id): (r.length, r.verbatim, r.doc_at, r.item_at) for r in matches(df, items).collect()}
    assert rows.keys() == want and rows[1, 1] == rows[1, 2] == (24, 24, 5, 5) and rows[3, 1] == (24, 12, 5, 5) and rows[5, 3] == (40, 40, 2, 10)
    assert rows[8, 3] == (40, 20, 0, 10) and rows[14, 7] == (45, 45, 0, 0) and rows[16, 3] == (90, 90, 3000, 0)
    assert {(r.doc_id, r.item_id): (r.length, r.verbatim, r.doc_at, r.item_at) for r in matches(df, items, shard=500).collect()} == rows
    found = leaks(df, items)
    assert {r.doc_id for r in without_leaks(df, found).collect()} == set(docs) - {d for d, _ in want}
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def test_a_phrase_met_in_many_places(spark):
    """Thousands of places of one phrase in one shard, gone through in slices."""
    phrase = row(ENGLISH[2], 0, 30, " ")
    items = spark.createDataFrame([(k, "en", f"Read this.\n{phrase} {ENGLISH[k % 2]}\nWho?") for k in range(4)], "item_id bigint, lang string, text string")
    docs = spark.createDataFrame([(k, f"{phrase} {phrase}") for k in range(1500)], "doc_id bigint, text string")
    got = matches(docs, items)
    assert got.count() == 6000 and got.where("length = 30 and verbatim = 30 and doc_at = 0 and item_at = 0").count() == 6000
