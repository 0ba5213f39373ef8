from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.glyphs import LOOKALIKES, consistent, fold, latin, readings, same_look_pairs

SCHEMA = "idx bigint, title string, description string, field string, text string"


def table(spark, titles):
    return spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in enumerate(titles)], SCHEMA)


def forms(spark, titles):
    out = consistent(table(spark, titles), "idx", ["title"]).collect()
    return {r.idx: r.text for r in out}


def test_fold_changes_only_what_cannot_be_seen():
    assert fold("Ａ１　－b ‐c ﬁn é ⼀​­﻿，K") == "A1 -b -c fin é 一,K"
    for kept in ("Café café CAFÉ", "★", "a—b", "a  b", "①²™㎏", "a\nb", "，。".translate({0xFF0C: ","}), "т", "β"):
        assert fold(kept) == kept
    assert fold(None) is None and fold("") == "" and len(fold("Ａ" * 200_000)) == 200_000


def test_look_alikes():
    assert latin("Саfé") == "Café" and latin("МАХ") == "MAX" and latin("ё") == "ë" and latin("т") is None and latin("βest") is None
    assert all(latin(k) == v for k, v in LOOKALIKES.items())


def test_readings_by_the_script_of_most_letters():
    assert readings("привeт") == ["привет"] and readings("Москвa") == ["Москва"] and readings("Αθήνo") == ["Αθήνο"]
    assert readings("Tаvgos") == ["Tavgos"] and readings("MАХ") == ["МАХ", "MAX"] and readings("Маx") == ["Мах", "Max"] and readings("АΑ")[-1] == "AA"
    assert readings("мир") == readings("Max") == readings("сор") == readings("") == [] and readings("ёжиk") == []


def test_words_are_rewritten_only_into_words_of_the_corpus(spark):
    got = forms(spark, ["Tavgos 12", "Тavgos 12", "Zеdrix", "мир а", "сор", "cop", "привет, друзья", "привeт", "Maх", "Маx", "РОСТ", "POCT", "PОCТ", None, ""])
    assert got[1] == "Tavgos 12"
    assert got[2] == "Zеdrix"  # nothing in the corpus supports it
    assert got[3] == "мир а" and got[4] == "сор" and got[10] == "РОСТ"  # words of one alphabet stay
    assert got[7] == "привет"  # Cyrillic by most of its letters
    assert got[8] == "Maх" and got[9] == "Маx"  # two spellings of one word don't support each other
    assert got[12] == "POCT" and got[13] is None and got[14] == ""


def test_words_of_another_alphabet_compare_by_their_look(spark):
    rows = consistent(table(spark, ["РОСТ x", "POCT x", "мир", "Маx"]), "idx", ["title"]).collect()
    assert {r.idx: (r.text, r.look) for r in rows} == {0: ("РОСТ x", "POCT x"), 1: ("POCT x", "POCT x"), 2: ("мир", "мир"), 3: ("Маx", "Маx")}


def test_pairs(spark):
    titles = ["Tavgos one", "Тavgos one", "Tavgos one", "tavgos one", "Ｔavgos one", "x", "x", None, None, "", " ", "　"]
    pairs = same_look_pairs(consistent(table(spark, titles), "idx", ["title", "description"]), "idx").collect()
    assert same_look_pairs(consistent(table(spark, ["РОСТ", "POCT", "сор"]), "idx", ["title"]), "idx").count() == 1
    assert sorted((r.field, r.idx_a, r.idx_b) for r in pairs) == sorted([("title", 0, 1), ("title", 1, 2), ("title", 0, 4), ("title", 1, 4), ("title", 2, 4), ("title", 10, 11)])
    assert same_look_pairs(consistent(table(spark, titles).limit(0), "idx", ["title"]), "idx").count() == 0


def test_a_hot_text_costs_only_its_result(spark):
    titles = ["same words here"] * 3000 + ["ｓame words here"]
    assert same_look_pairs(consistent(table(spark, titles), "idx", ["title"]), "idx").count() == 3000


ALPHABET = "aeopcxyABCEHKMOPTX 1-éü"
SWAPS = {v: [k for k in LOOKALIKES if LOOKALIKES[k] == v] for v in LOOKALIKES.values()}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(ALPHABET, min_size=3, max_size=12), min_size=1, max_size=4), st.randoms(use_true_random=False))
def test_disguised_texts_are_found(spark, texts, rnd):
    texts = list(dict.fromkeys(texts))
    other = ["".join(rnd.choice([c, *SWAPS.get(c, [c])]) for c in t) for t in texts]
    got = same_look_pairs(consistent(table(spark, texts + other), "idx", ["title"]), "idx").collect()
    want = {(i, i + len(texts)) for i, (a, b) in enumerate(zip(texts, other, strict=True)) if a != b}
    assert want <= {(r.idx_a, r.idx_b) for r in got}
