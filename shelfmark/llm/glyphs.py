"""Problem 1: text that looks the same but is stored in different characters.

``fold`` removes the differences a single character decides (width, composition, invisible marks,
kinds of space and hyphen, ligatures, radicals). Letters of another alphabet need the corpus: a word
that mixes alphabets is brought to the one most of its letters are of, if that gives a word of the corpus in
pure letters, else to the next. Words of one alphabet are never changed; those that consist of look-alikes only have their
Latin form in a key of their own, for comparing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.plans.runtime import cut

# Letters of the Cyrillic and Greek alphabets and the Latin letters of the same shape.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϳ": "J",
}
# Hyphens that are drawn like the hyphen-minus.
HYPHENS = "‐‑﹣－"
# Characters without a shape besides the general category Cf.
SHAPELESS = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"

_WIDE = ("<wide>", "<narrow>")


def _single(cp: int) -> str | None:
    """What one character is replaced by; None where it stays as it is."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if c in HYPHENS:
        return "-"
    if kind == "Cf" or c in SHAPELESS or 0xFE00 <= cp <= 0xFE0F:
        return ""
    if kind == "Zs" or c == "\t":
        return " "
    how = unicodedata.decomposition(c)
    if how.startswith(_WIDE):
        return unicodedata.normalize("NFKC", c)
    if 0x2E80 <= cp <= 0x2FDF or 0xF900 <= cp <= 0xFAFF or 0xFB00 <= cp <= 0xFB06 or c in "KÅΩµ":
        return unicodedata.normalize("NFKC", c)
    return None


_MAP = {cp: to for cp in [*range(0x80, 0x3400), *range(0xF900, 0x10000)] if not 0xE000 <= cp < 0xF900 and (to := _single(cp)) is not None and to != chr(cp)} | {0x09: " "}
_ANY = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_MAP)) + "]")


def fold(text: str | None) -> str | None:
    """One form for characters that differ in width, composition, kind of space or hyphen, or have no shape.

    Null stays null, an empty text empty. Case, accents, order, line ends and other punctuation stay.
    """
    if text is None or text.isascii() and "\t" not in text:
        return text
    return unicodedata.normalize("NFC", text.translate(_MAP) if _ANY.search(text) else text)


def script(c: str) -> str | None:
    """``L``, ``G`` or ``C`` for letters of the three alphabets with look-alikes; None for marks and all others."""
    cp = ord(c)
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "G"
    if 0x400 <= cp < 0x530:
        return "C"
    return "L" if c.isalpha() else None


#: Of each alphabet, the letter of every shape.
_OF_SHAPE: dict[str, dict[str, str]] = {"L": {v: v for v in LOOKALIKES.values()}, "G": {}, "C": {}}
for _letter, _shape in LOOKALIKES.items():
    _OF_SHAPE[script(_letter)].setdefault(_shape, _letter)


def in_script(word: str, target: str) -> str | None:
    """The word with the letters of other alphabets as the target's letters of the same shape; None where one has no such letter."""
    out = []
    for c in unicodedata.normalize("NFD", word):
        if script(c) in (None, target):
            out.append(c)
        elif (to := _OF_SHAPE[target].get(LOOKALIKES.get(c, c))) is not None:
            out.append(to)
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


def readings(word: str) -> list[str]:
    """What a word that mixes alphabets may stand for, the reading in the alphabet of most of its letters first (of equals Latin,
    then Cyrillic, then Greek; Latin also where only the two others are mixed); none for a word of one alphabet."""
    n = {k: 0 for k in "LCG"}
    for c in unicodedata.normalize("NFD", word):
        if (k := script(c)) is not None:
            n[k] += 1
    if sum(map(bool, n.values())) < 2:
        return []
    order = [k for k in sorted(n, key=lambda k: -n[k]) if n[k] or k == "L"]
    return [r for k in order if (r := in_script(word, k)) is not None]


def latin(word: str) -> str | None:
    """The word with every look-alike as its Latin letter; None where it holds another foreign letter."""
    return in_script(word, "L")


@F.pandas_udf(T.StringType())
def fold_col(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(fold, na_action="ignore").astype(object).where(s.notna(), None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def readings_col(s: pd.Series) -> pd.Series:
    return s.map(readings, na_action="ignore")


@F.pandas_udf(T.StringType())
def rewrite_col(text: pd.Series, repairs: pd.Series) -> pd.Series:
    def one(t, r):
        if t is None or r is None or not len(r):
            return t
        known = dict(r) if not isinstance(r, dict) else r
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: known.get(m[0], m[0]), t))

    return pd.Series([one(t, r) for t, r in zip(text, repairs, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def look_col(text: pd.Series) -> pd.Series:
    """The text with words of one foreign alphabet, if look-alikes only, in Latin letters."""
    one = lambda w: w if w.isascii() or readings(w) else latin(w) or w
    return text.map(lambda t: unicodedata.normalize("NFC", _WORD.sub(lambda m: one(m[0]), t)), na_action="ignore")


#: A word of the alphabets with look-alikes, marks included; Java's and Python's spelling.
WORD = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{M}]+"
FOREIGN = r"[\p{IsLatin}\p{M}]*[\p{IsGreek}\p{IsCyrillic}]" + WORD[:-1] + "*"
_WORD = re.compile("[A-Za-zªºÀ-ÖØ-öø-ʸ̀-ͯͰ-ϿЀ-ԯḀ-῿]+")


PURE = [r"^[\p{IsLatin}\p{M}]+$", r"^[\p{IsCyrillic}\p{M}]+$", r"^[\p{IsGreek}\p{M}]+$"]


def consistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, field, raw, text, look``: a row per key and column, ``text`` in the one consistent form.

    ``key`` must be unique. Null values come out as null. Columns other than those named are not read,
    so clashing names do no harm. A word that mixes alphabets is rewritten in the first of its ``readings`` that is a word of the
    corpus, standing somewhere in letters of that alphabet alone; without one it stays. ``look`` is ``text`` with words wholly
    of another alphabet's look-alikes in Latin letters: such a word may be of that language, so it isn't changed, but it looks the same.
    """
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in columns])).alias("x")).select("key", "x.field", "x.raw")
    folded = long.withColumn("text", fold_col("raw"))
    words = lambda pattern: F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    foreign = F.col("text").rlike(r"[\p{IsGreek}\p{IsCyrillic}]")
    # The few texts with a foreign letter are read several times below: folded once, written once.
    mixed = cut(folded.where(foreign))
    suspects = mixed.select("key", "field", F.explode(words(FOREIGN)).alias("word")).where(F.col("word").rlike(PURE[0][1:-2]) | (F.col("word").rlike(PURE[1][1:-2]) & F.col("word").rlike(PURE[2][1:-2])))
    read = suspects.select("word").distinct().select("word", F.posexplode(readings_col("word")).alias("pos", "reading"))
    vocabulary = folded.select(F.explode(words(WORD)).alias("reading")).where(reduce(lambda a, b: a | b, [F.col("reading").rlike(p) for p in PURE])).distinct()
    repairs = read.join(vocabulary, "reading").groupBy("word").agg(F.min_by("reading", "pos").alias("reading"))
    per_row = suspects.join(repairs, "word").groupBy("key", "field").agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("repairs"))
    plain = folded.where(F.col("text").isNull() | ~foreign).withColumn("look", F.col("text"))
    mended = mixed.join(per_row, ["key", "field"], "left").select("key", "field", "raw", rewrite_col("text", "repairs").alias("text"))
    return plain.unionByName(mended.withColumn("look", look_col("text"))).withColumnRenamed("key", key)


def digest(c: str) -> Column:
    return F.unhex(F.md5(F.col(c).cast("binary")))


def same_look_pairs(texts: DataFrame, key: str) -> DataFrame:
    """``field, idx_a, idx_b`` of rows equal in ``look`` but not in ``raw`` (see ``consistent``).

    Only digests are shuffled. Rows of one spelling are never compared with each other: the pairs are
    formed between the distinct spellings of a text and then spread to the rows of each, so the
    work follows the size of the result. Null values take no part.
    """
    rows = cut(texts.where("raw is not null").select("field", key, digest("look").alias("look"), digest("raw").alias("spelling")))
    spellings = rows.select("field", "look", "spelling").distinct()
    several = spellings.groupBy("field", "look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo < hi").select("field", "look")
    spellings = spellings.join(several, ["field", "look"], "left_semi")
    both = spellings.withColumnRenamed("spelling", "s1").join(spellings.withColumnRenamed("spelling", "s2"), ["field", "look"]).where("s1 < s2")
    rows = rows.join(several, ["field", "look"], "left_semi")
    left = rows.select("field", "look", F.col("spelling").alias("s1"), F.col(key).alias("k1"))
    right = rows.select("field", "look", F.col("spelling").alias("s2"), F.col(key).alias("k2"))
    return both.join(left, ["field", "look", "s1"]).join(right, ["field", "look", "s2"]).select("field", F.least("k1", "k2").alias("idx_a"), F.greatest("k1", "k2").alias("idx_b"))
