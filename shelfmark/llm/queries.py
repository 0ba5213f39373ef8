"""Queries of the training-text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import canonical, glyphs, leaks, listings, pieces, templates, tokens
from shelfmark.plans.runtime import spread, table

SQL: dict[str, str] = {}


def _looks(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.consistent(spread(table(spark, d, "products").select("idx", "title", "description")), "idx", ["title", "description"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.same_look_pairs(_looks(spark, d), "idx")


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every title and description in the one consistent form, and the key by which looks are compared."""
    return _looks(spark, d).select("idx", "field", "text", "look")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "products").select("idx", "subcategory", "brand"))
    kinds, makers = table(spark, d, "subcategory_queries"), table(spark, d, "brand_list")
    entry = F.col("canonical_subcategory").alias("entry")
    names = kinds.select(F.explode(F.concat(F.array("canonical_subcategory", "key", "slug_text", "query_text"), F.coalesce("known_names", F.array().cast("array<string>")))).alias("name"), entry)
    # A few wider classes, each with at least one entry of the fixed list.
    families = [r[0] for r in kinds.select(F.explode(F.array("category", "category_slug"))).distinct().collect() if r[0]]
    brands = makers.select(F.explode(F.array("canonical_brand", "name_zh")).alias("name"), F.col("canonical_brand").alias("entry"))
    return canonical.canonical_values(rows, "idx", "subcategory", names, kinds.select(entry), families, parts=True).unionByName(
        canonical.canonical_values(rows, "idx", "brand", brands, makers.select(F.col("canonical_brand").alias("entry")), [], parts=False)
    )


def _groups(spark: SparkSession, d: str) -> DataFrame:
    makers = table(spark, d, "brand_list").select(F.explode(F.array("canonical_brand", "name_zh")).alias("name"), F.col("canonical_brand").alias("entry"))
    return listings.product_groups(spread(table(spark, d, "products").select("idx", "title", "description", "parameters", "brand")), makers)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return listings.same_product_pairs(_groups(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with its group."""
    return _groups(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return templates.article_lines(spread(table(spark, d, "web_retrieval_results").select("result_id", "url", "title", "reader_content_preview")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(spread(table(spark, d, "documents").select("doc_id", "text")))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids decode to."""
    return tokens.texts_of(p6_ids(spark, d))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest row of each item's passage in each document, where it stands in both, and how much of it is verbatim."""
    return leaks.matches(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left when those with leaks are removed."""
    return leaks.without_leaks(table(spark, d, "documents"), p7_found(spark, d)).select("doc_id", "source")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(spread(table(spark, d, "documents").select("doc_id", "text")))


# Letters of other alphabets and, in the same places, the Latin letters they look like. The SQL has a table of its own.
_SQL_FOREIGN = "АВЕКМНОРСТУХІЈЅҮԚԜѴаеорсухіјѕԁԛԝһѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳͿ"
_SQL_LATIN = "ABEKMHOPCTYXIJSYQWVaeopcyxijsdqwhvABEZHIKMNOPTYXovjJ"


def _look_sql(c: str) -> str:
    """The look of a text in SQL: every look-alike letter counts as its Latin one, whatever word it stands in."""
    one, gone, long = dict(zip(_SQL_FOREIGN, _SQL_LATIN, strict=True)), "", {}
    for cp in [*range(0x80, 0x3400), *range(0xF900, 0x10000)]:
        ch, kind, wide = chr(cp), unicodedata.category(chr(cp)), unicodedata.normalize("NFKC", chr(cp))
        if kind == "Cf" or ch in "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0" or 0xFE00 <= cp <= 0xFE0F:
            gone += ch
        elif kind == "Zs":
            one[ch] = " "
        elif ch in "\u2010\u2011\ufe63\uff0d":
            one[ch] = "-"
        elif unicodedata.east_asian_width(ch) in "FH" and 0xFF00 < cp or cp == 0x3000 or 0x2E80 <= cp < 0x2FE0 or 0xF900 <= cp < 0xFB00 or 0xFB00 <= cp < 0xFB07 or ch in "\u212a\u212b\u2126\xb5":
            if wide != ch:
                (one if len(wide) == 1 else long)[ch] = wide
    # Composed letters of the other alphabets, by their base letter.
    for cp in range(0x370, 0x530):
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        if marks and base in _SQL_FOREIGN and len(to := unicodedata.normalize("NFC", one[base] + "".join(marks))) == 1:
            one[chr(cp)] = to
    one["\t"] = " "
    for ch, wide in long.items():
        c = f"replace({c}, chr({ord(ch)}), '{wide}')"
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return f"nfc_normalize(translate({c}, {quoted(''.join(one) + gone)}, {quoted(''.join(one.values()))}))"


SQL["p1_found"] = (
    "WITH x AS (SELECT idx, 'title' AS field, title AS raw FROM products UNION ALL SELECT idx, 'description', description FROM products), "
    f"k AS (SELECT idx, field, raw, {_look_sql('raw')} AS look FROM x WHERE raw IS NOT NULL) "
    "SELECT a.field, a.idx AS idx_a, b.idx AS idx_b FROM k a JOIN k b ON a.field = b.field AND a.look = b.look WHERE a.idx < b.idx AND a.raw <> b.raw"
)

SQL["p6_texts"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_texts, p3_found, p4_found, p4_groups, p5_found, p6_ids, p6_texts, p7_found, p7_matches, p7_clean, p8_pieces)}
