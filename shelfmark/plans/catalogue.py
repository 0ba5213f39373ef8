"""Registered queries of the catalogue: slugs, subcategory queries, documents and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.models import PRESETS, encode
from shelfmark.operators import catalogue as A
from shelfmark.operators.ranking import nearest, sample_groups
from shelfmark.operators.report import VARIANTS, in_benchmark_order, variants, with_sample_order
from shelfmark.plans.retrieval import SEED, rounded
from shelfmark.plans.runtime import table


def _products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return A.with_slugs(_products(spark, d)).select("idx", "category_slug", "subcategory_slug")


def _queries(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(A.subcategory_queries(_products(spark, d), mode))

    return run


def positives_packed(spark: SparkSession, d: str) -> DataFrame:
    p = A.packed_positives(_products(spark, d))
    return p.select("key", F.array_join(F.col("positive_indices").cast("array<string>"), ",").alias("positive_indices"), F.md5(F.array_join("image_paths", "|").cast("binary")).alias("image_paths"))


def qrels_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Positives of each key, a row counted once."""
    return rounded(table(spark, d, "qrels").distinct().groupBy("key").agg(F.count("*").alias("positive_count")))


def _documents(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _products(spark, d).select("idx", X.document_text(mode).alias("document"))

    return run


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Every subcategory's prompt in each model's two variants."""
    q = table(spark, d, "subcategory_queries").select("key", "slug_text", "canonical_subcategory")
    return A.prompted(q, variants(spark)).select("model_name", "input_language", "key", "prompt", "prompt_label")


def encoded_search(spark: SparkSession, d: str) -> DataFrame:
    """The five titles nearest to each subcategory's name, by the stand-in encoder."""
    titles = encode(_products(spark, d).select("idx", "title"), "idx", "title", PRESETS["siglip2"])
    q = encode(table(spark, d, "subcategory_queries").select(F.xxhash64("key").alias("query_id"), "query_text"), "query_id", "query_text", PRESETS["siglip2"])
    return rounded(nearest(q, titles, 5))


def price_ties(spark: SparkSession, d: str) -> DataFrame:
    """Prices and parts of them as text, many of which read like ties between two neighbours."""
    parts = {"whole": F.col("price"), "eighth": F.col("price") / 8, "tenth": F.col("price") / 10, "loss": -F.col("price") / 16}
    share = X.percent(F.col("price") / 2000)
    return _products(spark, d).select("idx", *[X.half_even_text(c).alias(n) for n, c in parts.items()], share.alias("share"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subcategory_queries").select("key", X.request_text(F.col("category"), F.col("canonical_subcategory")).alias("request"))


def product_cases(spark: SparkSession, d: str) -> DataFrame:
    """Five sampled members of each subcategory."""
    return rounded(sample_groups(table(spark, d, "qrels").distinct(), "key", "idx", 5, SEED).select("key", "repeat_id", "idx"))


def variant_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of models and languages in the sample report; what isn't listed comes last."""
    more = variants(spark).select("model_name", "input_language").unionByName(table(spark, d, "subcategory_queries").select(F.col("key").alias("model_name"), F.lit("fr").alias("input_language")))
    return rounded(with_sample_order(more))


def benchmark_order(spark: SparkSession, d: str) -> DataFrame:
    """The variants as the benchmark lists them."""
    return rounded(in_benchmark_order(variants(spark)).select("model_name", "input_language", "query_mode", "place"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (slugs, positives_packed, qrels_distinct, prompts, requests, encoded_search, product_cases, variant_order, benchmark_order, price_ties)},
    **{f"subcategory_queries_{m}": _queries(m) for m in X.QUERY_MODES},
    **{f"documents_{m}": _documents(m) for m in X.DOCUMENT_MODES},
}

_WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_SLUGS = "x AS (SELECT *, string_split(image, '/')[-2] AS key, string_split(image, '/')[-3] AS slug FROM products)"
_MODE = lambda v, n: f"(SELECT key, arg_max({v}, (n, -met)) AS {n} FROM (SELECT key, {v}, count(*) AS n, min(idx) AS met FROM x WHERE {v} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
_TEXT = {"canonical_zh": "canonical_subcategory", "canonical_zh_with_category": "category || ' ' || canonical_subcategory", "slug_en": "slug_text", "slug_en_with_category": "replace(category_slug, '_', ' ') || ' ' || slug_text"}
_LIST = lambda c: f"CASE WHEN len({c}) > 0 THEN array_to_string(list_transform({c}, lambda v: coalesce(v, 'None')), '、') END"
_MAP = lambda c: f"CASE WHEN cardinality({c}) > 0 THEN array_to_string(list_transform(map_entries({c}), lambda e: e.key || ': ' || coalesce(e.value, 'None')), '；') END"
_RICH = {"price": "printf('%.2f', price)", "rating": "rating::VARCHAR", "colors": _LIST("colors"), "sizes": _LIST("sizes"), "parameters": _MAP("parameters"), "after_sales": _MAP("after_sales")}


def _lines(labels: dict[str, str], cell: Callable[[str], str]) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"'{label}: ' || {cell(c)}" for c, label in labels.items()) + ")"


_VARIANTS = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in VARIANTS) + ") AS t(model_name, input_language, query_mode, prompt_template, prompt_label)"
_PLACE = lambda c, names: "CASE " + c + " " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names, 1)) + " ELSE 999 END"

SQL: dict[str, str] = {
    "slugs": "SELECT idx, string_split(image, '/')[-3] AS category_slug, string_split(image, '/')[-2] AS subcategory_slug FROM products",
    "positives_packed": f"WITH {_SLUGS} SELECT key, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS positive_indices, md5(string_agg(image, '|' ORDER BY idx)) AS image_paths FROM x WHERE key IS NOT NULL GROUP BY key",
    "qrels_distinct": "SELECT key, count(*) AS positive_count FROM (SELECT DISTINCT key, idx FROM qrels) GROUP BY key",
    "prompts": f"SELECT model_name, input_language, key, coalesce(replace(prompt_template, '{{label}}', label), label) AS prompt, prompt_label FROM (SELECT *, CASE WHEN query_mode = 'slug_en' THEN slug_text ELSE canonical_subcategory END AS label FROM subcategory_queries CROSS JOIN {_VARIANTS})",
    "price_ties": "SELECT idx, printf('%.2f', price) AS whole, printf('%.2f', price / 8) AS eighth, printf('%.2f', price / 10) AS tenth, printf('%.2f', -price / 16) AS loss, printf('%.1f', price / 2000 * 100.0) || '%' AS share FROM products",
    "requests": "SELECT key, '我想找一款属于“' || category || '”类目的“' || canonical_subcategory || '”。请优先保留真正属于这个子类别、商品信息匹配、明显不是其他近似子类别的结果。' AS request FROM subcategory_queries",
    "product_cases": f"SELECT key, repeat_id, idx FROM (SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY md5('{SEED}:' || idx), idx) AS repeat_id FROM (SELECT DISTINCT key, idx FROM qrels)) WHERE repeat_id <= 5",
    "variant_order": f"SELECT model_name, input_language, ({_PLACE('input_language', ('zh', 'en'))})::BIGINT AS language_order, ({_PLACE('model_name', ('clip', 'chinese_clip', 'siglip2', 'gme_2b'))})::BIGINT AS model_order FROM (SELECT model_name, input_language FROM {_VARIANTS} UNION ALL SELECT key, 'fr' FROM subcategory_queries)",
    "benchmark_order": f"SELECT model_name, input_language, query_mode, row_number() OVER (ORDER BY {_PLACE('input_language', ('en', 'zh'))}, {_PLACE('model_name', ('clip', 'chinese_clip', 'siglip2', 'gme_2b'))}) AS place FROM {_VARIANTS}",
    **{
        f"subcategory_queries_{m}": f"""WITH {_SLUGS}, g AS (SELECT key, arg_min(slug, idx) AS category_slug, count(*) AS positive_count, trim(replace(key, '_', ' ')) AS slug_text FROM x WHERE key IS NOT NULL GROUP BY key),
 a AS (SELECT key, category_slug, category, canonical_subcategory, slug_text, positive_count FROM g LEFT JOIN {_MODE('category', 'category')} USING (key) LEFT JOIN {_MODE('subcategory', 'canonical_subcategory')} USING (key))
 SELECT key, category_slug, category, canonical_subcategory, slug_text, {text} AS query_text, positive_count FROM a"""
        for m, text in _TEXT.items()
    },
    "documents_compact_rerank_zh": "SELECT idx, " + _lines(X.COMPACT_LABELS, lambda c: f"CASE WHEN {_STRIP(c)} <> '' THEN {c} END") + " AS document FROM products",
    "documents_description_only": f"SELECT idx, {_STRIP('coalesce(description, chr(32))')} AS document FROM products",
    "documents_title_brand_desc": "SELECT idx, concat_ws('；', " + ", ".join(f"'{label}: ' || coalesce({c}, '')" for c, label in X.BRIEF_LABELS.items()) + ") AS document FROM products",
    "documents_rich_zh": "SELECT idx, " + _lines(X.RICH_LABELS, lambda c: _RICH.get(c, f"CASE WHEN {c} <> '' THEN {c} END")) + " AS document FROM products",
}
