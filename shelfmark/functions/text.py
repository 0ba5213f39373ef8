"""Text columns of catalogue rows: paths, labelled documents, queries, prompts and report cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that str.strip() takes off.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"

# Labels of the fields in documents, in order.
RICH_LABELS = {
    "id": "商品ID", "category": "一级类目", "subcategory": "二级类目", "title": "标题", "brand": "品牌", "price": "价格", "colors": "颜色",
    "sizes": "尺码/规格", "parameters": "商品参数", "shop_name": "店铺", "rating": "评分", "after_sales": "售后", "description": "商品描述",
}
COMPACT_LABELS = {"category": "一级类目", "subcategory": "二级类目", "title": "商品标题", "brand": "品牌", "description": "商品描述"}
BRIEF_LABELS = {"title": "商品标题", "brand": "品牌", "description": "商品描述"}

DOCUMENT_MODES = ("rich_zh", "compact_rerank_zh", "description_only", "title_brand_desc")
QUERY_MODES = ("canonical_zh", "canonical_zh_with_category", "slug_en", "slug_en_with_category")


def strip(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def slug_to_text(slug: Column) -> Column:
    return strip(F.replace(slug, F.lit("_"), F.lit(" ")))


def path_part(path: Column, from_end: int) -> Column:
    """The nth part of a path counted from its end, the file being the first; null if the path is shorter."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def list_text(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), "、", "None")


def map_text(c: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "；")


def half_even_text(c: Column, digits: int = 2) -> Column:
    """Fixed decimals (at most two), rounded by the binary value as printf does: only a value that lies exactly between two
    neighbours goes to the even one.

    Where the shortest decimal of the number reads like such a tie, the number is compared with the tie in whole numbers: both sides
    times a power of two. From 2^53 on the digits are the shortest that tell the number. NaN and infinities read ``nan`` and ``inf``.
    """
    if digits > 2:
        raise ValueError("at most two decimals")
    x = c.cast("double")
    size, ten = F.abs(x), 10**digits
    scaled = size.try_cast("decimal(36,18)") * F.lit(ten)
    down = F.floor(scaled)
    over = scaled - down
    k = (F.lit(53) - F.floor(F.log2(size))).cast("int")
    number = F.floor(size * F.pow(F.lit(2.0), k)).cast("bigint").cast("decimal(20,0)") * F.lit(2 * ten)
    tie = (down.cast("decimal(18,0)") * F.lit(2) + F.lit(1)) * F.floor(F.pow(F.lit(2.0), k)).cast("bigint").cast("decimal(20,0)")
    half = F.lit(0.5).cast("decimal(2,1)")
    up = F.when(over != half, over > half).when(number != tie, number > tie).otherwise(down % 2 == 1)
    near = (down.cast("decimal(18,0)") + F.when(up, F.lit(1)).otherwise(F.lit(0))) / F.lit(ten).cast("decimal(3,0)")
    text = F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.lit("inf")).when(size < F.lit(1e14), near.cast(f"decimal(38,{digits})").cast("string")).otherwise(F.format_string(f"%.{digits}f", size))
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text))


def _lines(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *parts)


def document_text(mode: str = "rich_zh") -> Column:
    """A catalogue row as text. ``rich_zh`` leaves out empty fields (0 is not empty), ``compact_rerank_zh`` blank ones;
    ``title_brand_desc`` keeps every label. Missing values count as empty."""
    if mode == "compact_rerank_zh":
        return _lines([F.when(strip(F.col(c)) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in COMPACT_LABELS.items()])
    if mode == "description_only":
        return strip(F.coalesce(F.col("description"), F.lit("")))
    if mode == "title_brand_desc":
        return F.concat_ws("；", *[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(""))) for c, label in BRIEF_LABELS.items()])
    if mode != "rich_zh":
        raise ValueError(f"unknown document mode {mode!r}; one of {DOCUMENT_MODES}")
    text = {"price": half_even_text(F.col("price")), "rating": F.col("rating").cast("string")}
    text |= {c: F.when(F.size(c) > 0, list_text(F.col(c))) for c in ("colors", "sizes")}
    text |= {c: F.when(F.size(c) > 0, map_text(F.col(c))) for c in ("parameters", "after_sales")}
    plain = lambda c: F.when(F.col(c) != "", F.col(c))
    return _lines([F.concat(F.lit(f"{label}: "), text.get(c, plain(c))) for c, label in RICH_LABELS.items()])


def query_text(mode: str, category: Column, canonical: Column, category_slug: Column, slug_text: Column) -> Column:
    """What is searched for a subcategory."""
    if mode == "canonical_zh":
        return canonical
    if mode == "canonical_zh_with_category":
        return F.concat(category, F.lit(" "), canonical)
    if mode == "slug_en":
        return slug_text
    if mode == "slug_en_with_category":
        return F.concat(slug_to_text(category_slug), F.lit(" "), slug_text)
    raise ValueError(f"unknown query mode {mode!r}; one of {QUERY_MODES}")


def fill(template: Column, label: Column) -> Column:
    """The template with its label; without a template the label alone."""
    return F.coalesce(F.replace(template, F.lit("{label}"), label), label)


def request_text(category: Column, canonical: Column) -> Column:
    """The shopper's request a reranker gets."""
    return F.concat(F.lit("我想找一款属于“"), category, F.lit("”类目的“"), canonical, F.lit("”。请优先保留真正属于这个子类别、商品信息匹配、明显不是其他近似子类别的结果。"))


def preview(content: Column, length: int = 500) -> Column:
    """The first code points."""
    return F.left(content, F.lit(length))


def percent(c: Column) -> Column:
    return F.concat(half_even_text(c * F.lit(100.0), 1), F.lit("%"))


def display_name(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("-"))


def mean_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / F.lit(float(len(columns)))
