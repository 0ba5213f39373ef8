"""Catalogue rows: derived slugs, subcategory queries and their positives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import path_part, query_text, slug_to_text


def with_slugs(products: DataFrame, image: str = "image") -> DataFrame:
    """``subcategory_slug`` and ``category_slug``: the folder of the image and the one above it."""
    return products.withColumns({"subcategory_slug": path_part(F.col(image), 2), "category_slug": path_part(F.col(image), 3)})


def most_common(rows: DataFrame, by: str, value: str, position: str, name: str) -> DataFrame:
    """The most frequent value of each group, the first met of equals; nulls aren't counted.

    Counted by group and value first, so a large group is never gathered in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    return counted.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias(name))


def subcategory_queries(products: DataFrame, mode: str = "canonical_zh") -> DataFrame:
    """One row per image folder: ``key, category_slug, category, canonical_subcategory, slug_text, query_text, positive_count``.

    Folders of one name under different categories are one subcategory; its category slug is that of its first row.
    """
    rows = with_slugs(products).where(F.col("subcategory_slug").isNotNull()).withColumnRenamed("subcategory_slug", "key")
    out = rows.groupBy("key").agg(F.min_by("category_slug", "idx").alias("category_slug"), F.count("*").alias("positive_count"))
    out = out.join(most_common(rows, "key", "category", "idx", "category"), "key", "left")
    out = out.join(most_common(rows, "key", "subcategory", "idx", "canonical_subcategory"), "key", "left")
    out = out.withColumn("slug_text", slug_to_text(F.col("key")))
    text = query_text(mode, F.col("category"), F.col("canonical_subcategory"), F.col("category_slug"), F.col("slug_text"))
    return out.select("key", "category_slug", "category", "canonical_subcategory", "slug_text", text.alias("query_text"), "positive_count")


def positives(products: DataFrame) -> DataFrame:
    """``key, idx, image``: the members of each subcategory, one row each."""
    return with_slugs(products).where(F.col("subcategory_slug").isNotNull()).select(F.col("subcategory_slug").alias("key"), "idx", "image")


def packed_positives(products: DataFrame) -> DataFrame:
    """``key, positive_indices, image_paths`` in order of ``idx``, for sinks that hold lists."""
    at = F.array_sort(F.collect_list(F.struct("idx", "image")))
    return positives(products).groupBy("key").agg(at.alias("m")).select("key", F.transform("m", lambda x: x["idx"]).alias("positive_indices"), F.transform("m", lambda x: x["image"]).alias("image_paths"))


def prompted(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """Every query in every variant (``model_name, input_language, query_mode, prompt_template, prompt_label``), a fixed list."""
    from shelfmark.functions.text import fill

    label = F.when(F.col("query_mode") == "slug_en", F.col("slug_text")).otherwise(F.col("canonical_subcategory"))
    return queries.join(F.broadcast(variants), F.lit(True)).withColumn("prompt", fill(F.col("prompt_template"), label))
