"""Report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import display_name, percent
from shelfmark.operators.metrics import KS, mean_precision

# The order of models and languages in the two kinds of report.
MODEL_ORDER = ("clip", "chinese_clip", "siglip2", "gme_2b")
BENCHMARK_LANGUAGES, SAMPLE_LANGUAGES = ("en", "zh"), ("zh", "en")
UNKNOWN = 999

# Model, language, query mode, prompt template and its label.
VARIANTS = (
    ("clip", "en", "slug_en", "a photo of a {label}", "OpenAI CLIP template"),
    ("clip", "zh", "canonical_zh", "a photo of a {label}", "OpenAI CLIP template with Chinese label"),
    ("chinese_clip", "en", "slug_en", None, "raw label"),
    ("chinese_clip", "zh", "canonical_zh", None, "raw label"),
    ("siglip2", "en", "slug_en", "This is a photo of {label}.", "SigLIP2 official template"),
    ("siglip2", "zh", "canonical_zh", "This is a photo of {label}.", "SigLIP2 official template with Chinese label"),
    ("gme_2b", "en", "slug_en", None, "raw label + official retrieval instruction"),
    ("gme_2b", "zh", "canonical_zh", None, "raw label + official retrieval instruction"),
)


def variants(spark) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "model_name string, input_language string, query_mode string, prompt_template string, prompt_label string")


def order_by_list(column: Column, names: tuple[str, ...], *, strict: bool) -> Column:
    """The place in a fixed list; what isn't in it is an error, or comes last."""
    place = F.array_position(F.array(*map(F.lit, names)), column)
    other = F.raise_error(F.concat(F.lit("not in the list: "), column)).cast("bigint") if strict else F.lit(UNKNOWN).cast("bigint")
    return F.when(place > 0, place).otherwise(other)


def in_benchmark_order(rows: DataFrame) -> DataFrame:
    """The rows of a report in order, with their ``place`` from 1: a few rows, one for each model and language."""
    at = Window.orderBy(order_by_list(F.col("input_language"), BENCHMARK_LANGUAGES, strict=True), order_by_list(F.col("model_name"), MODEL_ORDER, strict=True))
    return rows.withColumn("place", F.row_number().over(at)).orderBy("place")


def with_sample_order(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"language_order": order_by_list(F.col("input_language"), SAMPLE_LANGUAGES, strict=False), "model_order": order_by_list(F.col("model_name"), MODEL_ORDER, strict=False)})


def combined_rows(summaries: DataFrame) -> DataFrame:
    """The wide row of each model and language: precision at all cut-offs, hits at 1, 5 and 10, mean precision."""
    head = [c for c in ("model_name", "input_language", "query_mode", "prompt_template", "prompt_label") if c in summaries.columns]
    return summaries.select(*head, *[F.col(f"`avg_precision@{k}`") for k in KS], *[F.col(f"`avg_hit@{k}`") for k in (1, 5, 10)], mean_precision().alias("avg_precision_mean"))


def with_mean_precision(rows: DataFrame) -> DataFrame:
    """The stored mean where there is one, else that of the six cut-offs."""
    stored = F.col("avg_precision_mean") if "avg_precision_mean" in rows.columns else F.lit(None).cast("double")
    return rows.withColumn("avg_precision_mean", F.coalesce(stored, mean_precision()))


def retrieval_table(rows: DataFrame) -> DataFrame:
    """Cells of the retrieval table, as text."""
    rows = with_mean_precision(rows)
    head = [display_name(F.col("model_name")).alias("model")] + (["input_language"] if "input_language" in rows.columns else [])
    return rows.select(*head, *[percent(F.col(f"`avg_precision@{k}`")).alias(f"top{k}") for k in KS], percent(F.col("avg_precision_mean")).alias("average"))


def rerank_table(summary: DataFrame, judged: DataFrame) -> DataFrame:
    """Label-based and judged ratios of each method, as text; a method without a judgement is left out."""
    both = summary.join(judged, "method_name")
    return both.select(
        display_name(F.col("method_name")).alias("method"), percent(F.col("avg_top5_relevance_ratio")).alias("label_top5"), percent(F.col("avg_filtered_irrelevant_ratio")).alias("label_filtered"),
        percent(F.col("avg_top5_relevant_ratio_gpt")).alias("judge_top5"), percent(F.col("avg_filtered_correct_ratio_gpt")).alias("judge_filtered"),
    )


def multi_route_table(summary: DataFrame) -> DataFrame:
    """Precision and hit rate at 10 of each route (``route`` and its means), as text."""
    return summary.select(display_name(F.col("route")).alias("route"), percent(F.col("`avg_precision@10`")).alias("top10"), percent(F.col("`avg_hit@10`")).alias("hit10"))


def best_judged(summary: DataFrame, judged: DataFrame) -> DataFrame:
    """The method the judge finds best, found after the two tables are joined by name; of equals the first in order of name."""
    both = summary.join(judged, "method_name")
    return both.orderBy(F.desc("avg_top5_relevant_ratio_gpt"), "method_name").limit(1)


def merge_judge_batches(batches: list[DataFrame]) -> DataFrame:
    """Rows of batches whose columns differ, one under the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def judge_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("method_name").agg(F.avg("top5_relevant_ratio_gpt").alias("avg_top5_relevant_ratio_gpt"), F.avg("filtered_correct_ratio_gpt").alias("avg_filtered_correct_ratio_gpt"), F.count("*").alias("case_count"))


def listed(text: str) -> list[str]:
    """The names of a comma-separated option."""
    return [x.strip() for x in text.split(",") if x.strip()]


def restrict(rows: DataFrame, column: str, names: str) -> DataFrame:
    return rows.where(F.col(column).isin(listed(names)))


def suffixed(name: str, suffix: str) -> str:
    return f"{name}{suffix}" if suffix else name
