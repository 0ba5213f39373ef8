"""Reranking and filtering of candidates, and how well it went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.generation import decode_selection
from shelfmark.functions.text import document_text


def matched(rows: DataFrame, known: DataFrame, on: str, filled: str) -> DataFrame:
    """An inner join in which a row without its partner is an error, not a missing row; ``filled`` is a column of ``known`` that is never null."""
    both = rows.join(known, on, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {on} "), F.col(on).cast("string")))
    return both.withColumn(filled, F.when(F.col(filled).isNull(), missing).otherwise(F.col(filled)))


def candidate_documents(candidates: DataFrame, products: DataFrame, mode: str = "compact_rerank_zh", *, strict: bool = True) -> DataFrame:
    """``query_id, cand_rank, idx`` with the product's id, image path, subcategory and text. A candidate that is no product is an error,
    or without ``strict`` left out."""
    own = products.select("idx", F.col("id").alias("product_id"), F.col("image").alias("image_path"), "subcategory", document_text(mode).alias("document"))
    return matched(candidates, own, "idx", "document") if strict else candidates.join(own, "idx")


def rank_by_score(scored: DataFrame) -> DataFrame:
    """``rank`` by descending score, ties in candidate order, NaN last."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "cand_rank")
    return scored.withColumn("rank", F.row_number().over(order))


def select_by_model(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates in the order a model's answer (``query_id, answer``) names them.

    Numbers that name no candidate are dropped, repeated ones keep their places. The score is 6 less the
    candidate's own place. Answers that can't be read give no rows; ``decode_selection`` tells why.
    """
    read = answers.select("query_id", decode_selection(F.col("answer")).alias("s"))
    named = read.select("query_id", F.posexplode("s.ranked_doc_ids").alias("pos", "cand_rank"))
    chosen = named.join(candidates, ["query_id", "cand_rank"]).withColumn("score", (F.lit(6) - F.col("cand_rank")).cast("double"))
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).drop("pos")


def filtered_out(ranked: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """The candidates that aren't among the first ``k``, in candidate order."""
    return candidates.join(ranked.where(F.col("rank") <= k).select("query_id", "idx").distinct(), ["query_id", "idx"], "left_anti")


def selection_ratios(ranked: DataFrame, candidates: DataFrame, match: Column, k: int = 5) -> DataFrame:
    """``query_id, top5_relevance_ratio, filtered_irrelevant_ratio``; the latter is 0 where nothing was filtered out,
    the former null where nothing was selected. ``match`` tells a relevant row; unknown counts as no match."""
    hit = F.coalesce(match, F.lit(False)).cast("double")
    top = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.avg(hit).alias("top5_relevance_ratio"))
    rest = filtered_out(ranked, candidates, k).groupBy("query_id").agg(F.avg(F.lit(1.0) - hit).alias("filtered_irrelevant_ratio"))
    ids = candidates.select("query_id").distinct()
    return ids.join(top, "query_id", "left").join(rest, "query_id", "left").withColumn("filtered_irrelevant_ratio", F.coalesce("filtered_irrelevant_ratio", F.lit(0.0)))


def rerank_summary(ratios: DataFrame) -> DataFrame:
    """Means of each ``method_name``."""
    return ratios.groupBy("method_name").agg(F.avg("top5_relevance_ratio").alias("avg_top5_relevance_ratio"), F.avg("filtered_irrelevant_ratio").alias("avg_filtered_irrelevant_ratio"), F.count("*").alias("case_count"))


def case_rows(ranked: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """One row per query with parallel lists of the selected and of the filtered candidates."""
    fields = ("product_id", "idx", "image_path", "document")
    ordered = lambda rank, cols: F.array_sort(F.collect_list(F.struct(rank, *cols)))
    top = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(ordered("rank", (*fields, "score")).alias("t"))
    rest = filtered_out(ranked, candidates, k).groupBy("query_id").agg(ordered("cand_rank", fields).alias("f"))
    names = {"product_id": "product_ids", "idx": "indices", "image_path": "image_paths", "document": "documents", "score": "scores"}
    cells = [F.col(f"t.{c}").alias(f"top5_{names[c]}") for c in (*fields, "score")] + [F.col(f"f.{c}").alias(f"filtered_{names[c]}") for c in fields]
    return candidates.select("query_id").distinct().join(top, "query_id", "left").join(rest, "query_id", "left").select("query_id", *cells)
