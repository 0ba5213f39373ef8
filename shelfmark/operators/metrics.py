"""Retrieval quality at cut-offs. Rankings are long tables ``query_id, rank, idx``, relevance is ``query_id, idx``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import mean_of

KS = (1, 3, 5, 10, 20, 50)


def judged(rankings: DataFrame, relevance: DataFrame, by: str = "query_id") -> DataFrame:
    """The rankings with ``rel``, 1 where the item is relevant. Relevance listed twice counts once."""
    known = relevance.select(by, "idx").distinct().withColumn("rel", F.lit(1))
    return rankings.join(known, [by, "idx"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def without_reference(relevance: DataFrame, references: DataFrame, by: str = "query_id") -> DataFrame:
    """Relevance less the reference item of each query (``by, reference``)."""
    return relevance.join(references.select(by, F.col("reference").alias("idx")), [by, "idx"], "left_anti")


def per_query(rankings: DataFrame, relevance: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS, by: str = "query_id") -> DataFrame:
    """``by, positive_count, precision@k, recall@k, hit@k`` for every query of ``queries``.

    Precision divides by ``k``, also where a list is shorter. A query without positives has null recall,
    one without a list zeros.
    """
    counts = relevance.select(by, "idx").distinct().groupBy(by).agg(F.count("*").alias("positives"))
    deep = judged(rankings.where(F.col("rank") <= max(ks)), relevance, by)
    hits = deep.groupBy(by).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"h{k}") for k in ks])
    rows = queries.select(by).distinct().join(counts, by, "left").join(hits, by, "left")
    n, h = F.coalesce("positives", F.lit(0)), lambda k: F.coalesce(f"h{k}", F.lit(0)).cast("double")
    return rows.select(
        by, n.cast("double").alias("positive_count"),
        *[(h(k) / F.lit(float(k))).alias(f"precision@{k}") for k in ks],
        *[F.try_divide(h(k), n.cast("double")).alias(f"recall@{k}") for k in ks],
        *[F.when(h(k) > 0, 1.0).otherwise(0.0).alias(f"hit@{k}") for k in ks],
    )


def macro(rows: DataFrame, ks: tuple[int, ...] = KS, prefix: str = "avg_") -> DataFrame:
    """One row of means over the queries; queries without positives don't enter recall."""
    return rows.agg(*[F.avg(f"`{m}@{k}`").alias(f"{prefix}{m}@{k}") for m in ("precision", "recall", "hit") for k in ks], F.count("*").alias("query_count"))


def long_form(summary: DataFrame, ks: tuple[int, ...] = KS, prefix: str = "avg_") -> DataFrame:
    """``k, precision, recall, hit`` from a wide summary."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"`{prefix}{m}@{k}`").alias(m) for m in ("precision", "recall", "hit")]) for k in ks])
    return summary.select(*[c for c in summary.columns if "@" not in c], F.explode(cells).alias("x")).select("*", "x.*").drop("x")


def single_positive(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``recall@k, mrr, median_rank, mean_rank`` of queries with one known positive (``rank`` from 1)."""
    return ranks.agg(
        *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall@{k}") for k in ks],
        F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"), F.median(F.col("rank").cast("double")).alias("median_rank"), F.avg(F.col("rank").cast("double")).alias("mean_rank"),
    )


def mean_precision(ks: tuple[int, ...] = KS, prefix: str = "avg_"):
    return mean_of([F.col(f"`{prefix}precision@{k}`") for k in ks])


def pack(rankings: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """A list column for a sink: the first ``k`` items in order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "idx")))
    return rankings.where(F.col("rank") <= k).groupBy(by).agg(F.transform(ordered, lambda x: x["idx"]).alias(name))
