"""Routes of candidates into one list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_routes(first: DataFrame, second: DataFrame, per_route: int = 5, *, by: str = "query_id") -> DataFrame:
    """``by, rank, idx``: the first ``per_route`` of one ranking, then as many of the other that aren't among them.

    Rankings are ``by, rank, idx``; an ``idx`` twice in one counts at its first place. ``per_route <= 0`` takes all.
    Of the second route only ``2 * per_route`` ranks can matter, so a longer one is cut before the join.
    """
    once = lambda r: r.groupBy(by, "idx").agg(F.min("rank").alias("rank"))
    a, b = once(first), once(second)
    at = Window.partitionBy(by).orderBy("rank")
    a = a.withColumn("n", F.row_number().over(at))
    if per_route > 0:
        a = a.where(F.col("n") <= per_route)
    b = b.withColumn("n", F.row_number().over(at))
    if per_route > 0:
        b = b.where(F.col("n") <= 2 * per_route)
    b = b.drop("n").join(a.select(by, "idx"), [by, "idx"], "left_anti").withColumn("n", F.row_number().over(at))
    if per_route > 0:
        b = b.where(F.col("n") <= per_route)
    both = a.select(by, "idx", F.lit(0).alias("route"), "n").unionByName(b.select(by, "idx", F.lit(1).alias("route"), "n"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("route", "n"))).select(by, "rank", "idx")


def aggregate_lists(lists: DataFrame, by: str, list_id: str, total: int = 10) -> DataFrame:
    """``by, rank, idx, score, hits, best_rank``: reciprocal-rank sum over the lists of a group.

    Order: score, then number of lists, both descending, then best rank, then ``idx``. The sum is folded in the
    order of the lists, so it is the same to the last bit wherever it runs.
    """
    rows = lists.groupBy(by, "idx").agg(F.array_sort(F.collect_list(F.struct(list_id, "rank"))).alias("at"), F.count("*").alias("hits"), F.min("rank").alias("best_rank"))
    rows = rows.withColumn("score", F.aggregate("at", F.lit(0.0), lambda acc, x: acc + F.lit(1.0) / x["rank"])).drop("at")
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("hits"), "best_rank", "idx")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= total).select(by, "rank", "idx", "score", "hits", "best_rank")
