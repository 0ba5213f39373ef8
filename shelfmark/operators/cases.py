"""Retrieval cases: several seeded references per subcategory, four routes each, and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.vectors import fuse
from shelfmark.operators.fusion import aggregate_lists, merge_routes
from shelfmark.operators.metrics import KS, judged, macro, per_query, without_reference
from shelfmark.operators.ranking import nearest, sample_groups
from shelfmark.operators.rerank import matched

ROUTES = ("text_to_image", "image_to_image", "image_text_to_image", "multi_route")


def repeat_cases(members: DataFrame, repeats: int, seed: int, *, strict: bool = False) -> DataFrame:
    """``case_id, key, repeat_id, reference``: ``repeats`` members (``key, idx``) of each subcategory."""
    cases = sample_groups(members.select("key", "idx").distinct(), "key", "idx", repeats, seed, strict=strict)
    return cases.select(F.xxhash64("key", "repeat_id").alias("case_id"), "key", "repeat_id", F.col("idx").alias("reference"))


def rank_routes(cases: DataFrame, texts: DataFrame, corpus: DataFrame, k: int = 50, per_route: int = 5) -> DataFrame:
    """``case_id, route, rank, idx`` of the four routes.

    ``texts`` has the text vector of each ``key``, ``corpus`` is ``idx, vector``; a case without either is an error. The text route is ranked once a key, not
    once a case; the reference of a case is left out of all its routes.
    """
    own = corpus.select(F.col("idx").alias("reference"), F.col("vector").alias("image"))
    full = matched(matched(cases, own, "reference", "image"), texts.select("key", F.col("vector").alias("text")), "key", "text")
    full = full.select("case_id", "key", "reference", "image", "text", fuse(F.col("image"), F.col("text")).alias("fused"))
    search = lambda c: nearest(full.select(F.col("case_id").alias("query_id"), F.col(c).alias("vector"), "reference"), corpus, k, exclude="reference").withColumnRenamed("query_id", "case_id")
    image, fused = search("image"), search("fused")
    keyed = texts.where("vector is not null").select(F.xxhash64("key").alias("query_id"), "vector", "key")
    by_text = nearest(keyed, corpus, k + 1).join(keyed.select("query_id", "key"), "query_id").select("key", F.col("rank").alias("r"), "idx")
    text = cases.join(by_text, "key").where("idx <> reference")
    text = _renumbered(text.select("case_id", "r", "idx")).where(F.col("rank") <= k)
    multi = merge_routes(text, image.select("case_id", "rank", "idx"), per_route, by="case_id")
    routes = zip(ROUTES, (text, image, fused, multi), strict=True)
    out = None
    for name, r in routes:
        part = r.select("case_id", F.lit(name).alias("route"), "rank", "idx")
        out = part if out is None else out.unionByName(part)
    return out


def _renumbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("r"))).drop("r")


def case_relevance(cases: DataFrame, qrels: DataFrame) -> DataFrame:
    """``case_id, idx``: the members of the case's subcategory but its reference."""
    all_of = cases.select("case_id", "key").join(qrels.select("key", "idx").distinct(), "key").select("case_id", "idx")
    return without_reference(all_of, cases.select("case_id", "reference"), "case_id")


def case_metrics(cases: DataFrame, routes: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``case_id, route`` and the metrics of each case; the merged route has metrics at 10 only.

    All routes are judged in one join and counted in one aggregation by case and route.
    """
    relevance = case_relevance(cases, qrels)
    counts = relevance.groupBy("case_id").agg(F.count("*").alias("positives"))
    hits = judged(routes.where(F.col("rank") <= max(ks)), relevance, "case_id").groupBy("case_id", "route")
    hits = hits.agg(*[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"h{k}") for k in ks])
    grid = cases.select("case_id", F.explode(F.array(*map(F.lit, ROUTES))).alias("route"))
    rows = grid.join(counts, "case_id", "left").join(hits, ["case_id", "route"], "left")
    n, h = F.coalesce("positives", F.lit(0)).cast("double"), lambda k: F.coalesce(f"h{k}", F.lit(0)).cast("double")
    own = lambda k, c: c if k == 10 else F.when(F.col("route") != "multi_route", c)
    return rows.select(
        "case_id", "route", n.alias("positive_count"),
        *[own(k, h(k) / F.lit(float(k))).alias(f"precision@{k}") for k in ks],
        *[own(k, F.try_divide(h(k), n)).alias(f"recall@{k}") for k in ks],
        *[own(k, F.when(h(k) > 0, 1.0).otherwise(0.0)).alias(f"hit@{k}") for k in ks],
    )


def case_summary(metrics: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over the cases of each route."""
    return metrics.groupBy("route").agg(*[F.avg(f"`{m}@{k}`").alias(f"avg_{m}@{k}") for m in ("precision", "recall", "hit") for k in ks], F.count("*").alias("query_count"))


def top10_summary(rankings: DataFrame, relevance: DataFrame, queries: DataFrame, by: str) -> DataFrame:
    """``avg_precision@10, avg_hit@10, query_count`` of lists of ten."""
    return macro(per_query(rankings, relevance, queries, (10,), by), (10,)).select("`avg_precision@10`", "`avg_hit@10`", "query_count")


def aggregated_candidates(cases: DataFrame, routes: DataFrame, route: str = "multi_route", total: int = 10) -> DataFrame:
    """The lists of a subcategory's cases as one: ``key, rank, idx, score, hits, best_rank``."""
    lists = routes.where((F.col("route") == route) & (F.col("rank") <= total)).join(cases.select("case_id", "key", "repeat_id"), "case_id")
    return aggregate_lists(lists, "key", "repeat_id", total)


def candidate_rows(cases: DataFrame, routes: DataFrame, products: DataFrame, attributes: DataFrame, total: int = 10, of: tuple[str, ...] = ("multi_route", "image_text_to_image")) -> DataFrame:
    """One row per subcategory for a sink: ``key``, its ``attributes``, ``reference_indices``, ``reference_image_paths`` in order of the
    cases, and of each route a list of ``rank, index, product_id, image_path``.

    The attributes (a row per ``key``) are those of the first case, as all cases of a key share them. Cases or candidates without a
    catalogue line, and keys without attributes, are an error.
    """
    names = products.select("idx", "id", "image")
    item = F.struct("rank", F.col("idx").alias("index"), F.col("id").alias("product_id"), F.col("image").alias("image_path"))
    refs = matched(cases.withColumnRenamed("reference", "idx"), names, "idx", "image").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("repeat_id", "idx", "image"))).alias("r"))
    rows = matched(refs, attributes.withColumn("_known", F.lit(1)), "key", "_known").drop("_known")
    rows = rows.withColumns({"reference_indices": F.col("r.idx"), "reference_image_paths": F.col("r.image")}).drop("r")
    for route in of:
        lists = matched(aggregated_candidates(cases, routes, route, total), names, "idx", "id").groupBy("key").agg(F.array_sort(F.collect_list(item)).alias(f"{route}_top{total}"))
        rows = rows.join(lists, "key", "left")
    return rows
