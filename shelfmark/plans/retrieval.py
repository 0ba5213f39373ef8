"""Registered queries of retrieval: rankings, routes, cases and their quality on the embedding table.

The corpus is every embedding, labels are the subcategories. Queries are the rows whose id is divisible by 100; the
text vector of a label is that of its lowest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.vectors import fuse, l2_normalize, norm, sigmoid
from shelfmark.operators import cases as C
from shelfmark.operators import metrics as M
from shelfmark.operators import ranking as R
from shelfmark.operators.fusion import merge_routes
from shelfmark.operators.report import combined_rows, multi_route_table, retrieval_table
from shelfmark.plans.runtime import spread, table
from shelfmark.sources.files import predictions

SEED, REPEATS = 20260403, 5
KS = M.KS


def rounded(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and fractions to six digits, as the SQL has them."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if k in ("double", "float") else F.col(f"`{c}`").cast("bigint").alias(c) if k in ("int", "bigint", "smallint") else F.col(f"`{c}`") for c, k in kinds.items()])


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"), "label"))


def queries_of(c: DataFrame) -> DataFrame:
    return c.where("idx % 100 = 0").select(F.col("idx").alias("query_id"), "vector", "label", F.col("idx").alias("own"))


def relevance_of(q: DataFrame, c: DataFrame) -> DataFrame:
    return q.join(c.select("idx", "label"), "label").where("idx <> query_id").select("query_id", "idx")


def prototypes(c: DataFrame) -> DataFrame:
    return c.groupBy("label").agg(F.min_by("vector", "idx").alias("vector"), F.min("idx").alias("prototype"))


def i2i_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest neighbours of each query, itself left out."""
    c = corpus(spark, d)
    return rounded(R.nearest(queries_of(c), c, 10, exclude="own"))


def i2i_ranked_sql_strategy(spark: SparkSession, d: str) -> DataFrame:
    """The same by the declarative strategy."""
    c = corpus(spark, d)
    return rounded(R.nearest(queries_of(c), c, 10, exclude="own", strategy="sql"))


def i2i_last_variant(spark: SparkSession, d: str) -> DataFrame:
    """The labels' prototypes against each other, self kept at the end of the list instead of left out."""
    p = prototypes(corpus(spark, d))
    found = R.nearest(p.select(F.col("prototype").alias("query_id"), "vector", F.col("prototype").alias("own")), p.select(F.col("prototype").alias("idx"), "vector"), 50, exclude="own", how="last")
    return rounded(found.select("query_id", "rank", "idx"))


def i2i_per_query(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    q = queries_of(c)
    return rounded(M.per_query(R.nearest(q, c, max(KS), exclude="own"), relevance_of(q, c), q))


def i2i_eval(spark: SparkSession, d: str) -> DataFrame:
    """Macro precision, recall and hit rate at the six cut-offs."""
    c = corpus(spark, d)
    q = queries_of(c)
    m = M.per_query(R.nearest(q, c, max(KS), exclude="own"), relevance_of(q, c), q)
    return rounded(M.long_form(M.macro(m)))


def topk_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The list of each query as a report holds it: images, scores and whether they are right, in order."""
    c = corpus(spark, d)
    q = queries_of(c)
    images = c.select("idx", F.concat(F.lit("images/"), "label", F.lit("/"), "idx", F.lit(".jpg")).alias("image"))
    rows = predictions(R.nearest(q, c, 10, exclude="own").withColumn("score", F.round("score", 4)), relevance_of(q, c), images)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)) if c == "topk_scores" else F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("query_id", text("topk_image_paths"), text("topk_scores"), text("topk_correct_flags"))


def fused_eval(spark: SparkSession, d: str) -> DataFrame:
    """Image and text vector fused into one query."""
    c = corpus(spark, d)
    q = queries_of(c).join(prototypes(c).select("label", F.col("vector").alias("text")), "label").withColumn("vector", fuse(F.col("vector"), F.col("text"))).drop("text")
    m = M.per_query(R.nearest(q, c, max(KS), exclude="own"), relevance_of(q, c), q)
    return rounded(M.long_form(M.macro(m)))


def single_positive_eval(spark: SparkSession, d: str) -> DataFrame:
    """Rank statistics of each query's one positive, the prototype of its label."""
    c = corpus(spark, d)
    q = queries_of(c).join(prototypes(c).select("label", F.col("prototype").alias("positive")), "label").where("positive <> query_id")
    return rounded(M.single_positive(R.rank_of_positive(q, c)))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d).withColumn("unit", l2_normalize(F.col("vector")))
    return rounded(c.select("idx", norm(F.col("vector")).alias("norm"), norm(F.col("unit")).alias("unit_norm"), sigmoid(norm(F.col("vector"))).alias("sigmoid")))


def _cases(c: DataFrame) -> DataFrame:
    return C.repeat_cases(c.select(F.col("label").alias("key"), "idx"), REPEATS, SEED)


def _routes(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    cases = _cases(c)
    texts = prototypes(c).select(F.col("label").alias("key"), "vector")
    return cases, C.rank_routes(cases, texts, c.select("idx", "vector"))


def repeat_cases(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cases(corpus(spark, d)).select("key", "repeat_id", "reference"))


def case_routes(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of every route of every case."""
    cases, routes = _routes(corpus(spark, d))
    return rounded(routes.where("rank <= 10").join(cases, "case_id").select("key", "repeat_id", "route", "rank", "idx"))


def multi_route(spark: SparkSession, d: str) -> DataFrame:
    """Five of the text route, then five others of the image route."""
    c = corpus(spark, d)
    q = queries_of(c)
    image = R.nearest(q, c, 50, exclude="own").select("query_id", "rank", "idx")
    by_text = q.join(prototypes(c).select("label", F.col("vector").alias("text")), "label").select("query_id", F.col("text").alias("vector"), "own")
    text = R.nearest(by_text, c, 50, exclude="own").select("query_id", "rank", "idx")
    return rounded(merge_routes(text, image))


def case_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    cases, routes = _routes(c)
    m = C.case_metrics(cases, routes, c.select(F.col("label").alias("key"), "idx"))
    return rounded(m.join(cases, "case_id").select("key", "repeat_id", "route", "positive_count", *[f"`{x}@10`" for x in ("precision", "recall", "hit")]))


def case_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means of the image and the fused route at all cut-offs, of the merged one at 10."""
    c = corpus(spark, d)
    cases, routes = _routes(c)
    return rounded(C.case_summary(C.case_metrics(cases, routes, c.select(F.col("label").alias("key"), "idx"))))


def aggregated(spark: SparkSession, d: str) -> DataFrame:
    cases, routes = _routes(corpus(spark, d))
    return C.aggregated_candidates(cases, routes)


def aggregated_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregated(spark, d))


def candidate_table(spark: SparkSession, d: str) -> DataFrame:
    """Each label's row for a sink: both routes' lists, the references and their images, the label's attributes."""
    c = corpus(spark, d)
    cases, routes = _routes(c)
    lines = c.select("idx", F.concat(F.lit("p"), "idx").alias("id"), F.concat(F.lit("images/"), "label", F.lit("/"), "idx", F.lit(".jpg")).alias("image"))
    attributes = c.select(F.col("label").alias("key")).distinct().withColumn("text_query", F.concat(F.lit("label "), "key"))
    rows = C.candidate_rows(cases, routes, lines, attributes)
    text = lambda n, f: F.array_join(F.transform(n, f), ",").alias(n)
    item = lambda x: F.concat_ws(":", x["rank"], x["index"], x["product_id"], x["image_path"])
    same = lambda x: x.cast("string")
    return rounded(rows.select("key", "text_query", text("reference_indices", same), text("reference_image_paths", same), text("multi_route_top10", item), text("image_text_to_image_top10", item)))


def multi_route_summary(spark: SparkSession, d: str) -> DataFrame:
    """Precision and hit rate of the merged lists of ten."""
    c = corpus(spark, d)
    cases, routes = _routes(c)
    relevance = C.case_relevance(cases, c.select(F.col("label").alias("key"), "idx"))
    return rounded(C.top10_summary(routes.where("route = 'multi_route'"), relevance, cases, "case_id"))


def multi_route_report(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    cases, routes = _routes(c)
    m = C.case_metrics(cases, routes, c.select(F.col("label").alias("key"), "idx"))
    return multi_route_table(rounded(C.case_summary(m).where(F.col("route").isin("multi_route", "image_text_to_image"))))


def late_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """What stands behind the first five of ten neighbours."""
    c = corpus(spark, d)
    return rounded(R.beyond(R.nearest(queries_of(c), c, 10, exclude="own"), 5))


def _twice(c: DataFrame) -> DataFrame:
    """Every vector under two ids."""
    return c.unionByName(c.withColumn("idx", F.col("idx") + 1_000_000))


def rank_with_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Where each query's prototype, in its second copy, stands among vectors that all come twice."""
    c = corpus(spark, d)
    q = queries_of(c).join(prototypes(c).select("label", F.col("prototype").alias("positive")), "label").where("positive <> query_id")
    return rounded(R.rank_of_positive(q.withColumn("positive", F.col("positive") + 1_000_000), _twice(c)))


def neighbours_with_duplicates(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return rounded(R.nearest(queries_of(c), _twice(c), 11).select("query_id", "rank", "idx"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """The three searched routes as if they were models."""
    c = corpus(spark, d)
    cases, routes = _routes(c)
    m = C.case_metrics(cases, routes.where("route <> 'multi_route'"), c.select(F.col("label").alias("key"), "idx")).where("route <> 'multi_route'")
    return C.case_summary(m).withColumnRenamed("route", "model_name").withColumn("input_language", F.lit("en"))


def combined_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(combined_rows(_summaries(spark, d)))


def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_table(combined_rows(rounded(_summaries(spark, d))))


def best_route(spark: SparkSession, d: str) -> DataFrame:
    """The row of the best mean precision, the first in order of name among equals."""
    rows = combined_rows(_summaries(spark, d))
    return rounded(R.first_best(rows, F.round("avg_precision_mean", 9), "model_name").select("model_name", "avg_precision_mean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        i2i_eval, i2i_ranked, i2i_ranked_sql_strategy, i2i_last_variant, i2i_per_query, fused_eval, single_positive_eval, vector_norms, repeat_cases,
        topk_predictions, case_routes, multi_route, case_metrics, case_summary, aggregated_candidates, combined_report, retrieval_report, best_route,
        candidate_table, multi_route_summary, multi_route_report, late_neighbours, rank_with_duplicates, neighbours_with_duplicates,
    )
}

_Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0)"
_P = "p AS (SELECT label, min(vec_id) AS prototype FROM embeddings GROUP BY label), pv AS (SELECT p.label, p.prototype, e.embedding::DOUBLE[] AS v FROM p JOIN embeddings e ON e.vec_id = p.prototype)"
_R = """s AS (SELECT q.query_id, c.vec_id AS idx, list_dot_product(q.v, c.embedding::DOUBLE[]) AS score, c.label AS cl FROM q JOIN embeddings c ON c.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM s)"""
_REL = "rel AS (SELECT q.query_id, e.vec_id AS idx FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.query_id)"


def _fused(a: str, b: str) -> str:
    mean = f"list_transform(list_zip({a}, {b}), lambda x: (x[1] + x[2]) / 2.0)"
    return f"(SELECT list_transform(m, lambda y: y / sqrt(list_dot_product(m, m))) FROM (SELECT {mean} AS m))"


def _metrics_sql(source: str, ks: tuple[int, ...] = KS, by: str = "query_id", queries: str = "q") -> str:
    """Per-query metrics over a ranking ``source`` and relevance ``rel``."""
    cells = ", ".join(f"coalesce(h{k}, 0) / {k}.0 AS \"precision@{k}\", CASE WHEN coalesce(n, 0) > 0 THEN coalesce(h{k}, 0)::DOUBLE / n END AS \"recall@{k}\", CASE WHEN coalesce(h{k}, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS \"hit@{k}\"" for k in ks)
    sums = ", ".join(f"sum(CASE WHEN x.rank <= {k} THEN 1 ELSE 0 END) AS h{k}" for k in ks)
    return (
        f"h AS (SELECT x.{by}, {sums} FROM {source} x JOIN rel ON rel.{by} = x.{by} AND rel.idx = x.idx WHERE x.rank <= {max(ks)} GROUP BY 1), "
        f"n AS (SELECT {by}, count(*) AS n FROM rel GROUP BY 1), "
        f"m AS (SELECT z.{by}, coalesce(n, 0)::DOUBLE AS positive_count, {cells} FROM (SELECT DISTINCT {by} FROM {queries}) z LEFT JOIN n USING ({by}) LEFT JOIN h USING ({by}))"
    )


def _long_sql(ks: tuple[int, ...] = KS) -> str:
    return " UNION ALL ".join(f"SELECT count(*) AS query_count, {k}::BIGINT AS k, round(avg(\"precision@{k}\"), 6) AS precision, round(avg(\"recall@{k}\"), 6) AS recall, round(avg(\"hit@{k}\"), 6) AS hit FROM m" for k in ks)


_CASES = f"""cases AS (SELECT label AS key, repeat_id, reference, label || ':' || repeat_id AS case_id FROM
(SELECT label, vec_id AS reference, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) AS repeat_id FROM embeddings) WHERE repeat_id <= {REPEATS})"""
_CASE_ROUTES = f"""{_P}, {_CASES},
cv AS (SELECT c.*, e.embedding::DOUBLE[] AS a, pv.v AS b, {_fused("e.embedding::DOUBLE[]", "pv.v")} AS f FROM cases c JOIN embeddings e ON e.vec_id = c.reference JOIN pv ON pv.label = c.key),
sc AS (SELECT cv.case_id, c.vec_id AS idx, list_dot_product(cv.b, c.embedding::DOUBLE[]) AS st, list_dot_product(cv.a, c.embedding::DOUBLE[]) AS si, list_dot_product(cv.f, c.embedding::DOUBLE[]) AS sf
 FROM cv JOIN embeddings c ON c.vec_id <> cv.reference),
single AS (SELECT case_id, 'text_to_image' AS route, row_number() OVER (PARTITION BY case_id ORDER BY st DESC, idx) AS rank, idx FROM sc
 UNION ALL SELECT case_id, 'image_to_image', row_number() OVER (PARTITION BY case_id ORDER BY si DESC, idx), idx FROM sc
 UNION ALL SELECT case_id, 'image_text_to_image', row_number() OVER (PARTITION BY case_id ORDER BY sf DESC, idx), idx FROM sc),
t5 AS (SELECT * FROM single WHERE route = 'text_to_image' AND rank <= 5),
i5 AS (SELECT case_id, idx, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS n FROM single x WHERE route = 'image_to_image' AND rank <= 10 AND NOT EXISTS (SELECT 1 FROM t5 WHERE t5.case_id = x.case_id AND t5.idx = x.idx)),
routes AS (SELECT case_id, route, rank, idx FROM single WHERE rank <= 50 UNION ALL SELECT case_id, 'multi_route', rank, idx FROM t5 UNION ALL SELECT case_id, 'multi_route', 5 + n, idx FROM i5 WHERE n <= 5)"""
_CASE_REL = "rel AS (SELECT c.case_id, e.vec_id AS idx FROM cases c JOIN embeddings e ON e.label = c.key AND e.vec_id <> c.reference)"
_CASE_M = f"""{_CASE_REL}, n AS (SELECT case_id, count(*) AS n FROM rel GROUP BY 1),
rj AS (SELECT x.*, CASE WHEN rel.idx IS NULL THEN 0 ELSE 1 END AS rel FROM routes x LEFT JOIN rel ON rel.case_id = x.case_id AND rel.idx = x.idx),
m AS (SELECT c.case_id, c.key, c.repeat_id, rj.route, n.n::DOUBLE AS positive_count, {", ".join(f'sum(CASE WHEN rank <= {k} THEN rj.rel ELSE 0 END) / {k}.0 AS p{k}, sum(CASE WHEN rank <= {k} THEN rj.rel ELSE 0 END)::DOUBLE / n.n AS r{k}, max(CASE WHEN rank <= {k} THEN rj.rel ELSE 0 END)::DOUBLE AS h{k}' for k in KS)}
 FROM rj JOIN cases c USING (case_id) JOIN n USING (case_id) GROUP BY 1, 2, 3, 4, n.n)"""


def _only10(c: str, k: int) -> str:
    return f"avg({c}{k})" if k == 10 else f"CASE WHEN route = 'multi_route' THEN NULL ELSE avg({c}{k}) END"


_SUMMARY = "SELECT route, " + ", ".join(f"round({_only10(c, k)}, 6) AS \"avg_{n}@{k}\"" for n, c in (("precision", "p"), ("recall", "r"), ("hit", "h")) for k in KS) + ", count(*) AS query_count FROM m GROUP BY route"
_MEAN = " + ".join(f"avg(p{k})" for k in KS)
_COMBINED = (
    "SELECT route AS model_name, 'en' AS input_language, " + ", ".join(f'round(avg(p{k}), 6) AS "avg_precision@{k}"' for k in KS) + ", " + ", ".join(f'round(avg(h{k}), 6) AS "avg_hit@{k}"' for k in (1, 5, 10))
    + f", round(({_MEAN}) / 6.0, 6) AS avg_precision_mean FROM m WHERE route <> 'multi_route' GROUP BY route"
)
_PCT = lambda x: f"printf('%.1f', {x} * 100.0) || '%'"

SQL: dict[str, str] = {
    "i2i_ranked": f"WITH {_Q}, {_R} SELECT query_id, rank, idx, round(score, 6) AS score FROM r WHERE rank <= 10",
    "topk_predictions": f"WITH {_Q}, {_R}, {_REL}, x AS (SELECT r.query_id, r.rank, 'images/' || r.cl || '/' || r.idx || '.jpg' AS image, round(r.score, 4) AS score, CASE WHEN rel.idx IS NULL THEN 0 ELSE 1 END AS flag FROM r LEFT JOIN rel ON rel.query_id = r.query_id AND rel.idx = r.idx WHERE r.rank <= 10) SELECT query_id, string_agg(image, ',' ORDER BY rank) AS topk_image_paths, string_agg(printf('%.4f', score), ',' ORDER BY rank) AS topk_scores, string_agg(flag::VARCHAR, ',' ORDER BY rank) AS topk_correct_flags FROM x GROUP BY query_id",
    "i2i_last_variant": f"WITH {_P} SELECT a.prototype AS query_id, row_number() OVER (PARTITION BY a.prototype ORDER BY a.prototype = b.prototype, list_dot_product(a.v, b.v) DESC, b.prototype) AS rank, b.prototype AS idx FROM pv a CROSS JOIN pv b",
    "i2i_per_query": f"WITH {_Q}, {_R}, {_REL}, {_metrics_sql('r')} SELECT query_id, positive_count, " + ", ".join(f'round("{n}@{k}", 6) AS "{n}@{k}"' for n in ("precision", "recall", "hit") for k in KS) + " FROM m",
    "i2i_eval": f"WITH {_Q}, {_R}, {_REL}, {_metrics_sql('r')} {_long_sql()}",
    "fused_eval": f"WITH q0 AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0), {_P}, q AS (SELECT query_id, {_fused('q0.v', 'pv.v')} AS v, label FROM q0 JOIN pv USING (label)), {_R}, {_REL}, {_metrics_sql('r')} {_long_sql()}",
    "single_positive_eval": f"""WITH {_Q}, {_P}, s AS (SELECT q.query_id, c.vec_id AS idx, p.prototype, row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.v, c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank
 FROM q JOIN p USING (label) CROSS JOIN embeddings c WHERE p.prototype <> q.query_id), k AS (SELECT rank FROM s WHERE idx = prototype)
 SELECT round(avg((rank <= 1)::INT), 6) AS "recall@1", round(avg((rank <= 5)::INT), 6) AS "recall@5", round(avg((rank <= 10)::INT), 6) AS "recall@10", round(avg(1.0 / rank), 6) AS mrr, round(median(rank::DOUBLE), 6) AS median_rank, round(avg(rank::DOUBLE), 6) AS mean_rank FROM k""",
    "vector_norms": "SELECT vec_id AS idx, round(sqrt(list_dot_product(v, v)), 6) AS norm, 1.0::DOUBLE AS unit_norm, round(1 / (1 + exp(-sqrt(list_dot_product(v, v)))), 6) AS sigmoid FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
    "repeat_cases": f"WITH {_CASES} SELECT key::BIGINT AS key, repeat_id, reference FROM cases",
    "case_routes": f"WITH {_CASE_ROUTES} SELECT key::BIGINT AS key, repeat_id, route, rank, idx FROM routes JOIN cases USING (case_id) WHERE rank <= 10",
    "multi_route": f"""WITH {_Q}, {_P}, s AS (SELECT q.query_id, c.vec_id AS idx, list_dot_product(q.v, c.embedding::DOUBLE[]) AS si, list_dot_product(pv.v, c.embedding::DOUBLE[]) AS st FROM q JOIN pv USING (label) JOIN embeddings c ON c.vec_id <> q.query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY si DESC, idx) AS ri, row_number() OVER (PARTITION BY query_id ORDER BY st DESC, idx) AS rt FROM s),
 b AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY ri) AS n FROM r WHERE rt > 5)
 SELECT query_id, rt AS rank, idx FROM r WHERE rt <= 5 UNION ALL SELECT query_id, 5 + n, idx FROM b WHERE n <= 5""",
    "case_metrics": f'WITH {_CASE_ROUTES}, {_CASE_M} SELECT key::BIGINT AS key, repeat_id, route, positive_count, round(p10, 6) AS "precision@10", round(r10, 6) AS "recall@10", round(h10, 6) AS "hit@10" FROM m',
    "case_summary": f"WITH {_CASE_ROUTES}, {_CASE_M} {_SUMMARY}",
    "aggregated_candidates": f"""WITH {_CASE_ROUTES}, l AS (SELECT key, repeat_id, rank, idx FROM routes JOIN cases USING (case_id) WHERE route = 'multi_route' AND rank <= 10),
 g AS (SELECT key, idx, list_reduce(list(1.0::DOUBLE / rank ORDER BY repeat_id), lambda a, b: a + b) AS score, count(*) AS hits, min(rank) AS best_rank FROM l GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, hits DESC, best_rank, idx) AS rank FROM g) SELECT key::BIGINT AS key, rank, idx, round(score, 6) AS score, hits, best_rank FROM o WHERE rank <= 10""",
    "combined_report": f"WITH {_CASE_ROUTES}, {_CASE_M} {_COMBINED}",
    "best_route": f"WITH {_CASE_ROUTES}, {_CASE_M}, c AS ({_COMBINED}) SELECT model_name, avg_precision_mean FROM c ORDER BY avg_precision_mean DESC, model_name LIMIT 1",
    "retrieval_report": f"WITH {_CASE_ROUTES}, {_CASE_M}, c AS ({_COMBINED}) SELECT replace(model_name, '_', '-') AS model, input_language, "
    + ", ".join(f'{_PCT(chr(34) + f"avg_precision@{k}" + chr(34))} AS top{k}' for k in KS) + ", " + _PCT("(" + " + ".join(f'"avg_precision@{k}"' for k in KS) + ") / 6.0") + " AS average FROM c",
}
SQL["i2i_ranked_sql_strategy"] = SQL["i2i_ranked"]
_TWICE = "twice AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings)"
SQL["late_neighbours"] = f"WITH {_Q}, {_R} SELECT query_id, rank, idx, round(score, 6) AS score FROM r WHERE rank > 5 AND rank <= 10"
SQL["multi_route_summary"] = f"""WITH {_CASE_ROUTES}, {_CASE_M} SELECT round(avg(p10), 6) AS "avg_precision@10", round(avg(h10), 6) AS "avg_hit@10", count(*) AS query_count FROM m WHERE route = 'multi_route'"""
SQL["multi_route_report"] = f"WITH {_CASE_ROUTES}, {_CASE_M}, t AS (SELECT route, round(avg(p10), 6) AS p, round(avg(h10), 6) AS h FROM m WHERE route IN ('multi_route', 'image_text_to_image') GROUP BY 1) SELECT replace(route, '_', '-') AS route, {_PCT('p')} AS top10, {_PCT('h')} AS hit10 FROM t"
SQL["rank_with_duplicates"] = f"""WITH {_Q}, {_P}, {_TWICE}, s AS (SELECT q.query_id, t.idx, p.prototype + 1000000 AS positive, row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.v, t.v) DESC, t.idx) AS rank
 FROM q JOIN p USING (label) CROSS JOIN twice t WHERE p.prototype <> q.query_id) SELECT query_id, positive, rank FROM s WHERE idx = positive"""
SQL["neighbours_with_duplicates"] = f"WITH {_Q}, {_TWICE} SELECT * FROM (SELECT q.query_id, row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.v, t.v) DESC, t.idx) AS rank, t.idx FROM q CROSS JOIN twice t) WHERE rank <= 11"


def _list_sql(route: str) -> str:
    item = "rank || ':' || idx || ':p' || idx || ':images/' || label || '/' || idx || '.jpg'"
    return f"""(SELECT key, string_agg({item}, ',' ORDER BY rank) AS x FROM (SELECT o.*, e.label FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, hits DESC, best_rank, idx) AS rank FROM
 (SELECT key, idx, list_reduce(list(1.0::DOUBLE / rank ORDER BY repeat_id), lambda a, b: a + b) AS score, count(*) AS hits, min(rank) AS best_rank FROM (SELECT key, repeat_id, rank, idx FROM routes JOIN cases USING (case_id) WHERE route = '{route}' AND rank <= 10) GROUP BY 1, 2)) o
 JOIN embeddings e ON e.vec_id = o.idx WHERE o.rank <= 10) GROUP BY key)"""


SQL["candidate_table"] = f"""WITH {_CASE_ROUTES}, refs AS (SELECT key, string_agg(reference::VARCHAR, ',' ORDER BY repeat_id) AS ids, string_agg('images/' || key || '/' || reference || '.jpg', ',' ORDER BY repeat_id) AS paths FROM cases GROUP BY 1)
 SELECT refs.key::BIGINT AS key, 'label ' || refs.key AS text_query, ids AS reference_indices, paths AS reference_image_paths, a.x AS multi_route_top10, b.x AS image_text_to_image_top10 FROM refs JOIN {_list_sql("multi_route")} a USING (key) JOIN {_list_sql("image_text_to_image")} b USING (key)"""
