"""Registered queries of reranking and judging.

The candidates are what retrieval gives: of each label the ten that its cases' merged lists agree on, wrong ones among them, with their
catalogue lines. A label goes by the name of the subcategory of its first vector that has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import generation as G
from shelfmark.functions import text as X
from shelfmark.models import ModelConfig, generated, pair_score
from shelfmark.operators import rerank as K
from shelfmark.operators.report import best_judged, judge_summary, merge_judge_batches, rerank_table, restrict
from shelfmark.plans.retrieval import aggregated, rounded
from shelfmark.plans.runtime import cut, table
from shelfmark.sources.files import row_range


def _names(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, category, canonical_subcategory`` of each label."""
    kinds = table(spark, d, "subcategory_queries").select("key", "category", "canonical_subcategory")
    filed = table(spark, d, "qrels").distinct().join(table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "label"), "idx")
    return filed.groupBy("label").agg(F.min_by("key", F.struct("idx", "key")).alias("key")).join(kinds, "key").select(F.col("label").alias("query_id"), "category", "canonical_subcategory")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    lists = aggregated(spark, d).select(F.col("key").alias("query_id"), F.col("rank").alias("cand_rank"), "idx")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "label")
    # The smallest tables have vectors without a catalogue line.
    c = K.candidate_documents(lists.join(labels, "idx"), table(spark, d, "products"), strict=False).join(_names(spark, d), "query_id")
    # Ten rows a query, read several times by what follows: the retrieval runs once.
    return cut(c)


def _match():
    return F.col("label") == F.col("query_id")


def _judge():
    """A judge of its own mind: it goes by whether the document names the subcategory."""
    return F.contains("document", "canonical_subcategory")


def _by_encoder(c: DataFrame) -> DataFrame:
    return K.rank_by_score(c.withColumn("score", pair_score(F.col("canonical_subcategory"), F.col("document"), ModelConfig("overlap"))))


def _prompts(c: DataFrame) -> DataFrame:
    docs = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cand_rank", "document"))).alias("x"), F.first(X.request_text(F.col("category"), F.col("canonical_subcategory"))).alias("request"))
    # Documents are numbered by their place in the prompt.
    return docs.select("query_id", G.judge_prompt(F.col("request"), F.transform("x", lambda x: x["document"])).alias("prompt"))


def _by_model(c: DataFrame) -> DataFrame:
    """Candidates in the order a generator names them."""
    answers = _prompts(c).select("query_id", generated(F.col("prompt"), ModelConfig("longest"))["value"].alias("answer"))
    placed = c.withColumn("cand_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("cand_rank")))
    return K.select_by_model(answers, placed)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a model may word them: clean, in prose, without the closing brace, repeated and foreign numbers, broken, none."""
    kind = F.length("key") % 6
    body = '"ranked_doc_ids":[3,1,2,99,3,7],"filtered_doc_ids":[4,5,6]'
    text = (
        F.when(kind == 0, "{" + body + "}").when(kind == 1, "Sure:\n{" + body + "}\nDone.").when(kind == 2, "{" + body)
        .when(kind == 3, '{"ranked_doc_ids":[2,1,5,4,3],"filtered_doc_ids":[]}').when(kind == 4, '{"ranked_doc_ids":[1,2').otherwise("I can't tell.")
    )
    return table(spark, d, "subcategory_queries").select("key", text.alias("answer"))


def rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_by_encoder(_candidates(spark, d)).select("query_id", "rank", "cand_rank", "idx", "score"))


def rerank_ratios(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    r = _by_encoder(c)
    return rounded(K.selection_ratios(r, c, _match()))


def model_selection(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the order a model named them."""
    return rounded(_by_model(_candidates(spark, d)).select("query_id", "rank", "cand_rank", "idx", "score"))


def model_ratios(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return rounded(K.selection_ratios(_by_model(c), c, _match()))


def decoded_answers(spark: SparkSession, d: str) -> DataFrame:
    s = _answers(spark, d).select("key", G.decode_selection(F.col("answer")).alias("s"))
    join = lambda c: F.array_join(F.col(f"s.{c}").cast("array<string>"), ",").alias(c)
    return s.select("key", join("ranked_doc_ids"), join("filtered_doc_ids"), F.col("s.error").isNotNull().alias("failed"))


def _both(c: DataFrame, match=_match) -> DataFrame:
    return K.selection_ratios(_by_encoder(c), c, match()).withColumn("method_name", F.lit("overlap_encoder")).unionByName(K.selection_ratios(_by_model(c), c, match()).withColumn("method_name", F.lit("language_model")))


def _judge_rows(c: DataFrame) -> DataFrame:
    """The judge's rows of both methods, from two batches whose columns differ."""
    rows = _both(c, _judge).select("method_name", F.col("query_id").alias("subcategory"), F.col("top5_relevance_ratio").alias("top5_relevant_ratio_gpt"), F.col("filtered_irrelevant_ratio").alias("filtered_correct_ratio_gpt"))
    early, late = rows.where("subcategory < 5"), rows.where("subcategory >= 5").withColumn("notes", F.concat(F.lit("label "), "subcategory"))
    return merge_judge_batches([early, late])


def judged_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_judge_rows(_candidates(spark, d)))


def judged_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(judge_summary(_judge_rows(_candidates(spark, d))))


def rerank_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.rerank_summary(_both(_candidates(spark, d))))


def rerank_report(spark: SparkSession, d: str) -> DataFrame:
    """The table of both methods, by the labels and by a judge of its own mind."""
    c = _candidates(spark, d)
    return rerank_table(rounded(K.rerank_summary(_both(c))), rounded(judge_summary(_judge_rows(c))))


def judged_best(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    best = best_judged(rounded(K.rerank_summary(_both(c))), rounded(judge_summary(_judge_rows(c))).drop("case_count"))
    return best.select("method_name", "avg_top5_relevance_ratio", "avg_top5_relevant_ratio_gpt")


def restricted_methods(spark: SparkSession, d: str) -> DataFrame:
    """Of the methods, those that an option names."""
    return rounded(restrict(K.rerank_summary(_both(_candidates(spark, d))), "method_name", " language_model, ,bge"))


def filtered_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    r = _by_encoder(c)
    return rounded(K.filtered_out(r, c).select("query_id", "cand_rank", "idx"))


def rerank_case_rows(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    r = _by_encoder(c)
    rows = K.case_rows(r, c)
    join = lambda x: F.array_join(F.col(x).cast("array<string>"), ",").alias(x)
    return rows.select("query_id", *[join(x) for x in ("top5_product_ids", "top5_indices", "top5_image_paths", "filtered_product_ids", "filtered_indices", "filtered_image_paths")])


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(_candidates(spark, d))


def candidate_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows 5 to 24 of the list of subcategories in order of key."""
    keys = F.array_sort(F.collect_list("key"))
    return rounded(row_range(table(spark, d, "subcategory_queries").agg(keys.alias("k")).select(F.posexplode("k").alias("pos", "key")), 5, 20))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (rerank_scores, rerank_ratios, rerank_summary, rerank_report, filtered_candidates, rerank_case_rows, model_selection, model_ratios, decoded_answers, judge_prompts, candidate_range, judged_rows, judged_summary, judged_best, restricted_methods)
}

from shelfmark.plans.catalogue import SQL as _CATALOGUE  # noqa: E402
from shelfmark.plans.retrieval import SQL as _RETRIEVAL  # noqa: E402

_NAMES = "names AS (SELECT f.label, s.category, s.canonical_subcategory FROM (SELECT e.label, arg_min(q.key, (q.idx, q.key)) AS key FROM (SELECT DISTINCT key, idx FROM qrels) q JOIN embeddings e ON e.vec_id = q.idx GROUP BY 1) f JOIN subcategory_queries s ON s.key = f.key)"
_CAND = f"""d AS ({_CATALOGUE["documents_compact_rerank_zh"]}), agg AS ({_RETRIEVAL["aggregated_candidates"]}), {_NAMES},
c AS (SELECT a.key AS query_id, a.rank AS cand_rank, row_number() OVER (PARTITION BY a.key ORDER BY a.rank) AS place, a.idx, p.id, p.image, e.label, d.document, s.category, s.canonical_subcategory
 FROM agg a JOIN embeddings e ON e.vec_id = a.idx JOIN products p ON p.idx = a.idx JOIN d ON d.idx = a.idx JOIN names s ON s.label = a.key)"""
_LOGIT = "len(list_intersect(list_distinct(string_split(canonical_subcategory, '')), list_distinct(string_split(document, '')))) - 2.0"
_RANKED = f"e AS (SELECT *, 1 / (1 + exp(-({_LOGIT}))) AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_LOGIT} DESC, cand_rank) AS rank FROM c)"
_CHOSEN = "m AS (SELECT * EXCLUDE (pos) FROM (SELECT *, (6 - place)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY length(document) DESC, place) AS pos, pos AS rank FROM c) WHERE rank <= 5)"
_READ = "SELECT key, CASE length(key) % 6 WHEN 0 THEN [3,1,2,99,3,7] WHEN 1 THEN [3,1,2,99,3,7] WHEN 2 THEN [3,1,2,99,3,7] WHEN 3 THEN [2,1,5,4,3] END AS ids, CASE WHEN length(key) % 6 < 3 THEN [4,5,6] WHEN length(key) % 6 = 3 THEN [] END AS rest FROM subcategory_queries"
_HIT = "CASE WHEN label = query_id THEN 1.0 ELSE 0.0 END"
_SAID = "CASE WHEN contains(document, canonical_subcategory) THEN 1.0 ELSE 0.0 END"


def _ratios_sql(ranked: str, name: str, hit: str = _HIT) -> str:
    return f"""t_{name} AS (SELECT query_id, avg({hit}) AS top5 FROM {ranked} WHERE rank <= 5 GROUP BY 1),
f_{name} AS (SELECT query_id, avg(1.0 - ({hit})) AS rest FROM c WHERE NOT EXISTS (SELECT 1 FROM {ranked} x WHERE x.query_id = c.query_id AND x.idx = c.idx AND x.rank <= 5) GROUP BY 1),
r_{name} AS (SELECT i.query_id, top5 AS top5_relevance_ratio, coalesce(rest, 0.0) AS filtered_irrelevant_ratio FROM (SELECT DISTINCT query_id FROM c) i LEFT JOIN t_{name} USING (query_id) LEFT JOIN f_{name} USING (query_id))"""


_OUT = "SELECT query_id, round(top5_relevance_ratio, 6) AS top5_relevance_ratio, round(filtered_irrelevant_ratio, 6) AS filtered_irrelevant_ratio FROM "
_SUMMARY = f"""WITH {_CAND}, {_RANKED}, {_CHOSEN}, {_ratios_sql("e", "e")}, {_ratios_sql("m", "m")}, b AS (SELECT 'overlap_encoder' AS method_name, * FROM r_e UNION ALL SELECT 'language_model', * FROM r_m),
s AS (SELECT method_name, round(avg(top5_relevance_ratio), 6) AS avg_top5_relevance_ratio, round(avg(filtered_irrelevant_ratio), 6) AS avg_filtered_irrelevant_ratio, count(*) AS case_count FROM b GROUP BY 1)"""
_JUDGED = f"""{_SUMMARY}, {_ratios_sql("e", "je", _SAID)}, {_ratios_sql("m", "jm", _SAID)}, j AS (SELECT 'overlap_encoder' AS method_name, * FROM r_je UNION ALL SELECT 'language_model', * FROM r_jm),
js AS (SELECT method_name, round(avg(top5_relevance_ratio), 6) AS t, round(avg(filtered_irrelevant_ratio), 6) AS f, count(*) AS case_count FROM j GROUP BY 1)"""
_AGG = lambda c, by: f"string_agg({c}::VARCHAR, ',' ORDER BY {by})"
_PCT = lambda x: f"printf('%.1f', {x} * 100.0) || '%'"

SQL: dict[str, str] = {
    "rerank_scores": f"WITH {_CAND}, {_RANKED} SELECT query_id, rank, cand_rank, idx, round(score, 6) AS score FROM e",
    "rerank_ratios": f"WITH {_CAND}, {_RANKED}, {_ratios_sql('e', 'e')} {_OUT} r_e",
    "rerank_summary": f"{_SUMMARY} SELECT * FROM s",
    "rerank_report": f"{_JUDGED} SELECT replace(method_name, '_', '-') AS method, {_PCT('avg_top5_relevance_ratio')} AS label_top5, {_PCT('avg_filtered_irrelevant_ratio')} AS label_filtered, {_PCT('t')} AS judge_top5, {_PCT('f')} AS judge_filtered FROM s JOIN js USING (method_name)",
    "judged_rows": f"{_JUDGED} SELECT method_name, query_id AS subcategory, round(top5_relevance_ratio, 6) AS top5_relevant_ratio_gpt, round(filtered_irrelevant_ratio, 6) AS filtered_correct_ratio_gpt, CASE WHEN query_id >= 5 THEN 'label ' || query_id END AS notes FROM j",
    "judged_summary": f"{_JUDGED} SELECT method_name, t AS avg_top5_relevant_ratio_gpt, f AS avg_filtered_correct_ratio_gpt, case_count FROM js",
    "judged_best": f"{_JUDGED} SELECT method_name, avg_top5_relevance_ratio, t AS avg_top5_relevant_ratio_gpt FROM s JOIN js USING (method_name) ORDER BY t DESC, method_name LIMIT 1",
    "restricted_methods": f"{_SUMMARY} SELECT * FROM s WHERE method_name = 'language_model'",
    "filtered_candidates": f"WITH {_CAND}, {_RANKED} SELECT query_id, cand_rank, idx FROM e WHERE rank > 5",
    "rerank_case_rows": f"""WITH {_CAND}, {_RANKED}, t AS (SELECT query_id, {_AGG("id", "rank")} AS top5_product_ids, {_AGG("idx", "rank")} AS top5_indices, {_AGG("image", "rank")} AS top5_image_paths FROM e WHERE rank <= 5 GROUP BY 1),
 f AS (SELECT query_id, {_AGG("id", "cand_rank")} AS filtered_product_ids, {_AGG("idx", "cand_rank")} AS filtered_indices, {_AGG("image", "cand_rank")} AS filtered_image_paths FROM e WHERE rank > 5 GROUP BY 1) SELECT * FROM t LEFT JOIN f USING (query_id)""",
    "model_selection": f"WITH {_CAND}, {_CHOSEN} SELECT query_id, rank, place AS cand_rank, idx, round(score, 6) AS score FROM m",
    "model_ratios": f"WITH {_CAND}, {_CHOSEN}, {_ratios_sql('m', 'm')} {_OUT} r_m",
    "decoded_answers": f"WITH a AS ({_READ}) SELECT key, array_to_string(ids, ',') AS ranked_doc_ids, array_to_string(rest, ',') AS filtered_doc_ids, ids IS NULL AS failed FROM a",
    "judge_prompts": "WITH " + _CAND + ", b AS (SELECT query_id, string_agg('DocID: ' || place || chr(10) || document, chr(10) || chr(10) ORDER BY cand_rank) AS docs, first('我想找一款属于“' || category || '”类目的“' || canonical_subcategory || '”。请优先保留真正属于这个子类别、商品信息匹配、明显不是其他近似子类别的结果。') AS request FROM c GROUP BY 1) SELECT query_id, concat_ws(chr(10) || chr(10), "
    + ", ".join("'" + x.replace("'", "''") + "'" for x in G.JUDGE_LINES) + ", 'User query:' || chr(10) || request, 'Candidate documents:', docs) AS prompt FROM b",
    "candidate_range": "SELECT pos, key FROM (SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key FROM subcategory_queries) WHERE pos >= 5 AND pos < 25",
}
