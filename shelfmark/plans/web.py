"""Registered queries of the web results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import generation as G
from shelfmark.operators import web as V
from shelfmark.plans.retrieval import rounded
from shelfmark.plans.runtime import table

QUESTION = "Which one should I buy?"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_retrieval_results")


def web_results_to_read(spark: SparkSession, d: str) -> DataFrame:
    """The first three results of each search of a run, less those without a link."""
    results = _pages(spark, d).withColumn("link", F.col("url"))
    return rounded(V.results_to_read(results, ["run_name", "text_query"], "result_id", "link").select("run_name", "text_query", "result_rank", "result_id", "link"))


def web_reader_rows(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("result_id", F.col("reader_content_preview").alias("content"), "error")
    return rounded(V.reader_rows(pages).select("result_id", "reader_content_length", "reader_content_preview", "error"))


def web_organic_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each search's raw JSON, put together from its results; a search without JSON takes its query as an address."""
    item = F.struct("title", F.col("url").alias("link"))
    raw = _pages(spark, d).groupBy("run_name", "text_query").agg(F.array_sort(F.collect_list(F.struct("result_id", item.alias("x")))).alias("a"))
    raw = raw.withColumn("payload", F.to_json(F.struct(F.transform("a", lambda a: a["x"]).alias("organic_results"))))
    ran = F.size("a") > 1
    links = raw.select("run_name", "text_query", F.posexplode(V.links_or_urls(ran, F.col("payload"), F.array("text_query"))).alias("pos", "x"))
    return rounded(links.select("run_name", "text_query", "pos", "x.title", "x.link"))


def web_summary_prompts(spark: SparkSession, d: str) -> DataFrame:
    m = G.summary_messages(F.col("reader_content_preview"), F.lit(QUESTION))
    rows = _pages(spark, d).where("reader_content_preview is not null").select("result_id", F.inline(m))
    return rows.select("result_id", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def web_run_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages, failures and mean length of each run."""
    return rounded(_pages(spark, d).groupBy("run_name").agg(F.count("*").alias("pages"), F.count("error").alias("failed"), F.avg("reader_content_length").alias("mean_length")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (web_results_to_read, web_reader_rows, web_organic_links, web_summary_prompts, web_run_counts)}

_T = lambda s: "'" + s.replace("'", "''") + "'"
_HEAD, _REST = G.SUMMARY_PROMPT.split("{webpage_content}")
_MIDDLE, _TAIL = _REST.split("{question}")

SQL: dict[str, str] = {
    "web_results_to_read": "SELECT run_name, text_query, result_rank, result_id, link FROM (SELECT *, url AS link, row_number() OVER (PARTITION BY run_name, text_query ORDER BY result_id) AS result_rank FROM web_retrieval_results) WHERE result_rank <= 3 AND link <> ''",
    "web_reader_rows": "SELECT result_id, CASE WHEN error IS NULL THEN length(reader_content_preview) END AS reader_content_length, CASE WHEN error IS NULL THEN left(reader_content_preview, 500) END AS reader_content_preview, error FROM (SELECT result_id, reader_content_preview, error FROM web_retrieval_results)",
    "web_organic_links": """WITH r AS (SELECT *, url AS link, row_number() OVER w AS n, count(*) OVER (PARTITION BY run_name, text_query) AS size FROM web_retrieval_results WINDOW w AS (PARTITION BY run_name, text_query ORDER BY result_id))
 SELECT run_name, text_query, row_number() OVER (PARTITION BY run_name, text_query ORDER BY n) - 1 AS pos, title, link FROM r WHERE size > 1 AND n <= 3 AND link <> '' UNION ALL SELECT run_name, text_query, 0, text_query, text_query FROM r WHERE size = 1""",
    "web_summary_prompts": f"SELECT result_id, 'system' AS role, md5({_T(G.SUMMARY_SYSTEM)}) AS content_md5 FROM web_retrieval_results WHERE reader_content_preview IS NOT NULL UNION ALL SELECT result_id, 'user', md5({_T(_HEAD)} || left(reader_content_preview, 30000) || {_T(_MIDDLE)} || {_T(QUESTION)} || {_T(_TAIL)}) FROM web_retrieval_results WHERE reader_content_preview IS NOT NULL",
    "web_run_counts": "SELECT run_name, count(*) AS pages, count(error) AS failed, round(avg(reader_content_length), 6) AS mean_length FROM web_retrieval_results GROUP BY run_name",
}
