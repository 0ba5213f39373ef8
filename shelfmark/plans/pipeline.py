"""The stages put together: a benchmark of encoders, retrieval within a catalogue, reranking of what it finds, and pages from the web.

Each run is a dictionary of lazy tables by name; ``write_run`` computes them into a folder of their own with a manifest. A stage
reads the tables of the one before, so a list that is reranked is the one that was retrieved.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.generation import judge_prompt, summary_messages
from shelfmark.functions.text import request_text
from shelfmark.models import PRESETS, ModelConfig, encode, generated, pair_score
from shelfmark.operators import cases as C
from shelfmark.operators import metrics as M
from shelfmark.operators import rerank as K
from shelfmark.operators.catalogue import prompted
from shelfmark.operators.ranking import nearest
from shelfmark.operators.report import combined_rows, multi_route_table, retrieval_table
from shelfmark.operators.web import links_or_urls, reader_rows
from shelfmark.sources.files import predictions, write_manifest
from shelfmark.sources.search import Transport, read_pages

Run = dict[str, DataFrame]


def benchmark(queries: DataFrame, variants: DataFrame, images: dict[str, DataFrame], qrels: DataFrame, products: DataFrame, k: int = 50) -> Run:
    """Every variant's prompts against the vectors (``idx, vector``) that its model made of the images.

    ``queries`` has ``key, slug_text, canonical_subcategory``, ``qrels`` has ``key, idx``. Tables: ``summary``, ``report``, ``predictions``.
    """
    prompts = prompted(queries, variants).withColumn("query_id", F.xxhash64("key"))
    relevance = qrels.select(F.xxhash64("key").alias("query_id"), "idx")
    summaries, lists = [], []
    for v in variants.collect():  # a fixed list, a row for each model and language
        own = prompts.where((F.col("model_name") == v.model_name) & (F.col("input_language") == v.input_language))
        found = nearest(encode(own, "query_id", "prompt", PRESETS[v.model_name]), images[v.model_name], k)
        named = [F.lit(v[c]).alias(c) for c in ("model_name", "input_language", "query_mode", "prompt_template", "prompt_label")]
        summaries.append(M.macro(M.per_query(found, relevance, own)).select(*named, "*"))
        lists.append(predictions(found, relevance, products).select(*named[:2], "*"))
    summary = combined_rows(reduce(DataFrame.unionByName, summaries))
    return {"summary": summary, "report": retrieval_table(summary), "predictions": reduce(DataFrame.unionByName, lists)}


def in_domain(members: DataFrame, texts: DataFrame, corpus: DataFrame, products: DataFrame, attributes: DataFrame, *, repeats: int = 5, seed: int = 20260403) -> Run:
    """Cases of each subcategory (``members``: ``key, idx``), their four routes, and what the cases of a subcategory agree on.

    ``attributes`` has a row per ``key``. Tables: ``cases``, ``routes``, ``metrics``, ``summary``, ``multi_route``, ``agreed``, ``candidates``.
    """
    cases = C.repeat_cases(members, repeats, seed, strict=True)
    routes = C.rank_routes(cases, texts, corpus)
    metrics = C.case_metrics(cases, routes, members)
    summary = C.case_summary(metrics)
    return {
        "cases": cases, "routes": routes, "metrics": metrics, "summary": summary, "multi_route": multi_route_table(summary.where("route in ('multi_route', 'image_text_to_image')")),
        "agreed": C.aggregated_candidates(cases, routes), "candidates": C.candidate_rows(cases, routes, products, attributes),
    }


def rerank(agreed: DataFrame, products: DataFrame, attributes: DataFrame, reranker: ModelConfig, generator: ModelConfig, match=None) -> Run:
    """What retrieval agreed on (``key, rank, idx``), in the order of a cross-encoder and in that of a generator, five of ten kept.

    ``attributes`` has ``key, category, canonical_subcategory``. Tables: ``cross_encoder``, ``generator`` (case rows) and ``summary``.
    """
    lists = agreed.select(F.col("key").alias("query_id"), F.col("rank").alias("cand_rank"), "idx")
    known = attributes.select(F.col("key").alias("query_id"), "category", "canonical_subcategory")
    c = K.matched(K.candidate_documents(lists, products), known, "query_id", "canonical_subcategory")
    match = F.col("subcategory") == F.col("canonical_subcategory") if match is None else match
    request = request_text(F.col("category"), F.col("canonical_subcategory"))
    scored = K.rank_by_score(c.withColumn("score", pair_score(request, F.col("document"), reranker)))
    docs = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cand_rank", "document"))).alias("x"), F.first(request).alias("request"))
    answers = docs.select("query_id", generated(judge_prompt(F.col("request"), F.transform("x", lambda x: x["document"])), generator)["value"].alias("answer"))
    chosen = K.select_by_model(answers, c)
    ratios = [K.selection_ratios(r, c, match).withColumn("method_name", F.lit(n)) for n, r in ((reranker.name, scored), (generator.name, chosen))]
    return {"cross_encoder": K.case_rows(scored, c), "generator": K.case_rows(chosen, c), "summary": K.rerank_summary(ratios[0].unionByName(ratios[1]))}


def web(spark: SparkSession, searches: DataFrame, transport: Transport, generator: ModelConfig, question: str) -> Run:
    """The first pages of each search read and summed up.

    ``searches`` has ``searched`` (whether it ran), ``payload`` (its raw JSON) and ``urls`` (what is read where it didn't run). The
    addresses are a few per search and become the requests of the reader. Tables: ``pages`` with text, length, summary and errors.
    """
    links = searches.select(F.explode(links_or_urls(F.col("searched"), F.col("payload"), F.col("urls"))).alias("x")).select("x.*").distinct()
    asked = [r.link for r in links.select("link").distinct().collect()]
    read = read_pages(spark, asked, transport).select(F.col("key").alias("link"), "content", "error")
    said = generated(F.element_at(summary_messages(F.col("content"), F.lit(question)), 2)["content"], generator)
    pages = reader_rows(read).withColumn("said", F.when(F.col("error").isNull(), said))
    return {"pages": links.join(pages, "link").select("link", "title", "reader_content_length", "reader_content_preview", F.col("said.value").alias("summary"), F.coalesce("error", "said.error").alias("error"))}


def write_run(run: Run, folder: str, name: str, **fields) -> str:
    """Every table of a run as parquet in the run's own folder, which is returned, and what it was made with."""
    own = write_manifest(folder, name, tables=sorted(run), **fields)
    for table, df in run.items():
        df.write.mode("overwrite").parquet(os.path.join(own, table))
    return own
