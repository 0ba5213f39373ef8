"""Named queries of the core and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.nested import flatten_payloads
from shelfmark.plans import catalogue, judging, retrieval, web
from shelfmark.plans.runtime import spread, table

FLAGSHIP = "i2i_eval"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_payloads(spread(table(spark, d, "product_payloads").select("record_id", "payload")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, **retrieval.QUERIES, **catalogue.QUERIES, **judging.QUERIES, **web.QUERIES}
SQL: dict[str, str] = {**retrieval.SQL, **catalogue.SQL, **judging.SQL, **web.SQL}
