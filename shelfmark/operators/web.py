"""Results of a web search: which pages are read, and the rows that come of reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import preview

PREVIEW = 500


def results_to_read(results: DataFrame, by: list[str], position: str, link: str, first: int = 3) -> DataFrame:
    """The first results of each search, less those without a link: cut first, then skipped."""
    at = Window.partitionBy(*by).orderBy(position)
    return results.withColumn("result_rank", F.row_number().over(at)).where((F.col("result_rank") <= first) & F.col(link).isNotNull() & (F.col(link) != ""))


def organic_links(payload: Column, first: int = 3) -> Column:
    """``title, link`` of the first organic results in a search's raw JSON."""
    found = F.from_json(payload, "struct<organic_results:array<struct<title:string,link:string>>>")["organic_results"]
    return F.filter(F.slice(F.coalesce(found, F.array().cast("array<struct<title:string,link:string>>")), 1, first), lambda x: x["link"].isNotNull() & (x["link"] != ""))


def links_or_urls(searched: Column, payload: Column, urls: Column, first: int = 3) -> Column:
    """The links of a search that ran; where it didn't, the given addresses, all of them, as their own titles."""
    given = F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.struct(u.alias("title"), u.alias("link")))
    return F.when(searched, organic_links(payload, first)).otherwise(given)


def reader_rows(pages: DataFrame, content: str = "content", error: str = "error", length: int = PREVIEW) -> DataFrame:
    """``reader_content_length`` in code points and ``reader_content_preview`` of pages that were read; both null beside an error."""
    ok = F.col(error).isNull()
    return pages.withColumns({"reader_content_length": F.when(ok, F.length(content).cast("bigint")), "reader_content_preview": F.when(ok, preview(F.col(content), length))})
