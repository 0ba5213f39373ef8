"""Web search and page reading as Spark data sources. The transport, a function from address and options to text, is
injected, so a run needs no network and a test no server."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Addresses, time limits and the names and values of parameters of the two services.
SEARCH_URL, READER_PREFIX = "https://serpapi.com/search", "https://r.jina.ai/"
SEARCH_TIMEOUT, READER_TIMEOUT = 60, 120

Transport = Callable[[str, dict, dict, int], str]


@dataclass(frozen=True)
class SearchConfig:
    api_key: str | None = None
    hl: str = "zh-cn"
    gl: str = "cn"
    location: str = "Beijing, China"
    safe: str = "active"
    output: str = "json"


def search_params(config: SearchConfig, **own) -> dict:
    """The request's parameters; its own win over the configured ones. Without a key there is no search."""
    if not config.api_key:
        raise RuntimeError("a search needs an API key")
    return {"api_key": config.api_key, "hl": config.hl, "gl": config.gl, "location": config.location, "output": config.output, **own}


def text_search(config: SearchConfig, query: str, start: int = 0, num: int = 10) -> dict:
    return search_params(config, engine="google", q=query, start=start, num=num)


def image_search(config: SearchConfig, query: str, ijn: int = 0) -> dict:
    return search_params(config, engine="google_images", q=query, ijn=ijn, safe=config.safe)


def reader_headers(api_key: str | None = None, instruction: str | None = None, respond_with: str | None = None, json_schema: dict | None = None) -> dict:
    given = {"Authorization": api_key and f"Bearer {api_key}", "x-instruction": instruction, "x-respond-with": respond_with, "x-json-schema": json_schema and json.dumps(json_schema, ensure_ascii=False)}
    return {k: v for k, v in given.items() if v}


class _Request(InputPartition):
    def __init__(self, key: str, url: str, params: dict, headers: dict, timeout: int):
        self.key, self.url, self.params, self.headers, self.timeout = key, url, params, headers, timeout


class _Reader(DataSourceReader):
    def __init__(self, requests: list[_Request], transport: Transport):
        self.requests, self.transport = requests, transport

    def partitions(self) -> list[_Request]:
        return self.requests

    def read(self, partition: _Request) -> Iterator[tuple]:
        """A request that fails is a row with its error; the others are not touched by it."""
        try:
            text = self.transport(partition.url, partition.params, partition.headers, partition.timeout)
            yield partition.key, partition.url, text, len(text), None
        except Exception as e:  # noqa: BLE001
            yield partition.key, partition.url, None, None, str(e)


def _source(name: str, requests: list[_Request], transport: Transport) -> type[DataSource]:
    class Requests(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "key string, url string, content string, content_length bigint, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(requests, transport)

    return Requests


def search(spark: SparkSession, queries: dict[str, dict], transport: Transport) -> DataFrame:
    """``key, url, content, content_length, error``: the raw JSON of each search; ``queries`` are parameters by key."""
    name = "shelfmark_search"
    spark.dataSource.register(_source(name, [_Request(k, SEARCH_URL, p, {}, SEARCH_TIMEOUT) for k, p in queries.items()], transport))
    return spark.read.format(name).load()


def read_pages(spark: SparkSession, urls: list[str], transport: Transport, **options) -> DataFrame:
    """The same columns for pages read through the reader; ``key`` is the page's own address."""
    name = "shelfmark_reader"
    spark.dataSource.register(_source(name, [_Request(u, READER_PREFIX + u, {}, reader_headers(**options), READER_TIMEOUT) for u in urls], transport))
    return spark.read.format(name).load()
