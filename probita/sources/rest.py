"""A paged REST collection of declarations as a batch data source.

Pages are read until one is empty or has fewer than a full page of items, at most ``max_pages``; a failed request is
tried three times with growing pauses; only failures of the network or the server are, not the client's own (4xx but 429). ``fetcher`` names a function ``module:function(url, params) -> dict``; without it
urllib is used. Each year is one partition.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, MAX_PAGES, TRIES, FIRST_PAUSE = 100, 100, 3, 1.5


def http(url: str, params: dict) -> dict:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=30) as r:
        return json.load(r)


def fetcher(name: str | None) -> Callable[[str, dict], dict]:
    if not name:
        return http
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def tried(fetch: Callable[[str, dict], dict], url: str, params: dict, pause: float = FIRST_PAUSE) -> dict:
    for n in range(TRIES):
        try:
            return fetch(url, params)
        except (OSError, json.JSONDecodeError) as e:
            code = getattr(e, "code", 0)
            if n == TRIES - 1 or (400 <= code < 500 and code != 429):
                raise
            time.sleep(pause * 2**n)
    raise AssertionError


def pages(fetch: Callable[[str, dict], dict], url: str, params: dict, max_pages: int = MAX_PAGES, first: int = 1, pause: float = FIRST_PAUSE) -> Iterator[tuple[int, list[dict]]]:
    for page in range(first, first + max_pages):
        items = tried(fetch, f"{url}/documents/list", params | {"page": page}, pause).get("data") or []
        if items:
            yield page, items
        if len(items) < PAGE:
            return


class Year(InputPartition):
    def __init__(self, year: str | None):
        super().__init__(year)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [Year(y.strip() or None) for y in self.o.get("years", "").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, url = fetcher(self.o.get("fetcher")), self.o["url"]
        params = {k: v for k, v in (("query", self.o.get("query")), ("declaration_type", self.o.get("type")), ("declaration_year", partition.value)) if v}
        pause = float(self.o.get("pause", FIRST_PAUSE))
        for page, items in pages(fetch, url, params, int(self.o.get("maxpages", MAX_PAGES)), pause=pause):
            for x in items:
                body = tried(fetch, f"{url}/documents/{x['id']}", {}, pause) if self.o.get("full", "true") == "true" else x
                yield page, str(x["id"]), json.dumps(body, ensure_ascii=False)


class Declarations(DataSource):
    """``spark.read.format("declarations_rest").option("url", ...).option("years", "2023,2024").load()``"""

    @classmethod
    def name(cls) -> str:
        return "declarations_rest"

    def schema(self) -> str:
        return "page int, id string, value string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
