"""A data source over an interface that answers in numbered pages of JSON rows.

``spark.dataSource.register(Pages)``, then
``spark.read.format("pages").schema(...).option("url", "https://host/list?page={page}").option("pages", 40).load()``.
Each page is a partition; a page that is not there is empty, and one that
cannot be read fails its task, which Spark tries again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PageReader(DataSourceReader):
    def __init__(self, names: list[str], options: dict):
        self.names, self.url, self.pages = names, options["url"], int(options.get("pages", 1))
        self.token = options.get("token")

    def partitions(self) -> list[Page]:
        return [Page(self.url.format(page=n + 1)) for n in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        request = Request(partition.url, headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urlopen(request, timeout=60) as answer:
                rows = json.load(answer)
        except HTTPError as failure:
            if failure.code == 404:
                return
            raise
        for row in rows:
            yield tuple(row.get(name) for name in self.names)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "number INT, title STRING, body STRING, head_sha STRING"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema.fieldNames(), dict(self.options))
