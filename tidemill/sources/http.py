"""HTTP as a Spark source: ``spark.read.format("tidemill_http")`` after ``register(spark)``.

Options: ``url`` (several, parted by white space, are read in parallel), ``mode`` ``document`` or
``lines``, ``pagination`` ``none`` or ``link`` (follows ``rel="next"``), ``timeout`` seconds. Each row
is (url, value): a whole body, or a line of one. An answer that is no success fails the task, and
Spark tries it again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemill.session import ship

_NEXT = re.compile(r'<([^>]+)>\s*;[^,]*\brel="?next"?')


class Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options["url"].split()
        self.mode, self.pagination = options.get("mode", "document"), options.get("pagination", "none")
        self.timeout = float(options.get("timeout", 30))
        if self.mode not in ("document", "lines") or self.pagination not in ("none", "link"):
            raise ValueError(f"mode {self.mode!r} or pagination {self.pagination!r} is not known")

    def partitions(self) -> list[InputPartition]:
        return [Url(u) for u in self.urls]

    def read(self, partition: Url) -> Iterator[tuple]:
        from urllib.parse import urljoin
        from urllib.request import urlopen

        url, seen = partition.url, set()
        while url and url not in seen:
            seen.add(url)
            with urlopen(url, timeout=self.timeout) as answer:
                if self.mode == "document":
                    yield url, answer.read().decode("utf-8", "replace")
                else:
                    for line in answer:
                        yield url, line.decode("utf-8", "replace").rstrip("\r\n")
                more = _NEXT.search(answer.headers.get("Link") or "") if self.pagination == "link" else None
            url = urljoin(url, more[1]) if more else None


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_http"

    def schema(self) -> str:
        return "url string, value string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(HttpSource)
