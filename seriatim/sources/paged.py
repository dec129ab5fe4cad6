"""A paged service as a data source: tasks read ranges of its pages, up to the total that the first page states.

    spark.dataSource.register(PagedAnswers)
    spark.read.format("paged_answers").option("folder", folder).load()

A page's answer is a JSON object with ``total_pages`` and ``items``, as a service gives them in headers and body.  Answers
come from a transport: here ``Recorded``, a folder that all tasks see with a part ``page=<n>`` for each page; another one
needs a ``get`` alone.  Filters on ``page`` leave out pages before any is read.  An answer that isn't there ends a range,
as a service's error ends the reading; one that is no such object is a row without items' fields and with its failure.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "page int, pos int, title string, link string, slug string, date string, content string, failed string"


@dataclass(frozen=True)
class Recorded:
    """Answers in a shared folder; each reading leaves a mark in ``log``, if that is given."""

    folder: str
    log: str | None = None

    def get(self, page: int) -> str | None:
        parts = sorted(glob.glob(f"{local(self.folder)}/page={page}/part-*"))
        if self.log:
            os.makedirs(local(self.log), exist_ok=True)
            with open(f"{local(self.log)}/{page}-{uuid.uuid4().hex}", "w"):
                pass
        if not parts:
            return None
        text = []
        for p in parts:
            with open(p, encoding="utf-8") as f:
                text.append(f.read())
        return "".join(text)


def local(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"recorded answers lie in a folder that tasks can open, not in {url.scheme}://")
    return unquote(url.path) if url.scheme else path


class Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


def ranges(pages: Iterable[int], most: int) -> list[tuple[int, int]]:
    """Runs of page numbers without gaps, of up to ``most`` pages."""
    out: list[tuple[int, int]] = []
    for p in sorted(set(pages)):
        if out and out[-1][1] == p - 1 and p - out[-1][0] < most:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


class PagedReader(DataSourceReader):
    def __init__(self, transport, most: int) -> None:
        self.transport, self.most = transport, most
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and f.attribute == ("page",):
                self.kept.append(f)
            else:
                yield f

    def _wanted(self, page: int) -> bool:
        holds = {EqualTo: lambda v: page == v, GreaterThan: lambda v: page > v, GreaterThanOrEqual: lambda v: page >= v, In: lambda v: page in v, LessThan: lambda v: page < v, LessThanOrEqual: lambda v: page <= v}
        return all(holds[type(f)](f.value) for f in self.kept)

    def partitions(self) -> list[InputPartition]:
        """The first page tells how many there are; without a number it is the only one."""
        body = self.transport.get(1)
        try:
            total = int(json.loads(body)["total_pages"]) if body else 0
        except (ValueError, KeyError, TypeError):
            total = 1
        found = [Pages(*r) for r in ranges((p for p in range(1, total + 1) if self._wanted(p)), self.most)]
        return found or [Pages(1, 0)]  # no pages: without a partition Spark would ask for all at once

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            body = self.transport.get(page)
            if body is None:
                return
            yield from rows_of(page, body)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _rendered(value) -> str | None:
    return _text(value.get("rendered")) if isinstance(value, dict) else _text(value)


def rows_of(page: int, body: str) -> Iterator[tuple]:
    try:
        items = json.loads(body)["items"]
    except (ValueError, KeyError, TypeError):
        yield (page, None, None, None, None, None, None, "not an answer")
        return
    for pos, i in enumerate(items if isinstance(items, list) else []):
        if isinstance(i, dict):
            yield (page, pos, _rendered(i.get("title")), _text(i.get("link")), _text(i.get("slug")), _text(i.get("date")), _rendered(i.get("content")), None)
        else:
            yield (page, pos, None, None, None, None, None, "not an item")


class PagedAnswers(DataSource):
    """Options: folder, pages_per_task (8), and log for ``Recorded``."""

    @classmethod
    def name(cls) -> str:
        return "paged_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(Recorded(self.options["folder"], self.options.get("log")), int(self.options.get("pages_per_task", "8")))


def paged_answers(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Items of all pages, with their page and place in it; filters on ``page`` reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedAnswers)
    return spark.read.format("paged_answers").options(folder=folder, **options).load()
