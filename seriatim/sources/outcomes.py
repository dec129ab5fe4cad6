"""Records that can't be read are rows too: each reader gives what it could read and, for the rest, ``failed`` (part, reason).

A broken book, member, sitemap, answer or page costs itself and nothing else; no reader raises for what a record holds.
``good`` and ``failures`` divide the rows; write them first where both are wanted, since each reads all records again.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = "struct<part:string,reason:string>"
FAILURES = "source string, path string, part string, reason string"
#: Fixed value: chapters' names in a zipped book.
CHAPTER = r"OEBPS/chapter-\d+-.+\.html"
ITEMS = "array<struct<title:struct<rendered:string>,content:struct<rendered:string>,link:string,slug:string,date:string>>"
_SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _bad string"


def good(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("failed is null").drop("failed")


def failures(outcomes: DataFrame, source: str, path: str) -> DataFrame:
    """source, path, part, reason of what failed."""
    return outcomes.filter("failed is not null").select(F.lit(source).alias("source"), F.col(path).cast("string").alias("path"), "failed.part", "failed.reason")


def _failed(reason: Column, part: Column | None = None) -> Column:
    """``reason`` as a failure; null where that is null."""
    return F.when(reason.isNotNull(), F.struct((F.lit(None).cast("string") if part is None else part).alias("part"), reason.alias("reason"))).alias("failed")


def _members(data: bytes | None, member: re.Pattern) -> Iterator[tuple[int | None, str | None, str | None, str | None]]:
    """number, name, text and what is wrong of a book's members, by name."""
    if data is None:
        yield None, None, None, "no content"
        return
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OverflowError, NotImplementedError):
        yield None, None, None, "not a zip"
        return
    with book:
        for i, name in enumerate(sorted(n for n in book.namelist() if member.fullmatch(n)), 1):
            try:
                yield i, name, book.read(name).decode("utf-8"), None
            except UnicodeDecodeError:
                yield i, name, None, "not UTF-8"
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError, OSError):
                yield i, name, None, "broken member"


def chapters(zipped: DataFrame, member: str = CHAPTER) -> DataFrame:
    """book, number, name, html of the chapters of zipped books (path, content), by name, and failed; numbers keep their place whatever a chapter holds."""
    pattern = re.compile(member)
    fields = {"book": pa.string(), "number": pa.int32(), "name": pa.string(), "html": pa.string(), "failed": pa.struct([("part", pa.string()), ("reason", pa.string())])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(path, number, name, text, reason and {"part": name, "reason": reason}) for number, name, text, reason in _members(data.as_py(), pattern)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(fields.values())], names=list(fields))

    return zipped.select("path", "content").mapInArrow(run, f"book string, number int, name string, html string, failed {FAILED}")


def sitemaps(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """The other columns of ``maps`` with pages and maps (the URLs that each lists) and failed."""
    d = maps.withColumn("_read", F.from_xml(xml, _SITEMAP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    listed = lambda c: F.filter(F.transform(F.coalesce(F.col(f"_read.{c}.loc"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    reason = F.when(F.col(xml).isNull(), "no content").when(F.col("_read._bad").isNotNull(), "not XML")
    return d.select(*(c for c in maps.columns if c != xml), listed("url").alias("pages"), listed("sitemap").alias("maps"), _failed(reason))


def answers(found: DataFrame, body: str = "body") -> DataFrame:
    """The other columns of ``found`` with items (those of a REST answer, a JSON array) and failed."""
    items = F.from_json(body, ITEMS)
    reason = F.when(F.col(body).isNull(), "no content").when(~F.startswith(F.ltrim(body), F.lit("[")) & F.startswith(F.ltrim(body), F.lit("{")), "not an array").when(items.isNull(), "not JSON")
    return found.select(*(c for c in found.columns if c != body), F.when(reason.isNull(), items).alias("items"), _failed(reason))


def fetched(listed: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """``listed`` with the html of its pages (``key``, html and maybe status; one row a key) and failed."""
    p = pages.select(F.col(key), F.col("html"), (F.col("status") if "status" in pages.columns else F.lit(200)).alias("_status"), F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "not fetched").when((F.col("_status") < 200) | (F.col("_status") > 299), F.concat(F.lit("status "), F.col("_status").cast("string"))).when(F.col("html").isNull(), "no content")
    return listed.join(p, key, "left").select(*listed.columns, F.when(reason.isNull(), F.col("html")).alias("html"), _failed(reason))
