"""Interleaved documents: ordered text and media references, with payloads resolved by digest.

``sequences`` parses HTML into one ordered array of items, each a text or a reference to media by digest with its
caption and its position.  ``store`` keeps payloads as PGM pictures of 8-bit samples, 64 to a row, which is lossless.
``measure`` reads stored bytes back and computes their features.  ``resolve`` joins references to what the store has
by digest and puts the items back in order; a digest that many documents share is dealt over several parts.

Defined cases: null HTML has no items; a null text is an empty payload, a long one a picture of as many rows as it
takes; a reference whose digest the store lacks keeps its place with null media columns; a caption is null where there
is none; several stored copies of one digest count as one; repeated rows stay; other columns, whatever their names, are
left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.llm.common import join_shared, staged

ROW = 64
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
MEASURED = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: A comment, script or tag that the page's end cuts off takes the rest, so no part of a page is read twice; quotes open a
#: value after = only.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_MEDIA = {"img", "video", "audio"}


def parse(page: str | None) -> list[dict]:
    """Items of one page in order; texts between media are joined, white space collapses."""
    items: list[dict] = []
    words: list[str] = []
    caption: list[str] | None = None
    figure: int | None = None
    at = 0

    def take(raw: str) -> None:
        (words if caption is None else caption).append(entities.unescape(raw))

    def flush() -> None:
        text = " ".join(" ".join(words).split())
        words.clear()
        if text:
            items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    for m in _MARKUP.finditer(page or ""):
        take(page[at : m.start()])
        at = m.end()
        close, tag = m[2] == "/", (m[3] or "").lower()
        if tag in _MEDIA and not close:
            found = {k.lower(): next((x for x in (a, b, c) if x), "") for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            digest = found.get("data-digest") or found.get("src", "").removeprefix("digest:")
            flush()
            items.append({"kind": "media", "text": None, "digest": digest or None, "caption": entities.unescape(found["alt"]) if found.get("alt") else None})
        elif tag == "figure":
            flush()
            figure = None if close else len(items)
        elif tag == "figcaption" and not close:
            caption = []
        elif tag == "figcaption" and caption is not None:
            text = " ".join(" ".join(caption).split())
            caption = None
            for item in items[figure if figure is not None else len(items) :]:
                if item["kind"] == "media":
                    item["caption"] = text or item["caption"]
    take((page or "")[at:])
    flush()
    return [{"position": i, **x} for i, x in enumerate(items)]


def sequences(pages: DataFrame, key: str, page: str) -> DataFrame:
    """``key`` and ``items`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(parse, batch.column(1).to_pylist()), pa.list_(ITEM))], names=["key", "items"])

    out = pages.select(F.col(key).alias("key"), F.col(page).cast("string").alias("page"))
    return out.mapInArrow(run, f"key {dict(pages.dtypes)[key]}, items {ITEMS}").withColumnRenamed("key", key)


def payload(text: Column) -> Column:
    """UTF-8 bytes, with bytes 0 up to a positive multiple of ROW."""
    raw = F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / ROW))
    return F.rpad(raw, (rows * ROW).cast("int"), F.lit(b"\0"))


def stored(data: Column) -> Column:
    """A binary PGM picture with the payload's bytes as its samples."""
    header = F.concat(F.lit(f"P5\n{ROW} "), (F.octet_length(data) / ROW).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(header, "UTF-8"), data)


def store(rows: DataFrame, name: str = "media") -> DataFrame:
    """Writes ``rows`` (digest, n_bytes, payload) to the shared folder as media and returns what was written."""
    return staged(rows.select("digest", "n_bytes", stored(F.col("payload")).alias("media")), name)


def samples(media: bytes) -> np.ndarray:
    """The picture's samples, rows x ROW."""
    kind, size, depth, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width * height != len(data):
        raise ValueError("not an 8-bit PGM picture of this module")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def feature(picture: np.ndarray) -> str:
    """Mean and deviation of the samples in hundredths, the share of blank samples in thousandths, and the columns' means as hex."""
    height = picture.shape[0]
    columns = picture.sum(axis=0, dtype=np.int64) // height
    total, squares = int(picture.sum(dtype=np.int64)), int((picture.astype(np.int64) ** 2).sum()) if height < 1 << 16 else sum(int((part.astype(np.int64) ** 2).sum()) for part in np.array_split(picture, height >> 15))
    n = picture.size
    spread = max(0, n * squares - total * total)
    return f"m{100 * total // n}.d{int(100 * (spread**0.5) / n)}.b{1000 * int((picture == 0).sum()) // n}.{columns.astype(np.uint8).tobytes().hex()}"


def measure(media: DataFrame) -> DataFrame:
    """A row for each stored medium, from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEASURED.split(", ")]
        for batch in batches:
            rows = []
            for digest, n_bytes, medium in zip(*(batch.column(c) for c in ("digest", "n_bytes", "media")), strict=True):
                data = medium.as_py()
                picture = samples(data)
                own = picture.tobytes()
                rows.append((digest.as_py(), n_bytes.as_py(), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(picture)))
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)}, schema=pa.schema([(n, pa.string() if kind == "string" else pa.int64()) for n, kind in (x.split() for x in MEASURED.split(", "))]))

    return media.select("digest", "n_bytes", "media").mapInArrow(run, MEASURED)


def resolve(items: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """A row for each media reference of ``items`` (``key``, items): key, position, caption and what the store has of its digest."""
    refs = items.select(key, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("i")).select(key, F.col("i.position").alias("position"), F.col("i.digest").alias("digest"), F.col("i.caption").alias("caption"))
    values = [c for c in measured.columns if c != "digest"]
    known = measured.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct(*values)).alias("m"))
    known = staged(known, "measured")
    return join_shared(refs, known, "digest", "copies", "left").select(key, "position", "caption", "digest", *(F.col(f"m.{c}").alias(c) for c in values))


def interleave(items: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """``key`` and ``items`` with a ``media`` struct in each reference (null in texts); ``key`` must be unique."""
    values = [c for c in measured.columns if c != "digest"]
    found = resolve(items, measured, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*values)))).alias("m"))
    d = items.join(found, key, "left")
    return d.select(key, F.transform("items", lambda x: x.withField("media", F.try_element_at("m", x["position"]))).alias("items"))


def digest_report(documents: DataFrame) -> DataFrame:
    """Every document as a page that shows its own text as a picture: stored, read back, measured and resolved by digest."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("payload", payload(F.col("text"))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    d = d.withColumn("digest", F.sha2(F.concat(F.encode(F.concat(F.col("n_bytes").cast("string"), F.lit(":")), "UTF-8"), F.col("payload")), 256))
    pages = d.select("doc_id", F.format_string('<article><p>Document %s</p><figure><img src="digest:%s"><figcaption>%s bytes</figcaption></figure></article>', F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "digest", F.col("n_bytes").cast("string")).alias("page"))
    measured = measure(store(d.select("digest", "n_bytes", "payload")))
    found = resolve(sequences(pages, "doc_id", "page"), measured, "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
