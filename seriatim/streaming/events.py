"""Streams: message events to first opens and clicks, running votes, new users, and the periodic delivery.

Each stateful result equals its batch form over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriatim import schemas
from seriatim.operators import delivery, merge


def table_stream(spark: SparkSession, folder: str, table: str, schema: str | None = None) -> DataFrame:
    """A stream over one Parquet table of a folder of tables."""
    kind = spark.read.parquet(f"{folder}/{table}.parquet").schema if schema is None else schema
    return spark.readStream.schema(kind).option("pathGlobFilter", f"{table}.parquet").option("recursiveFileLookup", "false").parquet(folder)


def webhook_events(lines: DataFrame, value: str = "value", received: Column | None = None) -> DataFrame:
    """message_id, event_type, ts from webhook bodies (JSON); ``received`` is the time of arrival."""
    e = F.from_json(value, schemas.WEBHOOK_EVENT)
    at = F.current_timestamp() if received is None else received
    return lines.select(e.alias("e"), at.alias("ts")).select(F.col("e.data.email_id").alias("message_id"), F.col("e.type").alias("event_type"), "ts").filter(F.col("message_id").isNotNull())


def first_events(events: DataFrame, opened: str, clicked: str) -> DataFrame:
    """A running table (update mode) of each message's first event of either kind, by event time."""
    return delivery.first_events(events, opened, clicked)


def first_events_once(events: DataFrame, opened: str, clicked: str, late: str = "7 days") -> DataFrame:
    """Append mode: each message's first-seen event of either kind, once; state older than ``late`` is given up."""
    d = events.filter(F.col("message_id").isNotNull() & F.col("event_type").isin(opened, clicked)).withWatermark("ts", late)
    return d.dropDuplicatesWithinWatermark(["message_id", "event_type"])


def count_changes(changes: DataFrame) -> DataFrame:
    """blog_id, tag, n: by how much changes (sign: 1 or -1; blog_id; tags) move the counts of posts by tag, and of all under an empty tag.

    A post counts once for a tag; one that changes its tags is a row with the old ones and -1, and one with the new.
    """
    every = F.array_union(F.array(F.lit("")), F.coalesce("tags", F.array().cast("array<string>")))
    return changes.select("blog_id", F.explode(every).alias("tag"), "sign").groupBy("blog_id", "tag").agg(F.sum("sign").alias("n")).filter("n <> 0")


def counted_available(changes: DataFrame, folder: str) -> DataFrame:
    """Posts by blog and tag, kept by the stream ``changes`` as far as there is any; a batch reads and writes the buckets of its keys only."""
    table = KeyedTable(changes.sparkSession, f"{folder}/counts", ["blog_id", "tag"])
    run_available(changes, f"{folder}/progress", lambda batch, number: table.count(count_changes(batch), number), "append")
    return table.read("blog_id string, tag string, n long")


def running_votes(events: DataFrame, url: Column) -> DataFrame:
    """Votes by URL in lower case, in update mode."""
    return events.groupBy(F.lower(url).alias("url")).agg(F.count("*").alias("vote_count"))


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Processes what is there, batch by batch, and ends."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q


class KeyedTable:
    """A table in a shared folder that batches are merged into.

    Rows lie in buckets by their keys.  A batch writes new versions of the buckets that it touches, and a small table of
    which bucket has which version, so its cost follows the batch.  A batch that comes again gives the same table; what
    only versions before the last two use is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 32) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.last: int | None = None

    def _versions(self, number: int | None) -> dict[int, int]:
        if number is None or number < 0:
            return {}
        path, system = self._path(f"{self.path}/versions/v{number}")
        data = system.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "ascii")
        data.close()
        return {int(b): int(v) for b, v in (line.split() for line in text.splitlines())}

    def _rows(self, versions: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int, into: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``into(old rows, batch)`` gives the new rows of the touched buckets."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        known = self._versions(number - 1)
        batch = batch.persist()  # which buckets it touches, and the merge, from one run of the batch
        try:
            touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # ``buckets`` numbers at most
            new = into(self._rows({b: v for b, v in known.items() if b in touched}, batch.schema), batch)
            if touched:
                name = merge.unused("bucket", new)
                new = new.withColumn(name, bucket).withColumnRenamed(name, "bucket").repartition(len(touched), "bucket")  # a file a bucket
                new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{number}")
        finally:
            batch.unpersist()
        left = {b for b in touched if self._exists(f"{self.path}/data/v{number}/bucket={b}")}  # a bucket may have lost its last row
        now = {b: v for b, v in known.items() if b not in touched} | dict.fromkeys(left, number)
        self._tell(number, now)
        self._delete(self._versions(number - 2) if number > 1 else {}, known, now)
        self.last = number

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def newest(self) -> int | None:
        """The number of the last batch that the folder has; none of a new table."""
        path, system = self._path(f"{self.path}/versions")
        if not system.exists(path):
            return None
        names = [x.getPath().getName() for x in system.listStatus(path)]
        return max((int(n[1:]) for n in names if n[1:].isdigit()), default=None)

    def _exists(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    def _tell(self, number: int, now: dict[int, int]) -> None:
        """Writes which bucket has which version: a line each, as the driver's own small file, in place at once."""
        path, system = self._path(f"{self.path}/versions/v{number}")
        draft = path.suffix(".draft")
        out = system.create(draft, True)
        out.write(bytearray("".join(f"{b} {v}\n" for b, v in sorted(now.items())), "ascii"))
        out.close()
        system.delete(path, False)
        system.rename(draft, path)

    def _delete(self, older: dict[int, int], known: dict[int, int], now: dict[int, int]) -> None:
        """What neither this version nor the one before uses."""
        for b, v in older.items():
            if v not in (known.get(b), now.get(b)):
                folder, system = self._path(f"{self.path}/data/v{v}/bucket={b}")
                system.delete(folder, True)

    def upsert(self, batch: DataFrame, number: int) -> None:
        self.merge(batch, number, lambda old, rows: merge.upsert(old, rows, self.keys))

    def insert(self, batch: DataFrame, number: int) -> None:
        self.merge(batch, number, lambda old, rows: merge.insert_absent(old, rows, self.keys))

    def count(self, batch: DataFrame, number: int) -> None:
        """Adds the batch's ``n`` to those of the keys; keys that come to 0 go."""
        self.merge(batch, number, lambda old, rows: old.unionByName(rows).groupBy(*self.keys).agg(F.sum("n").alias("n")).filter("n <> 0"))

    def read(self, schema) -> DataFrame:
        """The table after the last batch; without any, an empty one."""
        return self._rows(self._versions(self.last), schema)


def deliver(items: DataFrame, sent_log: DataFrame) -> DataFrame:
    """Due items that haven't been sent, by subscription and post: a batch that comes again sends nothing twice."""
    return items.join(sent_log.select("subscription_id", "post_id"), ["subscription_id", "post_id"], "left_anti")
