"""Arriving packages: a stream of whole files, of which each document's newest version counts.

Versions of a document may arrive late, out of order and more than once. Keyed state remembers, for each document, which
version was told last: when it was modified and the digest of its bytes. Only a newer version is passed on, so a repeated
file costs a digest and nothing else; of versions modified at the same moment the one with the greater digest is newer.
What was passed on is appended; :func:`latest` reads the newest version of each document from it, which is what a batch
over all files gives, whatever the order of arrival and however often the stream was stopped and started again.

State goes when the watermark, ``delay`` behind the newest modification time, has passed a document's version. Files
that are older than the watermark when they arrive are dropped. The bytes themselves are never part of the state.

Documents share the state of their bucket, a list of versions by hash of the name: a batch reads and writes each list once,
where a state for each document would be asked for one by one. The number of buckets belongs to a stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from leafmill.functions.text import file_type
from leafmill.sources import docx

FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: Name and digest of a version; equal bytes of one moment are one version.
VERSION = "modified timestamp, digest string, content binary"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000, max_age: str = "7d") -> DataFrame:
    """doc_id (the file's name), modified, content of package files that appear below ``folder``.

    Spark's file source passes over files modified more than ``max_age`` before the newest one that it has seen."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.[dD][oO][cC][xX]", "maxFilesPerTrigger": str(files_per_batch), "maxFileAge": max_age}
    raw = spark.readStream.format("binaryFile").schema(FILES).options(**options).load(folder)
    good = raw.filter(file_type(F.col("path")) == "docx")
    return good.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.col("modificationTime").alias("modified"), "content")


class Newest(StatefulProcessor):
    """Passes a document's version on if it is newer than all that were passed on before. A key is a bucket of documents."""

    def __init__(self, kind: str, keep_ms: int):
        self.kind, self.keep_ms = kind, keep_ms

    def init(self, handle) -> None:
        self.handle, self.told = handle, handle.getListState("told", f"doc_id {self.kind}, modified bigint, digest string")

    def goes(self, modified: int) -> int:
        return modified // 1000 + self.keep_ms

    def keep(self, told: dict) -> None:
        """Writes the versions, with one timer for the first that goes."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if told:
            self.told.put([(d, *v) for d, v in told.items()])
            self.handle.registerTimer(min(self.goes(v[0]) for v in told.values()))
        else:
            self.told.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = {d: (modified, digest) for d, modified, digest in self.told.get()} if self.told.exists() else {}
        new = {}
        for frame in rows:
            for d, modified, digest, content in zip(frame["doc_id"].tolist(), frame["micros"].tolist(), frame["digest"], frame["content"]):
                if d not in told or (modified, digest) > told[d]:
                    told[d], new[d] = (modified, digest), content
        if new:
            self.keep(told)
            yield pd.DataFrame({"doc_id": list(new), "micros": [told[d][0] for d in new], "digest": [told[d][1] for d in new], "content": list(new.values())})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.keep({d: (modified, digest) for d, modified, digest in self.told.get() if self.goes(modified) > now})
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state with timers needs this store; a query keeps the settings under which it was started."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def newest(packages: DataFrame, delay: str = "1 day", keep_ms: int = 0, buckets: int = 1024) -> DataFrame:
    """The versions of a stream (doc_id, modified, content) that are newer than those before: doc_id, modified, digest,
    content. State stays ``keep_ms`` longer than the watermark asks for and lies in ``buckets`` lists."""
    kind = dict(packages.dtypes)["doc_id"]
    keyed = packages.filter("doc_id is not null and modified is not null and content is not null").withWatermark("modified", delay)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = keyed.select(bucket, "doc_id", "modified", F.unix_micros("modified").alias("micros"), F.sha2("content", 256).alias("digest"), "content")
    out = keyed.groupBy("bucket").transformWithStateInPandas(Newest(kind, keep_ms), f"doc_id {kind}, micros bigint, digest string, content binary", "Append", "EventTime")
    return out.select("doc_id", F.timestamp_micros("micros").alias("modified"), "digest", "content")


def measured(packages: DataFrame) -> DataFrame:
    """doc_id, modified, digest, paragraphs, chars and the texts of a version's paragraphs; batch or stream. A package that
    can't be read has none."""
    read = docx.texts(packages.withColumn("doc_id", F.struct("doc_id", "modified", "digest")).select("doc_id", "content"))
    return read.select("doc_id.*", F.size("texts").alias("paragraphs"), F.aggregate("texts", F.lit(0), lambda a, t: a + F.length(t)).alias("chars"), "texts")


def start(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Handles everything that has arrived, appends to Parquet and stops; state survives in ``checkpoint``."""
    with _state_store(results.sparkSession):
        return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(versions: DataFrame) -> DataFrame:
    """The newest of each document's ``versions`` (doc_id, modified, digest, ...)."""
    rest = [c for c in versions.columns if c != "doc_id"]
    return versions.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("modified", "digest")).alias("v")).select("doc_id", "v.*")
