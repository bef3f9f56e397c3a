"""A snippet library on shared storage that several writers keep at once.

The store is a folder of change sets, each written once and never changed: rows of name, body, updated_at and whether the
name was deleted then. Writers only ever add sets of their own, so they need no lock; a set counts once Spark has marked
it as whole. Reading takes the newest row of each name over all sets: the later ``updated_at`` (a missing one is the
oldest), at one moment a deletion before a body, then the first body. Since this choice doesn't depend on how rows are
grouped into sets, :func:`compact` may write the newest rows as one more set and only then remove the sets it read: a
reader sees the same library before, between and after, also if the compaction dies half-way or two of them meet. A
reader that planned before a removal and reads after it fails and is to be started again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import tokens
from leafmill.operators.templates import valid_library

VERSION = "name string, body string, updated_at bigint, deleted boolean"


def _files(spark: SparkSession, place: str):
    """The folder as the session's file system knows it: works wherever Spark can read and write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def change_sets(spark: SparkSession, place: str) -> list[str]:
    """The store's whole change sets; a set without Spark's mark is still being written, or its writer is gone."""
    fs, path = _files(spark, place)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("set-")]
    return sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _add(rows: DataFrame, place: str) -> str:
    to = f"{place}/set-{uuid.uuid4().hex}"
    rows.write.parquet(to)
    return to


def put(snippets: DataFrame, place: str) -> str:
    """Adds or replaces ``snippets`` (name, body, updated_at); rows without a valid name or a body are left out."""
    rows = valid_library(snippets).select("name", "body", F.col("updated_at").cast("bigint").alias("updated_at"), F.lit(False).alias("deleted"))
    return _add(rows, place)


def remove(names: DataFrame, place: str) -> str:
    """Deletes ``names`` (name, updated_at: when); later bodies bring a name back."""
    name = tokens.snippet_name(F.col("name"))
    rows = names.select(name.alias("name"), F.lit(None).cast("string").alias("body"), F.col("updated_at").cast("bigint").alias("updated_at"), F.lit(True).alias("deleted"))
    return _add(rows.filter("name != ''"), place)


def _age() -> Column:
    return F.struct(F.col("updated_at").isNull(), -F.col("updated_at"), ~F.col("deleted"), "body")


def newest(rows: DataFrame) -> DataFrame:
    """The newest row of each name, deletions too; combined before the shuffle, so a name of very many versions is no hot
    key."""
    return rows.groupBy("name").agg(F.min_by(F.struct("body", "updated_at", "deleted"), _age()).alias("v")).select("name", "v.*")


def _rows(spark: SparkSession, sets: list[str]) -> DataFrame:
    return spark.read.schema(VERSION).parquet(*sets) if sets else spark.createDataFrame([], VERSION)


def load(spark: SparkSession, place: str) -> DataFrame:
    """name, body, updated_at of the library; empty if there is no store."""
    return newest(_rows(spark, change_sets(spark, place))).filter("not deleted").drop("deleted")


def compact(spark: SparkSession, place: str, forget_before: int | None = None) -> int:
    """Writes the newest rows as one set, then removes the sets they came from; returns how many these were.

    Deletions stay, as a set of another writer may still bring an older body, but for those before ``forget_before``."""
    sets = change_sets(spark, place)
    if len(sets) > 1 or forget_before is not None:
        rows = newest(_rows(spark, sets))
        if forget_before is not None:
            rows = rows.filter(~F.col("deleted") | (F.coalesce("updated_at", F.lit(-(1 << 62))) >= forget_before))
        _add(rows, place)
        fs, _ = _files(spark, place)
        for s in sets:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(s), True)
    return len(sets)


def json_lists(library: DataFrame, *by: str) -> DataFrame:
    """``by`` and json: the library of each group as a JSON list in order of names, as ``templates.read_library`` reads it."""
    item = F.struct("name", "body", F.col("updated_at").alias("updatedAt"))
    return library.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))
