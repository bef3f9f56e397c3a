"""The paragraph table: from texts, scope and emptiness filters, changed-only projection, transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """One paragraph per line of ``text``: the kept columns, para_idx, text. A null text has no paragraphs."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("para_idx", "text"))


def in_scope(paragraphs: DataFrame, scope: str = "all") -> DataFrame:
    if scope not in ("all", "body"):
        raise ValueError(f"unknown scope: {scope}")
    return paragraphs if scope == "all" else paragraphs.filter(F.col("part") == "body")


def non_empty(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.filter(F.length("text") > 0)


def transformed(paragraphs: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Adds ``new_text`` and ``changed``; empty paragraphs stay as they are."""
    new = F.when(F.length("text") > 0, change(F.col("text"))).otherwise(F.col("text"))
    return paragraphs.withColumn("new_text", new).withColumn("changed", F.coalesce(F.col("new_text") != F.col("text"), F.lit(False)))


def changed_only(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.filter("changed")


def change_counts(paragraphs: DataFrame, *by: str) -> DataFrame:
    return paragraphs.groupBy(*by).agg(F.count_if("changed").alias("n_changed"), F.count("*").alias("n_paragraphs"))


def edit_errors(op: Column, find: Column, regex: Column, prefix: Column, suffix: Column) -> Column:
    """Error code of an edit row, or null: empty search, empty affix, unknown operation.

    Whether a pattern compiles is checked by :func:`check_pattern` before it is used.
    """
    known = op.isin("replace", "case", "trim", "affix")
    empty_find = (op == "replace") & (F.coalesce(F.length(find), F.lit(0)) == 0)
    empty_affix = (op == "affix") & (F.coalesce(F.length(prefix), F.lit(0)) + F.coalesce(F.length(suffix), F.lit(0)) == 0)
    return F.when(~F.coalesce(known, F.lit(False)), "unknown-op").when(empty_find, "empty-find").when(empty_affix, "empty-affix")


def check_pattern(spark, pattern: str) -> None:
    """Raises ValueError if the regex does not compile."""
    if not pattern:
        raise ValueError("empty-find")
    try:
        spark.range(1).select(F.regexp_count(F.lit(""), F.lit(pattern))).collect()
    except Exception as e:
        raise ValueError(f"bad-regex: {pattern}") from e
