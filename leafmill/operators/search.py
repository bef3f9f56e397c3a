"""Search across a corpus: matches, previews, numbering and limited replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.patterns import let, literal_pattern, matches, split_up
from leafmill.functions.text import count_literal, count_regex, find_all, shortened

IN_ORDER = ("para_idx", "start")


def matches_of(paragraphs: DataFrame, find: str, regex: bool = False, headings_only: bool = False) -> DataFrame:
    """doc_id, para_idx, match_no, start, length, sample of case-insensitive matches, numbered in document order.

    ``headings_only`` needs an ``is_heading`` column.
    """
    if headings_only:
        paragraphs = paragraphs.filter("is_heading")
    hits = paragraphs.select("doc_id", "para_idx", F.explode(find_all(F.col("text"), find, regex)).alias("h"))
    out = hits.select("doc_id", "para_idx", F.col("h.start").alias("start"), F.length("h.before").alias("length"), F.col("h.before").alias("sample"))
    order = Window.partitionBy("doc_id").orderBy(*IN_ORDER)
    return out.withColumn("match_no", F.row_number().over(order) - 1)


def numbered(found: DataFrame, step: int = 1) -> DataFrame:
    """Adds position (from 1), total and the match that ``step`` further on is reached, wrapping around."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return found.withColumn("total", total).withColumn("position", F.col("match_no") + 1).withColumn("next_match", F.pmod(F.col("match_no") + step, F.col("total")))


def preview(paragraphs: DataFrame, find: str, regex: bool = False, samples: int = 8) -> DataFrame:
    """Per document: hits, paragraphs hit and the first samples of paragraphs (case-sensitive, as replacement is)."""
    n = count_regex(F.col("text"), find) if regex else count_literal(F.col("text"), find)
    hit = paragraphs.withColumn("n", n).filter("n > 0")
    rows = F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.struct("para_idx", shortened(F.col("text"), 72).alias("text")))))
    first = hit.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx")))
    return first.groupBy("doc_id").agg(F.sum("n").alias("hits"), F.count("*").alias("paragraphs"), rows.alias("samples"))


def replace_some(nodes: DataFrame, find: str, repl: str, regex: bool = False, skip: int = 0, most: int | None = None, order: str = "node_idx") -> DataFrame:
    """Replaces at most ``most`` occurrences of each document after the first ``skip``, in order of ``order``.

    Adds new_text and n_replaced. A running count per document says which of a node's matches are due.
    """
    pattern = find if regex else literal_pattern(find)
    n = F.size(matches(F.col("text"), pattern))
    counted = nodes.withColumn("_n", n)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("_from", F.greatest(F.lit(skip) - before, F.lit(0)))
    last = F.col("_n") if most is None else F.least(F.col("_n"), F.greatest(F.lit(skip + most) - before, F.lit(0)))
    counted = counted.withColumn("_to", last)
    return counted.withColumn("new_text", _due(F.col("text"), pattern, repl)).withColumn("n_replaced", F.greatest(F.col("_to") - F.col("_from"), F.lit(0)).cast("int")).drop("_n", "_from", "_to")


def _due(text: Column, pattern: str, repl: str) -> Column:
    def joined(p: Column) -> Column:
        m, g = p["hits"], p["gaps"]
        pick = F.transform(m, lambda hit, i: F.when((i >= F.col("_from")) & (i < F.col("_to")), F.lit(repl)).otherwise(hit))
        parts = F.zip_with(F.slice(g, F.lit(1), F.size(m)), pick, lambda a, b: F.concat(a, b))
        return F.concat(F.array_join(parts, ""), F.element_at(g, -1))

    return let(split_up(text, pattern), joined)
