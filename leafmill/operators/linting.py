"""Scanning and fixing a corpus with the typography rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import lint
from leafmill.functions.text import hit_snippet, splice


def scan(paragraphs: DataFrame, rules: Iterable[lint.Rule], lang: Column | None = None, details: bool = True) -> DataFrame:
    """One row per hit: the paragraph's ids, rule_id, ord, start, end, before, after, hit_id, snippet, fixed_paragraph."""
    rules = tuple(rules)
    ids = [c for c in paragraphs.columns if c != "text"]
    hits = paragraphs.filter(F.length("text") > 0).withColumn("hit", F.explode(lint.scan(F.col("text"), rules, lang))).select(*ids, "text", "hit.*")
    hits = hits.withColumn("hit_id", F.concat_ws("-", "rule_id", "para_idx", "ord", "start"))
    if details:
        args = [F.col(c) for c in ("text", "start", "end")]
        hits = hits.withColumn("snippet", hit_snippet(*args, F.col("before"), F.col("after"))).withColumn("fixed_paragraph", splice(*args, F.col("after")))
    return hits.drop("text")


def counts(paragraphs: DataFrame, rules: Iterable[lint.Rule], lang: Column | None = None) -> DataFrame:
    """The paragraph's ids, rule_id and n of each rule that has hits: the scan's counts without placing the hits."""
    ids = [c for c in paragraphs.columns if c != "text"]
    return paragraphs.select(*ids, F.explode(lint.counts(F.col("text"), tuple(rules), lang)).alias("c")).select(*ids, "c.*")


def by_rule(counted: DataFrame) -> DataFrame:
    """Hits and documents of each rule."""
    return counted.groupBy("rule_id").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def by_document_and_rule(counted: DataFrame) -> DataFrame:
    """Both levels at once; a null rule_id is a document's total, nulls in both the corpus's."""
    return counted.rollup("doc_id", "rule_id").agg(F.sum("n").alias("n"))


def with_hits(paragraphs: DataFrame, rules: Iterable[lint.Rule], lang: Column | None = None) -> DataFrame:
    """Paragraphs in which some rule has a hit."""
    return paragraphs.filter(F.size(lint.counts(F.col("text"), tuple(rules), lang)) > 0)


def fix(paragraphs: DataFrame, rules: Iterable[lint.Rule], lang: Column | None = None, only_hit: bool = False, on: Iterable[lint.Rule] | None = None) -> DataFrame:
    """Changed paragraphs with ``new_text``. ``only_hit``: just those with a hit of ``on`` (the same rules by default)."""
    rules = tuple(rules)
    if only_hit:
        paragraphs = with_hits(paragraphs, tuple(on or rules), lang)
    # a list of none or one, so that the fixes run once for the test and the result
    changed = F.filter(F.array(lint.fix(F.col("text"), rules, lang)), lambda new: new != F.col("text"))
    return paragraphs.withColumn("new_text", F.explode(changed))


def apply_hits(paragraphs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Paragraphs with one chosen hit each (doc_id, para_idx, start, end, after) spliced in."""
    hit = chosen.select("doc_id", "para_idx", "start", "end", "after")
    return paragraphs.join(hit, ["doc_id", "para_idx"]).withColumn("new_text", splice(F.col("text"), F.col("start"), F.col("end"), F.col("after"))).drop("start", "end", "after")
