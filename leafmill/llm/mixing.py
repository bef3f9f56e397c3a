"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources in code point order (null last) weigh 3, 1, 2, 3, ... and share
150 % of all words; a target never exceeds twice its source's size, what is cut off is shared anew by weight. A
source whose target is k times its size plus a rest takes every document k times, and once more those whose 60-bit
hash lies below the source's threshold. The threshold comes from nested histograms: words by source and leading 12
hash bits give the bucket in which the rest is used up, only that bucket's rows go into the next 12 bits' histogram,
and so on to the single document, so nothing is sorted. The document at the edge goes in if that brings the source
nearer to its rest.

Defined cases: null text has size 0 and takes 0; null source is a source of its own; the hash is of id and text, so
rows that share an id (or have none) are chosen one by one, and only rows that repeat both stand or fall together, as
they can't be told apart; texts are counted whole, however long; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, free_prefix, table

BITS, LEVELS = 12, 5
WEIGHTS = (3, 1, 2)


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of the id as text, a colon and the md5 of the text."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size), one row each, with ``target``: water-filling by weight under the caps.

    The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_fill = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("top") / F.col("weight"))
    s = (
        s.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("used", F.coalesce(F.sum("top").over(by_fill), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0)))
    )
    # the sources whose cap lies below the level at their own place are full; the first other one sets the level
    s = s.withColumn("level", (F.col("budget") - F.col("used")) / F.col("left"))
    s = s.withColumn("level", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "place", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("h", 60 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source: ``times`` (full passes) and ``below``, the hash under which documents go in once more."""
    spent = goals.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("times"),
        (F.col("target") - F.col("source_size") * F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).alias("rest"),
        F.lit(0).cast("bigint").alias("below"),
        F.lit(0).cast("bigint").alias("before"),
    )
    rows = sized
    for level in range(LEVELS):
        counts = cut(rows.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")), "mixhist")
        to_here = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        edge = counts.withColumn("under", F.coalesce(F.sum("n").over(to_here), F.lit(0)))
        edge = edge.join(spent.withColumnRenamed("source", "s0"), F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
        # buckets that are used up; the first one that isn't holds the edge
        edge = edge.filter(F.col("before") + F.col("under") + F.col("n") > F.col("rest"))
        edge = edge.groupBy("source").agg(F.min_by(F.struct("b", "n", "low", "high", "under", "before", "rest"), "b").alias("e")).select("source", "e.*")
        edge = edge.select(
            "source",
            F.col("low"),
            (F.col("before") + F.col("under")).alias("reached"),
            (F.col("low") == F.col("high")).alias("single"),
            # one hash value left: it goes in if that brings the source nearer
            ((F.col("before") + F.col("under") + F.col("n") / 2) <= F.col("rest")).alias("in"),
        )
        edge = cut(edge, "mixedge")
        spent = spent.join(edge.withColumnRenamed("source", "s0"), F.col("source").eqNullSafe(F.col("s0")), "left")
        spent = spent.select(
            "source",
            "times",
            "rest",
            # below: everything with a smaller hash is in; without an edge the whole source fits
            F.when(F.col("low").isNull(), F.when(F.lit(level == 0), F.lit(1 << 60)).otherwise(F.col("below")))
            .when(F.col("single") & F.col("in"), F.col("low") + 1)
            .otherwise(F.col("low"))
            .alias("below"),
            F.coalesce("reached", "before").alias("before"),
        )
        open_ = edge.filter(~F.col("single")).select(F.col("source").alias("s0"), F.shiftright("low", 60 - BITS * (level + 1)).alias("lead"))
        if level + 1 == LEVELS or open_.isEmpty():
            break
        rows = rows.join(open_, F.col("source").eqNullSafe(F.col("s0")) & (F.shiftright("h", 60 - BITS * (level + 1)) == F.col("lead"))).select(*sized.columns)
    return cut(spent.select("source", "times", "below"), "mixthresholds")


def mix_plan(sized: DataFrame) -> DataFrame:
    """One row per source: s1 (its name), source_size, target, times, below."""
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixgoals")
    found = goals.join(thresholds(sized, goals).withColumnRenamed("source", "s0"), F.col("source").eqNullSafe(F.col("s0")))
    return cut(found.drop("s0").withColumnRenamed("source", "s1"), "mixplan")


def sizes(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", word_count("text").alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h")), "mixsizes")


def times_taken(h: Column) -> Column:
    """How often the mix takes a document whose row is joined to its source's plan."""
    return F.least(F.lit(2), F.col("times") + (h < F.col("below")).cast("int"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each document (0, 1, 2 times its size)."""
    sized = sizes(docs)
    out = sized.join(mix_plan(sized), F.col("source").eqNullSafe(F.col("s1")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken(F.col("h"))).alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; those without words are taken once."""
    plan = mix_plan(sizes(docs))
    own = free_prefix(docs.columns, "_mix_")
    plan = plan.select(*(F.col(c).alias(f"{own}{c}") for c in plan.columns))
    more = F.least(F.lit(2), F.col(f"{own}times") + (hash60(docs["doc_id"], docs["text"]) < F.col(f"{own}below")).cast("int"))
    taken = F.when(word_count(docs["text"]) > 0, more).otherwise(1)
    rows = docs.join(plan, docs["source"].eqNullSafe(F.col(f"{own}s1"))).withColumn(f"{own}taken", taken).filter(F.col(f"{own}taken") > 0)
    return rows.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}taken")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
lev AS (
  SELECT *, source_size * 2.0::DOUBLE AS top, source_size * 2.0::DOUBLE / weight AS fill,
         (SELECT sum(source_size) * 1.5::DOUBLE FROM src) AS budget FROM src),
lev2 AS (
  SELECT *, (budget - coalesce(sum(top) OVER w, 0)) / ((SELECT sum(weight) FROM src) - coalesce(sum(weight) OVER w, 0)) AS level,
         row_number() OVER (ORDER BY fill, source IS NULL, source) AS place
  FROM lev WINDOW w AS (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size,
         least(top, coalesce((SELECT arg_min(level, place) FROM lev2 WHERE fill > level) * weight, top))::DOUBLE AS target FROM lev2),
run AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS times,
         sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, times + CASE WHEN upto - own / 2.0 <= target - source_size * times THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
