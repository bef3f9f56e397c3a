"""Statistics, outlines and navigation over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.patterns import WS
from leafmill.operators import structure
from leafmill.plans.base import P_SQL, paras, query, trim_sql

_H = f""",
hd AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1)::INTEGER AS heading_no, para_idx, label
  FROM (SELECT doc_id, para_idx, {trim_sql('text')} AS label FROM p) WHERE len(label) > 0 AND len(label) < 120 AND regexp_matches(label, '{structure.HEADING_START}'))"""


def _p(spark, sf_dir):
    return paras(spark, sf_dir).drop("lang")


@query("w03_outline", f"WITH {P_SQL}{_H} SELECT doc_id, heading_no, para_idx, CASE WHEN len(label) > 80 THEN label[:77] || '…' ELSE label END AS label FROM hd WHERE heading_no < 40")
def w03(spark, sf_dir):
    """The first 40 headings of each document, by the fallback rule, as texts carry no tags."""
    return structure.headings(_p(spark, sf_dir), most=40)


@query("a01_document_stats", f"WITH {P_SQL}{_H} SELECT doc_id, sum(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')))::BIGINT AS words, sum(len(text))::BIGINT AS chars, count(*) AS paragraphs, 0::BIGINT AS tables, coalesce(any_value(n), 0)::BIGINT AS headings FROM p LEFT JOIN (SELECT doc_id, count(*) AS n FROM hd GROUP BY doc_id) USING (doc_id) GROUP BY doc_id")
def a01(spark, sf_dir):
    return structure.statistics(_p(spark, sf_dir))


@query("a07_heading_indices", f"WITH {P_SQL}{_H} SELECT doc_id, string_agg(para_idx, ',' ORDER BY para_idx) AS heading_idx FROM hd GROUP BY doc_id")
def a07(spark, sf_dir):
    found = structure.heading_indices(structure.headings(_p(spark, sf_dir)))
    return found.withColumn("heading_idx", F.array_join("heading_idx", ","))


@query(
    "w04_heading_navigation",
    f"""WITH {P_SQL}{_H}, m AS (SELECT p.doc_id, p.para_idx, hd.para_idx AS h, hd.label FROM p LEFT JOIN hd USING (doc_id, para_idx))
SELECT doc_id, para_idx, last_value(label IGNORE NULLS) OVER here AS heading, last_value(h IGNORE NULLS) OVER here AS heading_idx,
       coalesce(min(h) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(h) OVER (PARTITION BY doc_id)) AS next_heading,
       coalesce(max(h) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(h) OVER (PARTITION BY doc_id)) AS previous_heading
FROM m WINDOW here AS (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def w04(spark, sf_dir):
    """Also J8: the heading that each paragraph falls under."""
    p = _p(spark, sf_dir)
    return structure.under_headings(p, structure.headings(p)).drop("text")


@query(
    "a08_list_markers",
    f"""WITH {P_SQL}, l AS (SELECT doc_id, para_idx, para_idx % 4 AS ilvl, (doc_id % 3)::INTEGER AS num_id FROM p WHERE para_idx % 5 <> 4),
k AS (SELECT doc_id, CASE WHEN num_id = 0 THEN CASE ilvl WHEN 0 THEN 'numbered' WHEN 1 THEN 'legacy' WHEN 2 THEN 'image' ELSE 'none' END WHEN num_id = 1 THEN 'bullet' ELSE 'none' END AS marker FROM l)
SELECT doc_id, count(*) FILTER (marker = 'image') AS n_image, count(*) FILTER (marker = 'numbered') AS n_numbered, count(*) FILTER (marker = 'legacy') AS n_legacy,
       count(*) FILTER (marker = 'bullet') AS n_bullet, count(*) FILTER (marker = 'none') AS n_none, count(*) FILTER (marker = 'legacy') AS n_issues FROM k GROUP BY doc_id""",
)
def a08(spark, sf_dir):
    """Paragraphs as list items of three numbering definitions, audited by marker kind."""
    p = _p(spark, sf_dir).select("doc_id", "para_idx", F.when(F.col("para_idx") % 5 == 4, -1).otherwise(F.col("para_idx") % 4).cast("int").alias("list_level"), (F.col("doc_id") % 3).cast("int").alias("num_id"))
    kinds = spark.createDataFrame([(0, 0, "decimal", "Arial", False), (0, 1, "bullet", "Wingdings", False), (0, 2, "bullet", None, True), (0, 3, "none", None, False), *((1, i, "bullet", "Arial", False) for i in range(4))], "num_id int, ilvl int, num_fmt string, font string, is_image boolean")
    numbering = p.select("doc_id").distinct().join(kinds, F.pmod(F.col("doc_id"), F.lit(3)) == F.col("num_id")).withColumn("lvl_text", F.lit(None).cast("string"))
    return structure.marker_audit(structure.list_markers(p, numbering))
