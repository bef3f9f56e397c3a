"""Document statistics, outlines, heading navigation and list-marker audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.patterns import ends_trimmed
from leafmill.functions.text import shortened, word_count

# Style names of headings, the start of a heading by its looks, fonts whose bullets are private symbols.
HEADING_STYLE = r"(?i)heading|docx-heading|Title|Subtitle"
HEADING_START = r"^[A-Z0-9ĄĆĘŁŃÓŚŹŻ]"
LEGACY_FONT = r"(?i)Symbol|Wingdings|Webdings|MT Extra|Marlett"
_EMPTY = {"style": "string", "table_no": "int", "tag": "string"}


def _with_defaults(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumns({c: F.lit(None).cast(t) for c, t in _EMPTY.items() if c not in paragraphs.columns})


def headings(paragraphs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, heading_no, para_idx, label.

    Tagged paragraphs (``tag`` h1 to h6) are the headings; only a document without any falls back to style names and
    to short lines that start like a heading.
    """
    p = _with_defaults(paragraphs).withColumn("_label", ends_trimmed(F.col("text"))).filter(F.length("_label") > 0)
    tagged = F.coalesce(F.lower("tag").rlike("^h[1-6]$"), F.lit(False))
    looks = F.coalesce(F.col("style").rlike(HEADING_STYLE), F.lit(False)) | ((F.length("_label") < 120) & F.col("_label").rlike(HEADING_START))
    p = p.withColumn("_tagged", tagged).withColumn("_any", F.max("_tagged").over(Window.partitionBy("doc_id")))
    found = p.filter(F.when(F.col("_any"), F.col("_tagged")).otherwise(looks))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx")) - 1
    out = found.select("doc_id", number.alias("heading_no"), "para_idx", F.col("_label").alias("label"))
    return out if most is None else out.filter(F.col("heading_no") < most).withColumn("label", shortened(F.col("label"), 80))


def statistics(paragraphs: DataFrame) -> DataFrame:
    """doc_id, words, chars, headings, paragraphs, tables; words are summed paragraph by paragraph."""
    p = _with_defaults(paragraphs)
    base = p.groupBy("doc_id").agg(
        F.sum(word_count(F.col("text"))).cast("bigint").alias("words"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.count("*").alias("paragraphs"),
        F.countDistinct("table_no").alias("tables"),
    )
    n = headings(p).groupBy("doc_id").agg(F.count("*").alias("headings"))
    return base.join(n, "doc_id", "left").withColumn("headings", F.coalesce("headings", F.lit(0)).cast("bigint"))


def heading_indices(found: DataFrame) -> DataFrame:
    """doc_id and the sorted distinct paragraph indices of its headings."""
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("para_idx")).alias("heading_idx"))


def under_headings(paragraphs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds what surrounds each paragraph: the heading it falls under (label, index) and the next and previous heading,
    which wrap around. All four are null in a document without headings."""
    marks = found.select("doc_id", "para_idx", F.col("para_idx").alias("_h"), F.col("label").alias("_label"))
    p = paragraphs.join(marks, ["doc_id", "para_idx"], "left")
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("para_idx")
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    return p.select(
        *paragraphs.columns,
        F.last("_label", ignorenulls=True).over(to_here).alias("heading"),
        F.last("_h", ignorenulls=True).over(to_here).alias("heading_idx"),
        F.coalesce(F.first("_h", ignorenulls=True).over(after), F.min("_h").over(doc)).alias("next_heading"),
        F.coalesce(F.last("_h", ignorenulls=True).over(before), F.max("_h").over(doc)).alias("previous_heading"),
    )


def list_markers(paragraphs: DataFrame, numbering: DataFrame) -> DataFrame:
    """List paragraphs with their marker kind and glyph number.

    ``numbering``: doc_id, num_id, ilvl, num_fmt, lvl_text, font, is_image.
    """
    items = paragraphs.filter(F.col("list_level") >= 0).withColumnRenamed("list_level", "ilvl")
    kind = (
        F.when(F.coalesce("is_image", F.lit(False)), "image")
        .when(F.col("num_fmt").isNotNull() & ~F.col("num_fmt").isin("bullet", "none"), "numbered")
        .when(F.coalesce(F.col("font").rlike(LEGACY_FONT), F.lit(False)), "legacy")
        .when(F.coalesce("num_fmt", F.lit("none")) == "none", "none")
        .otherwise("bullet")
    )
    return items.join(numbering, ["doc_id", "num_id", "ilvl"], "left").withColumn("marker", kind).withColumn("glyph", F.col("ilvl") % 3)


def marker_audit(markers: DataFrame) -> DataFrame:
    kinds = ("image", "numbered", "legacy", "bullet", "none")
    return markers.groupBy("doc_id").agg(*(F.count_if(F.col("marker") == k).alias(f"n_{k}") for k in kinds), F.count_if(F.col("marker") == "legacy").alias("n_issues"))
