"""Structural edits, batches and ordered replay of edit logs over paragraph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import editlog


def renumbered(paragraphs: DataFrame, *order: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return paragraphs.withColumn("para_idx", number.cast("int")).drop(*(c for c in order if c.startswith("_")))


def split_paragraphs(paragraphs: DataFrame, splits: DataFrame) -> DataFrame:
    """``splits`` (doc_id, para_idx, before, after): each named paragraph becomes two that share its properties."""
    s = splits.select("doc_id", "para_idx", "before", "after", F.lit(True).alias("_hit"))
    both = F.when(F.col("_hit"), F.array("before", "after")).otherwise(F.array("text"))
    rows = paragraphs.join(s, ["doc_id", "para_idx"], "left").withColumn("_parts", both)
    rows = rows.select(*(c for c in paragraphs.columns if c != "text"), F.posexplode("_parts").alias("_k", "text"))
    return renumbered(rows, "para_idx", "_k").select(*paragraphs.columns)


def merge_paragraphs(paragraphs: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges`` (doc_id, para_idx): each named paragraph is joined to the one before; index 0 stays. Adds join_at, the
    length of the text before the first joint, on paragraphs that took another in."""
    m = merges.filter("para_idx > 0").select("doc_id", "para_idx").distinct().withColumn("_joins", F.lit(1))
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    rows = paragraphs.join(m, ["doc_id", "para_idx"], "left").withColumn("_block", F.sum(F.when(F.col("_joins") == 1, 0).otherwise(1)).over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"])
    kept = [F.min_by(c, "para_idx").alias(c) for c in paragraphs.columns if c not in ("doc_id", "para_idx", "text")]
    out = rows.groupBy("doc_id", "_block").agg(texts.alias("_texts"), *kept)
    out = out.withColumn("text", F.array_join("_texts", "")).withColumn("join_at", F.when(F.size("_texts") > 1, F.length(F.col("_texts")[0])))
    return out.withColumn("para_idx", (F.col("_block") - 1).cast("int")).select(*paragraphs.columns, "join_at")


def change_list_level(paragraphs: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (doc_id, para_idx, delta): levels move within 0 to 8. Adds changed; other paragraphs stay."""
    new = F.greatest(F.lit(0), F.least(F.lit(8), F.col("list_level") + F.col("delta")))
    level = F.when((F.col("list_level") >= 0) & F.col("delta").isNotNull(), new).otherwise(F.col("list_level")).cast("int")
    rows = paragraphs.join(changes.select("doc_id", "para_idx", "delta"), ["doc_id", "para_idx"], "left")
    return rows.withColumn("_level", level).withColumn("changed", F.col("_level") != F.col("list_level")).withColumn("list_level", F.col("_level")).drop("_level", "delta")


def apply_batch(paragraphs: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` (doc_id, para_idx, text): new texts by position, sanitised; others and unknown positions are left alone.

    Of several items for one position the last by ``seq`` counts; without such a column, the greatest text.
    """
    last = F.max_by("text", F.struct("seq", "text")) if "seq" in items.columns else F.max("text")
    new = items.groupBy("doc_id", "para_idx").agg(T.sanitize_xml(last).alias("_new"))
    rows = paragraphs.join(new, ["doc_id", "para_idx"], "left")
    rows = rows.withColumn("changed", F.col("_new").isNotNull() & (F.col("_new") != F.col("text")))
    return rows.withColumn("text", F.coalesce("_new", "text")).drop("_new")


def appended(pending: DataFrame, derived: DataFrame) -> DataFrame:
    """Pending edits followed by derived ones, whose seq goes on from the last pending one of the document."""
    last = pending.groupBy("doc_id").agg(F.max("seq").alias("_last"))
    moved = derived.join(last, "doc_id", "left").withColumn("seq", (F.col("seq") + F.coalesce(F.col("_last") + 1, F.lit(0))).cast("int")).drop("_last")
    return pending.unionByName(moved)


def edit_column(text: Column, op: str = "replace", **p: str) -> Column:
    """One uniform edit as a Column; ``op`` and its parameters are checked here."""
    if op == "replace":
        if not p.get("find"):
            raise ValueError("empty-find")
        change = T.replace_regex if p.get("regex") else T.replace_literal
        return change(text, p["find"], p.get("replace", ""))
    if op == "case":
        return {"upper": F.upper, "lower": F.lower}.get(p.get("mode", "title"), T.title_case)(text)
    if op == "trim":
        return {"collapse": T.trim_collapse, "hard": T.trim_hard}.get(p.get("mode", "ends"), T.trim_ends)(text)
    if op == "affix":
        if not (p.get("prefix") or p.get("suffix")):
            raise ValueError("empty-affix")
        return T.affix(text, p.get("prefix", ""), p.get("suffix", ""))
    raise ValueError("unknown-op")


def apply_uniform(paragraphs: DataFrame, log: list[dict]) -> DataFrame:
    """The same ordered edits for every document, as one chain of Columns: adds new_text and changed."""
    out = F.col("text")
    for edit in log:
        out = edit_column(out, **edit)
    new = F.when(F.length("text") > 0, out).otherwise(F.col("text"))
    return paragraphs.withColumn("new_text", new).withColumn("changed", F.col("new_text") != F.col("text"))


def replay(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """Each document's own ordered log on its paragraphs: doc_id, para_idx, text, n_changes (see :mod:`editlog`).

    Documents without edits come out unchanged with n_changes 0.
    """
    return editlog.edited(editlog.run_log(paragraphs, edits, nodes=False, told=False)).select("doc_id", "para_idx", "text", "n_changes")
