"""Run tables: merging, offsets, styling and splicing of character ranges, paragraph diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.model import RUN
from leafmill.operators import ranges

KEY = ("doc_id", "para_idx")


def exploded(paragraphs: DataFrame, runs: str = "runs") -> DataFrame:
    """The long form: doc_id, para_idx, run_idx, is_break, text, style."""
    return paragraphs.select(*KEY, F.posexplode(runs).alias("run_idx", "r")).select(*KEY, "run_idx", "r.*")


def nested(rows: DataFrame) -> DataFrame:
    """The nested form: doc_id, para_idx, runs."""
    run = F.struct("is_break", "text", "style").cast(RUN)
    ordered = F.array_sort(F.collect_list(F.struct("run_idx", run.alias("r"))), lambda a, b: a["run_idx"] - b["run_idx"])
    return rows.groupBy(*KEY).agg(F.transform(ordered, lambda x: x["r"]).alias("runs"))


def merged(rows: DataFrame) -> DataFrame:
    """Neighbours of equal style as one run; breaks never merge. A paragraph's runs are gathered once."""
    out = exploded(nested(rows).select(*KEY, R.merge_adjacent(F.col("runs")).alias("runs")))
    brk = F.coalesce("is_break", F.lit(False))
    return out.select(*KEY, "run_idx", brk.alias("is_break"), F.when(~brk, F.coalesce("text", F.lit(""))).alias("text"), "style")


def with_offsets(rows: DataFrame) -> DataFrame:
    """Adds run_start and run_end in the paragraph's text; a break counts one character."""
    n = F.when(F.coalesce("is_break", F.lit(False)), 1).otherwise(F.length(F.coalesce("text", F.lit(""))))
    order = Window.partitionBy(*KEY).orderBy("run_idx")
    ends = rows.withColumn("_n", n).withColumn("run_end", F.sum("_n").over(order).cast("int"))
    return ends.withColumn("run_start", (F.col("run_end") - F.col("_n")).cast("int")).drop("_n")


def locate(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The runs that each range (doc_id, para_idx, start, end) touches, with the part of the run: from_offset, to_offset.

    A range of length zero is in the run whose characters it stands before, or at the very end in the last one.
    """
    o = with_offsets(rows).withColumn("_last", F.max("run_end").over(Window.partitionBy(*KEY)))
    both = o.join(asked, list(KEY))
    touch = (F.col("start") < F.col("run_end")) & (F.col("end") > F.col("run_start"))
    at = (F.col("start") == F.col("end")) & (((F.col("run_start") <= F.col("start")) & (F.col("start") < F.col("run_end"))) | ((F.col("start") == F.col("_last")) & (F.col("run_end") == F.col("_last"))))
    hit = both.filter(touch | at)
    return hit.select(*KEY, "start", "end", "run_idx", F.greatest(F.col("start") - F.col("run_start"), F.lit(0)).alias("from_offset"), (F.least("end", "run_end") - F.col("run_start")).alias("to_offset"))


def restyle(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Applies styles to any ranges (doc_id, para_idx, start, end, new_style, seq) of run rows, see :mod:`ranges`."""
    return exploded(ranges.restyled(nested(rows), marks))


def splice(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Replaces any ranges (doc_id, para_idx, start, end, insert, seq) of run rows, see :mod:`ranges`."""
    return exploded(ranges.respliced(nested(rows), cuts))


def changed_paragraphs(baseline: DataFrame, edited: DataFrame, how: str = "inner") -> DataFrame:
    """Paragraphs (doc_id, para_idx, runs) whose runs differ; only indexes that both have, unless ``how`` is outer."""
    a = baseline.select(*KEY, F.col("runs").alias("old_runs"))
    b = edited.select(*KEY, F.col("runs").alias("runs"))
    both = a.join(b, list(KEY), how)
    same = F.col("old_runs").isNotNull() & F.col("runs").isNotNull() & R.runs_equal(F.col("old_runs"), F.col("runs"))
    state = F.when(F.col("old_runs").isNull(), "added").when(F.col("runs").isNull(), "removed").otherwise("changed")
    return both.filter(~F.coalesce(same, F.lit(False))).withColumn("state", state)
