"""Packages are unpacked a few at a time, whatever batches Spark hands over, and each entry is computed once."""

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.plans import source_queries
from leafmill.sources import docx


def sizes(batch, column, **limits):
    got = list(docx.sliced(iter([batch]), column, **limits))
    assert pa.Table.from_batches(got).combine_chunks() == pa.Table.from_batches([batch]).combine_chunks()
    return [b.num_rows for b in got]


def test_slices():
    content = pa.RecordBatch.from_pydict({"c": pa.array([b"x" * n for n in (5, 0, 5, 30, 1)] + [None] * 4, pa.binary())})
    assert sizes(content, "c", rows=3, size=10) == [3, 1, 3, 2]
    assert sizes(content.slice(2, 3), "c", rows=3, size=10) == [1, 1, 1]
    lists = pa.RecordBatch.from_pydict({"c": pa.array([["ab", "c"], [], None, ["d" * 9], ["e"]], pa.list_(pa.string()))})
    assert sizes(lists, "c", size=9) == [3, 1, 1]
    entries = pa.RecordBatch.from_pydict({"c": pa.array([[{"name": "a", "data": b"x" * 9}], [{"name": "b", "data": None}]], pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())])))})
    assert sizes(entries, "c", size=10) == [1, 1]
    assert sizes(pa.RecordBatch.from_pydict({"c": pa.array([b"x"] * 200, pa.binary())}), "c") == [64, 64, 64, 8]
    assert list(docx.sliced(iter([content.slice(0, 0)]), "c")) == []


def test_parts_are_built_once(spark, sf_dir):
    plan = source_queries.s07_exact(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # zipped, patched, entries


def test_run_properties(spark):
    looks = [(None, "", ""), ("#", "x<\"", "0pt"), ("rgb(1, 2, 300)", None, "9.5pt"), ("red", "A", "10px"), ("#ab12cd", None, "junk")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(looks)], "i int, color string, font_family string, font_size string")
    run = F.struct(F.lit(False).alias("is_break"), F.lit("a ").alias("text"), R.style(bold=F.col("i") == 3, color=F.col("color"), font_family=F.col("font_family"), font_size=F.col("font_size")).alias("style"))
    got = [r["x"] for r in rows.orderBy("i").select(R.runs_xml(F.array(run)).alias("x")).collect()]
    t = '<w:t xml:space="preserve">a </w:t></w:r>'
    assert got == [
        f"<w:r>{t}",
        f'<w:r><w:rPr><w:rFonts w:ascii="x&lt;&quot;" w:hAnsi="x&lt;&quot;"/><w:sz w:val="0"/></w:rPr>{t}',
        f'<w:r><w:rPr><w:color w:val="010212C"/><w:sz w:val="19"/></w:rPr>{t}',
        f'<w:r><w:rPr><w:rFonts w:ascii="A" w:hAnsi="A"/><w:b/><w:color w:val="RED"/><w:sz w:val="15"/></w:rPr>{t}',
        f'<w:r><w:rPr><w:color w:val="AB12CD"/></w:rPr>{t}',
    ]
