"""Styled runs: from web pages and from paragraphs with styles that follow from their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.functions import text as T
from leafmill.operators import ranges, structure, styled
from leafmill.plans.base import P_SQL, paras, query, table
from leafmill.sources import docx, html


@query("s06_html_runs")
def s06(spark, sf_dir):
    """Styled runs of all pages' blocks."""
    return styled.exploded(html.paragraphs(table(spark, sf_dir, "pages"))).withColumn("style", R.style_css(F.col("style")))


@query("s09_runs_to_html")
def s09(spark, sf_dir):
    return html.paragraphs(table(spark, sf_dir, "pages")).select("doc_id", "para_idx", R.runs_html(F.col("runs")).alias("html"))


@query("w03_page_outline")
def w03_pages(spark, sf_dir):
    """Outline of pages, where heading tags decide."""
    return structure.headings(html.paragraphs(table(spark, sf_dir, "pages")).select("doc_id", "para_idx", "tag", "text"))


_CSS = """'color: rgb(' || (n_chars % 256) || ', 0, 16); font-weight:' || CASE WHEN doc_id % 2 = 0 THEN 'bold' ELSE '400' END || ';font-size: ' || (doc_id % 20 + 1) || 'px; Font-Family: "Courier New", mono; text-decoration: underline dotted; font-style:' || CASE WHEN doc_id % 3 = 0 THEN 'italic' ELSE 'normal' END"""


def _css():
    d, n = F.col("doc_id"), F.col("n_chars")
    return F.concat(F.lit("color: rgb("), (n % 256).cast("string"), F.lit(", 0, 16); font-weight:"), F.when(d % 2 == 0, "bold").otherwise("400"), F.lit(";font-size: "), (d % 20 + 1).cast("string"), F.lit('px; Font-Family: "Courier New", mono; text-decoration: underline dotted; font-style:'), F.when(d % 3 == 0, "italic").otherwise("normal"))


@query(
    "r03_parse_css",
    f"""SELECT doc_id, printf('%02X', (n_chars % 256)::INTEGER) || '0010' AS hex, px AS points, CASE WHEN doc_id % 2 = 0 THEN true END AS bold, CASE WHEN doc_id % 3 = 0 THEN true END AS italic, true AS underline,
       'rgb(' || (n_chars % 256) || ', 0, 16)' AS color, 'Courier New"' AS font_family, regexp_replace(px::VARCHAR, '\\.0$', '') || 'pt' AS font_size
FROM (SELECT *, (floor((doc_id % 20 + 1) * 0.75::DOUBLE * 2 + 0.5) / 2)::DOUBLE AS px FROM documents)""",
)
def r03(spark, sf_dir):
    """Inline CSS to styles, with colours and sizes normalised."""
    s = table(spark, sf_dir, "documents").select("doc_id", R.parse_css(_css()).alias("s"), R.css_size(F.concat((F.col("doc_id") % 20 + 1).cast("string"), F.lit("px"))).alias("points"))
    return s.select("doc_id", R.css_color(F.col("s.color")).alias("hex"), "points", "s.bold", "s.italic", "s.underline", "s.color", "s.font_family", "s.font_size")


def _styled(spark, sf_dir):
    """Each paragraph cut into words' runs whose style follows from the word's number."""
    words = F.split(F.col("text"), " ", -1)
    run = lambda w, i: F.struct(F.lit(False).alias("is_break"), F.concat(F.when(i > 0, " ").otherwise(""), w).alias("text"), R.style(bold=F.when(i % 6 >= 3, F.lit(True)), color=F.when(i % 8 >= 4, "#FF0000").otherwise(""), italic=F.lit(None)).alias("style"))
    p = paras(spark, sf_dir).withColumn("runs", F.transform(words, run))
    return p.select("doc_id", "para_idx", "text", "runs")


_W = f"""WITH {P_SQL},
w AS (SELECT doc_id, para_idx, (i - 1) AS i, CASE WHEN i > 1 THEN ' ' ELSE '' END || x AS t
      FROM (SELECT doc_id, para_idx, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM p)),
s AS (SELECT *, (i // 3) % 2 = 1 AS bold, (i // 4) % 2 = 1 AS red FROM w),
g AS (SELECT *, CASE WHEN lag(bold) OVER k = bold AND lag(red) OVER k = red THEN 0 ELSE 1 END AS n FROM s WINDOW k AS (PARTITION BY doc_id, para_idx ORDER BY i)),
u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, para_idx ORDER BY i) - 1 AS run_idx FROM g),
m AS (SELECT doc_id, para_idx, run_idx::INTEGER AS run_idx, string_agg(t, '' ORDER BY i) AS text, bool_or(bold) AS bold, bool_or(red) AS red FROM u GROUP BY doc_id, para_idx, run_idx),
o AS (SELECT *, (sum(len(text)) OVER (PARTITION BY doc_id, para_idx ORDER BY run_idx))::INTEGER AS run_end FROM m)"""
_CSS_OF = "CASE WHEN bold AND red THEN 'font-weight:bold;color:#FF0000' WHEN bold THEN 'font-weight:bold' WHEN red THEN 'color:#FF0000' ELSE '' END"


@query("w02_merge_runs", f"{_W} SELECT doc_id, para_idx, run_idx, text, {_CSS_OF} AS css FROM m")
def w02(spark, sf_dir):
    """Neighbours of equal style merged by islands."""
    return styled.merged(styled.exploded(_styled(spark, sf_dir))).select("doc_id", "para_idx", "run_idx", "text", R.style_css(F.col("style")).alias("css"))


@query("r06_runs_to_text", f"WITH {P_SQL} SELECT doc_id, para_idx, text, (doc_id + para_idx) % 2 = 0 OR len(string_split(text, ' ')) <= 3 AS same FROM p")
def r06(spark, sf_dir):
    """Text of runs, and their equality with the merged runs or, in every other paragraph, with unstyled ones.

    The first three words have no style, so only paragraphs of up to three words equal unstyled runs.
    """
    runs = F.col("runs")
    other = F.when((F.col("doc_id") + F.col("para_idx")) % 2 == 0, R.merge_adjacent(runs)).otherwise(R.text_runs(F.col("text")))
    return _styled(spark, sf_dir).select("doc_id", "para_idx", R.runs_text(runs).alias("text"), R.runs_equal(runs, other).alias("same"))


@query("s09_styled_to_html", f"""{_W} SELECT doc_id, para_idx, string_agg(CASE WHEN css = '' THEN t ELSE '<span style="' || css || '">' || t || '</span>' END, '' ORDER BY run_idx) AS html
FROM (SELECT doc_id, para_idx, run_idx, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, {_CSS_OF} AS css FROM m) GROUP BY doc_id, para_idx""")
def s09_styled(spark, sf_dir):
    """Merged runs of all paragraphs as HTML."""
    return _styled(spark, sf_dir).select("doc_id", "para_idx", R.runs_html(R.merge_adjacent(F.col("runs"))).alias("html"))


@query("s03_docx_runs", f"{_W} SELECT doc_id, para_idx, run_idx, false AS is_break, text, {_CSS_OF} AS css FROM m")
def s03(spark, sf_dir):
    """Styled runs written into packages and read out of them again."""
    packages = docx.built(docx.written(_styled(spark, sf_dir)))
    return docx.runs(packages).withColumn("css", R.style_css(F.col("style"))).drop("style")


@query("j09_offsets_to_runs", f"""{_W} SELECT doc_id, para_idx, 5 AS start, 25 AS "end", run_idx, greatest(5 - (run_end - len(text)), 0)::INTEGER AS from_offset, (least(25, run_end) - (run_end - len(text)))::INTEGER AS to_offset
FROM o WHERE 5 < run_end AND 25 > run_end - len(text)""")
def j09(spark, sf_dir):
    r = _styled(spark, sf_dir)
    asked = r.select("doc_id", "para_idx", F.lit(5).alias("start"), F.lit(25).alias("end"))
    return styled.locate(styled.merged(styled.exploded(r)), asked)


@query("r08_restyle_range", f"WITH {P_SQL} SELECT doc_id, para_idx, text, text[6:25] AS underlined FROM p")
def r08(spark, sf_dir):
    """Characters 5 to 24 underlined: the text stays, and exactly they are."""
    r = _styled(spark, sf_dir)
    marks = r.select("doc_id", "para_idx", F.lit(5).alias("start"), F.lit(25).alias("end"), R.style(underline=F.lit(True)).alias("new_style"))
    runs = F.col("runs")
    marked = F.array_join(F.transform(F.filter(runs, lambda x: F.coalesce(x["style"]["underline"], F.lit(False))), lambda x: x["text"]), "")
    return ranges.restyled(r, marks).select("doc_id", "para_idx", R.runs_text(runs).alias("text"), marked.alias("underlined"))


@query("r09_splice_range", f"WITH {P_SQL} SELECT doc_id, para_idx, text[:5] || '<new>' || text[9:] AS text FROM p")
def r09(spark, sf_dir):
    """Characters 5 to 7 replaced; shorter paragraphs take the new text at their end."""
    r = _styled(spark, sf_dir)
    n = F.length("text")
    cuts = r.select("doc_id", "para_idx", F.least(F.lit(5), n).alias("start"), F.least(F.lit(8), n).alias("end"), F.lit("<new>").alias("insert"))
    return ranges.respliced(r, cuts).select("doc_id", "para_idx", R.runs_text(F.col("runs")).alias("text"))


def _many(r):
    """Ranges of every paragraph: two that overlap, one inside them, an empty one, one far beyond the text, one of all."""
    look = [R.style(underline=F.lit(True), color=F.lit("#00FF00")), R.style(italic=F.lit(True), color=F.lit("#0000FF")), R.style(bold=F.lit(True), font_size=F.lit("9pt")), R.style(bold=F.lit(True)), R.style(italic=F.lit(True)), R.style(font_family=F.lit("Arial"), color=F.lit(""))]
    n = F.length("text")
    ends = [(F.lit(2), F.lit(20)), (F.lit(10), F.lit(30)), (F.lit(12), F.lit(15)), (F.lit(7), F.lit(7)), (F.lit(90_000), F.lit(90_001)), (F.lit(-3), n + 5)]
    given = F.array(*(F.struct(F.lit(i).alias("seq"), a.alias("start"), b.alias("end"), s.alias("new_style"), F.lit(f"<{i}>").alias("insert")) for i, ((a, b), s) in enumerate(zip(ends, look))))
    return r.select("doc_id", "para_idx", F.inline(given))


@query(
    "r08_many_ranges",
    f"""{_W}, c AS (SELECT doc_id, para_idx, bold, red, run_end - len(text) + k AS pos, text[k + 1] AS ch FROM (SELECT *, unnest(range(len(text))) AS k FROM o)),
z AS (SELECT doc_id, para_idx, pos, ch, bold OR pos BETWEEN 12 AND 14 AS bold, pos BETWEEN 10 AND 29 AS italic, pos BETWEEN 2 AND 19 AS underline,
  CASE WHEN pos BETWEEN 10 AND 29 THEN '#0000FF' WHEN pos BETWEEN 2 AND 19 THEN '#00FF00' WHEN red THEN '#FF0000' ELSE '' END AS color, CASE WHEN pos BETWEEN 12 AND 14 THEN '9pt' ELSE '' END AS size FROM c),
y AS (SELECT *, concat_ws(';', CASE WHEN bold THEN 'font-weight:bold' END, CASE WHEN italic THEN 'font-style:italic' END, CASE WHEN underline THEN 'text-decoration:underline' END, CASE WHEN color <> '' THEN 'color:' || color END, 'font-family:"Arial"', CASE WHEN size <> '' THEN 'font-size:' || size END) AS css FROM z),
g2 AS (SELECT *, CASE WHEN lag(css) OVER k = css THEN 0 ELSE 1 END AS n FROM y WINDOW k AS (PARTITION BY doc_id, para_idx ORDER BY pos)),
u2 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, para_idx ORDER BY pos) - 1 AS run_idx FROM g2)
SELECT doc_id, para_idx, run_idx::INTEGER AS run_idx, string_agg(ch, '' ORDER BY pos) AS text, css FROM u2 GROUP BY doc_id, para_idx, run_idx, css""",
)
def r08_many(spark, sf_dir):
    """Overlapping, nested and empty ranges of every paragraph restyled at once; the SQL goes character by character."""
    r = _styled(spark, sf_dir)
    return styled.exploded(ranges.restyled(r, _many(r))).select("doc_id", "para_idx", "run_idx", "text", R.style_css(F.col("style")).alias("css"))


@query(
    "r09_many_ranges",
    f"WITH {P_SQL} SELECT doc_id, para_idx, CASE WHEN len(text) >= 12 THEN text[:4] || '<0>' || text[7] || '<1>' || text[11] || '<2>' || text[13:] ELSE text END AS text FROM p",
)
def r09_many(spark, sf_dir):
    """Three replacements in each paragraph of twelve characters or more, two of them overlapping."""
    r = _styled(spark, sf_dir)
    spots = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(f"<{i}>").alias("insert")) for i, (a, b) in enumerate([(4, 6), (7, 10), (11, 12)])))
    cuts = r.filter(F.length("text") >= 12).select("doc_id", "para_idx", F.inline(F.concat(spots, F.array(F.struct(F.lit(3).alias("seq"), F.lit(8).alias("start"), F.lit(10).alias("end"), F.lit("").alias("insert"))))))
    return ranges.respliced(r, cuts).select("doc_id", "para_idx", R.runs_text(F.col("runs")).alias("text"))


@query("j05_paragraph_diff", f"WITH {P_SQL} SELECT doc_id, para_idx, 'changed' AS state, upper(text[1]) || 'x' AS head FROM p WHERE (doc_id + para_idx) % 4 = 1 AND len(text) > 0")
def j05(spark, sf_dir):
    """Every fourth paragraph edited; merged runs of equal looks don't count as a change."""
    r = _styled(spark, sf_dir)
    edit = (F.col("doc_id") + F.col("para_idx")) % 4 == 1
    new = R.text_runs(F.concat(T.upper_char(F.left("text", F.lit(1))), F.lit("x")))
    edited = r.select("doc_id", "para_idx", F.when(edit & (F.length("text") > 0), new).otherwise(R.merge_adjacent(F.col("runs"))).alias("runs"))
    return styled.changed_paragraphs(r.select("doc_id", "para_idx", "runs"), edited).select("doc_id", "para_idx", "state", R.runs_text(F.col("runs")).alias("head"))


@query("x06_text_to_runs", "SELECT doc_id, (2 * (len(string_split(text, chr(10)))) - 1)::INTEGER AS n_runs, (len(string_split(text, chr(10))) - 1)::INTEGER AS n_breaks, text FROM documents WHERE text IS NOT NULL")
def x06(spark, sf_dir):
    runs = R.text_runs(F.col("text"))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(runs).alias("n_runs"), F.size(F.filter(runs, lambda r: r["is_break"])).alias("n_breaks"), R.runs_text(runs).alias("text"))


_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("s08_runs_to_xml", f"WITH {P_SQL} SELECT doc_id, para_idx, '<w:r><w:rPr><w:rFonts w:ascii=\"Courier New\" w:hAnsi=\"Courier New\"/><w:b/><w:color w:val=\"FF0000\"/><w:sz w:val=\"28\"/></w:rPr><w:t' || CASE WHEN regexp_matches(text, '^\\s|\\s$') THEN ' xml:space=\"preserve\"' ELSE '' END || '>' || {_ESC} || '</w:t></w:r>' AS xml FROM p")
def s08(spark, sf_dir):
    look = R.style(bold=F.lit(True), color=F.lit("#ff0000"), font_family=F.lit("Courier New"), font_size=F.lit("14pt"))
    run = F.array(F.struct(F.lit(False).alias("is_break"), F.col("text"), look.alias("style")))
    return paras(spark, sf_dir).select("doc_id", "para_idx", R.runs_xml(run).alias("xml"))
