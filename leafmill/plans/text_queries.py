"""String operators over all paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import lint
from leafmill.functions import text as T
from leafmill.functions.patterns import WS
from leafmill.operators import linting, paragraphs
from leafmill.plans.base import D_SQL, P_SQL, defects, paras, query, table, trim_sql, upper_sql


def _c():
    return F.col("text")


def _each(spark, sf_dir, source=paras, **columns):
    return source(spark, sf_dir).select("doc_id", "para_idx", *(c.alias(n) for n, c in columns.items()))


def _sql(cte: str, source: str, columns: str) -> str:
    return f"WITH {cte} SELECT doc_id, para_idx, {columns} FROM {source}"


@query("t01_sanitize", _sql(P_SQL, "p", "regexp_replace(text || chr(1) || 'x' || chr(31), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS out"))
def t01(spark, sf_dir):
    return _each(spark, sf_dir, out=T.sanitize_xml(F.concat(_c(), F.lit("\x01x\x1f"))))


@query("t02_replace_literal", _sql(P_SQL, "p", "replace(text, 'the ', 'THE$1 ') AS out"))
def t02(spark, sf_dir):
    return _each(spark, sf_dir, out=T.replace_literal(_c(), "the ", "THE$1 "))


@query("t03_replace_regex", _sql(P_SQL, "p", "regexp_replace(text, '[aeiou]{2}', '$1', 'g') AS out"))
def t03(spark, sf_dir):
    return _each(spark, sf_dir, out=T.replace_regex(_c(), "[aeiou]{2}", "$1"))


@query("t04_count", _sql(P_SQL, "p", "((len(text) - len(replace(text, 'th', ''))) // 2)::INTEGER AS n_literal, len(regexp_extract_all(text, '[A-Z][a-z]+'))::INTEGER AS n_regex"))
def t04(spark, sf_dir):
    return _each(spark, sf_dir, n_literal=T.count_literal(_c(), "th"), n_regex=T.count_regex(_c(), "[A-Z][a-z]+"))


@query("t06_case", _sql(P_SQL, "p", f"{upper_sql('text')} AS up, lower(text) AS low"))
def t06(spark, sf_dir):
    return _each(spark, sf_dir, up=F.upper(_c()), low=F.lower(_c()))


@query("t07_title_case", _sql(P_SQL, "p", r"array_to_string(list_transform(regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*|[^\p{L}]+'), lambda w: replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:])), '') AS out"))
def t07(spark, sf_dir):
    return _each(spark, sf_dir, out=T.title_case(_c()))


@query("t08_trims", _sql(D_SQL, "d", f"{trim_sql('text')} AS ends, {trim_sql(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS collapsed, {trim_sql(r"regexp_replace(text, '[\x{A0}\x{2007}\x{202F}]', ' ', 'g')")} AS hard"))
def t08(spark, sf_dir):
    return _each(spark, sf_dir, defects, ends=T.trim_ends(_c()), collapsed=T.trim_collapse(_c()), hard=T.trim_hard(_c()))


@query("t11_affix", _sql(P_SQL, "p", "CASE WHEN len(text) > 0 THEN '[[T]]' || text || '[[/T]]' ELSE text END AS out"))
def t11(spark, sf_dir):
    return _each(spark, sf_dir, out=T.affix(_c(), "[[T]]", "[[/T]]"))


@query("t12_collapse_keep_newlines", "SELECT doc_id, " + trim_sql(f"regexp_replace(replace(text, 'e ', 'e ' || chr(9) || chr(160)), '{WS.replace(chr(92) + 't-' + chr(92) + 'r', chr(92) + 't' + chr(92) + 'x0B-' + chr(92) + 'r')}+', ' ', 'g')") + " AS out FROM documents")
def t12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.collapse_keep_newlines(F.replace(_c(), F.lit("e "), F.lit("e \t" + chr(160)))).alias("out"))


@query("t13_transform_counts", f"WITH {P_SQL} SELECT doc_id, count(*) FILTER (text <> {upper_sql('text')} AND len(text) > 0) AS n_changed, count(*) AS n_paragraphs FROM p GROUP BY doc_id")
def t13(spark, sf_dir):
    return paragraphs.change_counts(paragraphs.transformed(paras(spark, sf_dir), F.upper), "doc_id")


@query(
    "t14_hit_snippets",
    rf"""WITH {D_SQL},
h AS (SELECT doc_id, para_idx, text, unnest(range(1, len(text) + 1)) AS i FROM d),
e AS (SELECT doc_id, para_idx, text, (i - 1)::INTEGER AS s, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY i) - 1 AS ord
      FROM h WHERE text[i] = ' ' AND text[i + 1] = ' ' AND (i = 1 OR text[i - 1] <> ' ')),
r AS (SELECT *, len(regexp_extract(text[s + 1:], '^ +')) AS n FROM e),
x AS (SELECT *, text[greatest(s - 18, 0) + 1:s] AS l, text[s + n + 1:s + n + 18] AS rt FROM r),
o AS (SELECT *, '"' || {trim_sql("l || repeat(' ', n::INTEGER) || rt")} || '" → "' || {trim_sql("l || ' ' || rt")} || '"' AS sn FROM x)
SELECT doc_id, para_idx, s AS start, (s + n)::INTEGER AS "end", CASE WHEN len(sn) > 80 THEN sn[:79] || '…' ELSE sn END AS snippet,
       text[:s] || ' ' || text[s + n + 1:] AS fixed_paragraph FROM o""",
)
def t14(spark, sf_dir):
    """Context and corrected paragraph of every double space."""
    hits = linting.scan(defects(spark, sf_dir), lint.enabled("pl", ["double-space"]))
    return hits.select("doc_id", "para_idx", "start", "end", "snippet", "fixed_paragraph")


@query("t16_shortened", _sql(P_SQL, "p", "CASE WHEN len(text) > 72 THEN text[:69] || '…' ELSE text END AS sample, CASE WHEN len(text) > 80 THEN text[:77] || '…' ELSE text END AS label"))
def t16(spark, sf_dir):
    return _each(spark, sf_dir, sample=T.shortened(_c(), 72), label=T.shortened(_c(), 80))


@query("t17_file_size", "SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 3) * 97 AS b FROM documents)")
def t17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.file_size(F.col("n_chars") * (F.col("doc_id") % 3) * 97).alias("size"))


@query("t18_escape_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS out FROM pages")
def t18(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("out"))


@query("t19_words", _sql(D_SQL, "d", f"len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))::INTEGER AS n_words"))
def t19(spark, sf_dir):
    return _each(spark, sf_dir, defects, n_words=T.word_count(_c()))


@query(
    "p01_scope_filters",
    f"WITH {P_SQL}, q AS (SELECT *, CASE WHEN para_idx % 7 = 3 THEN 'other' ELSE 'body' END AS part FROM p) SELECT part, count(*) AS n, count(*) FILTER (len(text) > 0) AS n_filled FROM q WHERE part = 'body' GROUP BY part",
)
def p01(spark, sf_dir):
    """Scope and emptiness."""
    p = paras(spark, sf_dir).withColumn("part", F.when(F.col("para_idx") % 7 == 3, "other").otherwise("body"))
    return paragraphs.in_scope(p, "body").groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 0).alias("n_filled"))


@query(
    "p04_edit_validation",
    """SELECT doc_id, CASE WHEN op NOT IN ('replace', 'case', 'trim', 'affix') THEN 'unknown-op' WHEN op = 'replace' AND len(find) = 0 THEN 'empty-find'
       WHEN op = 'affix' AND len(prefix) = 0 THEN 'empty-affix' END AS error
FROM (SELECT doc_id, ['replace', 'case', 'affix', 'zap'][doc_id % 4 + 1] AS op, CASE WHEN doc_id % 8 = 0 THEN '' ELSE lang END AS find, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END AS prefix FROM documents)""",
)
def p04(spark, sf_dir):
    d = F.col("doc_id")
    op = F.element_at(F.array(*map(F.lit, ("replace", "case", "affix", "zap"))), (d % 4 + 1).cast("int"))
    find, prefix = F.when(d % 8 == 0, "").otherwise(F.col("lang")), F.when(d % 3 == 0, "").otherwise("x")
    return table(spark, sf_dir, "documents").select("doc_id", paragraphs.edit_errors(op, find, F.lit(False), prefix, F.lit("")).alias("error"))


@query("p06_changed_only", f"WITH {D_SQL} SELECT doc_id, para_idx, {trim_sql('text')} AS new_text FROM d WHERE len(text) > 0 AND {trim_sql('text')} <> text")
def p06(spark, sf_dir):
    return paragraphs.changed_only(paragraphs.transformed(defects(spark, sf_dir), T.trim_ends)).select("doc_id", "para_idx", "new_text")
