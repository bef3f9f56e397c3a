"""Templates, snippets, mail merge and search over the customers' templates and all paragraphs."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import tokens as K
from leafmill.operators import search, search_index, templates
from leafmill.plans.base import P_SQL, T_SQL, hits_sql, paras, query, table
from leafmill.plans.base import templates as customer_templates
from leafmill.storage import shared_folder

AS_OF = datetime(2026, 6, 30, 14, 5)
_PLACE = r"\{\{\s*([a-zA-Z0-9_.-]+)\s*\}\}"
_TRIG = r"!([a-zA-Z][a-zA-Z0-9_-]*)\b"


def _c():
    return F.col("text")


def library(spark, sf_dir):
    """A snippet library from the nations: n0, n1, ... for even keys, and two fixed names."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    rows = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("from "), F.col("n_name"), F.lit(" {{c_name}}")).alias("body"), F.col("n_nationkey").cast("bigint").alias("updated_at"))
    fixed = spark.createDataFrame([("closing", "Yours, {cursor}!sig", 1), ("sig", "S$1", 1)], "name string, body string, updated_at bigint")
    return rows.unionByName(fixed)


L_SQL = """
lib AS (
  SELECT 'n' || n_nationkey AS name, 'from ' || n_name || ' {{c_name}}' AS body, n_nationkey::BIGINT AS updated_at FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL VALUES ('closing', 'Yours, {cursor}!sig', 1::BIGINT), ('sig', 'S$1', 1::BIGINT))"""
_TOKENS = "SELECT doc_id, para_idx, '{kind}' AS kind, regexp_extract(m, '{p}', 1) AS name, m AS token, s AS start, (s + len(m))::INTEGER AS \"end\" FROM {hits}"
_FIELDS = "WITH " + T_SQL + ", k AS (" + _TOKENS.format(kind="placeholder", p=_PLACE, hits=hits_sql("t", _PLACE)) + ")"
_TRIGGERS = "WITH " + T_SQL + "," + L_SQL + ", k AS (" + _TOKENS.format(kind="snippet", p=_TRIG, hits=hits_sql("t", _TRIG)) + ")"
_SAMPLES = "array_to_string(list_transform(list_sort(list((para_idx, start, token)))[:4], lambda x: x[1] || ':' || x[2] || ':' || x[3]), ' ')"


def _flat(samples: str = "samples"):
    return F.array_join(F.transform(samples, lambda x: F.concat_ws(":", x["para_idx"], x["start"], x["token"])), " ")


@query("k01_scan_placeholders", f"{_FIELDS} SELECT * FROM k")
def k01(spark, sf_dir):
    return templates.token_rows(customer_templates(spark, sf_dir), K.placeholder_hits(_c()))


@query("k02_scan_triggers", f"{_TRIGGERS} SELECT * FROM k")
def k02(spark, sf_dir):
    return templates.token_rows(customer_templates(spark, sf_dir), K.trigger_hits(_c()))


@query(
    "k03_names",
    r"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE replace(c_name, '#', '.') END AS placeholder, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE replace(c_name, '#', '_') END AS snippet,
       '{{' || c_name || '}}' AS token, '!' || c_name AS trigger, translate(replace(c_name, '#', '_'), '_-', '  ') AS label FROM customer""",
)
def k03(spark, sf_dir):
    """Normalised and formatted names (K3, K4)."""
    n, bad = F.col("c_name"), F.col("c_custkey") % 5 == 4
    place = F.concat(F.lit(" {{ "), F.replace(n, F.lit("#"), F.lit(".")), F.when(bad, "?").otherwise(""), F.lit(" }} "))
    snip = F.concat(F.lit(" !!"), F.replace(n, F.lit("#"), F.lit("_")), F.when(bad, " x").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", K.placeholder_name(place).alias("placeholder"), K.snippet_name(snip).alias("snippet"), K.placeholder_token(n).alias("token"), K.snippet_trigger(n).alias("trigger"), K.field_label(F.replace(n, F.lit("#"), F.lit("_"))).alias("label"))


@query("k05_dynamic_bodies", "SELECT c_custkey, 'Dnia 30 cze 2026 o 14:05, wtorek ' || c_name || '; ' AS pl, '30 cze 2026 14:05 ' || c_name AS both FROM customer")
def k05(spark, sf_dir):
    n = F.col("c_name")
    body, both = F.concat(F.lit("Dnia {date} o {TIME}, {day} "), n, F.lit("; {cursor}")), F.concat(F.lit("{datetime} "), n)
    return table(spark, sf_dir, "customer").select("c_custkey", K.resolve_body(body, AS_OF, "pl").alias("pl"), K.resolve_body(both, AS_OF, "pl").alias("both"))


@query("k05_english_bodies", "SELECT c_custkey, 'On Jun 30, 2026 at 2:05 PM, Tuesday, ' || c_name AS body, c_name || ': Jun 30, 2026 2:05 PM' AS both FROM customer")
def k05_english(spark, sf_dir):
    n = F.col("c_name")
    body, both = F.concat(F.lit("On {date} at {Time}, {day}, "), n, F.lit("{cursor}")), F.concat(n, F.lit(": {DateTime}"))
    return table(spark, sf_dir, "customer").select("c_custkey", K.resolve_body(body, AS_OF, "en").alias("body"), K.resolve_body(both, AS_OF, "en").alias("both"))


def _values():
    return F.create_map(F.lit("c_name"), F.when(F.col("doc_id") % 7 != 0, F.col("c_name")), F.lit("c_mktsegment"), F.concat(F.col("c_mktsegment"), F.lit(" $1 {{none}}")))


_FILL = "regexp_replace(replace(text, '{{c_name}}', CASE WHEN doc_id % 7 <> 0 THEN c_name ELSE '{{c_name}}' END), '\\{\\{\\s*c_mktsegment\\s*\\}\\}', c_mktsegment || ' $1 {{none}}')"


@query("k06_fill", f"WITH {T_SQL} SELECT doc_id, {_FILL} AS new_text, (1 + CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END)::INTEGER AS n_filled FROM t")
def k06(spark, sf_dir):
    f = K.fill(_c(), _values())
    return customer_templates(spark, sf_dir).select("doc_id", f["text"].alias("new_text"), f["n"].alias("n_filled"))


_BODIES = {"closing": "Yours, !sig", "sig": "S$1", "n1": "one", "n10": "ten"}


def _expanded(tail: str) -> str:
    """Names by length, then alphabet; a trigger's tail stays where it is."""
    out = "text"
    for name in sorted(_BODIES, key=lambda n: (-len(n), n)):
        out = f"regexp_replace({out}, '!{name}{tail}', '{_BODIES[name]}\\1', 'g')"
    return out


@query("k07_expand", f"WITH {T_SQL} SELECT doc_id, {_expanded('([^A-Za-z0-9_]|$)')} AS new_text FROM t")
def k07(spark, sf_dir):
    return customer_templates(spark, sf_dir).select("doc_id", K.expand(_c(), K.literal_map(_BODIES))["text"].alias("new_text"))


@query("k08_expand_auto", f"WITH {T_SQL} SELECT doc_id, {_expanded('([ .,;:!?)])')} AS new_text FROM t")
def k08(spark, sf_dir):
    """Only triggers that a delimiter follows."""
    return customer_templates(spark, sf_dir).select("doc_id", K.expand(_c(), K.literal_map(_BODIES), "auto")["text"].alias("new_text"))


@query("k09_field_summary", f"{_FIELDS} SELECT doc_id, name, count(*) AS n, {_SAMPLES} AS samples FROM k GROUP BY doc_id, name")
def k09(spark, sf_dir):
    """Also A4."""
    return templates.field_summary(customer_templates(spark, sf_dir)).withColumn("samples", _flat())


@query("k10_trigger_summary", f"{_TRIGGERS} SELECT doc_id, name, count(*) AS n, {_SAMPLES} AS samples, name IN (SELECT name FROM lib) AS has_definition FROM k GROUP BY doc_id, name")
def k10(spark, sf_dir):
    """Also A5 and J1."""
    return templates.trigger_summary(customer_templates(spark, sf_dir), library(spark, sf_dir)).withColumn("samples", _flat())


@query("j01_undefined_triggers", f"{_TRIGGERS} SELECT name, count(*) AS n FROM k WHERE name NOT IN (SELECT name FROM lib) GROUP BY name")
def j01(spark, sf_dir):
    return templates.undefined_triggers(customer_templates(spark, sf_dir), library(spark, sf_dir))


@query("j02_expand_map", f"{_TRIGGERS} SELECT doc_id, string_agg(name || '=' || body, '|' ORDER BY name) AS bodies FROM (SELECT DISTINCT doc_id, name FROM k) JOIN lib USING (name) GROUP BY doc_id")
def j02(spark, sf_dir):
    m = templates.expand_map(customer_templates(spark, sf_dir), library(spark, sf_dir))
    return m.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("bodies")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("bodies"))


@query("j03_mail_merge", "SELECT o_orderkey AS record_id, 'Order ' || o_orderkey || ' for ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' {{note}}' ELSE ' n' || o_custkey END || '.' AS new_text, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS n_filled FROM orders")
def j03(spark, sf_dir):
    """One template, one record per order; values are trimmed and empty ones stay open."""
    # one row of known size in one part, so no record is gathered again for an empty part of the templates
    template = spark.range(0, 1, 1, 1).select(F.lit("order").alias("template_id"), F.lit("Order {{key}} for {{cust}} {{note}}.").alias("text"))
    o = table(spark, sf_dir, "orders")
    note = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.concat(F.lit("n"), F.col("o_custkey").cast("string"), F.lit(" ")))
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("key", F.col("o_orderkey").cast("string")), ("cust", F.col("o_custkey").cast("string")), ("note", note))))
    values = templates.value_map(o.select(F.col("o_orderkey").alias("record_id"), F.explode(pairs).alias("p")).select("record_id", "p.*"))
    return templates.mail_merge(template, values.withColumn("template_id", F.lit("order"))).select("record_id", "new_text", "n_filled")


_OWN_SQL = "lib AS (SELECT 'c' || c_custkey AS name, c_name AS body, (c_custkey % 40)::BIGINT AS updated_at FROM customer)"


def customer_library(spark, sf_dir):
    """One snippet for each customer."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("name"), F.col("c_name").alias("body"), (key % 40).cast("bigint").alias("updated_at"))


@query("k11_upsert", f"WITH {_OWN_SQL}, new AS (SELECT 'c' || o_custkey AS name, 'order ' || o_orderkey AS body, 20::BIGINT AS updated_at FROM orders), u AS (SELECT *, 0 AS k FROM lib UNION ALL SELECT *, 1 FROM new) SELECT name, body, updated_at FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, k DESC, body) = 1")
def k11(spark, sf_dir):
    """Newest row by name."""
    o = table(spark, sf_dir, "orders")
    new = o.select(F.concat(F.lit("!c"), F.col("o_custkey").cast("string")).alias("name"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("body"), F.lit(20).cast("bigint").alias("updated_at"))
    return templates.upsert(customer_library(spark, sf_dir), new)


@query("u03_delete", f"WITH {_OWN_SQL} SELECT * FROM lib WHERE name NOT IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def u03(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.concat(F.lit("!c"), F.col("o_custkey").cast("string")).alias("name"))
    return templates.delete(customer_library(spark, sf_dir), gone)


@query("k12_expand_then_fill", f"WITH {T_SQL}, {L_SQL} SELECT doc_id, replace(regexp_replace(regexp_replace(text, '!n[0-9]+', coalesce((SELECT body FROM lib WHERE name = 'n' || c_nationkey), '!n' || c_nationkey)), '\\{{\\{{ c_mktsegment \\}}\\}}', c_mktsegment), '{{{{c_name}}}}', c_name) AS new_text FROM t")
def k12(spark, sf_dir):
    """Snippets by a join on what each template uses, then the placeholders that they bring in."""
    t = customer_templates(spark, sf_dir)
    own = library(spark, sf_dir).filter("name like 'n%'")
    maps = templates.expand_map(t, own)
    both = t.join(maps, "doc_id", "left").withColumn("bodies", F.coalesce("bodies", F.create_map().cast("map<string,string>")))
    out = templates.expand_and_fill(_c(), F.col("bodies"), F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), F.col("c_mktsegment")), AS_OF)
    return both.select("doc_id", out["text"].alias("new_text"))


@query("o01_polish_order", "SELECT (row_number() OVER (ORDER BY c_name COLLATE pl, c_name))::INTEGER AS place, c_name AS name FROM (SELECT DISTINCT c_name FROM customer)")
def o01(spark, sf_dir):
    """Names in Polish order, with their places, so the order survives the output."""
    return templates.ranked_names(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct())


@query("o02_by_length", "SELECT string_agg(turn, ' ' ORDER BY len(text) DESC, turn) AS turns, conv_id FROM conversations GROUP BY conv_id")
def o02(spark, sf_dir):
    """Turns of each conversation, longest first, stable."""
    c = table(spark, sf_dir, "conversations")
    order = F.array_sort(F.collect_list(F.struct((-F.length("text")).alias("l"), "turn")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(order, lambda x: x["turn"].cast("string")), " ").alias("turns"))


@query("t05_find_all", f"WITH {P_SQL}, h AS (SELECT doc_id, para_idx, s AS start, len(m)::INTEGER AS length, m AS sample FROM {hits_sql('p', '(?i)the')}) SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, start) - 1)::INTEGER AS match_no FROM h")
def t05(spark, sf_dir):
    return search.matches_of(paras(spark, sf_dir), "the")


#: A literal, alternatives, a class before mandatory letters, and a pattern of which nothing is mandatory.
_INDEXED = (("ation", False), ("(?:heit|keit)[a-z]*en", True), ("[bcd]er ", True), ("[xyz]", True))


def _indexed_sql() -> str:
    one = " UNION ALL ".join(f"SELECT {i} AS pattern, doc_id, para_idx, s AS start, m AS sample FROM {hits_sql('p', '(?i)' + find)}" for i, (find, _) in enumerate(_INDEXED))
    return f"WITH {P_SQL}, h AS ({one}) SELECT pattern, doc_id, para_idx, start, len(sample)::INTEGER AS length, sample, (row_number() OVER (PARTITION BY pattern, doc_id ORDER BY para_idx, start) - 1)::INTEGER AS match_no FROM h"


@query("t05_indexed_search", _indexed_sql())
def t05_indexed(spark, sf_dir):
    """Searches through an index of all paragraphs, which is built first."""
    index = search_index.build(paras(spark, sf_dir), f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", parts=16, buckets=16)
    found = [index.matches_of(find, regex).select(F.lit(i).alias("pattern"), "doc_id", "para_idx", "start", "length", "sample", "match_no") for i, (find, regex) in enumerate(_INDEXED)]
    return reduce(DataFrame.unionByName, found)


@query("a02_indexed_preview", f"WITH {P_SQL}, h AS (SELECT doc_id, para_idx, len(regexp_extract_all(text, '[a-z]+ment ')) AS n FROM p) SELECT doc_id, sum(n)::BIGINT AS hits, count(*) AS paragraphs FROM h WHERE n > 0 GROUP BY doc_id")
def a02_indexed(spark, sf_dir):
    """The preview of a replacement, of which only the paragraphs that the index names are read."""
    index = search_index.build(paras(spark, sf_dir), f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", parts=16, buckets=16)
    return index.preview("[a-z]+ment ", regex=True).select("doc_id", "hits", "paragraphs")


@query("w05_match_numbers", f"WITH {P_SQL}, h AS (SELECT doc_id, para_idx, s AS start FROM {hits_sql('p', '(?i)tion')}), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, start) - 1)::INTEGER AS match_no, count(*) OVER (PARTITION BY doc_id) AS total FROM h) SELECT *, match_no + 1 AS position, (match_no + total - 1) % total AS next_match FROM n")
def w05(spark, sf_dir):
    return search.numbered(search.matches_of(paras(spark, sf_dir), "tion", regex=True).drop("length", "sample"), step=-1)


#: Numbers, or the ends of words from two vowels on, before a comma or full stop.
_ENDS = "(?:[0-9]{2,}|[aeiou]{2}[a-z]+)[.,]"


@query("t05_regex_find_all", f"WITH {P_SQL}, h AS (SELECT doc_id, para_idx, s AS start, len(m)::INTEGER AS length, m AS sample FROM {hits_sql('p', '(?i)' + _ENDS)}) SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, start) - 1)::INTEGER AS match_no FROM h")
def t05_regex(spark, sf_dir):
    return search.matches_of(paras(spark, sf_dir), _ENDS, regex=True)


@query("p05_heading_search", f"WITH {P_SQL}, q AS (SELECT * FROM p WHERE len(text) < 120), h AS (SELECT doc_id, para_idx, s AS start, len(m)::INTEGER AS length, m AS sample FROM {hits_sql('q', '(?i)an')}) SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, start) - 1)::INTEGER AS match_no FROM h")
def p05(spark, sf_dir):
    p = paras(spark, sf_dir).withColumn("is_heading", F.length("text") < 120)
    return search.matches_of(p, "an", headings_only=True)


@query("a02_replace_preview", f"WITH {P_SQL}, n AS (SELECT doc_id, para_idx, text, (len(text) - len(replace(text, 'an', ''))) // 2 AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS k FROM n WHERE n > 0) SELECT doc_id, sum(n)::BIGINT AS hits, count(*) AS paragraphs, string_agg(para_idx || ':' || CASE WHEN len(text) > 72 THEN text[:69] || '…' ELSE text END, '|' ORDER BY para_idx) FILTER (k <= 8) AS samples FROM k GROUP BY doc_id")
def a02(spark, sf_dir):
    """Also W6 and O3: the first samples of each document."""
    out = search.preview(paras(spark, sf_dir), "an")
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x["para_idx"], x["text"])), "|"))


@query("a02_regex_preview", f"WITH {P_SQL}, n AS (SELECT doc_id, para_idx, text, len(regexp_extract_all(text, '{_ENDS}')) AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS k FROM n WHERE n > 0) SELECT doc_id, sum(n)::BIGINT AS hits, count(*) AS paragraphs, string_agg(para_idx || ':' || CASE WHEN len(text) > 72 THEN text[:69] || '…' ELSE text END, '|' ORDER BY para_idx) FILTER (k <= 8) AS samples FROM k GROUP BY doc_id")
def a02_regex(spark, sf_dir):
    out = search.preview(paras(spark, sf_dir), _ENDS, regex=True)
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x["para_idx"], x["text"])), "|"))


_KTH = f"""WITH {P_SQL}, h AS (SELECT doc_id, para_idx, ord, s, len(m) AS l FROM {hits_sql('p', 'the')}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, ord) AS k FROM h),
c AS (SELECT doc_id, para_idx, s, l, k BETWEEN 3 AND 5 AS due FROM n)
SELECT p.doc_id, p.para_idx, coalesce(x.t, p.text) AS new_text, coalesce(x.n, 0)::INTEGER AS n_replaced FROM p LEFT JOIN (
  SELECT c.doc_id, c.para_idx, count(*) FILTER (due) AS n,
         string_agg(p.text[coalesce(prev, 0) + 1:s] || CASE WHEN due THEN 'X$1' ELSE 'the' END, '' ORDER BY s) || any_value(p.text)[max(s + l) + 1:] AS t
  FROM (SELECT *, lag(s + l) OVER (PARTITION BY doc_id, para_idx ORDER BY s) AS prev FROM c) c JOIN p USING (doc_id, para_idx) GROUP BY c.doc_id, c.para_idx) x USING (doc_id, para_idx)"""


@query("w01_replace_kth", _KTH)
def w01(spark, sf_dir):
    """The third to fifth occurrence of each document."""
    out = search.replace_some(paras(spark, sf_dir), "the", "X$1", skip=2, most=3, order="para_idx")
    return out.select("doc_id", "para_idx", "new_text", "n_replaced")
