"""Structural edits, batches and edit logs over all paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import editlog, edits
from leafmill.plans.base import P_SQL, paras, query, table


def _p(spark, sf_dir):
    return paras(spark, sf_dir).drop("lang")


@query(
    "x01_split",
    f"""WITH {P_SQL}, r AS (SELECT doc_id, para_idx, 0 AS k, CASE WHEN para_idx = 1 THEN text[:10] ELSE text END AS text FROM p UNION ALL SELECT doc_id, para_idx, 1, text[11:] FROM p WHERE para_idx = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1)::INTEGER AS para_idx, text FROM r""",
)
def x01(spark, sf_dir):
    """Each document's second paragraph split after ten characters."""
    p = _p(spark, sf_dir)
    cut = p.filter("para_idx = 1").select("doc_id", "para_idx", F.left("text", F.lit(10)).alias("before"), F.substr(F.col("text"), F.lit(11)).alias("after"))
    return edits.split_paragraphs(p, cut)


@query(
    "x02_merge",
    f"""WITH {P_SQL}, b AS (SELECT *, sum(CASE WHEN para_idx % 3 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS block FROM p)
SELECT doc_id, block::INTEGER AS para_idx, string_agg(text, '' ORDER BY para_idx) AS text, CASE WHEN count(*) > 1 THEN len(arg_min(text, para_idx))::INTEGER END AS join_at FROM b GROUP BY doc_id, block""",
)
def x02(spark, sf_dir):
    """Paragraphs 1, 4, 7, ... joined to the ones before."""
    p = _p(spark, sf_dir)
    return edits.merge_paragraphs(p, p.filter("para_idx % 3 = 1").select("doc_id", "para_idx"))


@query("x02_split_then_merge", f"WITH {P_SQL} SELECT doc_id, para_idx, text FROM p")
def x02_identity(spark, sf_dir):
    """Splitting and merging again leaves every document as it was."""
    p = _p(spark, sf_dir)
    cut = p.filter("para_idx = 1").select("doc_id", "para_idx", F.left("text", F.lit(10)).alias("before"), F.substr(F.col("text"), F.lit(11)).alias("after"))
    again = edits.merge_paragraphs(edits.split_paragraphs(p, cut), cut.select("doc_id", F.lit(2).alias("para_idx")))
    return again.drop("join_at")


@query("x03_list_level", f"WITH {P_SQL}, l AS (SELECT doc_id, para_idx, para_idx % 10 - 1 AS lvl FROM p) SELECT doc_id, para_idx, CASE WHEN lvl >= 0 THEN least(8, lvl + 2) ELSE lvl END AS list_level, lvl >= 0 AND lvl < 8 AS changed FROM l")
def x03(spark, sf_dir):
    p = _p(spark, sf_dir).select("doc_id", "para_idx", (F.col("para_idx") % 10 - 1).cast("int").alias("list_level"))
    return edits.change_list_level(p, p.select("doc_id", "para_idx", F.lit(2).alias("delta")))


@query("x04_paragraph_batch", f"WITH {P_SQL} SELECT doc_id, para_idx, CASE WHEN para_idx % 2 = 0 THEN lang || '!' ELSE text END AS text, para_idx % 2 = 0 AND lang || '!' <> text AS changed FROM p")
def x04(spark, sf_dir):
    """New texts by position (also J4); positions beyond a document's end do nothing."""
    p = paras(spark, sf_dir)
    new = F.concat("lang", F.lit("!\x01"))
    items = p.filter("para_idx % 2 = 0").select("doc_id", "para_idx", new.alias("text")).unionByName(table(spark, sf_dir, "documents").select("doc_id", F.lit(100_000).alias("para_idx"), F.lit("nowhere").alias("text")))
    return edits.apply_batch(p.drop("lang"), items)


@query("a06_change_counts", f"WITH {P_SQL} SELECT doc_id, count(*) FILTER (upper(replace(text, 'the', 'a')) <> text) AS n_changed, count(*) AS n_paragraphs FROM p GROUP BY doc_id")
def a06(spark, sf_dir):
    """A uniform log of two edits as one chain, and how much it changes."""
    from leafmill.operators.paragraphs import change_counts

    log = [{"op": "replace", "find": "the", "replace": "a"}, {"op": "case", "mode": "upper"}]
    return change_counts(edits.apply_uniform(_p(spark, sf_dir), log), "doc_id")


@query("u01_append_edits", "SELECT doc_id, seq::INTEGER AS seq, op FROM (SELECT doc_id, doc_id % 3 AS seq, 'case' AS op FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 + 1 ELSE 0 END, 'paragraphBatch' FROM documents)")
def u01(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pending = d.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("seq"), F.lit("case").alias("op"))
    return edits.appended(pending, d.select("doc_id", F.lit(0).alias("seq"), F.lit("paragraphBatch").alias("op")))


@query(
    "x05_replay",
    f"""WITH {P_SQL}, a AS (SELECT doc_id, para_idx, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text,
        CASE WHEN doc_id % 2 = 0 THEN len(text) - len(replace(text, 'e', '')) ELSE 0 END AS n, max(para_idx) OVER (PARTITION BY doc_id) AS last FROM p),
b AS (SELECT doc_id, para_idx, 0 AS k, CASE WHEN para_idx = 0 THEN 'HEAD' ELSE text END AS text, n FROM a UNION ALL SELECT doc_id, para_idx, 1, 'TAIL', 0 FROM a WHERE para_idx = 0),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1 AS i, text, n FROM b),
m AS (SELECT doc_id, i - CASE WHEN i >= 2 THEN 1 ELSE 0 END AS i, i AS o, text, n FROM c)
SELECT doc_id, i::INTEGER AS para_idx, string_agg(text, '' ORDER BY o) AS text, (sum(sum(n)) OVER (PARTITION BY doc_id) + 1 + CASE WHEN count(*) OVER (PARTITION BY doc_id) > 2 OR max(max(o)) OVER (PARTITION BY doc_id) >= 2 THEN 1 ELSE 0 END)::BIGINT AS n_changes
FROM m GROUP BY doc_id, i""",
)
def x05(spark, sf_dir):
    """Per-document logs: a replacement in every other document, a split of paragraph 0, then a merge of paragraph 2."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    params = lambda **p: F.create_map(*(F.lit(x) for kv in p.items() for x in kv))
    rows = [
        d.filter("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("op"), params(find="e", replace="E").alias("params")),
        d.select("doc_id", F.lit(1).alias("seq"), F.lit("split").alias("op"), params(index="0", before="HEAD", after="TAIL").alias("params")),
        d.select("doc_id", F.lit(2).alias("seq"), F.lit("merge").alias("op"), params(index="2").alias("params")),
    ]
    log = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("items", F.lit(None).cast("array<struct<index:int,text:string>>"))
    return edits.replay(_p(spark, sf_dir), log)


# --- a mixed log of every operation ----------------------------------------------------------------------------

#: The log of every document, by seq: op, params, items, values.
MIXED_LOG = [
    (None, {"find": ", ", "replace": " {{who}} !sig, "}, None, None),
    ("placeholderFill", {}, None, {"who": "W {{ too }}", "too": "$1 \\", "none": ""}),
    ("snippetExpand", {"scope": "all"}, None, {"si": "no", "sig": "S{day}!si", "zz": "z"}),
    ("splitParagraph", {"index": "0", "before": "HEAD\nLINE", "after": "TAIL"}, None, None),
    ("mergeParagraph", {"index": "2"}, None, None),
    ("paragraphBatch", {}, [(1, "new one"), (1, "new two"), (100_000, "x")], None),
    ("listLevel", {"index": "3", "delta": "8"}, None, None),
    ("paint", {}, None, None),
    ("replace", {"find": "(", "regex": "true", "replace": "x"}, None, None),
    ("replace", {"find": ""}, None, None),
    ("case", {"mode": "lower", "scope": "body"}, None, None),
    ("affix", {"prefix": "<", "suffix": ">"}, None, None),
    ("trim", {"mode": "collapse"}, None, None),
    ("replace", {"find": "e", "replace": "E", "skip": "2", "max": "3"}, None, None),
]


def mixed_log(spark, sf_dir, **want):
    """The mixed log on all paragraphs, whose levels and parts follow from their numbers; ``want``: see ``run_log``."""
    level, part = (F.col("para_idx") % 10 - 1).cast("int"), F.when(F.col("para_idx") % 4 == 3, "other").otherwise("body")
    p = _p(spark, sf_dir).withColumns({"list_level": level, "part": part})
    edit = lambda i, op, params, items, values: F.struct(F.lit(i).alias("seq"), *(_literal(v, editlog.EDIT[c]).alias(c) for c, v in {"op": op, "params": params, "items": items, "values": values}.items()))
    log = F.array(*(edit(i, *e) for i, e in enumerate(MIXED_LOG)))
    return editlog.run_log(p, table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.inline(log)), **want)


def _literal(x, kind: str):
    if isinstance(x, dict):
        x = F.create_map(*(F.lit(v) for kv in x.items() for v in kv)) if x else F.create_map()
    elif isinstance(x, list):
        x = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(t).alias("text")) for i, t in x))
    else:
        x = F.lit(x)
    return x.cast(kind)


MIXED_SQL = f"""{P_SQL},
a AS (SELECT doc_id, para_idx AS i, text, count(*) OVER (PARTITION BY doc_id) AS c, (len(text) - len(replace(text, ', ', ''))) // 2 AS n0, replace(text, ', ', ' {{{{who}}}} !sig, ') AS t FROM p),
b AS (SELECT * REPLACE (replace(replace(t, '{{{{who}}}}', 'W {{{{ too }}}}'), '{{{{ too }}}}', '$1 \\') AS t), len(regexp_extract_all(t, '\\{{\\{{who\\}}\\}}')) * 2 AS n1 FROM a),
s AS (SELECT * REPLACE (regexp_replace(t, '!sig\\b', 'S{{day}}!si', 'g') AS t), len(regexp_extract_all(t, '!sig\\b')) AS n2 FROM b),
e AS (SELECT * REPLACE (regexp_replace(t, '!si\\b', 'no', 'g') AS t), n2 + len(regexp_extract_all(t, '!si\\b')) AS n2x FROM s),
m AS (
  SELECT doc_id, i, c, n0, n1, n2x AS n2, CASE i WHEN 0 THEN 'HEAD' || chr(10) || 'LINE' WHEN 1 THEN 'new two' ELSE t END AS t FROM e
  UNION ALL SELECT doc_id, 1, c, 0, 0, 0, 'new two' FROM e WHERE c = 1),
l AS (SELECT *, CASE WHEN i < 2 THEN -1 WHEN i = 3 THEN 8 ELSE i % 10 - 1 END AS list_level, CASE WHEN i % 4 = 3 THEN 'other' ELSE 'body' END AS part FROM m),
x10 AS (SELECT * REPLACE (CASE WHEN part = 'body' THEN lower(t) ELSE t END AS t), part = 'body' AND lower(t) <> t AS n10 FROM l),
x11 AS (SELECT * REPLACE (CASE WHEN t <> '' THEN '<' || t || '>' ELSE t END AS t), t <> '' AS n11 FROM x10),
x12 AS (SELECT * REPLACE (trim(regexp_replace(t, '[\\s\\x{{0B}}\\x{{A0}}]+', ' ', 'g')) AS t), trim(regexp_replace(t, '[\\s\\x{{0B}}\\x{{A0}}]+', ' ', 'g')) <> t AS n12 FROM x11),
y AS (SELECT *, string_split(t, 'e') AS w, coalesce(sum(len(t) - len(replace(t, 'e', ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM x12),
z AS (SELECT *, array_to_string(list_transform(w, lambda v, j: v || CASE WHEN j = len(w) THEN '' WHEN k + j > 2 AND k + j <= 5 THEN 'E' ELSE 'e' END), '') AS new_text FROM y),
n AS (
  SELECT doc_id, max(c) AS c, sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2, count_if(n10) AS n10, count_if(n11) AS n11, count_if(n12) AS n12, greatest(0, least(3, sum(len(w) - 1) - 2)) AS n13 FROM z GROUP BY doc_id)"""


@query(
    "x05_mixed_log",
    f"WITH {MIXED_SQL} SELECT z.doc_id, z.i::INTEGER AS para_idx, z.new_text AS text, z.list_level::INTEGER AS list_level, z.part, (n.n0 + n.n1 + n.n2 + 1 + CASE WHEN n.c > 1 THEN 1 ELSE 0 END + 2 + CASE WHEN n.c > 3 THEN 1 ELSE 0 END + n.n10 + n.n11 + n.n12 + n.n13)::BIGINT AS n_changes FROM z JOIN n USING (doc_id)",
)
def x05_mixed(spark, sf_dir):
    """Every operation in one log, with errors among them, on all documents."""
    return editlog.edited(mixed_log(spark, sf_dir, nodes=False, told=False)).drop("nodes")


@query(
    "x05_log_report",
    f"""WITH {MIXED_SQL}
SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13])::INTEGER AS seq,
  unnest(['replace', 'placeholderFill', 'snippetExpand', 'splitParagraph', 'mergeParagraph', 'paragraphBatch', 'listLevel', 'paint', 'replace', 'replace', 'case', 'affix', 'trim', 'replace']) AS op,
  unnest([n0, n1, n2, 1, CASE WHEN c > 1 THEN 1 ELSE 0 END, 2, CASE WHEN c > 3 THEN 1 ELSE 0 END, 0, 0, 0, n10, n11, n12, n13])::BIGINT AS n_changes,
  unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unknown-op', 'bad-regex', 'empty-find', NULL, NULL, NULL, NULL]) AS error FROM n""",
)
def x05_report(spark, sf_dir):
    """What each edit of the mixed log changed, and the errors."""
    return editlog.report(mixed_log(spark, sf_dir, texts=False))
