"""Typography rules over the paragraphs with defects: a scan and a fix query for each rule, and the corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import lint
from leafmill.functions.patterns import WS
from leafmill.operators import linting
from leafmill.plans.base import D_SQL, defects, hits_sql, query

#: Rule: (name, pattern for the SQL engine, hit's start, hit's before, hit's after, fixed text). The engine has no
#: lookaround, but its word boundary is ASCII, as wanted.
_WB = r"\b"
_CASES = {
    "double-space": ("g01_double_space", lint.DOUBLE_SPACE, "s", "m", "' '", "regexp_replace(text, ' {2,}', ' ', 'g')"),
    "space-before-punct": ("g02_space_before_punct", lint.SPACE_BEFORE, "s", "m", "m[-1]", rf"regexp_replace(text, '{lint.SPACE_BEFORE}', '\1', 'g')"),
    "ellipsis": ("g03_ellipsis", lint.ELLIPSIS, "s", "m", "'…'", rf"regexp_replace(text, '{lint.ELLIPSIS}', '…', 'g')"),
    "quotes-pl": ("g04_quotes_pl", lint.QUOTES, "s", "m", "'„' || m[2:]", rf"""regexp_replace(text, '{lint.QUOTES}', '„\1"', 'g')"""),
    "cap-after-period": ("g05_cap_after_period", lint.CAPITAL, "(s + len(m) - 1)::INTEGER", "m[-1]", "upper(m[-1])", None),
    "orphan-i": ("g06_orphan_i", lint.ORPHAN, "s", "m", rf"regexp_replace(m, '{lint.ORPHAN}', '\2 \1.')", rf"regexp_replace(text, '{lint.ORPHAN}', '\2 \1.')"),
    "nbsp-pl": ("g07_nbsp_pl", rf"(?i)\b([wzioua]){WS}+", "s", "m", "m[1] || chr(160)", rf"regexp_replace(text, '(?i)\b([wzioua]){WS}+', '\1' || chr(160), 'g')"),
}
_CAP_FIX = f"""array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{lint.CAPITAL}'), list_append(list_transform(regexp_extract_all(text, '{lint.CAPITAL}'), lambda m: m[:-2] || upper(m[-1])), '')),
  lambda z: z[1] || z[2]), '')"""


def _hits_sql(rule: str, extra: str = "") -> str:
    _, pattern, start, before, after, _ = _CASES[rule]
    return f"SELECT doc_id, para_idx, '{rule}' AS rule_id, ord, {start} AS start, (s + len(m))::INTEGER AS \"end\", {before} AS before, {after} AS after{extra} FROM {hits_sql('d', pattern)}"


def _scan(rule: str):
    def run(spark, sf_dir):
        hits = linting.scan(defects(spark, sf_dir).drop("lang"), lint.enabled("pl", [rule], nbsp=True), details=False)
        return hits.drop("hit_id")

    return run


def _fix(rule: str):
    def run(spark, sf_dir):
        return linting.fix(defects(spark, sf_dir), lint.enabled("pl", [rule], nbsp=True)).select("doc_id", "para_idx", "new_text")

    return run


for _rule, (_name, *_rest, _fixed) in _CASES.items():
    query(f"{_name}_scan", f"WITH {D_SQL} {_hits_sql(_rule)}")(_scan(_rule))
    _new = _fixed or _CAP_FIX
    query(f"{_name}_fix", f"WITH {D_SQL} SELECT doc_id, para_idx, new_text FROM (SELECT doc_id, para_idx, text, {_new} AS new_text FROM d) WHERE new_text <> text")(_fix(_rule))

_PL = [r.id for r in lint.enabled("pl")]
ALL_HITS = f"WITH {D_SQL}, h AS (" + " UNION ALL ".join(_hits_sql(r) for r in _PL) + ")"


def _chain(rules: list[str]) -> str:
    """Fixes one after another, each in a subquery of its own."""
    inner = "SELECT doc_id, para_idx, text AS old_text, text FROM d"
    for r in rules:
        inner = f"SELECT doc_id, para_idx, old_text, {_CASES[r][5] or _CAP_FIX} AS text FROM ({inner})"
    return inner


@query("g08_fix_pipeline", f"WITH {D_SQL} SELECT doc_id, para_idx, text AS new_text FROM ({_chain([*_PL, 'nbsp-pl'])}) WHERE text <> old_text")
def g08(spark, sf_dir):
    return linting.fix(defects(spark, sf_dir), lint.enabled("pl", nbsp=True)).select("doc_id", "para_idx", "new_text")


@query("g10_scan_corpus", f"{ALL_HITS} SELECT doc_id, para_idx, rule_id, ord, start, \"end\", before, after, rule_id || '-' || para_idx || '-' || ord || '-' || start AS hit_id FROM h")
def g10(spark, sf_dir):
    """All Polish rules at once, with the hits' stable ids."""
    return linting.scan(defects(spark, sf_dir).drop("lang"), lint.enabled("pl"), details=False)


@query("g10_scan_by_row_language", f"{ALL_HITS} SELECT d.lang, rule_id, count(*) AS n FROM h JOIN d USING (doc_id, para_idx) WHERE d.lang = 'en' AND rule_id NOT IN ('quotes-pl', 'orphan-i') GROUP BY ALL")
def g10_lang(spark, sf_dir):
    """Each paragraph by the rules of its own language; languages without rules have no hits."""
    counted = linting.counts(defects(spark, sf_dir), lint.enabled(None), F.col("lang"))
    return counted.groupBy("lang", "rule_id").agg(F.sum("n").alias("n"))


@query("a03_hits_by_rule", f"{ALL_HITS} SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY rule_id")
def a03(spark, sf_dir):
    return linting.by_rule(linting.counts(defects(spark, sf_dir), lint.enabled("pl")))


@query("a03_hits_rollup", f"{ALL_HITS} SELECT doc_id, rule_id, count(*) AS n FROM h GROUP BY ROLLUP (doc_id, rule_id)")
def a03_rollup(spark, sf_dir):
    return linting.by_document_and_rule(linting.counts(defects(spark, sf_dir), lint.enabled("pl")))


@query("g11_fix_batch", f"{ALL_HITS}, f AS ({_chain(['ellipsis'])}) SELECT doc_id, para_idx, text AS new_text FROM f SEMI JOIN h USING (doc_id, para_idx) WHERE text <> old_text")
def g11(spark, sf_dir):
    """One rule's fixes on paragraphs that have any hit."""
    rules = lint.enabled("pl")
    only = [r for r in rules if r.id == "ellipsis"]
    return linting.fix(defects(spark, sf_dir), only, only_hit=True, on=rules).select("doc_id", "para_idx", "new_text")


@query("g12_apply_one_hit", f"{ALL_HITS}, one AS (SELECT * FROM h WHERE rule_id = 'double-space' AND ord = 1) SELECT doc_id, para_idx, text[:start] || after || text[\"end\" + 1:] AS new_text FROM d JOIN one USING (doc_id, para_idx)")
def g12(spark, sf_dir):
    d = defects(spark, sf_dir)
    chosen = linting.scan(d, lint.enabled("pl", ["double-space"]), details=False).filter("ord = 1")
    return linting.apply_hits(d, chosen).select("doc_id", "para_idx", "new_text")


@query("j06_paragraphs_with_hits", f"{ALL_HITS} SELECT DISTINCT doc_id, para_idx FROM h")
def j06(spark, sf_dir):
    """Paragraphs that have hits (also the set U4)."""
    return linting.with_hits(defects(spark, sf_dir), lint.enabled("pl")).select("doc_id", "para_idx")


@query("j07_rules_by_language", f"WITH {D_SQL} SELECT lang, count(*) AS n_paragraphs, (count(*) * CASE lang WHEN 'en' THEN 4 WHEN 'pl' THEN 7 ELSE 0 END)::BIGINT AS n_checks FROM d GROUP BY lang")
def j07(spark, sf_dir):
    """How many rule checks each language's paragraphs need: paragraphs joined to the rules of their language."""
    rules = spark.createDataFrame([(lang, r.id) for r in lint.RULES for lang in r.langs], "rule_lang string, rule_id string")
    d = defects(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_paragraphs"))
    both = d.join(rules, d["lang"] == rules["rule_lang"], "left").groupBy("lang", "n_paragraphs").agg(F.count("rule_id").alias("n_rules"))
    return both.select("lang", "n_paragraphs", (F.col("n_paragraphs") * F.col("n_rules")).alias("n_checks"))


