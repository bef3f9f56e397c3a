"""Quality rules with adaptive thresholds.

Fixed cut-offs are replaced by fences around the quartiles of each language and source: a document fails if a measure
lies further outside the middle half than ``FENCE`` times its width plus a slack in the measure's own unit. The
quartiles come from mergeable sketches (``percentile_approx``): every task sketches its own rows, so a language or
source that holds a third of the corpus is no hot key. The fences are joined back on (lang, source).

The sketch's rank error is 1 / ``ACCURACY``, so its quartiles are those of the group exactly while a group has fewer rows
than that, and may be off by that share of the rows in larger ones.

Defined cases: null text has no words and fails the base rules; null lang or source is a group of its own; repeated
rows give repeated results and count as often as they occur; a measure that equals its fence passes; texts are counted
whole, however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import LEAD, SPACE, buffers, cut, mix, per_doc, prefix_sums, runs, spans_hash, sums_by_doc, table, windows_hash, word_spans

FENCE = 6.0
ACCURACY = 10_000
#: Measure: (expression, slack). Upper fences; mean_word also has a lower one.
MEASURES = {
    "mean_word": ("word_chars / nullif(n_words, 0)", 1.0),
    "symbols": ("n_symbols / nullif(n_words, 0)", 0.1),
    "dup_lines": ("n_dup_lines / n_lines", 0.4),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", 0.25),
    "uppers": ("n_uppers / nullif(word_chars, 0)", 0.15),
    "marks": ("n_marks / nullif(n_words, 0)", 0.3),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_uppers", "n_marks"]

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_SALT = np.uint64(0xA0761D6478BD642F)


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which items occur twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        e = s[1:] == s[:-1]
        same[1:] |= e
        same[:-1] |= e
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def count_measures(buf: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    n = len(off) - 1
    sums = prefix_sums(buf)
    start, end, doc = word_spans(buf, off)
    salt = (doc.astype(np.uint64) + np.uint64(1)) * _SALT
    # windows of words that lie within one document
    covered = np.zeros(len(doc) + 1, np.int64)
    if len(doc) >= window:
        inside = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
        h = windows_hash(spans_hash(sums, start, end), window)[inside]
        again = inside[_repeated(mix(h ^ salt[inside]))]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    covered = np.cumsum(covered)[: len(doc)] > 0
    # lines
    feed = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([off[:-1], feed + 1]), kind="stable")
    line_end = np.sort(np.concatenate([off[1:], feed]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(off, feed, side="right") - 1]), kind="stable")
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    d = line_doc[worded]
    key = mix(spans_hash(sums, line_start[worded], line_end[worded]) ^ ((d.astype(np.uint64) + np.uint64(1)) * _SALT))
    _, first = np.unique(key, return_index=True)
    return {
        "n_words": per_doc(doc, n),
        "word_chars": sums_by_doc(LEAD[buf] & ~SPACE[buf], off),
        "n_symbols": sums_by_doc(_SYMBOL[buf], off),
        "n_dup_lines": per_doc(d, n) - per_doc(d[first], n),
        "n_repeat_words": per_doc(doc[covered], n),
        "n_lines": per_doc(line_doc, n),
        "n_uppers": sums_by_doc(_UPPER[buf], off),
        "n_marks": sums_by_doc(_MARK[buf], off),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in runs(whole):
            got = count_measures(*buffers(batch.column("text")))
            cols = [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(got[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", *COUNTS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of the fences that a document broke."""
    measured = docs.select(F.col("doc_id").cast("bigint"), "lang", "source", "text").mapInArrow(_measure, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    measured = cut(measured.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")), "measures")
    values = measured.select("*", *(F.expr(e).alias(m) for m, (e, _) in MEASURES.items()))
    fences = (
        values.filter(~F.col("base_failed"))
        .groupBy(F.col("lang").alias("l0"), F.col("source").alias("s0"))
        .agg(*(F.percentile_approx(m, [0.25, 0.75], ACCURACY).alias(f"q_{m}") for m in MEASURES))
    )
    judged = values.join(fences, F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
    broken = []
    for m, (_, slack) in MEASURES.items():
        low, high = F.col(f"q_{m}")[0], F.col(f"q_{m}")[1]
        out = F.col(m) > high + F.lit(FENCE) * (high - low) + F.lit(slack)
        if m == "mean_word":
            out = out | (F.col(m) < low - F.lit(FENCE) * (high - low) - F.lit(slack))
        broken.append(F.when(out, F.lit(m)))
    judged = judged.withColumn("broken", F.concat_ws(",", *broken))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c
  FROM (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8))),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM win, (SELECT unnest(range(0, 8)) AS j) WHERE c > 1 GROUP BY r),
dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (len(t) - len(regexp_replace(t, '[#*$%%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_uppers,
         len(t) - len(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g')) AS n_marks
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
v AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, word_chars / nullif(n_words, 0)::DOUBLE AS mean_word,
         n_symbols / nullif(n_words, 0)::DOUBLE AS symbols, n_dup_lines / n_lines::DOUBLE AS dup_lines, n_repeat_words / nullif(n_words, 0)::DOUBLE AS repeats,
         n_uppers / nullif(word_chars, 0)::DOUBLE AS uppers, n_marks / nullif(n_words, 0)::DOUBLE AS marks FROM m),
f AS (
  SELECT lang, source, %s FROM v WHERE NOT base_failed GROUP BY lang, source),
j AS (
  SELECT v.*, concat_ws(',', %s) AS broken
  FROM v LEFT JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM j
""" % (
    ", ".join(f"quantile_disc({m}, 0.25) AS lo_{m}, quantile_disc({m}, 0.75) AS hi_{m}" for m in MEASURES),
    ", ".join(
        f"CASE WHEN {m} > hi_{m} + {FENCE}::DOUBLE * (hi_{m} - lo_{m}) + {s}::DOUBLE" + (f" OR {m} < lo_{m} - {FENCE}::DOUBLE * (hi_{m} - lo_{m}) - {s}::DOUBLE" if m == "mean_word" else "") + f" THEN '{m}' END"
        for m, (_, s) in MEASURES.items()
    ),
)
