"""Many ranges of one paragraph against a version that works character by character."""

import random

from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.model import RUNS, STYLE
from leafmill.operators import ranges, styled

PROPS = (*R.FLAGS, *R.NAMES)
SAME = lambda s: tuple(v or (False if i < 3 else "") for i, v in enumerate(s))


def characters(runs):
    return [(None if brk else c, list(style or [None] * 6)) for brk, text, style in runs for c in ("\n" if brk else text or "")]


def joined(line):
    """Characters as runs of equal looks."""
    out = []
    for c, s in line:
        if c is not None and out and out[-1][0] is not None and SAME(out[-1][1]) == SAME(s):
            out[-1] = (out[-1][0] + c, out[-1][1])
        else:
            out.append((c, s))
    return [(c is None, c, SAME(s)) for c, s in out]


def usable(asked, n):
    for seq, start, end, what in sorted(asked, key=lambda x: x[0]):
        if start is not None and end is not None and max(start, 0) <= min(end, n) and start <= n:
            yield max(start, 0), min(end, n), what


def plain_restyle(runs, asked):
    line = characters(runs)
    for a, b, style in usable(asked, len(line)):
        for c, s in line[a:b]:
            if c is not None:
                s[:] = [v if v else s[i] for i, v in enumerate(style or [None] * 6)]
    return joined(line)


def plain_splice(runs, asked):
    line, cuts = characters(runs), list(usable(asked, len(characters(runs))))
    gone = {i for a, b, _ in cuts for i in range(a, b)}
    out = []
    for i in range(len(line) + 1):
        for a, _, text in cuts:
            if a == i:
                style = line[i - 1][1] if i else list(runs[0][2] or [None] * 6) if runs else [None] * 6
                out += [(c, style) for c in text or ""]
        if i < len(line) and i not in gone:
            out.append(line[i])
    return joined(out)


def test_random_ranges(spark):
    r = random.Random(4)
    style = lambda: r.choice([None, tuple(r.choice([None, True, False]) for _ in range(3)) + tuple(r.choice([None, "", "a", "b"]) for _ in range(3))])
    run = lambda: (True, None, style()) if r.random() < 0.15 else (r.choice([None, False]), r.choice([None, "", "é", "ab", "漢😀x", "word "]), style())
    paras = [("d", i, [run() for _ in range(r.randrange(0, 9))]) for i in range(400)]
    spot = lambda: r.choice([None, *range(-2, 16), 10**6])
    marks, cuts = [], []
    for d, i, _ in paras:
        for k in range(r.choice([0, 1, 2, 6])):
            marks.append((d, i, k, spot(), spot(), style()))
            cuts.append((d, i, k, spot(), spot(), r.choice([None, "", "N", "new\n"])))
    r.shuffle(marks)
    p = spark.createDataFrame([*paras, ("none", 0, None)], f"doc_id string, para_idx int, runs {RUNS}")
    key = "doc_id string, para_idx int, seq int, start int, end int, "
    for use, plain, asked, kind in ((ranges.restyled, plain_restyle, marks, f"new_style {STYLE}"), (ranges.respliced, plain_splice, cuts, "insert string")):
        got = {(x["doc_id"], x["para_idx"]): x["runs"] for x in use(p, spark.createDataFrame([*asked, ("gone", 1, 0, 0, 1, None), ("none", 0, 0, 0, 1, None)], key + kind)).collect()}
        assert got.pop(("none", 0)) is None and len(got) == len(paras)
        for d, i, runs in paras:
            own = [m[2:] for m in asked if m[1] == i]
            found = [(x["is_break"], x["text"], tuple(x["style"]) if x["style"] else (None,) * 6) for x in got[d, i]]
            if own:
                assert [(b, t, SAME(s)) for b, t, s in found] == plain(runs, own), (runs, own)
            else:
                assert found == [(b, t, s or (None,) * 6) for b, t, s in runs]


def test_two_ranges_do_not_multiply_runs(spark):
    r = spark.createDataFrame([("a", 0, 0, False, "hello world", (None,) * 6)], f"doc_id string, para_idx int, run_idx int, is_break boolean, text string, style {STYLE}")
    marks = spark.createDataFrame([("a", 0, 0, 3), ("a", 0, 2, 5)], "doc_id string, para_idx int, start int, end int").withColumn("new_style", R.style(bold=F.lit(True)))
    assert [x["text"] for x in styled.restyle(r, marks).orderBy("run_idx").collect()] == ["hello", " world"]
    cuts = spark.createDataFrame([("a", 0, 0, 3, "J"), ("a", 0, 2, 5, "-")], "doc_id string, para_idx int, start int, end int, insert string")
    assert [x["text"] for x in styled.splice(r, cuts).collect()] == ["J- world"]


def test_long_paragraph(spark):
    """A million runs and two thousand ranges in one paragraph."""
    p = spark.range(1).select(F.lit("a").alias("doc_id"), F.lit(0).alias("para_idx"), F.transform(F.sequence(F.lit(0), F.lit(999_999)), lambda i: F.struct(F.lit(False).alias("is_break"), F.lit("ab").alias("text"), R.style(bold=i % 2 == 0).alias("style"))).alias("runs"))
    marks = spark.range(2000).select(F.lit("a").alias("doc_id"), F.lit(0).alias("para_idx"), F.col("id").alias("seq"), (F.col("id") * 1000).cast("int").alias("start"), (F.col("id") * 1000 + 500).cast("int").alias("end"), R.style(bold=F.lit(True)).alias("new_style"))
    got = ranges.restyled(p, marks).select(F.size("runs").alias("n"), F.length(R.runs_text(F.col("runs"))).alias("c")).first()
    assert tuple(got) == (2000 * 250, 2_000_000)  # of 500 runs a thousand characters, 251 become one
