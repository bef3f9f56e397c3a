"""Run queries against their SQL on paragraphs that the given tables don't hold."""

import duckdb
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.model import RUNS, STYLE
from leafmill.operators import ranges, styled
from leafmill.plans.registry import QUERIES, SQL

ODD = ["ßa b c d e", "ŉ x", "ᾳ x", "ﬁne day", "ǆ x", "éa b", "x", "Ax", "", " a  b ", "one two three four five six seven eight nine ten", "漢字 b\tc", "a b c d <e> & f g h i"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Every odd paragraph at several places, a text without words and none at all."""
    rows = [(i, "\n".join(ODD[i:] + ODD[:i]), "de", "s", 1) for i in range(len(ODD))] + [(50, "", "de", "s", 0), (51, None, "de", "s", 0)]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


def check(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet'")
    assert rows_of(QUERIES[name](spark, odd).toPandas()) == rows_of(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["j05_paragraph_diff", "w02_merge_runs", "s03_docx_runs", "j09_offsets_to_runs", "r06_runs_to_text", "r08_restyle_range", "r08_many_ranges", "r09_splice_range", "r09_many_ranges"])
def test_odd_paragraphs(name, spark, odd):
    check(spark, odd, name)


def test_ranges_in_parts_and_once(spark, monkeypatch):
    """What a task holds at once does not follow from Spark's batches; runs without a style, and no runs, stay as they were."""
    seen = []
    real = ranges.swept
    monkeypatch.setattr(ranges, "swept", lambda runs, asked, replace: seen.append(len(runs)) or real(runs, asked, replace))
    n = 1300
    runs = [[{"is_break": None, "text": "abc", "style": None}, {"is_break": True, "text": None, "style": None}]] * n
    asked = [[{"start": 1, "end": 2, "what": "X"}]] * n
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("what", pa.string())]))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n)), "para_idx": pa.array([0] * n), "ranges": pa.array(asked, kind), "runs": pa.array(runs, pa.list_(ranges._RUN))})
    out = list(ranges._sweep(True)(iter([batch])))
    assert seen == [512, 512, 276] and [b.num_rows for b in out] == seen
    assert {"".join(r["text"] or "|" for r in x) for b in out for x in b.column("runs").to_pylist()} == {"aXc|"}
    rows = spark.createDataFrame([(1, 0, runs[0]), (2, 0, None), (3, 0, []), (4, 0, [None, *runs[0]])], f"doc_id int, para_idx int, runs {RUNS}")
    none = spark.createDataFrame([], "doc_id int, para_idx int, start int, end int, insert string")
    got = ranges.respliced(rows, none)
    assert sorted(got.collect()) == sorted(rows.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0  # the runs are dealt once, not once for each kind


def test_merging_gathers_once(spark):
    """Breaks, missing texts and missing styles merge as before, without a window over all runs."""
    bold = (True, None, None, None, None, None)
    plain = (False, None, None, "", None, None)
    rows = [(1, 0, 3, True, None, bold), (1, 0, 0, None, None, None), (1, 0, 1, False, "a", plain), (1, 0, 2, None, "b", bold), (1, 0, 4, None, "c", bold), (1, 0, 5, False, "d", bold), (1, 1, 0, True, "x", None), (2, 0, 7, None, None, plain)]
    out = styled.merged(spark.createDataFrame(rows, f"doc_id int, para_idx int, run_idx int, is_break boolean, text string, style {STYLE}"))
    got = [(*r[:5], tuple(r["style"]) if r["style"] else None) for r in out.select("doc_id", "para_idx", "run_idx", "is_break", "text", "style").orderBy("doc_id", "para_idx", "run_idx").collect()]
    assert got == [(1, 0, 0, False, "a", None), (1, 0, 1, False, "b", bold), (1, 0, 2, True, None, bold), (1, 0, 3, False, "cd", bold), (1, 1, 0, True, None, None), (2, 0, 0, False, "", plain)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_equal_runs_as_their_canonical_forms(spark):
    """runs are compared and merged without a struct for each; results as of the plain forms."""
    import random

    r = random.Random(5)
    looks = [None, *({"bold": b, "italic": None, "underline": None, "color": c, "font_family": None, "font_size": z} for b in (None, False, True) for c in (None, "", "#F00") for z in (None, "9pt"))]

    def some():
        return r.choice([None, [], *([[None if r.random() < 0.03 else {"is_break": r.choice([None, False, False, False, True]), "text": r.choice([None, "", "a", "b"]), "style": r.choice(r.choice([looks, looks[:3]]))} for _ in range(r.randint(1, 9))] for _ in range(9)])])

    def cut(runs):
        return None if runs is None else [y for x in runs for y in ([x, {**x, "text": ""}] if x and not x["is_break"] and r.random() < 0.4 else [x])]

    pairs = [(x, cut(x) if r.random() < 0.6 else some()) for x in (some() for _ in range(600))]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"i int, a {RUNS}, b {RUNS}")

    def plain(runs):
        out = []
        for x in runs or []:
            x = x or {}
            s = x.get("style") or {}
            look = None if x.get("is_break") else tuple(s.get(k) or "" for k in R.FLAGS + R.NAMES)
            if out and look is not None and out[-1][0] == look:
                out[-1][1] += x.get("text") or ""
            else:
                out.append([look, "" if look is None else x.get("text") or ""])
        return runs if runs is None else out

    got = rows.select("i", R.runs_equal(F.col("a"), F.col("b")).alias("same"), (R.canonical(F.col("a")) == R.canonical(F.col("b"))).alias("slow"), R.merge_adjacent(F.col("a")).alias("m")).collect()
    for x in got:
        a, b = pairs[x["i"]]
        want = None if a is None or b is None else plain(a) == plain(b)
        assert x["same"] == x["slow"] == want, (a, b)
        assert plain(a) == plain(None if x["m"] is None else [m and m.asDict(True) for m in x["m"]])
        assert x["m"] is None or len(x["m"]) == len(plain(a))
    assert {x["same"] for x in got} == {True, False, None}
    plan = rows.select(R.runs_equal(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(bold, coalesce" not in plan  # no struct of a look for each run
