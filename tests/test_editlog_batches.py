"""The replay of edit logs over Arrow batches: rows dealt once, documents across batches, only what is asked for; shortcuts against patterns."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_editlog import LOG, PARAS, WS, plain, random_edit, whole

from leafmill.operators import editlog
from leafmill.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["x05_mixed_log", "x05_log_report", "x05_replay"])
def test_paragraphs_and_edits_are_dealt_once(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Join" not in plan


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, old)


def test_documents_across_batches(spark, small_batches):
    r, docs = random.Random(5), {}
    for d in range(60):
        word = random_edit(r)[1]
        nodes = lambda: [(word() or "t", r.choice([None, "bold"])) for _ in range(r.randrange(0, 3))]
        paras = [(r.choice([None, -1, 0, 8]), r.choice(["body", None]), nodes()) for _ in range(r.choice([1, 2, 9]))]
        docs[f"d{d}"] = (paras, [(i, *random_edit(r)[0]) for i in range(r.choice([0, 0, 1, 8]))])
    p = spark.createDataFrame([(d, i, whole(x[2]), *x) for d, (paras, _) in docs.items() for i, x in enumerate(paras)], PARAS)
    log = spark.createDataFrame([(d, *e) for d, (_, edits) in docs.items() for e in edits], LOG)
    got, told = {}, {}
    for x in editlog.edited(editlog.run_log(p, log, told=False)).orderBy("para_idx").collect():
        got.setdefault(x["doc_id"], []).append((x["para_idx"], x["text"], x["list_level"], x["part"], [tuple(n) for n in x["nodes"]], x["n_changes"]))
    for x in editlog.report(editlog.run_log(p, log, texts=False)).orderBy("seq").collect():
        told.setdefault(x["doc_id"], []).append(tuple(x)[1:])
    for d, (paras, edits) in docs.items():
        want, report = plain(paras, edits)
        n = sum(e[2] for e in report)
        assert got[d] == [(i, whole(x[2]), x[0], x[1], x[2], n) for i, x in enumerate(want)], (d, edits)
        assert told.get(d, []) == report
    bare = editlog.run_log(p, log, nodes=False, told=False)
    assert bare.filter("nodes is not null or seq is not null").count() == 0
    assert editlog.run_log(p, log, texts=False).filter("para_idx is not null").count() == 0
    assert sorted((x["doc_id"], x["para_idx"], x["text"]) for x in bare.collect()) == sorted((d, *x[:2]) for d, rows in got.items() for x in rows)


def test_without_edits_or_document(spark):
    """They come out with their own numbers; a null value of a snippet is an empty one; equal seq goes by op and parameters."""
    p = spark.createDataFrame([(None, 4, "x\ny"), (None, 9, None), ("a", 7, "b\n"), ("a", None, "c"), ("b", 5, "!k \U0001f600"), ("b", 5, "!j")], "doc_id string, para_idx int, text string")
    log = spark.createDataFrame([("b", None, "affix", {"suffix": "."}, None, None), ("b", 1, "snippetExpand", None, None, {"k": None, "j": "\x01\"é"}), ("b", 1, "affix", {"prefix": "b"}, None, None), ("b", 1, "affix", {"prefix": "a"}, None, None)], LOG)
    run = editlog.run_log(p, log).cache()
    got = {(x["doc_id"], x["para_idx"], x["text"]): [n["text"] for n in x["nodes"]] for x in run.filter("seq is null and op is null").collect()}
    assert got == {(None, 4, "x\ny"): ["x", None, "y"], (None, 9, ""): [], ("a", 7, "b\n"): ["b", None], ("a", None, "c"): ["c"], ("b", 0, 'ba"é.'): ['ba"é.'], ("b", 1, "ba \U0001f600."): ["ba \U0001f600."]}
    assert [(x["seq"], x["op"], x["n_changes"]) for x in run.filter(F.col("op").isNotNull()).orderBy(F.col("seq").asc_nulls_first(), "op").collect()] == [(None, "affix", 2), (1, "affix", 2), (1, "affix", 2), (1, "snippetExpand", 2)]
    run.unpersist()


def test_shortcuts():
    """Limits on a literal are those on its pattern; white space is collapsed and cut as the patterns say, for every character."""
    r = random.Random(3)
    for _ in range(2000):
        texts = ["".join(r.choice("ab.") for _ in range(r.randrange(7))) for _ in range(3)]
        find, limits = r.choice(["a", "ab", ".", "aa"]), {"skip": str(r.randrange(-1, 4)), "max": str(r.randrange(-1, 4)), "replace": r.choice(["", "x", "a", "aa"])}
        out = []
        for params in ({"find": find}, {"find": re.escape(find), "regex": "true"}):
            edit = editlog.Edit(json.dumps({"op": "replace", "by": json.dumps(params | limits)}))
            doc = [editlog.Paragraph(None, None, [(t, None)]) for t in texts]
            out.append((edit.change(doc, True), [x.nodes for x in doc]))
        assert out[0] == out[1], (texts, find, limits)
    for c in (c for i in range(0x110000) if not 0xD800 <= i < 0xE000 for c in [chr(i)]):
        t = f"{c}a {c}{c}b  {c}"
        assert editlog._collapsed(t) == re.sub(f"{WS}+", " ", t) and t.strip(editlog._ENDS) == re.sub(f"^{WS}+|{WS}+\\Z", "", t)
        assert editlog.sanitised(t) == re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", t)


def test_report_hands_back_no_paragraphs(spark, sf_dir, monkeypatch):
    runs = []
    monkeypatch.setattr(editlog, "report", lambda run, f=editlog.report: runs.append(run) or f(run))
    assert QUERIES["x05_log_report"](spark, sf_dir).count() and runs[0].filter("para_idx is not null").count() == 0
