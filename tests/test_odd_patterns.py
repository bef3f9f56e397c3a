"""Patterns that match nothing, names that hold quoting marks, names that come twice."""

import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import tokens as K
from leafmill.functions.patterns import _JVM_CHARS, WS
from leafmill.operators import search, templates


@pytest.mark.parametrize("pattern", ["o*", "x*", "(?=e)", "e|", "^", "a?", r"\b"])
def test_empty_matches(spark, pattern):
    texts = ["three", "one two", "", "oo", "eye", "aXa"]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, node_idx int").withColumn("doc_id", F.lit("a"))
    got = rows.select("text", T.find_all(F.col("text"), pattern, regex=True).alias("h")).collect()
    for r in got:
        assert [(h["start"], h["end"]) for h in r["h"]] == [m.span() for m in re.finditer(pattern, r["text"], re.I)], (pattern, r["text"])
    for r in search.replace_some(rows.withColumn("doc_id", F.col("node_idx")), pattern, "Y", regex=True, skip=1, most=2).collect():
        n = iter(range(10**6))
        assert r["new_text"] == re.sub(pattern, lambda m: "Y" if 1 <= next(n) < 3 else m[0], r["text"])


def test_quoting_marks_in_names(spark):
    values = F.create_map(F.lit(r"a\Eb"), F.lit("one"), F.lit(r"\Q"), F.lit("two"), F.lit("a.b"), F.lit("$1"))
    row = spark.range(1).select(K.fill(F.lit(r"{{a\Eb}} {{ \Q }} {{a.b}} {{axb}}"), values).alias("f"), K.expand(F.lit(r"!a\Eb !axb"), F.create_map(F.lit(r"a\Eb"), F.lit("x"))).alias("e")).first()
    assert tuple(row["f"]) == ("one two $1 {{axb}}", 3) and tuple(row["e"]) == ("x !axb", 1)


def test_repeated_names(spark):
    p = spark.createDataFrame([("a", 0, "!s !t !u")], "doc_id string, para_idx int, text string")
    library = spark.createDataFrame([("s", "old", 1), ("s", "new", 2), ("s", "none", None), ("t", "b", 1), ("t", "a", 1)], "name string, body string, updated_at bigint")
    assert templates.expand_map(p, library).first()["bodies"] == {"s": "new", "t": "a"}
    assert templates.expand_map(p, library.drop("updated_at")).first()["bodies"] == {"s": "new", "t": "a"}
    values = spark.createDataFrame([("r", "n", " x ", 2), ("r", "n", "y", 1), ("r", "m", " ", 1), ("r", None, "z", 1)], "record_id string, name string, value string, seq int")
    assert templates.value_map(values).first()["vals"] == {"n": "x"}
    assert templates.value_map(values.drop("seq")).first()["vals"] == {"n": "y"}


def test_both_white_space_classes_agree(spark):
    """The fast form of the white-space class matches the same characters over the whole range."""
    c = F.expr("substr(decode(unhex('00000078' || lpad(hex(id), 8, '0')), 'utf-32'), 2)")
    chars = spark.range(0x110000).filter("id < 55296 or id > 57343").select(c.alias("c"))
    assert chars.filter(F.col("c").rlike(f"^{WS}\\z") != F.col("c").rlike(f"^[{_JVM_CHARS}]\\z")).count() == 0
    assert chars.filter(F.col("c").rlike(f"^{WS}\\z")).count() == 25


def test_mail_merge_moves_values_once(spark, sf_dir):
    """records are neither shuffled twice nor gathered again for each part of the templates."""
    from leafmill.plans.registry import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in ("-1", before):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            out = QUERIES["j03_mail_merge"](spark, sf_dir)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1
            assert "ExistingRDD" not in plan  # a template row of unknown size, in as many parts as there are cores
            assert out.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
