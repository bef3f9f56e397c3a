"""The ten queries and the pipeline over whole tables: against their SQL, brute force or held-out labels."""


import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import cases
import corpus_pipeline
from leafmill.llm import registry


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, spark, duck, sf_dir):
    assert rows_of(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(registry.SQL[name]).df())


def test_suffix_dedup(spark, sf_dir, documents):
    got = sorted(map(tuple, registry.QUERIES["op3_suffix_dedup"](spark, sf_dir).collect()), key=str)
    assert got == cases.removed(documents)
    assert sum(r[2] for r in got)


def check_packed(rows, capacity=4096):
    """Sequences are gapless and within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, sf_dir, documents):
    got = registry.QUERIES["op7_packing"](spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == cases.tokenised(documents)
    assert check_packed(got) <= 1.02 * sum(r["length"] for r in got) / 4096 + 1


def test_language(spark, sf_dir):
    got = registry.QUERIES["op1_language_id"](spark, sf_dir)
    both = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in both) >= 0.98 * len(both)
    assert all(0 <= r["score"] <= 1 for r in both)


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.75), ("op4_quality", "quality", 0.9)])
def test_classifiers(name, label, least, spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES[name](spark, sf)
    assert got.count() == 1000 and got.filter("score < 0 or score > 1").isEmpty()
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", label).collect()
    good, bad = ([r["score"] for r in both if r[label] == v] for v in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert area >= least


def test_pipeline(spark, sf_dir):
    """Stage by stage against reference versions; the whole is what the last stage gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    secret = F.concat("text", F.lit(" token = abcdefgh12345"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 7, secret).otherwise(F.col("text")))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "secrets", "mixing", "packing"]
    known = stages["language_id"](spark, docs, sf_dir).cache()
    assert known.columns == columns and known.count() >= 0.97 * docs.count()
    one = stages["near_duplicates"](spark, known, sf_dir).cache()
    want = cases.linked([(r["doc_id"], r["text"]) for r in known.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    clean = stages["secrets"](spark, one, sf_dir).cache()
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (one, clean))
    changed = {d for d in before if before[d] != after[d]}
    assert changed and all("[secret]" in after[d] for d in changed) and clean.columns == columns
    from leafmill.llm.secrets import find_secrets

    assert find_secrets(clean).filter("n_assign + n_access + n_hex > 0").isEmpty()
    mixed = stages["mixing"](spark, clean, sf_dir).cache()
    from leafmill.llm.mixing import mix_sources

    times = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(clean).collect() if r["size"]}
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {d: n for d, n in times.items() if n} and mixed.columns == columns
    packed = stages["packing"](spark, mixed, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=str) == cases.tokenised([(r["doc_id"], r["text"]) for r in mixed.collect()])
    check_packed(packed)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
