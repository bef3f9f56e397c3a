"""The index of grams: what patterns must hold, and results equal to a search of all paragraphs."""

import random
import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from leafmill.operators import search
from leafmill.operators import search_index as S


def held(text):
    text = "".join(c.lower() if c in S._UPPER else S._FOLDS.get(c, c) for c in text)
    return {text[i : i + 3] for i in range(len(text) - 2)}


def may_match(pattern, text, regex=True):
    need = S.regex_need(pattern) if regex else S.literal_need(pattern)
    return need is None or bool(need.holds(lambda g: g in held(text)))


def random_regex(r, deep=0):
    def atom():
        k = r.random()
        if k < 0.65 or deep > 2:
            return r.choice("abcAB") if k < 0.6 else r.choice([".", r"\.", r"\w", "[ab]", "[^a-c&]", r"[\]a]", "^", "$", r"\b", r"\d", "é"])
        open_ = r.choice(["(", "(?:", "(?=", "(?!", "(?<!"])
        inner = "".join(r.choice("abc") for _ in range(r.randrange(1, 4))) if open_ == "(?<!" else random_regex(r, deep + 1)
        return open_ + inner + ")"

    def times(a):
        return "" if a in ("^", "$", r"\b") or a[:3] in ("(?=", "(?!", "(?<") else r.choice(["", "", "", "", "", "?", "*", "+", "{2}", "{0,2}", "{1,}", "+?"])

    branch = lambda: "".join(a + times(a) for a in (atom() for _ in range(r.randrange(1, 7))))
    return "|".join(branch() for _ in range(1 + (r.random() < 0.3)))


def test_no_match_is_lost():
    """Random regexes against random texts of few letters: whatever matches passes the condition; many others don't."""
    r, matched, kept, out = random.Random(4), 0, 0, 0
    for _ in range(3000):
        pattern = random_regex(r)
        for _ in range(12):
            text = "".join(r.choice("aabbccABé. 1") for _ in range(r.randrange(0, 14)))
            if re.search(pattern, text, re.I):
                assert may_match(pattern, text), (pattern, text)
                matched += 1
            elif may_match(pattern, text):
                kept += 1
            else:
                out += 1
    assert matched > 5000 and out > 2000  # neither side is empty


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("abcd", {"abc", "bcd"}), ("ab+cd", {"bcd"}), ("abx?cde", {"cde"}), ("(abc|bcd)e", {"abc", "bcd"}), ("(abc|b)", None), (r"\Qabc\E", None), ("[a[bc]]abc", None), ("(?x)a b c", None), ("(?i)ABC", {"abc"}), ("abc{2}", {"abc"}), (r"\babc\.", {"abc", "bc."}), ("", None), ("a{0}bcd", {"bcd"}), ("(?!abc)bcd", {"bcd"}), ("éabc", {"abc"}), ("(abc", None), ("abc)", None), (r"\x41abc", None), ("[]a]abc", None), (r"\1abc", {"abc"})],
)
def test_mandatory_grams(pattern, want):
    need = S.regex_need(pattern)
    assert (need and need.grams()) == want


TEXTS = ["The theatre", "no match", "THE King", "", None, "a.b.c (x)", "tion nation", "rationing the nation", "gęśl the jaźń", "\U0001f600the\U0001f600", "ab", "that ſon", "İnside the ınn", "the the the"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"d{i % 3}" if i % 5 else None, i if i % 4 else None, t, i % 2 == 0) for i, t in enumerate(TEXTS)]
    rows += [("d9", 0, "the the the", True), ("d9", 0, "the the the", True)]
    paras = spark.createDataFrame(rows, "doc_id string, para_idx int, text string, is_heading boolean")
    made = S.build(paras.filter("text is null or text not like 'r%'"), str(tmp_path_factory.mktemp("x") / "index"), parts=3, buckets=4)
    made.add(paras.filter("text like 'r%'"))
    return paras, S.SearchIndex(spark, made.folder)


@pytest.mark.parametrize(
    ("find", "regex"),
    [("the", False), ("THE T", False), ("king", False), ("son", False), ("inn", False), ("inside", False), ("b.c (", False), ("zz", False), ("zzz", False), ("jaźń", False), ("ation|tre", True), ("n(at|o )i?", True), ("t.e", True), ("(the ){2}", True), ("x*", True), ("[tT]he", True), (r"\bnation\b", True), ("|".join(f"q{i}{j}" for i in range(9) for j in range(9)) + "|the", True)],
)
def test_equal_to_a_full_search(index, find, regex):
    paras, made = index
    for headings in (False, True):
        a, b = made.matches_of(find, regex, headings).toPandas(), search.matches_of(paras, find, regex, headings).toPandas()
        # of repeated ids either row may come first
        assert rows_of(a.drop(columns="match_no")) == rows_of(b.drop(columns="match_no"))
        assert rows_of(a[["doc_id", "match_no"]]) == rows_of(b[["doc_id", "match_no"]])
    whole = lambda d: rows_of(d.select("doc_id", "hits", "paragraphs", F.size("samples").alias("n")).toPandas())
    assert whole(made.preview(find, regex)) == whole(search.preview(paras, find, regex))


def test_it_reads_few_paragraphs(index):
    _, made = index
    assert made.candidates("nation").count() == 2 and made.candidates("zzz").count() == 0
    assert made.candidates("n.t", regex=True).count() == len(TEXTS) + 2  # nothing mandatory: all
    plan = made.candidates("nation")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "In(gram" in plan


def test_no_paragraphs(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string, para_idx int, text string")
    made = S.build(none, str(tmp_path / "i"))
    assert made.matches_of("abc").count() == made.matches_of("a").count() == 0


def test_counts_come_from_postings(spark, tmp_path):
    """No second pass over the texts writes counts; how rare a gram is follows from the postings."""
    rows = spark.createDataFrame([(i, 0, "abc xyz" if i % 5 else "abc qrs") for i in range(20)], "doc_id int, para_idx int, text string")
    index = S.build(rows, f"file://{tmp_path}/index", parts=2, buckets=2)
    assert sorted(x.name for x in (tmp_path / "index").iterdir() if x.is_dir()) == ["postings", "settings", "texts"]
    assert "qrs" in index.need("abc qrs").grams() and "bc " not in index.need("abc qrs").grams()
    assert index.matches_of("c qrs").count() == 4


def shuffled(spark, group):
    """Bytes of shuffle that the jobs of a group wrote."""
    status, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_texts_and_postings_are_not_shuffled(spark, tmp_path):
    """a build writes no shuffle, and a search sends bits to the texts, however large Spark takes them to be."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "0 AS para_idx", "concat('the nation ', id) AS text").repartition(3).localCheckpoint()
    spark.sparkContext.setJobGroup("index-build", "")
    index = S.build(rows, f"file://{tmp_path}/index", parts=2, buckets=2)
    spark.sparkContext.setJobGroup("other", "")
    assert shuffled(spark, "index-build") == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.candidates("ion 29")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r["doc_id"] for r in found.collect()) == sorted(i for i in range(3000) if str(i).startswith("29"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grams_and_lists_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    texts = [None if r.random() < 0.1 else "".join(r.choice("aAbB .ęK\U0001f600\n~") for _ in range(r.randrange(0, 40))) for _ in range(300)]
    want = sorted((ord(x) << 16 | ord(y) << 8 | ord(z), i) for i, t in enumerate(texts) for x, y, z in (held(t) if t else ()) if all(" " <= c <= "~" for c in (x, y, z)))
    for size in (3, 64, 1 << 20):
        monkeypatch.setattr(S, "_BYTES", size)
        for a, b in ((0, 300), (7, 130), (9, 9)):
            code, text = S.grams(pa.array(texts, pa.string()).slice(a, b - a))
            assert list(zip(code.tolist(), text.tolist())) == sorted((c, i - a) for c, i in want if a <= i < b)
    lists = [sorted(r.sample(range(1 << S._SEGMENT), r.randrange(1, 200))) for _ in range(50)] + [[0], [127, 128, 256, 8191], list(range(8192))]
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    packed = S._packed(np.concatenate([np.array(x) for x in lists]), starts)
    assert [S._unpacked(x).tolist() for x in packed.to_pylist()] == lists


def test_segments_across_slices(spark, tmp_path, monkeypatch):
    """Texts of a segment whose postings are made in several parts, and more segments than one in a task."""
    monkeypatch.setattr(S, "_SEGMENT", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    rows = spark.range(1000).selectExpr("id AS doc_id", "CAST(id % 3 AS int) AS para_idx", "concat('abc ', id * 7919 % 1000) AS text").repartition(2)
    index = S.build(rows, f"file://{tmp_path}/index", parts=3, buckets=3)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for find in ("c 99", "abc", "bc 1", "123"):
        assert rows_of(index.candidates(find).select("doc_id").toPandas()) == rows_of(rows.filter(F.col("text").contains(find)).select("doc_id").toPandas())


def test_what_was_not_added_whole_is_not_read(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "abc xyz")], "doc_id int, para_idx int, text string")
    index = S.build(rows, f"file://{tmp_path}/index", parts=2, buckets=2)

    def torn(*_):
        raise RuntimeError("lost between the two tables")

    with monkeypatch.context() as m:
        m.setattr(S, "_bucket", torn)
        with pytest.raises(RuntimeError):
            index.add(rows)
    assert index.candidates("abc").count() == index.candidates("a").count() == 1
    index.add(rows)
    assert index.candidates("abc").count() == index.candidates("a").count() == 2
