"""Packages, structural edits, styled runs, streams: tables on literal inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.model import SNIPPETS
from leafmill.operators import edits, search, structure, styled, templates
from leafmill.sources import docx, html
from leafmill.streaming import ingest


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id", "para_idx").collect()]


@pytest.fixture()
def sample(spark):
    lines = ["Kiln log — spring", "Każda partia szkliwa stygnie przez noc w piecu.", "Wpisz {{partia}} przy każdym piecu, zanim ostygnie."]
    return spark.createDataFrame([("a", i, t, "Heading1" if i == 0 else None) for i, t in enumerate(lines)], "doc_id string, para_idx int, text string, style string")


def test_sample_document(sample):
    got = structure.statistics(sample).first()
    assert (got["paragraphs"], got["chars"], got["words"], got["tables"], got["headings"]) == (3, 115, 19, 0, 3)
    assert templates.field_summary(sample).first()["name"] == "partia"
    done = search.replace_some(sample, "{{partia}}", "B-17", order="para_idx")
    assert done.agg(F.sum("n_replaced")).first()[0] == 1


def test_structural_edits(spark):
    p = spark.createDataFrame([("a", 0, "night firing morning check"), ("a", 1, "next")], "doc_id string, para_idx int, text string")
    cut = spark.createDataFrame([("a", 0, "night firing", "morning check")], "doc_id string, para_idx int, before string, after string")
    two = edits.split_paragraphs(p, cut)
    assert texts(two) == ["night firing", "morning check", "next"]
    joined = edits.merge_paragraphs(two, spark.createDataFrame([("a", 1)], "doc_id string, para_idx int"))
    assert texts(joined) == ["night firingmorning check", "next"]
    assert joined.filter("para_idx = 0").first()["join_at"] == 12
    batch = edits.apply_batch(p, spark.createDataFrame([("a", 0, "upper shelf\nlower shelf"), ("a", 9, "x")], "doc_id string, para_idx int, text string"))
    assert texts(batch) == ["upper shelf\nlower shelf", "next"]
    twice = spark.createDataFrame([("a", 0, "zz first", 1), ("a", 0, "last", 2)], "doc_id string, para_idx int, text string, seq int")
    assert texts(edits.apply_batch(p, twice)) == ["last", "next"]
    assert texts(edits.apply_batch(p, twice.drop("seq"))) == ["zz first", "next"]
    kinds = [r["is_break"] for r in batch.filter("para_idx = 0").select(F.explode(R.text_runs(F.col("text"))).alias("r")).select("r.*").collect()]
    assert kinds == [False, True, False]
    levels = spark.createDataFrame([("a", 0, 8), ("a", 1, -1)], "doc_id string, para_idx int, list_level int")
    moved = edits.change_list_level(levels, levels.select("doc_id", "para_idx", F.lit(1).alias("delta")))
    assert moved.filter("changed").count() == 0


def test_replay_is_step_by_step(spark):
    p = spark.createDataFrame([("a", 0, "one two"), ("a", 1, "three"), ("b", 0, "x")], "doc_id string, para_idx int, text string")
    log = spark.createDataFrame(
        [
            ("a", 0, "split", {"index": "0", "before": "one", "after": "two"}, None),
            ("a", 1, "case", {"mode": "upper"}, None),
            ("a", 2, "merge", {"index": "2"}, None),
            ("a", 3, "paragraphBatch", {}, [(0, "first"), (7, "no")]),
            ("a", 4, None, {"find": "TWO", "replace": "$1"}, None),
        ],
        "doc_id string, seq int, op string, params map<string,string>, items array<struct<index:int,text:string>>",
    )
    got = edits.replay(p, log)
    assert texts(got) == ["first", "$1THREE", "x"]
    assert {r["doc_id"]: r["n_changes"] for r in got.collect()} == {"a": 7, "b": 0}


def test_limited_replacement(spark):
    nodes = spark.createDataFrame([("a", 0, "x x"), ("a", 1, "x"), ("a", 2, "x x")], "doc_id string, node_idx int, text string")
    some = search.replace_some(nodes, "x", "Y", skip=1, most=3).orderBy("node_idx").collect()
    assert [r["new_text"] for r in some] == ["x Y", "Y", "Y x"]
    assert [r["n_replaced"] for r in some] == [1, 1, 1]


def test_library(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], SNIPPETS)
    new = spark.createDataFrame([("!a", "new", 2), ("bad name", "x", 3), ("c", " ", 3)], SNIPPETS)
    assert {r["name"]: r["body"] for r in templates.upsert(old, new).collect()} == {"a": "new", "b": "2"}
    assert [r["name"] for r in templates.delete(old, new.limit(1)).collect()] == ["b"]
    names = spark.createDataFrame([(n, "", 1) for n in ("b", "a", "łz", "lz", "m", "A")], SNIPPETS)
    assert [r["name"] for r in templates.by_collation(names).collect()] == ["a", "A", "b", "lz", "łz", "m"]


def test_package_round_trip(spark, tmp_path):
    props = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    runs = '<w:r><w:rPr><w:b/><w:color w:val="FF0000"/><w:sz w:val="28"/></w:rPr><w:t>Loud crimson</w:t></w:r><w:r><w:rPr><w:i/><w:u w:val="single"/></w:rPr><w:t xml:space="preserve"> leaning line</w:t></w:r><w:r><w:rPr><w:rFonts w:ascii="Courier New"/></w:rPr><w:t xml:space="preserve"> typed</w:t></w:r>'
    table = "<w:r><w:t>upper shelf</w:t></w:r><w:r><w:br/></w:r><w:r><w:t>lower shelf</w:t></w:r>"
    content = docx.new_package([props + runs, table], {"word/other.xml": b"<x/>", "media/a.bin": bytes(range(256))})
    files = spark.createDataFrame([("a", bytearray(content)), ("broken", bytearray(b"no zip"))], "doc_id string, content binary")
    paras = docx.paragraphs(docx.parsed(files))
    assert texts(paras) == ["Loud crimson leaning line typed", "upper shelf\nlower shelf"]
    first = paras.filter("para_idx = 0").first()
    assert first["style"] == "Heading1" and first["list_level"] == -1
    assert [(r["text"], r["style"]["bold"], r["style"]["color"], r["style"]["font_size"], r["style"]["font_family"]) for r in first["runs"]] == [
        ("Loud crimson", True, "#FF0000", "14pt", None),
        (" leaning line", None, None, None, None),
        (" typed", None, None, None, "Courier New"),
    ]
    # writing the runs back and reading them again keeps every property
    changes = paras.filter("para_idx = 0").select("doc_id", "para_idx", R.runs_xml(F.col("runs")).alias("xml"))
    again = docx.patched(files.filter("doc_id = 'a'"), changes)
    same = docx.paragraphs(docx.parsed(again)).filter("para_idx = 0").first()
    assert same["runs"] == first["runs"] and same["style"] == "Heading1"
    new = zipfile.ZipFile(io.BytesIO(again.first()["content"]))
    old = zipfile.ZipFile(io.BytesIO(content))
    assert new.namelist() == old.namelist()
    assert all(new.read(n) == old.read(n) for n in old.namelist() if n != docx.PART)
    # files on disk
    docx.save(again.withColumn("name", F.concat("doc_id", F.lit(".docx"))), str(tmp_path))
    good, other = docx.routed(docx.read_files(spark, str(tmp_path)))
    assert good.count() == 1 and other.count() == 0


def test_nested_tables_are_listed_once(spark):
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = f"<w:r><w:t>top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p>{inner}</w:tc></w:tr></w:tbl><w:p><w:r><w:t>end</w:t></w:r>"
    files = spark.createDataFrame([("a", bytearray(docx.new_package([body])))], "doc_id string, content binary")
    got = docx.paragraphs(docx.parsed(files))
    assert texts(got) == ["top", "cell", "in", "end"]
    assert structure.statistics(got).first()["tables"] == 2


def test_numbering(spark):
    xml = f'<w:numbering xmlns:w="{docx.W}"><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="x"/><w:rPr><w:rFonts w:ascii="Wingdings"/></w:rPr></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    item = '<w:pPr><w:numPr><w:ilvl w:val="%d"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:t>x</w:t></w:r>'
    files = spark.createDataFrame([("a", bytearray(docx.new_package([item % 0, item % 1, item % 2], {docx.NUMBERING: xml.encode()})))], "doc_id string, content binary")
    got = docx.parsed(files)
    audit = structure.marker_audit(structure.list_markers(docx.paragraphs(got), docx.numbering(got))).first()
    assert (audit["n_legacy"], audit["n_numbered"], audit["n_none"], audit["n_issues"]) == (1, 1, 1, 1)


def test_html_runs(spark):
    page = '<h1>T</h1><p>a <b>b<i>c</i></b><span style="color:red">d</span><br>e&amp;f</p><script>no</script><p></p>'
    got = html.paragraphs(spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string"))
    assert texts(got) == ["T", "a bcd\ne&f", ""]
    runs = got.filter("para_idx = 1").first()["runs"]
    assert [(r["text"], r["style"]["bold"], r["style"]["italic"], r["style"]["color"]) for r in runs if not r["is_break"]] == [
        ("a ", None, None, None),
        ("b", True, None, None),
        ("c", True, True, None),
        ("d", None, None, "red"),
        ("e&f", None, None, None),
    ]


def plain_blocks(page):
    """Blocks of a page as [tag, [(break or text, bold, italic, underline)]], by walking its tags one by one."""
    import html as entities
    import re

    out, around, current = [], [], None
    page = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", page or "")
    for tag, name, text in re.findall(r"(<(/?\w+)[^>]*>)|([^<]+)", page):
        name = name.lower()
        if name.lstrip("/") in html.BLOCKS:
            around, current = [], None
            if name[0] != "/":
                current = []
                out.append([name, current])
        elif name == "br" and current is not None:
            current.append((None, {a for a in around}))
        elif text and current is not None:
            current.append((entities.unescape(text), {a for a in around}))
        elif name and name[0] == "/" and name[1:] in around:
            del around[len(around) - 1 - around[::-1].index(name[1:]) :]
        elif name and name[0] != "/" and current is not None and name not in html.VOID:
            around.append(name)
    merged = []
    for tag, pieces in out:
        runs = []
        for text, tags in pieces:
            look = (bool(tags & {"b", "strong"}), bool(tags & {"i", "em"}), "u" in tags)
            if text is not None and runs and runs[-1][0] is not None and runs[-1][1] == look:
                runs[-1] = (runs[-1][0] + text, look)
            else:
                runs.append((text, look if text is not None else None))
        merged.append((tag, runs))
    return merged


def test_whole_pages_by_walking(spark, sf_dir):
    """All runs of all pages, their HTML and their outline (s06, s09, w03) against a plain walk over the tags."""
    import html as entities

    from leafmill.plans.registry import QUERIES

    pages = {r["page_id"]: plain_blocks(r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}

    def css(look):
        return ";".join(c for c, on in zip(("font-weight:bold", "font-style:italic", "text-decoration:underline"), look or ()) if on)

    runs = [(d, i, k, text is None, text, css(look)) for d, b in pages.items() for i, (_, rs) in enumerate(b) for k, (text, look) in enumerate(rs)]
    got = QUERIES["s06_html_runs"](spark, sf_dir).select("doc_id", "para_idx", "run_idx", "is_break", "text", "style").collect()
    assert sorted(map(tuple, got), key=str) == sorted(runs, key=str) and any(r[5] for r in runs)

    def shown(text, look):
        text = entities.escape(text, quote=False) if text is not None else None
        return "<br>" if text is None else f'<span style="{css(look)}">{text}</span>' if css(look) else text

    want = sorted((d, i, "".join(shown(*r) for r in rs)) for d, b in pages.items() for i, (_, rs) in enumerate(b))
    assert sorted(map(tuple, QUERIES["s09_runs_to_html"](spark, sf_dir).collect())) == want
    want = []
    for d, blocks in pages.items():
        said = [(i, tag, "".join("\n" if t is None else t for t, _ in rs).strip()) for i, (tag, rs) in enumerate(blocks)]
        tagged = [(i, t) for i, tag, t in said if t and tag in {f"h{n}" for n in range(1, 7)}]
        looks = [(i, t) for i, _, t in said if t and len(t) < 120 and t[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789ĄĆĘŁŃÓŚŹŻ"]
        want += [(d, n, i, t) for n, (i, t) in enumerate(tagged or looks)]
    found = QUERIES["w03_page_outline"](spark, sf_dir).select("doc_id", "heading_no", "para_idx", "label")
    assert sorted(map(tuple, found.collect())) == sorted(want) and want


def test_restyle_and_splice(spark):
    r = spark.createDataFrame([("a", 0, 0, False, "Dark ink", (True, None, None, "red", None, None)), ("a", 0, 1, False, " faint", (None,) * 6)], f"doc_id string, para_idx int, run_idx int, is_break boolean, text string, style {__import__('leafmill.model').model.STYLE}")
    mark = spark.createDataFrame([("a", 0, 5, 11)], "doc_id string, para_idx int, start int, end int").withColumn("new_style", R.style(underline=F.lit(True)))
    got = styled.restyle(r, mark).orderBy("run_idx").collect()
    assert [(x["text"], x["style"]["bold"], x["style"]["underline"]) for x in got] == [("Dark ", True, None), ("ink", True, True), (" fa", None, True), ("int", None, None)]
    new = spark.createDataFrame([("a", 0, 8, 8, " added")], "doc_id string, para_idx int, start int, end int, insert string")
    got = styled.splice(r, new).orderBy("run_idx").collect()
    assert [(x["text"], x["style"]["bold"]) for x in got] == [("Dark ink added", True), (" faint", None)]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    q = ingest.start(ingest.measured(ingest.arriving(spark, str(tmp_path / "in"), docs.schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ingest.measured(docs)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_no_local_folder_on_a_cluster(monkeypatch):
    """Where executors are other machines, tables don't go to a folder that each has for itself."""
    from types import SimpleNamespace

    from leafmill.storage import shared_folder

    def session(**conf):
        get = SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d))
        return SimpleNamespace(conf=get, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: get))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(spark_sql_warehouse_dir="file:/home/x/spark-warehouse"))
    assert shared_folder(session(spark_sql_warehouse_dir="hdfs://n/warehouse/")) == "hdfs://n/warehouse"
    assert shared_folder(session(spark_checkpoint_dir="file:///mnt/shared", spark_sql_warehouse_dir="file:/x")) == "file:///mnt/shared"
