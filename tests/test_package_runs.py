"""Runs written into packages and read out of them as flat columns equal the plain forms."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.model import RUNS
from leafmill.operators import styled
from leafmill.sources import docx


def random_runs(r):
    color = ["", None, "#ab12cd", "rgb(1, 2, 300)", "RGBA( 9,8,7,0.5)", "red", 'a"<&', "rgb(1,2)"]
    size = [None, "", "9pt", "9.5pt", "10px", "11.7PX", "0pt", "junk", " .3pt", "-2.25pt", "1.2.3px"]
    looks = [{"bold": r.choice([None, False, True]), "italic": r.choice([None, True]), "underline": r.choice([None, True]), "color": r.choice(color), "font_family": r.choice([None, "", "A", 'x<"']), "font_size": r.choice(size)} for _ in range(3)]
    run = lambda: {"is_break": r.choice([None, False, False, False, True]), "text": r.choice([None, "", "a", " b", "c\t", "<&>", "\n", "ę "]), "style": r.choice([None, *looks])}
    return r.choice([None, []] + [[None if r.random() < 0.03 else run() for _ in range(r.randrange(1, 12))] for _ in range(9)])


def test_merged_xml_as_the_columns(spark):
    r = random.Random(6)
    runs = [random_runs(r) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(runs)), f"i int, runs {RUNS}").coalesce(1)
    want = [x["xml"] for x in rows.orderBy("i").select(R.runs_xml(R.merge_adjacent(F.col("runs"))).alias("xml")).collect()]
    given = pa.array(runs, pa.list_(docx._RUN))
    for a, b in ((0, 800), (13, 400), (5, 5), (700, 800)):
        assert docx.merged_xml(given.slice(a, b - a)).to_pylist() == want[a:b]
    assert docx.merged_xml(pa.array([None, []], pa.list_(docx._RUN))).to_pylist() == [None, ""]


#: Runs with texts and breaks at odd places: in properties, after texts, in fields, in links, twice the properties.
ODD = [
    "<w:r><w:t>a</w:t><w:t>b</w:t></w:r><w:r/>",
    "<w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t><w:br/></w:r><w:r><w:br/></w:r>",
    "<w:r><w:rPr><w:b/><w:t>in</w:t></w:rPr><w:t>a</w:t></w:r><w:r><w:rPr><w:b/><w:t>in</w:t></w:rPr><w:t>a</w:t></w:r>",
    "<w:r><w:rPr><w:i/><w:br/></w:rPr><w:t>a</w:t></w:r>",
    "<w:r><w:rPr><w:rPrChange><w:rPr><w:b/></w:rPr></w:rPrChange><w:u/></w:rPr><w:t>a</w:t></w:r>",
    "<w:r><w:t>a</w:t><w:rPr><w:b/></w:rPr></w:r><w:r><w:rPr/><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r>",
    "<w:hyperlink><w:r><w:rPr><w:color w:val='auto'/><w:sz w:val='21'/></w:rPr><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>no</w:t></w:r></w:ins>",
    "<w:r><w:rPr><w:color w:val='12'/><w:color w:val='34'/><w:rFonts ascii='F'/><w:sz w:val='x'/></w:rPr><w:tab/><w:t/><w:x><w:t>deep</w:t></w:x></w:r>",
    "",
]


def test_flat_runs_as_the_nested(spark):
    packages = [(1, docx.new_package(ODD)), (2, docx.new_package(ODD[::-1] * 3)), (3, b"no zip"), (4, docx.new_package([])), (5, None), (6, docx.new_package(ODD[:2], {docx.NUMBERING: b"<broken"})), (7, docx.new_package(ODD, {docx.NUMBERING: b"<ok/>"}))]
    files = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in packages], "doc_id int, content binary").coalesce(1)
    want = styled.exploded(docx.paragraphs(docx.parsed(files)))
    got = docx.runs(files)
    assert got.dtypes == want.dtypes
    order = ("doc_id", "para_idx", "run_idx")
    assert got.orderBy(*order).collect() == want.orderBy(*order).collect() != []


def test_runs_of_a_style_share_it(monkeypatch):
    """no dictionary and no walk for each run; a style is read once."""
    walked, read = [], []
    monkeypatch.setattr(docx, "_run", lambda r: walked.append(r))
    real = docx._style
    monkeypatch.setattr(docx, "_style", lambda p: read.append(p) or real(p))
    run = "<w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r><w:r><w:t>y</w:t></w:r>"
    part = f'<w:document xmlns:w="{docx.W}"><w:body>{f"<w:p>{run * 3}</w:p>" * 50}</w:body></w:document>'.encode()
    counts, texts, looks = docx.run_columns(part, docx.Styles())
    assert counts == [6] * 50 and texts == ["x", "y"] * 150 and looks == [1, 2] * 150
    assert not walked and len(read) == 2


def test_plain_parts_as_the_tree():
    """what is read without a tree is what the tree says, also of damaged parts; whatever else stands in a part is left
    to the tree."""
    import io
    import zipfile

    def columns(read, part):
        styles = docx.Styles()
        got = read(part, styles)
        return got and (*got[:2], [styles.known[i] for i in got[2]])

    def part_of(xmls):
        with zipfile.ZipFile(io.BytesIO(docx.new_package(xmls))) as z:
            return z.read(docx.PART)

    r, same, left = random.Random(7), 0, 0
    for _ in range(150):
        given = pa.array([random_runs(r) or [] for _ in range(r.randrange(6))], pa.list_(docx._RUN))
        part = part_of(docx.merged_xml(given).to_pylist())
        want = columns(docx.run_columns, part)
        got = columns(docx._plain_columns, part)
        assert got == want
        for _ in range(40):
            a = r.randrange(len(docx._HEAD), len(part))
            new = r.choice([b"", b"<w:p>", b"</w:p>", b"<w:p></w:p>", b"<w:r>", b"<w:br/>", b"&lt;", b"&", b"&#65;", b"\r", b"\x01", b"\xff", b"]]>", b"<!-- -->", b"<w:t>x</w:t>", b"<w:r><w:t>y</w:t></w:r>", b'<w:rPr><w:b w:val="1" w:val="2"/></w:rPr>', b"<w:rPr><w:t/></w:rPr>", b"<w:tbl>"])
            at = r.choice([a, part.find(b"<w:r>", a), part.find(b"</w:p>", a), part.find(b"<w:t", a)])
            torn = part[:at] + new + part[at + r.choice([0, 0, 0, 1, 5, 6]) :]
            got = columns(docx._plain_columns, torn)
            if got is None:
                left += 1
            else:
                assert got == columns(docx.run_columns, torn), torn  # raises where the tree can't read it
                same += 1
    assert same > 200 and left > 1000
    for xml in ODD[2:-1]:
        assert docx._plain_columns(part_of([xml]), docx.Styles()) is None
    assert columns(docx._plain_columns, part_of(["", "<w:r><w:t>&lt;&amp;lt;</w:t></w:r><w:r><w:br/></w:r>", ""])) == ([0, 2, 0], ["<&lt;", None], [docx._NO_STYLE, None])
