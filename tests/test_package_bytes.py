"""Patched packages: what changes and, byte for byte, what does not."""

import io
import random
import re
import zipfile

import pytest

from leafmill.sources import docx

W = docx.W


def part(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment"
        info = zipfile.ZipInfo("media/a.bin", (1999, 12, 31, 23, 58, 0))
        info.comment = b"kept"
        z.writestr(info, bytes(range(256)), zipfile.ZIP_STORED)
        z.writestr(docx.PART, xml.encode())
        z.writestr("later.xml", "<x/>", zipfile.ZIP_DEFLATED)
    return out.getvalue()


def xml_of(content: bytes) -> str:
    return zipfile.ZipFile(io.BytesIO(content)).read(docx.PART).decode()


def test_bytes_outside_stay():
    """Random documents of tables, text boxes, CDATA, comments and odd quotes: only the named paragraphs' insides change."""
    r = random.Random(7)
    for _ in range(200):
        count = 0

        def para(deep=0):
            nonlocal count
            if not deep:
                count += 1
            open_ = r.choice(["<w:p>", "<w:p w:a='x>y'>", '<w:p\n\tw14:id="1"  >', "<w:p xmlns:q='urn:q'>"])
            props = r.choice(["", "<w:pPr/>", '<w:pPr ><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr >'])
            inner = r.choice(["", "<w:r><w:t>a &amp; b</w:t></w:r>", "<w:r><w:t><![CDATA[</w:p>]]></w:t></w:r>", "<!-- </w:p> -->", "<?x </w:p> ?>"])
            if not deep and r.random() < 0.2:
                inner += f"<w:r><w:pict><w:txbx>{para(1)}</w:txbx></w:pict></w:r>"
            if r.random() < 0.15:
                return r.choice(["<w:p/>", "<w:p w:a='1' />"])
            return f"\x00{open_}{props}\x01{inner}\x02</w:p >" if not deep else f"{open_}{props}{inner}</w:p>"

        blocks = [r.choice([para, lambda: f"<w:tbl>\n<w:tr><w:tc>{para()}{para()}</w:tc></w:tr></w:tbl>", lambda: "<!--c-->\r"])() for _ in range(r.randrange(1, 6))]
        marked = f"""<?xml version='1.0'?><!DOCTYPE d><w:document xmlns:w="{W}" xmlns:w14='urn:14' xmlns:un="urn:u" Ignorable="w14">\n<w:body>{"".join(blocks)}<w:sectPr><w:p/></w:sectPr></w:body></w:document>\n<!-- end -->"""
        chosen = {i for i in range(count) if r.random() < 0.5}
        changes = {i: f"<w:r><w:t>new {i} é</w:t></w:r>" for i in chosen}
        places = list(re.finditer("\x00.*?\x01(.*?)\x02|<w:p( w:a='1' )?/>(?!</w:sectPr>)", marked, re.S))
        at, want = 0, ""
        for i, m in enumerate(places):
            want += marked[at : m.start()]
            if i not in chosen:
                want += m[0]
            elif m[0][0] == "\x00":
                want += m[0].replace("\x01" + m[1] + "\x02", changes[i])
            else:
                want += ("<w:p w:a='1'>" if m[2] else "<w:p>") + changes[i] + "</w:p>"
            at = m.end()
        clean = lambda t: re.sub("[\x00-\x02]", "", t)
        got, n, error = docx.patch(part(clean(marked)), changes)
        assert (n, error) == (len(chosen), None)
        assert xml_of(got) == clean(want + marked[at:])


def test_other_entries_keep_everything():
    old = part(f'<w:document xmlns:w="{W}"><w:body><w:p/></w:body></w:document>')
    new, n, error = docx.patch(old, {0: "<w:r/>", 9: "<w:r/>"})
    a, b = zipfile.ZipFile(io.BytesIO(old)), zipfile.ZipFile(io.BytesIO(new))
    assert (n, error, b.comment) == (1, None, b"a comment")
    for x, y in zip(a.infolist(), b.infolist(), strict=True):
        assert (x.filename, x.date_time, x.comment, x.external_attr) == (y.filename, y.date_time, y.comment, y.external_attr)
        assert x.filename == docx.PART or (a.read(x) == b.read(y) and x.compress_type == y.compress_type)


@pytest.mark.parametrize("head", [f"<d:document xmlns:d='{W}'><d:body><d:p><d:pPr/>", f"<document xmlns='{W}' xmlns:w='urn:other'><body><p><pPr/>"])
def test_other_prefixes(head):
    """Where w stands for something else, the new runs say what they mean."""
    tails = {"<d": "</d:p></d:body></d:document>", "<do": "</p></body></document>"}
    tail = tails["<do"] if head.startswith("<document") else tails["<d"]
    got, n, error = docx.patch(part(head + tail), {0: "<w:r><w:t>x</w:t></w:r><w:r><w:br/></w:r>"})
    assert xml_of(got) == f'{head}<w:r xmlns:w="{W}"><w:t>x</w:t></w:r><w:r xmlns:w="{W}"><w:br/></w:r>{tail}'
    assert docx.parse(got)[0][0]["text"] == "x\n"


def test_encodings():
    xml = f"<?xml version='1.0' encoding='ISO-8859-2'?><w:document xmlns:w='{W}'><w:body><w:p><w:r><w:t>ł</w:t></w:r></w:p><w:p/></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(docx.PART, xml.encode("iso-8859-2"))
    got, _, error = docx.patch(out.getvalue(), {1: "<w:r><w:t>ł漢</w:t></w:r>"})
    assert error is None and [p["text"] for p in docx.parse(got)[0]] == ["ł", "ł漢"]
    assert zipfile.ZipFile(io.BytesIO(got)).read(docx.PART).startswith(xml.encode("iso-8859-2")[:-40])


def test_errors_are_a_column(spark):
    good = part(f"<w:document xmlns:w='{W}'><w:body><w:p/></w:body></w:document>")
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.xml", "<x/>")
    wide = io.BytesIO()
    with zipfile.ZipFile(wide, "w") as z:
        z.writestr(docx.PART, f"<?xml version='1.0' encoding='utf-16'?><w:document xmlns:w='{W}'/>".encode("utf-16"))
    files = {"good": good, "plain": good, "odd": good, "torn": good[:-30], "junk": b"no zip", "none": None, "empty": empty.getvalue(), "bad": part("<a><b></a>"), "wide": wide.getvalue()}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "doc_id string, content binary")
    changes = spark.createDataFrame([(k, 0, "<w:r>" if k == "odd" else "<w:r/>") for k in files if k != "plain"] + [("gone", 0, "<w:r/>"), ("good", 7, "<w:r/>"), ("good", None, "<w:r/>")], "doc_id string, para_idx int, xml string")
    got = {r["doc_id"]: r for r in docx.patched(rows, changes).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"good": None, "plain": None, "odd": "bad-runs", "torn": "not-a-package", "junk": "not-a-package", "none": "no-content", "empty": "no-document-part", "bad": "bad-xml", "wide": "encoding"}
    assert {k for k, r in got.items() if r["n_changed"]} == {"good"}
    assert all(r["content"] == files[k] for k, r in got.items() if k != "good")
    assert sorted(r["name"] for r in docx.entries(rows.filter("doc_id in ('good', 'junk', 'none')")).collect()) == sorted(["media/a.bin", docx.PART, "later.xml"])
