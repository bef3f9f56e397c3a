"""Word-processor packages as tables and back. Only the document part is parsed or rewritten."""

from __future__ import annotations

import io
import math
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import file_type
from leafmill.model import RUNS, STYLE

# The format's names.
PART, NUMBERING = "word/document.xml", "word/numbering.xml"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_N = "{" + W + "}"
_R, _T, _BR, _RPR = (_N + n for n in ("r", "t", "br", "rPr"))
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'

PARAGRAPH = f"struct<para_idx:int,text:string,style:string,num_id:int,list_level:int,table_no:int,part:string,runs:{RUNS},nodes:array<string>>"
LEVEL = "struct<num_id:int,ilvl:int,num_fmt:string,lvl_text:string,font:string,is_image:boolean>"


_STYLE = pa.struct([*((n, pa.bool_()) for n in ("bold", "italic", "underline")), *((n, pa.string()) for n in ("color", "font_family", "font_size"))])
_RUN = pa.struct([("is_break", pa.bool_()), ("text", pa.string()), ("style", _STYLE)])
_PARAGRAPH = pa.struct([("para_idx", pa.int32()), ("text", pa.string()), ("style", pa.string()), ("num_id", pa.int32()), ("list_level", pa.int32()), ("table_no", pa.int32()), ("part", pa.string()), ("runs", pa.list_(_RUN)), ("nodes", pa.list_(pa.string()))])
_LEVEL = pa.struct([("num_id", pa.int32()), ("ilvl", pa.int32()), ("num_fmt", pa.string()), ("lvl_text", pa.string()), ("font", pa.string()), ("is_image", pa.bool_())])


def sliced(batches: Iterator[pa.RecordBatch], column: str, rows: int = 64, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that what a task unpacks at once stays small: up to ``rows`` rows, and up to ``size`` bytes of
    ``column`` unless one row alone has more."""
    for batch in batches:
        c = batch.column(column)
        if pa.types.is_list(c.type):
            n, items = pc.fill_null(pc.list_value_length(c), 0).to_numpy(), c.flatten()
            ends = np.append(0, np.cumsum(n))
            parts = items.flatten() if pa.types.is_struct(items.type) else [items]
            held = sum(pc.fill_null(pc.binary_length(p), 0).to_numpy().astype(np.int64) for p in parts if pa.types.is_string(p.type) or pa.types.is_binary(p.type))
            sums = np.append(0, np.cumsum(held))[ends]
        else:
            sums = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(sums, sums[at] + size, side="right")) - 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), path, size, modified, content of all files below ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("doc_id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def routed(files: DataFrame, name: str = "path", mime: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that can be ingested, and the others; both with file_type."""
    typed = files.withColumn("file_type", file_type(F.col(name), F.col(mime) if mime else None))
    return typed.filter("file_type = 'docx'"), typed.filter("file_type != 'docx'")


def _val(parent, *path: str):
    for p in path:
        parent = parent.find(_N + p) if parent is not None else None
    if parent is None:
        return None
    return parent.get(_N + "val", parent.get("val"))


def _int(raw, default: int | None = None) -> int | None:
    m = re.match(r"\s*([+-]?\d+)", raw or "")
    return int(m[1]) if m else default


def _paragraphs(root) -> Iterator[tuple]:
    """(element, number of its table or None, part) in document order; paragraphs inside paragraphs are no rows."""
    tables = 0

    def walk(node, table, part):
        nonlocal tables
        for child in node:
            name = child.tag.rpartition("}")[2]
            if name == "p":
                yield child, table, part
            elif name == "tbl":
                tables += 1
                yield from walk(child, tables, part)
            elif name != "sectPr":
                yield from walk(child, table, part)

    body = root.find(_N + "body")
    yield from walk(body if body is not None else root, None, "body" if body is not None else "other")


_NO_STYLE = dict.fromkeys(("bold", "italic", "underline", "color", "font_family", "font_size"))


def _run(r) -> dict:
    texts = []
    for c in r.iter():
        if c.tag == _N + "t":
            texts.append(c.text or "")
        elif c.tag == _N + "br":
            return {"is_break": True, "text": None, "style": None}
    pr = r.find(_N + "rPr")
    return {"is_break": False, "text": "".join(texts), "style": _NO_STYLE if pr is None else _style([(c.tag, c.attrib) for c in pr])}


def _style(properties: list[tuple[str, dict[str, str]]]) -> dict:
    """The style that the properties of a run, tag and attributes, say."""
    said: dict[str, dict[str, str]] = {}
    for tag, own in properties:
        said.setdefault(tag, own)
    has = lambda n: True if _N + n in said else None
    get = lambda tag, n: (own := said.get(_N + tag, {})).get(_N + n, own.get(n))
    half, color = _int(get("sz", "val")), get("color", "val")
    return {
        "bold": has("b"),
        "italic": has("i"),
        "underline": has("u"),
        "color": f"#{color}" if color and color != "auto" else None,
        "font_family": get("rFonts", "ascii"),
        "font_size": f"{half / 2:g}pt" if half else None,
    }


def parse(content: bytes) -> tuple[list[dict], list[dict]]:
    """Paragraphs and numbering levels of one package; both empty if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            paras = paragraph_rows(z.read(PART))
            return paras, level_rows(z.read(NUMBERING)) if NUMBERING in z.namelist() else []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, ValueError):
        return [], []


def _own_runs(p) -> Iterator:
    """The run elements of a paragraph, those of its links too."""
    for c in p:
        if c.tag == _R:
            yield c
        elif c.tag == _N + "hyperlink":
            yield from c.findall(_R)


class Styles:
    """Styles by number, so that each is read once, however many runs have it. Number 0 is that of a break."""

    def __init__(self):
        self.known, self.numbers = [None], {}

    def of(self, key: tuple) -> int:
        """``key`` has the tag and attributes of each property, flat."""
        if (got := self.numbers.get(key)) is None:
            got = self.numbers[key] = len(self.known)
            self.known.append(_style([(k[0], dict(k[1:])) for k in key]))
        return got


#: The document part that :func:`new_package` writes, around its paragraphs, and a run as ``runs_xml`` writes it.
_HEAD = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w={quoteattr(W)}><w:body>'
_TAIL = "</w:body></w:document>"
_PLAIN = re.compile(r'<w:r>(?:<w:rPr>((?:<w:[A-Za-z]+(?: w:[A-Za-z]+="[^"<]*")*/>)*)</w:rPr>)?(?:<w:t(?: xml:space="preserve")?>([^<>]*)</w:t>|(<w:br/>))</w:r>')
_BETWEEN = re.compile(r"(?:</w:p>)?(?:<w:p></w:p>)*(?:<w:p>)?")
_ENTITY = re.compile("&(?:amp|lt|gt);")
_UNLIKE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]")


def _plain_columns(part: bytes, styles: Styles) -> tuple[list[int], list[str | None], list[int]] | None:
    """:func:`run_columns` of a part that has the form of our own writer throughout, read without a tree; None if
    anything else stands in it, so that the tree decides whether it is right and what it says."""
    try:
        text = part.decode()
    except UnicodeDecodeError:
        return None
    if not (text.startswith(_HEAD) and text.endswith(_TAIL)) or _UNLIKE.search(text):
        return None
    pieces = _PLAIN.split(text[len(_HEAD) : -len(_TAIL)])
    between, said, texts, breaks = pieces[::4], pieces[1::4], pieces[2::4], pieces[3::4]
    counts, last, inside = [], 0, False
    for i, x in enumerate(between):
        if not x:
            continue
        if not _BETWEEN.fullmatch(x) or x.startswith("</w:p>") != inside:
            return None
        if inside:
            counts.append(i - last)
        counts += [0] * x.count("<w:p></w:p>")
        last, inside = i, x.endswith("<w:p>")
        if not inside and i < len(between) - 1:
            return None
    if inside or (not between[0] and len(between) > 1):
        return None
    if "&" in text:
        for i, x in enumerate(texts):
            if x and "&" in x:
                if x.count("&") != len(_ENTITY.findall(x)):
                    return None
                texts[i] = x.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    numbers: dict[str | None, int] = {None: styles.of(())}
    for x in set(said) - {None}:
        try:
            got = ElementTree.fromstring(f"<w:rPr xmlns:w={quoteattr(W)}>{x}</w:rPr>")
        except ElementTree.ParseError:
            return None
        if any(e.tag in (_T, _BR) for e in got):
            return None
        numbers[x] = styles.of(tuple([(e.tag, *e.attrib.items()) for e in got]))
    looks = [numbers[x] for x in said]
    if any(breaks):
        looks = [0 if b else n for b, n in zip(breaks, looks)]
    return counts, texts, looks


def run_columns(part: bytes, styles: Styles) -> tuple[list[int], list[str | None], list[int]]:
    """The runs of a document part as :func:`paragraph_rows` has them, as columns: how many each paragraph has, text and
    style number of each. Runs of properties and texts alone, nearly all, are read without a walk and a dictionary."""
    counts, texts, looks = [], [], []
    for p, _, _ in _paragraphs(ElementTree.fromstring(part)):
        before = len(texts)
        for r in _own_runs(p):
            text, key, plain = None, None, True
            for c in r:
                if c.tag == _T and not len(c):
                    text = (c.text or "") if text is None else text + (c.text or "")
                elif c.tag == _RPR and key is None and not any(map(len, c)):
                    key = tuple([(e.tag, *e.attrib.items()) for e in c])
                    if key not in styles.numbers and any(k[0] in (_T, _BR) for k in key):
                        plain = False
                        break
                else:
                    plain = False
                    break
            if plain:
                texts.append(text or "")
                looks.append(styles.of(key or ()))
                continue
            got = _run(r)
            texts.append(got["text"])
            pr = r.find(_RPR)
            looks.append(0 if got["is_break"] else styles.of(tuple((e.tag, *e.attrib.items()) for e in (() if pr is None else pr) if e.tag not in (_T, _BR))))
        counts.append(len(texts) - before)
    return counts, texts, looks


def paragraph_rows(part: bytes) -> list[dict]:
    """The paragraphs of a document part."""
    out = []
    for i, (p, table, part_name) in enumerate(_paragraphs(ElementTree.fromstring(part))):
        num = p.find(f"{_N}pPr/{_N}numPr")
        runs = [_run(r) for r in _own_runs(p)]
        said = [c for r in p.iter(_N + "r") for c in r if c.tag in (_N + "t", _N + "br")]
        out.append(
            {
                "para_idx": i,
                "text": "".join((c.text or "") if c.tag == _N + "t" else "\n" for c in said),
                "style": _val(p, "pPr", "pStyle"),
                "num_id": _int(_val(num, "numId")) if num is not None else None,
                "list_level": -1 if num is None else _int(_val(num, "ilvl") or "0", 0),
                "table_no": table,
                "part": part_name,
                "runs": runs,
                "nodes": [c.text or "" for c in said if c.tag == _N + "t"],
            }
        )
    return out


def paragraph_texts(part: bytes) -> list[str]:
    """The texts alone of the paragraphs of a document part, as in :func:`paragraph_rows`."""
    t, br = _N + "t", _N + "br"
    return ["".join([(c.text or "") if c.tag == t else "\n" for r in p.iter(_N + "r") for c in r if c.tag in (t, br)]) for p, _, _ in _paragraphs(ElementTree.fromstring(part))]


def level_rows(part: bytes) -> list[dict]:
    """The levels of a numbering part."""
    return _levels(ElementTree.fromstring(part))


def _levels(root) -> list[dict]:
    kinds = {a.get(_N + "abstractNumId"): a for a in root.iter(_N + "abstractNum")}
    out = []
    for num in root.iter(_N + "num"):
        kind = kinds.get(_val(num, "abstractNumId"))
        for lvl in kind.iter(_N + "lvl") if kind is not None else ():
            fonts = lvl.find(f"{_N}rPr/{_N}rFonts")
            out.append({"num_id": _int(num.get(_N + "numId")), "ilvl": _int(lvl.get(_N + "ilvl"), 0), "num_fmt": _val(lvl, "numFmt"), "lvl_text": _val(lvl, "lvlText"), "font": fonts.get(_N + "ascii") if fonts is not None else None, "is_image": lvl.find(_N + "lvlPicBulletId") is not None})
    return out


def parsed(files: DataFrame) -> DataFrame:
    """doc_id, paras, levels of each package (doc_id, content); one pass serves all tables below."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            got = [parse(c) for c in batch.column("content").to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.list_(_PARAGRAPH), pa.list_(_LEVEL)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "paras", "levels"])

    kind = dict(files.dtypes)["doc_id"]
    return files.select("doc_id", "content").mapInArrow(read, f"doc_id {kind}, paras array<{PARAGRAPH}>, levels array<{LEVEL}>")


def texts(files: DataFrame) -> DataFrame:
    """doc_id and the texts of the paragraphs of each package (doc_id, content), for readers that need nothing else; none
    if it can't be read."""

    def one(content: bytes) -> list[str]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found = paragraph_texts(z.read(PART))
                if NUMBERING in z.namelist():
                    level_rows(z.read(NUMBERING))
                return found
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, ValueError):
            return []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            got = pa.array([one(c) for c in batch.column("content").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), got], ["doc_id", "texts"])

    kind = dict(files.dtypes)["doc_id"]
    return files.select("doc_id", "content").mapInArrow(read, f"doc_id {kind}, texts array<string>")


def runs(files: DataFrame) -> DataFrame:
    """doc_id, para_idx, run_idx, is_break, text, style of all runs of the packages (doc_id, content), for readers that
    need nothing else: flat columns of a package at a time, in which a style is a number until the last. None of those
    that can't be read."""

    def one(content: bytes, styles: Styles) -> tuple[list[int], list[str | None], list[int]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                part = z.read(PART)
                found = _plain_columns(part, styles) or run_columns(part, styles)
                if NUMBERING in z.namelist():
                    level_rows(z.read(NUMBERING))
                return found
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, ValueError):
            return [], [], []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            styles, sizes, paras, counts, texts, looks = Styles(), [], [], [], [], []
            for content in batch.column("content").to_pylist():
                n, text, look = one(content, styles)
                sizes.append(len(text))
                paras += range(len(n))
                counts += n
                texts += text
                looks += look
            n, looks = np.array(counts, np.int64), np.array(looks, np.int64)
            at = np.arange(len(texts)) - np.repeat(np.cumsum(n) - n, n)
            columns = [
                batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                pa.array(np.repeat(np.array(paras, np.int32), n)),
                pa.array(at.astype(np.int32)),
                pa.array(looks == 0),
                pa.array(texts, pa.string()),
                pa.array(styles.known, _STYLE).take(pa.array(looks)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "para_idx", "run_idx", "is_break", "text", "style"])

    kind = dict(files.dtypes)["doc_id"]
    return files.select("doc_id", "content").mapInArrow(read, f"doc_id {kind}, para_idx int, run_idx int, is_break boolean, text string, style {STYLE}")


def paragraphs(packages: DataFrame) -> DataFrame:
    return packages.select("doc_id", F.explode("paras").alias("p")).select("doc_id", "p.*").drop("nodes")


def text_nodes(packages: DataFrame) -> DataFrame:
    """doc_id, node_idx, para_idx, text."""
    flat = F.flatten(F.transform("paras", lambda p: F.transform(p["nodes"], lambda t: F.struct(p["para_idx"].alias("para_idx"), t.alias("text")))))
    return packages.select("doc_id", F.posexplode(flat).alias("node_idx", "n")).select("doc_id", "node_idx", "n.*")


def numbering(packages: DataFrame) -> DataFrame:
    return packages.select("doc_id", F.explode("levels").alias("l")).select("doc_id", "l.*")


# --- writing -------------------------------------------------------------------------------------------------


def new_package(paragraph_xml: list[str], extra: dict[str, bytes] | None = None) -> bytes:
    """A package whose document part holds the given paragraphs (inner XML of each)."""
    body = "".join(f"<w:p>{x}</w:p>" for x in paragraph_xml)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr(PART, f"{_HEAD}{body}{_TAIL}")
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def built(rows: DataFrame) -> DataFrame:
    """Packages of paragraph rows (doc_id, para_idx, xml): doc_id, content. A group is one document."""
    kind = dict(rows.dtypes)["doc_id"]
    ordered = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "xml"))), lambda x: x["xml"]).alias("xmls"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "xmls"):
            packages = pa.array([new_package(x) for x in batch.column("xmls").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packages], ["doc_id", "content"])

    return ordered.mapInArrow(write, f"doc_id {kind}, content binary")


_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _properties(bold: bool, italic: bool, underline: bool, color: str, family: str, size: str) -> str:
    """The properties of a run of this style, as :func:`leafmill.functions.runs.runs_xml` has them."""
    attr = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    rgb = re.search(r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", color, re.I | re.A)
    if rgb:
        color = "".join(f"{min(int(x), (1 << 64) - 1):02X}" for x in rgb.groups())
    else:
        color = color.removeprefix("#").upper()
    half = ""
    if said := re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))", size, re.A):
        points = float(said[1])
        if re.search(r"^[\d.]+px$", size, re.I | re.A):
            points = math.floor(points * 0.75 * 2 + 0.5) / 2
        half = f'<w:sz w:val="{int(math.copysign(math.floor(abs(points * 2) + 0.5), points))}"/>'
    font = f'<w:rFonts w:ascii="{attr(family)}" w:hAnsi="{attr(family)}"/>' if family else ""
    inner = font + "<w:b/>" * bold + "<w:i/>" * italic + (f'<w:color w:val="{attr(color)}"/>' if color else "") + half + '<w:u w:val="single"/>' * underline
    return f"<w:rPr>{inner}</w:rPr>" if inner else ""


def merged_xml(runs: pa.Array) -> pa.Array:
    """``runs_xml(merge_adjacent(runs))`` of :mod:`leafmill.functions.runs` for all paragraphs of a batch at once: styles
    are numbers, runs of a paragraph lie side by side, so their texts and those of a paragraph are joined by their ends."""
    sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
    first = np.append(0, np.cumsum(sizes))
    brk, text, style = runs.flatten().flatten()
    looks = style.flatten()
    number = sum(pc.fill_null(x, False).to_numpy(zero_copy_only=False).astype(np.int64) << i for i, x in enumerate(looks[:3]))
    for x in looks[3:]:
        words = pc.fill_null(x, "").dictionary_encode()
        if len(words.dictionary) > 1:
            number = np.unique(number * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True)[1]
    brk = pc.fill_null(brk, False).to_numpy(zero_copy_only=False)
    opens = np.append(True, brk[1:] | brk[:-1] | (number[1:] != number[:-1])) if len(brk) else brk
    opens[first[:-1][sizes > 0]] = True
    at = np.flatnonzero(opens)
    text = pc.fill_null(text, "").cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    ends = ends[np.append(at, len(text))]
    data = np.append(np.frombuffer(text.buffers()[2] or b"", np.uint8), 0)
    full = np.diff(ends) > 0
    white = full & (_WHITE[data[np.where(full, ends[:-1], -1)]] | _WHITE[data[np.where(full, ends[1:] - 1, -1)]])
    text = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), text.buffers()[2]]) if len(at) else pa.array([], pa.large_string())
    text = pc.if_else(pa.array(brk[at]), "", text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = pc.replace_substring(text, a, b)
    kind, one, which = np.unique(np.where(brk[at], -2, number[at] * 2 + white), return_index=True, return_inverse=True)
    heads = []
    for k, i in zip(kind.tolist(), at[one].tolist()):
        said = [x[i].as_py() for x in looks]
        space = ' xml:space="preserve"' if k % 2 else ""
        heads.append("<w:r><w:br/></w:r>" if k == -2 else f"<w:r>{_properties(*(bool(x) for x in said[:3]), *(x or '' for x in said[3:]))}<w:t{space}>")
    tails = ["" if k == -2 else "</w:t></w:r>" for k in kind.tolist()]
    which = pa.array(which)
    xml = pc.binary_join_element_wise(pa.array(heads, pa.large_string()).take(which), text, pa.array(tails, pa.large_string()).take(which), pa.scalar("", pa.large_string()))
    ends = np.frombuffer(xml.buffers()[1], np.int64)[: len(xml) + 1] if len(xml) else np.zeros(1, np.int64)
    ends = ends[np.searchsorted(at, first)]
    whole = pa.Array.from_buffers(pa.large_string(), len(runs), [None, pa.py_buffer(ends), xml.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(runs.is_null(), None, whole).cast(pa.string())


def written(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para_idx, xml of paragraphs with runs, neighbours of equal style joined."""
    kind = dict(paragraphs.dtypes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "runs", 8192, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("para_idx"), merged_xml(batch.column("runs"))], ["doc_id", "para_idx", "xml"])

    runs = F.col("runs") if kind["runs"] == RUNS else F.col("runs").cast(RUNS)  # a cast that only says what may be null copies each run
    rows = paragraphs.select("doc_id", "para_idx", runs.alias("runs"))
    return rows.mapInArrow(write, f"doc_id {kind['doc_id']}, para_idx {kind['para_idx']}, xml string")


class PatchError(ValueError):
    """Why a package can't be patched; the text is a code."""


_TAG = re.compile(rb"""<(?:[^<>"']|"[^"]*"|'[^']*')*>""")


def _events(data: bytes, start, end) -> None:
    """Sends the names (with their namespaces) and byte offsets of all start and end tags."""
    parser = expat.ParserCreate(namespace_separator="}")
    scopes: dict[str, list[str]] = {}
    parser.StartNamespaceDeclHandler = lambda prefix, uri: scopes.setdefault(prefix or "", []).append(uri or "")
    parser.EndNamespaceDeclHandler = lambda prefix: scopes[prefix or ""].pop()
    parser.StartElementHandler = lambda name, _: start(name, parser.CurrentByteIndex, (scopes.get("w") or [""])[-1])
    parser.EndElementHandler = lambda name: end(name, parser.CurrentByteIndex)
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise PatchError("bad-xml") from e


def _places(data: bytes) -> list[tuple[int, int, list[tuple[int, int]], str]]:
    """Byte span of each paragraph row, the spans of its properties, and what the prefix w stands for there."""
    path, tags, found = [], [], {True: [], False: []}
    row, bodies = None, 0

    def start(name: str, at: int, w: str) -> None:
        nonlocal row, bodies
        bodies += len(path) == 1 and name == W + "}body"
        local = name.rpartition("}")[2]
        if row is None and path and local == "p" and not any(x.rpartition("}")[2] == "sectPr" for x in path):
            row = (len(path), at, [], w, bodies == 1 and len(path) > 1 and path[1] == W + "}body")
        path.append(name)
        tags.append(at)

    def end(name: str, at: int) -> None:
        nonlocal row
        path.pop()
        first = tags.pop()
        opening = _TAG.match(data, first)
        stop = opening.end() if opening[0].endswith(b"/>") else _TAG.match(data, at).end()
        if row and len(path) == row[0]:
            found[row[4]].append((row[1], stop, row[2], row[3]))
            row = None
        elif row and len(path) == row[0] + 1 and name == W + "}pPr":
            row[2].append((first, stop))

    _events(data, start, end)
    return found[True] if bodies else found[False]


def _declared(xml: bytes) -> bytes:
    """The runs, each of which says what the prefix w stands for."""
    tops, depth = [], 0

    def start(name: str, at: int, w: str) -> None:
        nonlocal depth
        depth += 1
        if depth == 2:
            tops.append(at)

    def end(name: str, at: int) -> None:
        nonlocal depth
        depth -= 1

    says = b" xmlns:w=" + quoteattr(W).encode()
    head = b"<w:p" + says + b">"
    _events(head + xml + b"</w:p>", start, end)
    for at in reversed(tops):
        stop = re.compile(rb"[^\s/>]+").match(xml, at - len(head) + 1).end()
        xml = xml[:stop] + says + xml[stop:]
    return xml


def patched_part(data: bytes, changes: dict[int, str]) -> tuple[bytes, int]:
    """The document part with the runs of some paragraphs replaced, and how many. Every byte outside them, their tags and
    their properties stays as it is: declarations, comments, instructions, quotes and white space are not touched."""
    said = re.match(rb"""(?:\xef\xbb\xbf)?\s*<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)""", data)
    encoding = said[1].decode().lower() if said else "utf-8"
    if encoding.startswith(("utf-16", "utf-32", "ucs")) or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise PatchError("encoding")
    out, at, n = [], 0, 0
    for i, (a, b, props, w) in enumerate(_places(data)):
        if i not in changes:
            continue
        try:
            own = _declared(changes[i].encode())
        except PatchError as e:
            raise PatchError("bad-runs") from e
        new = (changes[i] if w == W else own.decode()).encode(encoding, "xmlcharrefreplace")
        tag = _TAG.match(data, a)[0]
        if tag.endswith(b"/>"):
            close = b"</" + re.match(rb"<([^\s/>]+)", tag)[1] + b">"
            tag = tag[:-2].rstrip() + b">"
        else:
            close = data[data.rindex(b"</", a, b) : b]
        out += [data[at:a], tag, *(data[x:y] for x, y in props), new, close]
        at, n = b, n + 1
    return b"".join([*out, data[at:]]), n


UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def patch(content: bytes | None, changes: dict[int, str]) -> tuple[bytes | None, int, str | None]:
    """The package with the runs of some paragraphs replaced, how many they were, and an error code or None.

    Other entries keep their content, order, dates, compression and comments. With an error (no-content, not-a-package,
    no-document-part, bad-xml, bad-runs, encoding) the package stays as it is."""
    if content is None:
        return None, 0, "no-content"
    out = io.BytesIO()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as new:
            part, n = patched_part(old.read(PART), changes)
            if not n:
                return content, 0, None
            new.comment = old.comment
            for entry in old.infolist():
                data = part if entry.filename == PART else old.read(entry)
                new.writestr(entry, data, zipfile.ZIP_DEFLATED if entry.filename == PART else entry.compress_type, 6)
    except KeyError:
        return content, 0, "no-document-part"
    except PatchError as e:
        return content, 0, str(e)
    except LookupError:
        return content, 0, "encoding"
    except UNREADABLE:
        return content, 0, "not-a-package"
    return out.getvalue(), n, None


def patched(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Packages (doc_id, content) with changed paragraphs (doc_id, para_idx, xml) written in: doc_id, content, n_changed,
    error (see :func:`patch`). Of several changes of one paragraph the greatest text counts; positions that a package
    doesn't have, and changes of unknown documents, do nothing."""
    kind = dict(files.dtypes)["doc_id"]
    one = changes.filter("para_idx is not null and xml is not null").groupBy("doc_id", "para_idx").agg(F.max("xml").alias("xml"))
    listed = one.groupBy("doc_id").agg(F.collect_list(F.struct("para_idx", "xml")).alias("changes"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            got = [patch(c, {x["para_idx"]: x["xml"] for x in m}) for c, m in zip(batch.column("content").to_pylist(), batch.column("changes").to_pylist())]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "content", "n_changed", "error"])

    joined = files.select("doc_id", "content").join(listed, "doc_id", "left").withColumn("changes", F.coalesce("changes", F.array().cast("array<struct<para_idx:int,xml:string>>")))
    return joined.mapInArrow(write, f"doc_id {kind}, content binary, n_changed bigint, error string")


def zipped(rows: DataFrame) -> DataFrame:
    """Packages of entries (doc_id, name, data) as any writer may have made them: doc_id, content, entries by name."""
    kind = dict(rows.dtypes)["doc_id"]
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("data").cast("binary").alias("data")))).alias("entries"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "entries"):
            packages = []
            for found in batch.column("entries").to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for e in found:
                        z.writestr(zipfile.ZipInfo(e["name"]), e["data"] or b"", zipfile.ZIP_DEFLATED)
                packages.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packages, pa.binary())], ["doc_id", "content"])

    return listed.mapInArrow(write, f"doc_id {kind}, content binary")


def entries(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, name, data of every entry of the packages (doc_id, content), and the columns ``keep`` of its package; none
    of those that can't be read."""
    kinds, own = dict(files.dtypes), ("doc_id", *keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            at, found = [], []
            for i, content in enumerate(batch.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        got = [(x.filename, z.read(x)) for x in z.infolist()]
                except UNREADABLE:
                    continue
                at += [i] * len(got)
                found += got
            kept = [batch.column(c).take(pa.array(at, pa.int32())) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], [*own, "name", "data"])

    return files.select(*own, "content").mapInArrow(read, f"{', '.join(f'{c} {kinds[c]}' for c in own)}, name string, data binary")


def save(packages: DataFrame, folder: str, name: str = "name") -> None:
    """Writes each package to a file of its own in a folder that all executors share (a mounted path). A file appears
    whole or not at all, also if its task runs twice or is lost."""

    def put(rows) -> None:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, r[name])
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, path)

    packages.select(name, "content").foreachPartition(put)
