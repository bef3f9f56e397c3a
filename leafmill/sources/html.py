"""Web pages as paragraphs and styled runs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.runs import merge_adjacent, merge_styles, parse_css, runs_text, style
from leafmill.model import RUN
from leafmill.sources.docx import sliced

BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li"}
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "area", "base", "col", "embed", "source", "track"}
RAW = "array<struct<para_idx:int,tag:string,pieces:array<struct<is_break:boolean,text:string,bold:boolean,italic:boolean,underline:boolean,css:array<string>>>>>"

_PIECE = pa.struct([("is_break", pa.bool_()), ("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("underline", pa.bool_()), ("css", pa.list_(pa.string()))])
_BLOCKS = pa.list_(pa.struct([("para_idx", pa.int32()), ("tag", pa.string()), ("pieces", pa.list_(_PIECE))]))


class _Blocks(HTMLParser):
    """Blocks with their text pieces; each piece knows the tags and inline styles around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.open: dict | None = None
        self.around: list[tuple[str, str | None]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in BLOCKS:
            self.open = {"para_idx": len(self.blocks), "tag": tag, "pieces": []}
            self.blocks.append(self.open)
            self.around = []
        elif tag == "br":
            self._piece(True, None)
        elif self.open is not None and tag not in VOID:
            self.around.append((tag, dict(attrs).get("style") if tag == "span" else None))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self.open, self.around = None, []
        else:
            for i in range(len(self.around) - 1, -1, -1):
                if self.around[i][0] == tag:
                    del self.around[i:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.skip and data:
            self._piece(False, data)

    def _piece(self, is_break: bool, text: str | None) -> None:
        if self.open is None:
            return
        tags = {t for t, _ in self.around}
        self.open["pieces"].append({"is_break": is_break, "text": text, "bold": bool(tags & {"b", "strong"}) or None, "italic": bool(tags & {"i", "em"}) or None, "underline": "u" in tags or None, "css": [s for _, s in self.around if s]})


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, para_idx, tag, pieces of every block of every page."""
    kind = dict(pages.dtypes)[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, html):
            out = []
            for page in batch.column(html).to_pylist():
                parser = _Blocks()
                parser.feed(page or "")
                parser.close()
                out.append(parser.blocks)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, _BLOCKS)], [key, "blocks"])

    raw = pages.select(key, html).mapInArrow(read, f"{key} {kind}, blocks {RAW}")
    return raw.select(key, F.explode("blocks").alias("b")).select(key, "b.*")


def paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, para_idx, tag, runs, text of every block; inline styles are parsed on the JVM side."""

    def run(p):
        own = style(bold=p["bold"], italic=p["italic"], underline=p["underline"])
        inherited = F.aggregate(p["css"], style(), lambda acc, css: merge_styles(acc, parse_css(css)))
        return F.struct(p["is_break"].alias("is_break"), p["text"].alias("text"), F.when(p["is_break"], style()).otherwise(merge_styles(inherited, own)).alias("style")).cast(RUN)

    rows = blocks(pages, key, html).withColumn("runs", merge_adjacent(F.transform("pieces", run)))
    return rows.select(F.col(key).alias("doc_id"), "para_idx", "tag", "runs", runs_text(F.col("runs")).alias("text"))
