"""Styled runs as structs: colours, sizes, inline CSS, equality, merging and serialisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.patterns import ends_trimmed, let
from leafmill.functions.text import escape_html
from leafmill.model import RUN, RUNS, STYLE

FLAGS, NAMES = ("bold", "italic", "underline"), ("color", "font_family", "font_size")


def style(**given: Column) -> Column:
    """A style struct; what is not given is null."""
    return F.struct(*(given.get(k, F.lit(None)).cast("boolean" if k in FLAGS else "string").alias(k) for k in (*FLAGS, *NAMES))).cast(STYLE)


def css_color(c: Column) -> Column:
    """RRGGBB of rgb(), rgba() or #hex, else null."""
    pattern = r"(?i)rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    parts = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    hexed = [F.conv(p, 10, 16) for p in parts]
    rgb = F.concat(*(F.when(F.length(h) < 2, F.concat(F.lit("0"), h)).otherwise(h) for h in hexed))
    return F.when(c.rlike(pattern), F.upper(rgb)).when(c.startswith("#"), F.upper(F.substr(c, F.lit(2))))


def css_size(c: Column) -> Column:
    """Points (double): px become three quarters, rounded to half points; pt and bare numbers stay."""
    number = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1)
    value = F.when(number != "", number.try_cast("double"))
    return F.when(c.rlike(r"(?i)^[\d.]+px$"), F.floor(value * 0.75 * 2 + 0.5) / 2).otherwise(value)


def size_label(points: Column) -> Column:
    """12.0 -> 12pt, 10.5 -> 10.5pt."""
    return F.concat(F.regexp_replace(points.cast("string"), r"\.0$", ""), F.lit("pt"))


def parse_css(css: Column) -> Column:
    """Inline style text to a style struct; of repeated keys the last that says something wins."""
    pairs = F.transform(
        F.filter(F.split(F.coalesce(css, F.lit("")), ";", -1), lambda c: F.instr(c, ":") > 0),
        lambda c: F.struct(F.lower(ends_trimmed(F.substring_index(c, ":", 1))).alias("k"), ends_trimmed(F.substr(c, F.instr(c, ":") + 1)).alias("v")),
    )

    def values(key: str) -> Column:
        return F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"])

    def last(c: Column) -> Column:
        return F.try_element_at(c, F.lit(-1))

    weight = lambda v: (v == "bold") | (F.coalesce(F.regexp_extract(v, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)) >= 600)
    family = last(values("font-family"))
    sizes = F.filter(F.transform(values("font-size"), css_size), lambda s: s.isNotNull() & (s != 0))
    return style(
        bold=F.when(F.exists(values("font-weight"), weight), F.lit(True)),
        italic=F.when(F.exists(values("font-style"), lambda v: v == "italic"), F.lit(True)),
        underline=F.when(F.exists(values("text-decoration"), lambda v: F.contains(v, F.lit("underline"))), F.lit(True)),
        color=last(values("color")),
        font_family=ends_trimmed(F.substring_index(F.regexp_replace(family, "^[\"']|[\"']$", ""), ",", 1)),
        font_size=size_label(last(sizes)),
    )


def style_css(s: Column) -> Column:
    return F.concat_ws(
        ";",
        F.when(s["bold"], "font-weight:bold"),
        F.when(s["italic"], "font-style:italic"),
        F.when(s["underline"], "text-decoration:underline"),
        F.when(F.length(s["color"]) > 0, F.concat(F.lit("color:"), s["color"])),
        F.when(F.length(s["font_family"]) > 0, F.concat(F.lit('font-family:"'), s["font_family"], F.lit('"'))),
        F.when(F.length(s["font_size"]) > 0, F.concat(F.lit("font-size:"), s["font_size"])),
    )


def normal(s: Column) -> Column:
    """A style whose missing and empty properties are alike, for comparing."""
    return F.struct(*(F.coalesce(s[k], F.lit(False)).alias(k) for k in FLAGS), *(F.coalesce(s[k], F.lit("")).alias(k) for k in NAMES))


def styles_equal(a: Column, b: Column) -> Column:
    return normal(a) == normal(b)


def has_style(s: Column) -> Column:
    return normal(s) != F.struct(*(F.lit(False).alias(k) for k in FLAGS), *(F.lit("").alias(k) for k in NAMES))


def merge_styles(base: Column, over: Column) -> Column:
    """Properties of ``over`` win where they say something."""
    flags = [F.when(over[k], F.lit(True)).otherwise(base[k]).alias(k) for k in FLAGS]
    names = [F.coalesce(F.nullif(over[k], F.lit("")), base[k]).alias(k) for k in NAMES]
    return F.struct(*flags, *names).cast(STYLE)


def _brk(r: Column) -> Column:
    return F.coalesce(r["is_break"], F.lit(False))


def _alike(a: Column, b: Column) -> Column:
    """:func:`styles_equal` property by property, so no structs are made and the first that differs decides."""
    said = [F.coalesce(a[k], d) == F.coalesce(b[k], d) for names, d in ((FLAGS, F.lit(False)), (NAMES, F.lit(""))) for k in names]
    return a.eqNullSafe(b) | reduce(lambda x, y: x & y, said)


def _starts(r: Column) -> Column:
    """Places where a run starts that looks unlike the one before; a break is alone. Never named twice without ``let``."""
    on = F.zip_with(r, F.slice(r, 2, F.size(r)), lambda x, y: ~_brk(x) & ~_brk(y) & _alike(x["style"], y["style"]))
    found = let(on, lambda s: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | ~F.get(s, i - 1)))
    return F.when(F.size(r) > 0, found).otherwise(F.array().cast("array<int>"))


def _spans(r: Column) -> Column:
    """(at, n) of each run that :func:`merge_adjacent` makes."""
    span = lambda s: F.transform(s, lambda at, k: F.struct(at.alias("at"), (F.coalesce(F.get(s, k + 1), F.size(r)) - at).alias("n")))
    return let(_starts(r), span)


def _joined(texts: Column, span: Column) -> Column:
    """The text of a span; one or two runs by place, as a slice costs more than they do."""
    said = lambda at: F.coalesce(F.get(texts, at), F.lit(""))
    at, n = span["at"], span["n"]
    return F.when(n == 1, said(at)).when(n == 2, F.concat(said(at), said(at + 1))).otherwise(F.array_join(F.slice(texts, at + 1, n), ""))


def merge_adjacent(runs: Column) -> Column:
    """Joins neighbours of equal style; breaks stay apart. One pass finds where runs start, one joins what lies between."""

    def joined(r: Column, spans: Column) -> Column:
        def one(texts: Column, u: Column) -> Column:
            first = F.get(r, u["at"])
            grown = F.struct(F.lit(False).alias("is_break"), _joined(texts, u).alias("text"), first["style"].alias("style")).cast(RUN)
            return F.when(u["n"] == 1, first.cast(RUN)).otherwise(grown)

        return let(r["text"], lambda texts: F.transform(spans, lambda u: one(texts, u)))

    return let(runs, lambda r: let(_spans(r), lambda s: F.when(F.size(s) < F.size(r), joined(r, s)).otherwise(r.cast(RUNS))))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.when(r["is_break"], "\n").otherwise(F.coalesce(r["text"], F.lit("")))), "")


def canonical(runs: Column) -> Column:
    """Merged runs whose missing and empty values are alike: equal for runs that look the same."""
    return F.transform(merge_adjacent(runs), lambda r: F.struct(_brk(r), F.when(~_brk(r), F.struct(F.coalesce(r["text"], F.lit("")), normal(r["style"])))))


def runs_equal(a: Column, b: Column) -> Column:
    """Same breaks, texts and styles once neighbours are merged, as :func:`canonical` has them; nothing is merged for it."""

    def side(r: Column) -> Column:
        return let(r, lambda x: F.struct(x.alias("runs"), x["text"].alias("texts"), _spans(x).alias("spans")))

    def same(p: Column, q: Column, u: Column, v: Column) -> Column:
        looks = lambda x, y: (_brk(x) == _brk(y)) & (_brk(x) | _alike(x["style"], y["style"]))
        x, y = F.get(p["runs"], u["at"]), F.get(q["runs"], v["at"])
        return looks(x, y) & (_brk(x) | (_joined(p["texts"], u) == _joined(q["texts"], v)))

    def all_same(p: Column, q: Column) -> Column:
        return F.forall(F.zip_with(p["spans"], q["spans"], lambda u, v: same(p, q, u, v)), lambda ok: ok)

    def both(p: Column, q: Column) -> Column:
        found = F.when(F.size(p["spans"]) == F.size(q["spans"]), all_same(p, q)).otherwise(False)
        return F.when(p["runs"].isNotNull() & q["runs"].isNotNull(), found)

    return let(side(a), lambda p: let(side(b), lambda q: both(p, q)))


def text_runs(text: Column) -> Column:
    """A plain text as runs: each newline is a break, empty parts keep an empty run."""
    parts = F.split(text, "\n", -1)
    run = lambda t: F.struct(F.lit(False).alias("is_break"), t.alias("text"), style().alias("style")).cast(RUN)
    gap = F.struct(F.lit(True).alias("is_break"), F.lit(None).cast("string").alias("text"), style().alias("style")).cast(RUN)
    return F.flatten(F.transform(parts, lambda t, i: F.when(i == 0, F.array(run(t))).otherwise(F.array(gap, run(t)))))


def runs_html(runs: Column) -> Column:
    def one(r: Column) -> Column:
        css, text = style_css(r["style"]), escape_html(F.coalesce(r["text"], F.lit("")))
        span = F.concat(F.lit('<span style="'), F.replace(css, F.lit('"'), F.lit("&quot;")), F.lit('">'), text, F.lit("</span>"))
        return F.when(r["is_break"], "<br>").when(css != "", span).otherwise(text)

    return F.array_join(F.transform(runs, one), "")


def runs_xml(runs: Column) -> Column:
    """WordprocessingML runs of a paragraph."""

    def one(r: Column) -> Column:
        s = r["style"]
        color = F.when(F.length(s["color"]) > 0, F.coalesce(css_color(s["color"]), F.upper(s["color"])))
        points = F.when(F.length(s["font_size"]) > 0, css_size(s["font_size"]))
        # all named once, since each use is computed again; what is null is left out
        rpr = F.concat_ws(
            "",
            F.lit("<w:rPr>"),
            F.when(F.length(s["font_family"]) > 0, let(_attr(s["font_family"]), lambda f: F.concat(F.lit('<w:rFonts w:ascii="'), f, F.lit('" w:hAnsi="'), f, F.lit('"/>')))),
            F.when(s["bold"], "<w:b/>"),
            F.when(s["italic"], "<w:i/>"),
            F.when(F.length(s["color"]) > 0, let(color, lambda c: F.when(F.length(c) > 0, F.concat(F.lit('<w:color w:val="'), _attr(c), F.lit('"/>'))))),
            F.concat(F.lit('<w:sz w:val="'), F.round(points * 2).cast("int").cast("string"), F.lit('"/>')),
            F.when(s["underline"], '<w:u w:val="single"/>'),
            F.lit("</w:rPr>"),
        )
        rpr = F.replace(rpr, F.lit("<w:rPr></w:rPr>"), F.lit(""))
        text = F.coalesce(r["text"], F.lit(""))
        space = F.when(F.left(text, F.lit(1)).rlike(r"\s") | F.right(text, F.lit(1)).rlike(r"\s"), ' xml:space="preserve"').otherwise("")
        return F.when(r["is_break"], "<w:r><w:br/></w:r>").otherwise(F.concat(F.lit("<w:r>"), rpr, F.lit("<w:t"), space, F.lit(">"), escape_html(text), F.lit("</w:t></w:r>")))

    return F.array_join(F.transform(runs, one), "")


def _attr(c: Column) -> Column:
    return F.replace(escape_html(c), F.lit('"'), F.lit("&quot;"))
