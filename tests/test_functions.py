"""Columns on literal inputs."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.functions import lint, runs, text, tokens
from leafmill.operators.edits import edit_column
from leafmill.operators.paragraphs import check_pattern, in_scope


@pytest.fixture(scope="module")
def one(spark):
    def value(*columns):
        got = spark.range(1).select(*columns).first()
        return got[0] if len(columns) == 1 else tuple(got)

    return value


L = F.lit


def test_typography(one):
    t = L("Piec  stygnie , a glina i.")
    hits = one(lint.scan(t, lint.enabled("pl")))
    assert [(h["rule_id"], h["start"], h["end"], h["before"], h["after"]) for h in hits] == [
        ("double-space", 4, 6, "  ", " "),
        ("space-before-punct", 13, 15, " ,", ","),
        ("orphan-i", 18, 26, "glina i.", "i glina."),
    ]
    assert one(lint.fix(t, lint.enabled("pl"))) == "Piec stygnie, a i glina."
    assert one(lint.scan(L("Piec stygnie, a i glina."), lint.enabled("pl"))) == []
    assert len(one(lint.scan(t, lint.enabled("en")))) == 2
    assert lint.enabled("fr") == ()


def test_hits_take_linear_time(spark):
    """Eight times the hits of one text take about eight times as long, not sixty-four times."""
    import time

    from leafmill.functions.patterns import regex_hits

    def took(n):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            spark.range(1).select(F.repeat(L("a  "), n).alias("t")).select(F.size(regex_hits(F.col("t"), " {2,}")).alias("n")).collect()
            best = min(best, time.perf_counter() - began)
        return best

    took(100)
    assert took(80_000) < 24 * max(took(10_000), 0.1)


def test_hits_of_many_lengths(one):
    from leafmill.functions.patterns import regex_hits

    for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 31, 33):
        t = "é" + "".join(f"{'x' * (i % 5)}{' ' * (1 + i % 3)}" for i in range(n))
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(" +", t)]
        assert [tuple(h) for h in one(regex_hits(L(t), " +"))] == want


def test_adjacent_runs_of_one_style_merge(one):
    none, bold = runs.style(), runs.style(bold=L(True))
    run = lambda t, s, brk=False: F.struct(L(brk).alias("is_break"), L(t).cast("string").alias("text"), s.alias("style"))
    given = F.array(run("a", none), run("b", runs.style(color=L(""))), run(None, none, True), run(None, none, True), run("c", none), run("d", bold), run(None, bold), run("e", bold))
    got = one(runs.merge_adjacent(given))
    assert [(r["is_break"], r["text"], r["style"]["bold"]) for r in got] == [(False, "ab", None), (True, None, None), (True, None, None), (False, "c", None), (False, "de", True)]
    assert one(runs.merge_adjacent(F.array().cast(runs.RUNS))) == []


def test_typography_quirks(one):
    quotes = lint.enabled("pl", ["quotes-pl"])
    assert one(lint.fix(L('"raz" x "dwa"'), quotes)) == '„raz" x „dwa"'
    assert one(lint.fix(lint.fix(L('"raz" x "dwa"'), quotes), quotes)) == '„raz„ x „dwa"'
    assert one(lint.fix(L("Tak.... nie"), lint.enabled("pl", ["ellipsis"]))) == "Tak…. nie"
    nb = chr(160)
    assert one(lint.fix(L("stąd w lesie i a, róża x"), lint.enabled("pl", ["nbsp-pl"], nbsp=True))) == f"stąd w{nb}lesie i{nb}a, róża{nb}x"
    assert not any(r.id == "nbsp-pl" for r in lint.enabled("pl"))


def test_placeholders(one):
    t = L("Piec {{numer}} {{typ}}, start {{dzien}}.")
    assert [(h["name"], h["start"], h["end"]) for h in one(tokens.placeholder_hits(t))] == [("numer", 5, 14), ("typ", 15, 22), ("dzien", 30, 39)]
    full = one(tokens.fill(t, tokens.literal_map({"numer": "7", "typ": "gazowy", "dzien": "2031-02-03"})))
    assert (full["text"], full["n"]) == ("Piec 7 gazowy, start 2031-02-03.", 3)
    assert one(tokens.fill(L("B {{ u }} {{v}}"), tokens.literal_map({"u": "1", "v": "{{u}}"})))["text"] == "B 1 {{u}}"
    assert one(tokens.fill(L("A {{ x }}"), tokens.literal_map({"x": "$1"})))["text"] == "A $1"
    assert one(tokens.fill(L("A {{x}}"), tokens.literal_map({"x": ""})))["n"] == 0
    assert one(tokens.placeholder_name(L(" {{ a.b }} "))) == "a.b"
    assert one(tokens.placeholder_name(L("a b"))) == ""


def test_snippets(one):
    t = L("Start !opis koniec.")
    assert [(h["name"], h["start"], h["end"]) for h in one(tokens.trigger_hits(t))] == [("opis", 6, 11)]
    grown = one(tokens.expand(t, tokens.literal_map({"opis": "Piec nr {{numer}}."})))
    assert grown["text"] == "Start Piec nr {{numer}}. koniec."
    assert one(tokens.expand(L("yo !top, !top"), tokens.literal_map({"top": "T"}), "auto"))["text"] == "yo T, !top"
    assert one(tokens.expand(L("!pot-lid !pots"), tokens.literal_map({"pot": "X"})))["text"] == "X-lid !pots"
    assert one(tokens.snippet_name(L("!!ab-c"))) == "ab-c"
    assert one(tokens.snippet_name(L("1a"))) == ""


def test_dynamic_bodies(one):
    at = datetime(2031, 2, 3, 16, 7)
    assert one(tokens.resolve_body(L("{date}, godz. {time}"), at, "pl")) == "3 lut 2031, godz. 16:07"
    english = one(tokens.resolve_body(L("{date}, godz. {time}"), at, "en")).replace(chr(0x202F), " ")
    assert english == "Feb 3, 2031, godz. 4:07 PM"
    assert one(tokens.resolve_body(L("{DAY}|{cursor}|"), at, "pl")) == "poniedziałek||"


def test_text(one):
    assert one(text.title_case(L("O'NEIL foo-BAR łódź 3abc"))) == "O'Neil Foo-Bar Łódź 3Abc"
    assert len(one(text.find_all(L("Łódź łódź"), "łó"))) == 2
    assert one(text.file_size(L(100)), text.file_size(L(2048)), text.file_size(L(3 << 20))) == ("100 B", "2.0 KB", "3.0 MB")
    assert one(text.file_size(L(124_160)), text.file_size(L(1536))) == ("121.3 KB", "1.5 KB")  # exactly 121.25: ties go up
    assert one(text.collapse_keep_newlines(L("  a \t b\r\n c  "))) == "a b\n c"
    assert one(text.replace_regex(L("abc"), "b", "$0$0")) == "a$0$0c"
    assert one(text.replace_literal(L("a.b.c"), ".", "$1")) == "a$1b$1c"
    assert one(text.trim_ends(L(chr(160) + " a " + chr(0xFEFF)))) == "a"
    assert one(text.output_name(L("x.DOCX")), text.with_extension(L("x"))) == ("x_edited.docx", "x.docx")
    assert one(text.file_type(L("a.pdf")), text.file_type(L("a.DOCX")), text.file_type(L("a.txt"))) == ("pdf", "docx", "unsupported")
    assert one(text.count_literal(L("aaaa"), "aa"), text.count_regex(L("aaaa"), "a")) == (2, 4)


def test_validation(spark):
    with pytest.raises(ValueError, match="empty-find"):
        edit_column(L("x"), "replace", find="")
    with pytest.raises(ValueError, match="empty-affix"):
        edit_column(L("x"), "affix")
    with pytest.raises(ValueError, match="unknown-op"):
        edit_column(L("x"), "zap")
    with pytest.raises(ValueError, match="bad-regex"):
        check_pattern(spark, "(")
    with pytest.raises(ValueError):
        in_scope(spark.range(1), "head")


def test_css(one):
    assert one(runs.css_color(L("rgba(255, 0, 16, .5)")), runs.css_color(L("#a1b2c3")), runs.css_color(L("red"))) == ("FF0010", "A1B2C3", None)
    assert one(runs.css_size(L("13px")), runs.css_size(L("10.5pt")), runs.css_size(L("12"))) == (10.0, 10.5, 12.0)
    got = one(runs.parse_css(L("font-weight: 700; FONT-FAMILY: 'Courier New', mono; color:red;font-size:14pt; text-decoration: underline")))
    assert (got["bold"], got["italic"], got["underline"], got["color"], got["font_size"]) == (True, None, True, "red", "14pt")
    assert one(runs.style_css(runs.style(bold=L(True), color=L("#FF0000")))) == "font-weight:bold;color:#FF0000"
    assert one(runs.styles_equal(runs.style(color=L("")), runs.style(bold=L(False)))) is True
    assert one(runs.merge_styles(runs.style(color=L("red"), bold=L(True)), runs.style(color=L(""))))["color"] == "red"
