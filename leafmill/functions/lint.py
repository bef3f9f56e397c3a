"""Typography rules: each finds its hits (offsets, before, after) and fixes a text. Rules are Columns, so a whole
corpus is scanned in one projection; new ones join by building a :class:`Rule`."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.patterns import NOT_WS, WORD_START, WS, fast, let, rebuild, regex_hits
from leafmill.model import HIT

# The rules' patterns and their languages.
DOUBLE_SPACE = " {2,}"
SPACE_BEFORE = WS + "+([,.;:!?])"
ELLIPSIS = r"\.{3}"
QUOTES = '"([^"\\n]+)"'
CAPITAL = "(^|[.!?]" + WS + "+)([a-ząćęłńóśźż])"
ORPHAN = "(" + NOT_WS + "+)" + WS + r"+(i)\." + WS + r"*\z"
SINGLE_LETTER = "(?i)" + WORD_START + "([wzioua])" + WS + "+"
NBSP = chr(0xA0)
#: The same hits as ORPHAN has, tried once a word, and the end that a text with a hit has.
_ORPHAN_ONCE = f"(?<!{NOT_WS})({NOT_WS}++){WS}++(i)\\.{WS}*\\z"
_LAST_I = f"i\\.{WS}*\\z"


@dataclass(frozen=True)
class Rule:
    id: str
    langs: tuple[str, ...]
    pattern: str
    hits: Callable[[Column], Column]
    fix: Callable[[Column], Column]
    optional: bool = False
    #: A cheap pattern that every text with a hit matches; others are not searched.
    only: str | None = None

    def count(self, text: Column) -> Column:
        """How many hits a text has, without placing them."""
        n = F.regexp_count(text, F.lit(fast(self.pattern)))
        return n if self.only is None else F.when(text.rlike(fast(self.only)), n).otherwise(F.lit(0))


def _after(pattern: str, after: Callable[[Column], Column], cut: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """Hits of a pattern; ``cut`` is the length of a leading part that the hit leaves out."""

    def hits(text: Column) -> Column:
        def one(h: Column) -> Column:
            skip = cut(h["before"]) if cut else F.lit(0)
            before = F.substr(h["before"], skip + 1) if cut else h["before"]
            return F.struct((h["start"] + skip).cast("int").alias("start"), h["end"].alias("end"), before.alias("before"), after(before).alias("after"))

        return F.transform(regex_hits(text, pattern), one).cast(f"array<{HIT}>")

    return hits


def _sub(pattern: str, repl: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, fast(pattern), repl)


def _orphan_hits(text: Column) -> Column:
    found = _after(_ORPHAN_ONCE, _sub(ORPHAN, "$2 $1."))(text)
    return F.when(text.rlike(fast(_LAST_I)), found).otherwise(F.array().cast(f"array<{HIT}>"))


def _orphan_fix(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(fast(_LAST_I)), _sub(_ORPHAN_ONCE, "$2 $1.")(t)).otherwise(t))


RULES = (
    Rule("double-space", ("pl", "en"), DOUBLE_SPACE, _after(DOUBLE_SPACE, lambda b: F.lit(" ")), _sub(DOUBLE_SPACE, " ")),
    Rule("space-before-punct", ("pl", "en"), SPACE_BEFORE, _after(SPACE_BEFORE, lambda b: F.right(b, F.lit(1))), _sub(SPACE_BEFORE, "$1")),
    Rule("ellipsis", ("pl", "en"), ELLIPSIS, _after(ELLIPSIS, lambda b: F.lit("…")), _sub(ELLIPSIS, "…")),
    Rule("quotes-pl", ("pl",), QUOTES, _after(QUOTES, lambda b: F.concat(F.lit("„"), F.substr(b, F.lit(2)))), _sub(QUOTES, "„$1\"")),
    Rule(
        "cap-after-period",
        ("pl", "en"),
        CAPITAL,
        _after(CAPITAL, F.upper, lambda b: F.length(b) - 1),
        lambda c: rebuild(c, CAPITAL, lambda m: F.concat(F.left(m, F.length(m) - 1), F.upper(F.right(m, F.lit(1))))),
    ),
    Rule("orphan-i", ("pl",), _ORPHAN_ONCE, _orphan_hits, _orphan_fix, only=_LAST_I),
    Rule("nbsp-pl", ("pl",), SINGLE_LETTER, _after(SINGLE_LETTER, lambda b: F.concat(F.left(b, F.lit(1)), F.lit(NBSP))), _sub(SINGLE_LETTER, "$1" + NBSP), optional=True),
)


def enabled(lang: str | None = "pl", ids: Iterable[str] = (), nbsp: bool = False) -> tuple[Rule, ...]:
    """Rules of a language (None: of any), optionally only some; optional ones only on demand."""
    ids = set(ids)
    return tuple(r for r in RULES if (not ids or r.id in ids) and (nbsp or not r.optional) and (lang is None or lang in r.langs))


def scan(text: Column, rules: Iterable[Rule], lang: Column | None = None) -> Column:
    """Array of (rule_id, ord, start, end, before, after) of all rules; ``lang`` switches rules row by row."""
    parts = []
    for rule in rules:
        found = F.transform(rule.hits(text), _numbered(rule.id))
        parts.append(found if lang is None else F.when(lang.isin(*rule.langs), found).otherwise(F.slice(found, 1, 0)))
    return F.flatten(F.array(*parts))


def counts(text: Column, rules: Iterable[Rule], lang: Column | None = None) -> Column:
    """Array of (rule_id, n) of the rules that have hits."""
    each = [F.struct(F.lit(r.id).alias("rule_id"), (r.count(text) if lang is None else F.when(lang.isin(*r.langs), r.count(text)).otherwise(0)).alias("n")) for r in rules]
    return F.filter(F.array(*each), lambda x: x["n"] > 0)


def _numbered(rule_id: str) -> Callable[[Column, Column], Column]:
    return lambda h, i: F.struct(F.lit(rule_id).alias("rule_id"), i.cast("int").alias("ord"), *(h[c].alias(c) for c in ("start", "end", "before", "after")))


def fix(text: Column, rules: Iterable[Rule], lang: Column | None = None) -> Column:
    """All fixes in list order."""
    return reduce(lambda c, r: r.fix(c) if lang is None else let(c, lambda t: F.when(lang.isin(*r.langs), r.fix(t)).otherwise(t)), rules, text)
