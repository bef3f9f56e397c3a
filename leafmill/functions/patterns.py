"""Regular expressions as Columns: match positions, gaps and literal replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the documents' own scripting dialect, wider than Java's \s.
WS_CHARS = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
# The same white space for the JVM: one look at a bit set and one at a range reject every other character.
_JVM_CHARS = r"\t\n\x0B\f\r \x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
#: ASCII word boundaries; Java's \b also knows other letters.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def literal_pattern(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def literal_replacement(text: str) -> str:
    """Replacement text in which nothing is expanded."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replacement_column(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def fast(pattern: str) -> str:
    """The pattern with ``WS`` and ``NOT_WS`` in a form that the JVM matches faster."""
    return pattern.replace(NOT_WS, f"[^{_JVM_CHARS}]").replace(WS, f"[{_JVM_CHARS}]")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(fast(pattern)), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    """What stands between the matches: always one more than there are matches."""
    return F.split(text, fast(pattern), -1)


def split_up(text: Column, pattern: str) -> Column:
    """Struct (hits, gaps) of the matches, also of a pattern that can match nothing.

    The JVM's split leaves out what stands before an empty match at the start; it is put back where a gap is missing."""
    pair = F.struct(matches(text, pattern).alias("hits"), gaps(text, pattern).alias("gaps"))
    full = lambda p: F.when(F.size(p["gaps"]) <= F.size(p["hits"]), F.concat(F.array(F.lit("")), p["gaps"])).otherwise(p["gaps"])
    return let(pair, lambda p: F.struct(p["hits"].alias("hits"), full(p).alias("gaps")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running_sum(values: Column) -> Column:
    """Sums up to and including each item, by doubling distances: n log n steps, no list is ever copied per item."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - far), F.lit(0)))

    return F.aggregate(rounds, values, step)


def regex_hits(text: Column, pattern: str) -> Column:
    """Array of (start, end, before) of all matches, empty ones too."""

    def placed(p: Column) -> Column:
        lengths = F.zip_with(p["hits"], F.slice(p["gaps"], F.lit(1), F.size(p["hits"])), lambda hit, gap: F.length(gap) + F.length(hit))
        at = lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("before"))
        return let(lengths, lambda n: F.zip_with(p["hits"], running_sum(n), at))

    return let(split_up(text, pattern), placed)


def rebuild(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match sent through ``change``."""

    def joined(p: Column) -> Column:
        parts = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])), p["hits"], lambda gap, hit: F.concat(gap, change(hit)))
        return F.concat(F.array_join(parts, ""), F.element_at(p["gaps"], -1))

    return let(text, lambda t: let(F.struct(matches(t, pattern).alias("hits"), gaps(t, pattern).alias("gaps")), joined))


def ends_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, fast(f"^{WS}+|(?<!{WS}){WS}+\\z"), "")
