"""Template tokens: ``{{placeholders}}`` and ``!snippets``: scanning, names, filling and expanding."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.patterns import WORD_END, WS, WS_CHARS, ends_trimmed, regex_hits, replacement_column
from leafmill.functions.text import sanitize_xml

# The tokens' patterns.
PLACEHOLDER = r"\{\{" + WS + r"*([a-zA-Z0-9_.-]+)" + WS + r"*\}\}"
TRIGGER = r"!([a-zA-Z][a-zA-Z0-9_-]*)" + WORD_END
DELIMITER = f"(?=[{WS_CHARS}.,;:!?)\\]}}])"


def _token_hits(text: Column, pattern: str, kind: str) -> Column:
    def one(h: Column) -> Column:
        name = F.regexp_extract(h["before"], pattern.replace(WORD_END, ""), 1)
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), h["before"].alias("token"), h["start"].alias("start"), h["end"].alias("end"))

    return F.transform(regex_hits(text, pattern), one)


def placeholder_hits(text: Column) -> Column:
    """Array of (kind, name, token, start, end)."""
    return _token_hits(text, PLACEHOLDER, "placeholder")


def trigger_hits(text: Column) -> Column:
    return _token_hits(text, TRIGGER, "snippet")


def placeholder_name(raw: Column) -> Column:
    """The bare name, or "" if it isn't one."""
    s = ends_trimmed(F.regexp_replace(ends_trimmed(raw), r"^\{\{" + WS + "*|" + WS + r"*\}\}\z", ""))
    return F.when(s.rlike(r"^[a-zA-Z0-9_.-]+\z"), s).otherwise("")


def placeholder_token(name: Column) -> Column:
    return F.concat(F.lit("{{"), ends_trimmed(name), F.lit("}}"))


def field_label(name: Column) -> Column:
    return F.translate(name, "_-", "  ")


def snippet_name(raw: Column) -> Column:
    s = F.regexp_replace(ends_trimmed(raw), "^!+", "")
    return F.when(s.rlike(r"^[a-zA-Z][a-zA-Z0-9_-]*\z"), s).otherwise("")


def snippet_trigger(name: Column) -> Column:
    return F.concat(F.lit("!"), ends_trimmed(name))


def clock(as_of: Column, lang: str = "pl") -> dict[str, Column]:
    """Date, time and weekday of ``as_of`` in the language's short forms."""

    def local(pattern: str) -> Column:
        locale = "en-US" if lang == "en" else "pl-PL"
        return F.to_csv(F.struct(as_of.alias("t")), {"timestampFormat": pattern, "locale": locale, "sep": chr(1)})

    date, time = (local("MMM d, yyyy"), local("h:mm a")) if lang == "en" else (local("d MMM yyyy"), local("HH:mm"))
    return {"date": date, "time": time, "datetime": F.concat_ws(" ", date, time), "day": local("EEEE")}


def resolve_body(body: Column, as_of: datetime, lang: str = "pl") -> Column:
    """Dynamic tokens of a snippet body; ``{cursor}`` vanishes."""
    at = F.lit(as_of).cast("timestamp")
    for name, value in (clock(at, lang) | {"cursor": F.lit("")}).items():
        body = F.regexp_replace(body, F.lit(r"(?i)\{" + name + r"\}"), replacement_column(value))
    return body


def _fold(text: Column, entries: Column, make: Callable[[Column], Column]) -> Column:
    """(text, count) after replacing by each entry (key, value) in turn."""
    zero = F.struct(text.alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, e: Column) -> Column:
        p = make(e["key"])
        return F.struct(F.regexp_replace(acc["text"], p, replacement_column(sanitize_xml(e["value"]))).alias("text"), (acc["n"] + F.regexp_count(acc["text"], p)).alias("n"))

    return F.aggregate(entries, zero, step)


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def fill(text: Column, values: Column) -> Column:
    """Struct (text, n): placeholders filled from a map, entry by entry; null and empty values are skipped."""
    entries = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return _fold(text, entries, lambda k: F.concat(F.lit(r"\{\{" + WS + "*"), _quoted(k), F.lit(WS + r"*\}\}")))


def expand(text: Column, bodies: Column, mode: str = "manual") -> Column:
    """Struct (text, n): triggers replaced by their bodies (a map), longest names first.

    ``mode="auto"`` only expands triggers that a delimiter follows.
    """
    by_length = F.array_sort(F.map_entries(bodies), lambda a, b: F.when(F.length(a["key"]) != F.length(b["key"]), F.length(b["key"]) - F.length(a["key"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    tail = DELIMITER if mode == "auto" else WORD_END
    return _fold(text, by_length, lambda k: F.concat(F.lit("!"), _quoted(k), F.lit(tail)))


def literal_map(pairs: Mapping[str, str] | Iterable[tuple[str, str]]) -> Column:
    items = list(pairs.items() if isinstance(pairs, Mapping) else pairs)
    return F.create_map(*(F.lit(x) for kv in items for x in kv)) if items else F.create_map().cast("map<string,string>")

