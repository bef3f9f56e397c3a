"""String functions: edits, counts and display forms. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.patterns import WS, WS_CHARS, ends_trimmed, fast, literal_pattern, literal_replacement, regex_hits


def sanitize_xml(text: Column) -> Column:
    """Drops characters that XML 1.0 forbids."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def replace_literal(text: Column, find: str, repl: str) -> Column:
    """Case-sensitive, left to right."""
    return F.replace(text, F.lit(find), F.lit(repl))


def replace_regex(text: Column, pattern: str, repl: str) -> Column:
    """Regex search; the replacement is literal."""
    return F.regexp_replace(text, pattern, literal_replacement(repl))


def count_literal(text: Column, find: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / F.lit(len(find))).cast("int")


def count_regex(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def find_all(text: Column, find: str, regex: bool = False) -> Column:
    """Case-insensitive search: array of (start, end, before)."""
    return regex_hits(text, "(?iu)" + (find if regex else literal_pattern(find)))


def title_case(text: Column) -> Column:
    """First letter of each run of letters upper, the rest lower."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{M}]*|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def upper_char(c: Column) -> Column:
    """The capital of one character, as one character: ß becomes ẞ, and what has no single capital stays as it is."""
    single = lambda x, other: F.when(F.length(x) <= 1, x).otherwise(other)
    return F.when(c == "ß", "ẞ").otherwise(single(F.upper(c), single(F.initcap(c), c)))


def trim_ends(text: Column) -> Column:
    return ends_trimmed(text)


def trim_collapse(text: Column) -> Column:
    return ends_trimmed(F.regexp_replace(text, fast(f"{WS}+"), " "))


def trim_hard(text: Column) -> Column:
    return ends_trimmed(F.regexp_replace(text, r"[\x{A0}\x{2007}\x{202F}]", " "))


def affix(text: Column, prefix: str = "", suffix: str = "") -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(prefix), text, F.lit(suffix))).otherwise(text)


def collapse_keep_newlines(text: Column) -> Column:
    """Runs of white space other than newlines become one space; CRLF becomes LF; ends are trimmed."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return ends_trimmed(F.regexp_replace(lf, f"[{WS_CHARS}&&[^\n]]+", " "))


def splice(text: Column, start: Column, end: Column, after: Column) -> Column:
    """The text with [start, end) replaced by ``after``."""
    return F.concat(F.left(text, start), after, F.substr(text, end + 1))


def hit_snippet(text: Column, start: Column, end: Column, before: Column, after: Column, context: int = 18, most: int = 80) -> Column:
    left = F.substr(text, F.greatest(start - context, F.lit(0)) + 1, start - F.greatest(start - context, F.lit(0)))
    right = F.substr(text, end + 1, F.lit(context))
    shown, fixed = ends_trimmed(F.concat(left, before, right)), ends_trimmed(F.concat(left, after, right))
    out = F.concat(F.lit('"'), shown, F.lit('" → "'), fixed, F.lit('"'))
    return F.when(F.length(out) > most, F.concat(F.left(out, F.lit(most - 1)), F.lit("…"))).otherwise(out)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if something was cut: 72 -> 69 + …, 80 -> 77 + …."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("…"))).otherwise(text)


def file_size(n: Column) -> Column:
    kb, mb = F.format_string("%.1f KB", n / 1024.0), F.format_string("%.1f MB", n / 1048576.0)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, kb).otherwise(mb)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def words(text: Column) -> Column:
    return F.filter(F.split(text, fast(f"{WS}+"), -1), lambda w: F.length(w) > 0)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def output_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"(?i)\.docx$", ""), F.lit("_edited.docx"))


def with_extension(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".docx"), name).otherwise(F.concat(name, F.lit(".docx")))


def file_type(name: Column, mime: Column | None = None) -> Column:
    """docx, pdf or unsupported, by MIME type or extension."""
    low, kind = F.lower(name), F.coalesce(F.lower(mime), F.lit("")) if mime is not None else F.lit("")
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    return F.when(low.endswith(".docx") | (kind == word), "docx").when(low.endswith(".pdf") | (kind == "application/pdf"), "pdf").otherwise("unsupported")
