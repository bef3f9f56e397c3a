"""Secret scans through a trigram index.

Each rule is a regex over bytes. :func:`trigram_query` derives from it which trigrams every match must hold, as an
AND/OR tree. A segment (a slice of a task's documents) gets an inverted index of the trigrams that the queries name:
trigram -> numbers of the documents that hold it. Intersecting and joining these postings gives a rule's candidate
documents; only those are matched against the regex. A rule without mandatory trigrams (long hex runs) scans every
document. The index folds A-Z, so it only ever admits more candidates, and it covers whole texts.

Base rules: ``assign``, ``access``, ``hex``; further ones add spans. Offsets are code points, end exclusive.

Defined cases: null text is empty and has no spans; repeated rows give repeated results; texts are scanned whole,
however long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import LEAD, LOWER, buffers, runs, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0  # whose length is held against `least`
    least: int = 0

    def compiled(self) -> re.Pattern[bytes]:
        return re.compile(self.pattern.encode(), re.IGNORECASE if self.ignore_case else 0)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
RULES = (
    *BASE_RULES,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

#: Query trees: True (no condition), a frozenset of alternatives (one trigram must occur), ("and"|"or", parts).
Query = object
_MOST = 64  # strings that an exact set may hold before it is turned into a query


def _grams(strings: set[bytes]) -> Query:
    """One of the strings occurs, so all trigrams of one of them do."""
    if any(len(s) < 3 for s in strings):
        return True
    return _any([("and", tuple(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


def _all(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def trigram_query(pattern: str) -> Query:
    """The condition on (folded) trigrams that every match of ``pattern`` meets; True if there is none."""
    parser = re._parser  # the standard library's own regex parser
    exact, query = _walk(parser.parse(pattern.encode()))
    return _all([query, _grams(exact)]) if exact else query


def _walk(seq) -> tuple[set[bytes] | None, Query]:
    """The exact strings that the sequence can match (None: unknown) and a condition on what surrounds them."""
    now: set[bytes] | None = {b""}
    parts: list[Query] = []

    def flush() -> None:
        nonlocal now
        if now:
            parts.append(_grams(now))
        now = None

    for op, arg in seq:
        name = str(op)
        strings, query = None, True
        if name == "LITERAL":
            strings = {bytes([arg]).lower()}
        elif name == "IN":
            chars = _chars(arg)
            strings = {bytes([c]) for c in chars} if chars and len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            strings, query = _walk(arg[3])
        elif name == "BRANCH":
            each = [_walk(a) for a in arg[1]]
            if all(s is not None for s, _ in each) and all(q is True for _, q in each):
                strings = set().union(*(s for s, _ in each))
            else:
                query = _any([_all([q, _grams(s)]) if s else q for s, q in each])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            s, q = _walk(inner)
            if low == 0 and high == 1 and s is not None and q is True:
                strings = s | {b""}
            elif low > 0:
                query = _all([q, _grams(s)]) if s else q
        if strings is not None and now is not None and len(now) * len(strings) <= _MOST:
            now = {a + b for a, b in product(now, strings)}
        else:
            flush()
            now = strings
        parts.append(query)
    if not any(p is not True for p in parts):
        return now, True
    if now:
        parts.append(_grams(now))
    return None, _all(parts)


def _chars(items) -> set[int] | None:
    out: set[int] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(arg)
        elif str(op) == "RANGE":
            out.update(range(arg[0], arg[1] + 1))
        else:
            return None
    return {bytes([c]).lower()[0] for c in out}


def _named(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class SegmentIndex:
    """Postings of the trigrams that the rules' queries name, for one slice of documents."""

    def __init__(self, grams: list[bytes]):
        self.grams = grams
        self.number = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(grams):
            self.number[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def postings(self, buf: np.ndarray, off: np.ndarray) -> dict[bytes, np.ndarray]:
        low = LOWER[buf].astype(np.uint32)
        code = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else np.empty(0, np.uint16)
        at = np.flatnonzero(code)
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[doc + 1]
        pairs = np.unique(code[at[inside]].astype(np.int64) << 32 | doc[inside])
        cuts = np.searchsorted(pairs, np.arange(1, len(self.grams) + 2, dtype=np.int64) << 32)
        return {g: pairs[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF for i, g in enumerate(self.grams)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Documents that meet the query: postings intersected under "and", joined under "or"."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings[query]
    kind, parts = query
    got = [candidates(p, postings, n) for p in parts]
    out = got[0]
    for g in sorted(got[1:], key=len):
        out = np.intersect1d(out, g, assume_unique=True) if kind == "and" else np.union1d(out, g)
    return out


def scanner(rules: tuple[Rule, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int]]]]]]:
    """For each slice of a batch, the (start, rule number, end) spans of each document by start and rule."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int]]]]]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [r.compiled() for r in rules]
        index = SegmentIndex(sorted(set().union(*map(_named, queries))))
        for whole in batches:
            for batch in runs(whole):
                buf, off = buffers(batch.column("text"))
                raw, postings = buf.tobytes(), index.postings(buf, off)
                spans: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
                for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
                    for d in candidates(query, postings, batch.num_rows).tolist():
                        a, b = int(off[d]), int(off[d + 1])
                        for m in pattern.finditer(raw, a, b):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                spans[d].append((m.start() - a, k, m.end() - a))
                for d, found in enumerate(spans):
                    if found:
                        text = buf[off[d] : off[d + 1]]
                        # matches are ASCII, so a byte offset is a code point offset plus the continuation bytes before it
                        extra = np.concatenate([[0], np.cumsum(~LEAD[text])])
                        spans[d] = sorted((s - int(extra[s]), k, e - int(extra[e])) for s, k, e in found)
                yield batch, spans

    return scan


SPANS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest and list of spans per document; the first three rules are the base."""
    scan = scanner(rules)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in scan(batches):
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for found in spans:
                told = [f"{rules[k].kind}:{s}:{e}" for s, k, e in found]
                base = ",".join(t for t, f in zip(told, found) if f[1] < 3)
                for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                    out[c].append(sum(f[1] == k for f in found))
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(",".join(told))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(report, SPANS)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each found span (overlapping ones joined) replaced by ``[secret]``; all columns stay as they are,
    but ``n_chars``, if there, follows the text."""
    scan = scanner(rules)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in scan(batches):
            if any(spans):
                texts = batch.column("text").to_pylist()
                for d, found in enumerate(spans):
                    if found:
                        parts, at = [], 0
                        for s, _, e in found:
                            if s >= at:
                                parts += [texts[d][at:s], "[secret]"]
                            at = max(at, e)
                        texts[d] = "".join([*parts, texts[d][at:]])
                k = batch.schema.get_field_index("text")
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
            yield batch

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op5_sql() -> str:
    """Starts by adding up the gaps and matches before each match."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, {k} AS k, '{rule.kind}' AS kind, s, s + len(m) AS e
  FROM (SELECT r, m, sum(len(g)) OVER w + coalesce(sum(len(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT r, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
              FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d) WHERE len(ms) > 0)
        WINDOW w AS (PARTITION BY r ORDER BY i))
  WHERE len(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hit AS ({' UNION ALL '.join(parts)}),
told AS (
  SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS every
  FROM (SELECT r, k, kind, s::BIGINT AS s, e::BIGINT AS e FROM hit) GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN told USING (r)
"""
