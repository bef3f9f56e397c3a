"""Edit logs: each document's own ordered edits, replayed by position on a piece table of its text nodes.

A document is a list of paragraphs, and a paragraph a list of text nodes and line breaks with their styles. An edit
touches the pieces it names: a split, merge or list level moves references, and a replacement, fill or expansion rewrites
only the nodes in which it finds something, so their styles stay. Transforms, splits, merges and batches set a
paragraph's whole text, which makes plain nodes of it. Every edit sees the positions that the last one left.

Paragraphs and edits are dealt by document once, as rows of one table that is sorted by document, edits first, and
Arrow batches of whole documents go through Python. Texts become nodes there, edits arrive as JSON and are made ready
(parsed, patterns compiled) once for all documents of a task that share them, and only rows and nodes that are asked for
are handed back. Documents without edits are passed on as they came.

=================  ====================================================================================================
``op``             what it takes from ``params`` (texts), ``items`` (index, text) and ``values`` (name to text)
=================  ====================================================================================================
null, replace      find, replace, regex (``true``), scope; on a document's last edit also skip and max
case, trim         mode, scope
affix              prefix, suffix, scope
paragraphBatch     items, one after the other
placeholderFill    values in order, scope; null and empty ones are skipped
snippetExpand      values, longest names first, scope
splitParagraph     index, before, after (also ``split``)
mergeParagraph     index of the paragraph that joins the one before it (also ``merge``)
listLevel          index, delta
=================  ====================================================================================================

Defined cases: an edit with an error (see :func:`edit_error`) changes nothing and is reported; positions beyond the
document, a merge of the first paragraph and a level outside a list change nothing either, without an error; a null text
is empty; character classes of a pattern know ASCII only; edits of equal ``seq`` are ordered by op and parameters; edits of unknown documents are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.patterns import WORD_END, WS_CHARS
from leafmill.functions.tokens import resolve_body

OPS = {"split": "splitParagraph", "merge": "mergeParagraph"}
KNOWN = ("replace", "case", "trim", "affix", "paragraphBatch", "placeholderFill", "snippetExpand", "splitParagraph", "mergeParagraph", "listLevel")
NODES = "array<struct<text:string,style:string>>"
EDIT = {"op": "string", "params": "map<string,string>", "items": "array<struct<index:int,text:string>>", "values": "map<string,string>"}
RUN = "doc_id {0}, para_idx int, text string, list_level int, part string, nodes " + NODES + ", seq int, op string, n_changes bigint, error string"

_SPACE = regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), WS_CHARS)
_WS = f"[{_SPACE}]"
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_TITLE, _SPACES, _DOUBLE, _HARD = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile(f"{_WS}+"), re.compile("  +"), re.compile("[\u00a0\u2007\u202f]")
_ENDS = "".join(c for c in map(chr, range(0x10000)) if re.match(_WS, c))
_BREAK = (None, None)


def edit_error(op: Column, params: Column, items: Column, values: Column) -> Column:
    """Error code of an edit, or null: unknown-op, empty-find, empty-affix, bad-number, bad-scope, no-items, no-values.

    Whether a pattern compiles (bad-regex) is found where it is used."""
    given = lambda name: F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(""))
    number = lambda name: given(name).rlike(r"^-?[0-9]{1,9}\z")
    at = op.isin("splitParagraph", "mergeParagraph", "listLevel")
    scoped = ~op.isin("paragraphBatch", "splitParagraph", "mergeParagraph", "listLevel") & ~given("scope").isin("", "all", "body")
    limits = (op == "replace") & ~(((given("skip") == "") | number("skip")) & ((given("max") == "") | number("max")))
    return (
        F.when(~op.isin(*KNOWN), "unknown-op")
        .when((op == "replace") & (given("find") == ""), "empty-find")
        .when((op == "affix") & (given("prefix") == "") & (given("suffix") == ""), "empty-affix")
        .when((at & ~number("index")) | ((op == "listLevel") & ~number("delta")) | limits, "bad-number")
        .when(scoped, "bad-scope")
        .when((op == "paragraphBatch") & items.isNull(), "no-items")
        .when(op.isin("placeholderFill", "snippetExpand") & values.isNull(), "no-values")
    )


def sanitised(text: str) -> str:
    return text if text.isprintable() else _FORBIDDEN.sub("", text)


def _collapsed(text: str) -> str:
    if text.isprintable():  # of all white space, only the space is
        return _DOUBLE.sub(" ", text) if "  " in text else text
    return _SPACES.sub(" ", text)


def _plain(text: str) -> list[tuple[str | None, str | None]]:
    """Plain nodes for a text: one for each line that isn't empty, breaks between lines."""
    if "\n" not in text:
        return [(text, None)] if text else []
    nodes: list[tuple[str | None, str | None]] = []
    for i, line in enumerate(text.split("\n")):
        if i:
            nodes.append(_BREAK)
        if line:
            nodes.append((line, None))
    return nodes


class Paragraph:
    __slots__ = ("level", "part", "nodes")

    def __init__(self, level: int | None, part: str | None, nodes: list[tuple[str | None, str | None]]):
        self.level, self.part, self.nodes = level, part, nodes

    @property
    def text(self) -> str:
        if len(self.nodes) == 1 and self.nodes[0][0] is not None:
            return self.nodes[0][0]
        return "".join("\n" if t is None else t for t, _ in self.nodes)

    def put(self, text: str) -> None:
        self.nodes = _plain(sanitised(text))


class Edit:
    """One edit, ready for any document: what it says as JSON (op, by: the parameters, items, values, error) is read once.

    Each operation returns how much it changed."""

    def __init__(self, said: str):
        e = json.loads(said)
        self.op, self.by, self.error = e["op"], e.get("by") or "", e.get("error")
        self.params = p = json.loads(self.by) if self.by else {}
        if self.error is None:
            try:
                self.change = self._change(p, e.get("items") or [], e.get("values") or {})
            except regex.error:
                self.error = "bad-regex"

    def _change(self, p: dict, items: list, values: dict) -> Callable[[list[Paragraph], bool], int]:
        """What the edit does to the paragraphs of a document, of whose log it may be the last one."""
        op, mode = self.op, p.get("mode")
        if op == "case":
            return self.transform({"upper": str.upper, "lower": str.lower}.get(mode, lambda t: _TITLE.sub(lambda m: m[0][0].upper() + m[0][1:].lower(), t)))
        if op == "trim":
            before = {"collapse": _collapsed, "hard": lambda t: _HARD.sub(" ", t)}.get(mode, lambda t: t)
            return self.transform(lambda t: before(t).strip(_ENDS))
        if op == "affix":
            prefix, suffix = p.get("prefix") or "", p.get("suffix") or ""
            return self.transform(lambda t: prefix + t + suffix)
        if op == "replace":
            free = (p.get("regex") or "").lower() in ("true", "1")
            return self.replace(p["find"], regex.compile(p["find"], regex.ASCII) if free else None)
        if op == "placeholderFill":
            found = [(("{{", name), re.compile(r"\{\{" + _WS + "*" + re.escape(name) + _WS + r"*\}\}"), sanitised(value)) for name, value in values.items() if value]
            return lambda paragraphs, last: sum(self.substitute(paragraphs, *f) for f in found)
        if op == "snippetExpand":
            found = [((f"!{name}",), re.compile("!" + re.escape(name) + WORD_END), sanitised(values[name] or "")) for name in sorted(values, key=lambda x: (-len(x), x))]
            return lambda paragraphs, last: sum(self.substitute(paragraphs, *f) for f in found)
        if op == "paragraphBatch":
            new = [(x["index"], sanitised(x.get("text") or "")) for x in items if x is not None and x.get("index") is not None]
            return lambda paragraphs, last: self.batch(paragraphs, new)
        return {"splitParagraph": self.split, "mergeParagraph": self.merge, "listLevel": self.list_level}[op]

    def scoped(self, paragraphs: list[Paragraph]) -> list[Paragraph]:
        return [x for x in paragraphs if x.part == "body"] if self.params.get("scope") == "body" else paragraphs

    def substitute(self, paragraphs: list[Paragraph], hints: tuple[str, ...], pattern: re.Pattern, value: str) -> int:
        """Puts ``value`` for the pattern in the nodes that hold all ``hints``."""
        n = 0
        for x in self.scoped(paragraphs):
            for i, (text, style) in enumerate(x.nodes):
                if text and all(h in text for h in hints):
                    new, k = pattern.subn(lambda m: value, text)
                    n += k
                    if new != text:
                        x.nodes[i] = (sanitised(new), style)
        return n

    def replace(self, find: str, pattern: regex.Pattern | None) -> Callable[[list[Paragraph], bool], int]:
        """``pattern`` or else the text ``find``; skip and max count matches of the whole document, in order."""
        new = self.params.get("replace") or ""
        limits = [int(self.params.get(k) or d) for k, d in (("skip", 0), ("max", -1))]

        def run(paragraphs: list[Paragraph], last: bool) -> int:
            skip, most = limits if last else (0, -1)
            seen = done = 0

            def one(m) -> str:
                nonlocal seen, done
                seen += 1
                if seen <= skip or 0 <= most <= done:
                    return m[0]
                done += 1
                return new

            for x in self.scoped(paragraphs):
                for i, (text, style) in enumerate(x.nodes):
                    if not text or (pattern is None and find not in text):
                        continue
                    if 0 <= most <= done:
                        return done
                    if pattern is not None:
                        out = pattern.sub(one, text)
                    elif skip <= seen and most < 0:
                        done += text.count(find)
                        out = text.replace(find, new)
                    else:
                        k = text.count(find)
                        a = min(max(skip - seen, 0), k)  # the first a stay, then b are replaced
                        b = min(k - a, most - done) if most >= 0 else k - a
                        seen, done = seen + k, done + b
                        cut = text.split(find, a + b)
                        out = find.join(cut[: a + 1]) + "".join(new + t for t in cut[a + 1 :])
                    if out != text:
                        x.nodes[i] = (sanitised(out), style)
            return done

        return run

    def transform(self, change: Callable[[str], str]) -> Callable[[list[Paragraph], bool], int]:
        def run(paragraphs: list[Paragraph], last: bool) -> int:
            n = 0
            for x in self.scoped(paragraphs):
                text = x.text
                if text and (new := change(text)) != text:
                    x.put(new)
                    n += 1
            return n

        return run

    def batch(self, paragraphs: list[Paragraph], items: list[tuple[int, str]]) -> int:
        n = 0
        for at, new in items:
            if 0 <= at < len(paragraphs) and paragraphs[at].text != new:
                paragraphs[at].put(new)
                n += 1
        return n

    def split(self, paragraphs: list[Paragraph], last: bool) -> int:
        at = int(self.params["index"])
        if not 0 <= at < len(paragraphs):
            return 0
        x = paragraphs[at]
        y = Paragraph(x.level, x.part, [])
        x.put(self.params.get("before") or "")
        y.put(self.params.get("after") or "")
        paragraphs.insert(at + 1, y)
        return 1

    def merge(self, paragraphs: list[Paragraph], last: bool) -> int:
        at = int(self.params["index"])
        if not 0 < at < len(paragraphs):
            return 0
        x, y = paragraphs[at - 1], paragraphs.pop(at)
        x.put(x.text + y.text)
        return 1

    def list_level(self, paragraphs: list[Paragraph], last: bool) -> int:
        at = int(self.params["index"])
        if not 0 <= at < len(paragraphs):
            return 0
        x = paragraphs[at]
        if x.level is None or x.level < 0:
            return 0
        new = max(0, min(8, x.level + int(self.params["delta"])))
        changed, x.level = new != x.level, new
        return int(changed)


#: Edits of a task, by what they say.
ready = lru_cache(maxsize=4096)(Edit)


def _starts(ids: pa.Array) -> np.ndarray:
    """Where the documents of sorted rows begin."""
    new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _documents(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Sorted rows as batches of at most ``most`` whole documents, with the bounds of these."""

    def parts(rows: pa.RecordBatch, starts: np.ndarray):
        bounds = [*starts.tolist(), rows.num_rows]
        for a in range(0, len(starts), most):
            own = bounds[a : a + most + 1]
            yield rows.slice(own[0], own[-1] - own[0]), [b - own[0] for b in own]

    joined = lambda held: pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
    held: list[pa.RecordBatch] = []  # of a document that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].column("doc_id")[-1] != batch.column("doc_id")[0]:
            yield from parts(joined(held), np.zeros(1, int))
            held = []
        starts = _starts(batch.column("doc_id"))
        if held and len(starts) > 1:
            yield from parts(joined([*held, batch.slice(0, starts[1])]), np.zeros(1, int))
            held, batch, starts = [], batch.slice(starts[1]), starts[1:] - starts[1]
        if len(starts) > 1:
            yield from parts(batch.slice(0, starts[-1]), starts[:-1])
            batch = batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield from parts(joined(held), np.zeros(1, int))


def _nulls_first(*x) -> list[tuple]:
    return [(v is not None, v) for v in x]


def _replay(batches: Iterator[pa.RecordBatch], texts: bool, nodes: bool, told: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, at, edit, text, list_level, part and maybe nodes) to rows of ``RUN``: of each slice its
    paragraphs (without seq) and its edits (without para_idx)."""
    kinds = {"para_idx": pa.int32(), "text": pa.string(), "list_level": pa.int32(), "part": pa.string(), "nodes": pa.list_(pa.struct([("text", pa.string()), ("style", pa.string())])), "seq": pa.int32(), "op": pa.string(), "n_changes": pa.int64(), "error": pa.string()}

    def rows(ids: pa.Array, at: list[int], **cols) -> pa.RecordBatch:
        n = len(at)
        made = [pa.nulls(n, kind) if (c := cols.get(name)) is None else c if isinstance(c, pa.Array) else pa.array(c, kind) for name, kind in kinds.items()]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *made], ["doc_id", *kinds])

    for batch, bounds in _documents(batches):
        at, edits, lines, levels, places = (batch.column(c).to_pylist() for c in ("at", "edit", "text", "list_level", "part"))
        if "nodes" in batch.schema.names:
            given = batch.column("nodes")
            offs = given.offsets.to_numpy()
            own, offs = given.values.slice(offs[0], offs[-1] - offs[0]), (offs - offs[0]).tolist()
            pairs = list(zip(own.field("text").to_pylist(), own.field("style").to_pylist()))
            first = lambda i: pairs[offs[i] : offs[i + 1]]
        else:
            first = lambda i: _plain(lines[i])
        p: list[list] = [[] for _ in range(6)]  # row, para_idx, text, list_level, part, n_changes
        e: list[list] = [[] for _ in range(5)]  # row, seq, op, n_changes, error
        ends, flat = [0], []
        for a, b in zip(bounds, bounds[1:]):
            k = a
            while k < b and edits[k] is not None:
                k += 1
            if k == b:
                continue
            if k == a:  # no edits
                if texts:
                    for c, v in zip(p, ([a] * (b - a), at[a:b], lines[a:b], levels[a:b], places[a:b], [0] * (b - a))):
                        c += v
                    for i in range(a, b) if nodes else ():
                        flat += first(i)
                        ends.append(len(flat))
                continue
            log = [(at[i], ready(edits[i])) for i in range(a, k)]
            if len(set(at[a:k])) < k - a:
                log.sort(key=lambda x: _nulls_first(x[0], x[1].op, x[1].by))
            doc = [Paragraph(levels[i], places[i], first(i)) for i in range(k, b)]
            if len(set(at[k:b])) < b - k:
                by = {id(x): (_nulls_first(at[i], x.level, x.part), [_nulls_first(*n) for n in x.nodes]) for i, x in enumerate(doc, k)}
                doc.sort(key=lambda x: by[id(x)])
            total = 0
            for i, (seq, edit) in enumerate(log):
                n = 0 if edit.error else edit.change(doc, i == len(log) - 1)
                total += n
                if told:
                    for c, v in zip(e, (a, seq, edit.op, n, edit.error)):
                        c.append(v)
            if texts:
                m = len(doc)
                for c, v in zip(p, ([a] * m, range(m), [x.text for x in doc], [x.level for x in doc], [x.part for x in doc], [total] * m)):
                    c += v
                for x in doc if nodes else ():
                    flat += x.nodes
                    ends.append(len(flat))
        ids = batch.column("doc_id")
        if p[0]:
            made = None
            if nodes:
                both = [pa.array(c, pa.string()) for c in (zip(*flat) if flat else ((), ()))]
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(both, ["text", "style"]))
            yield rows(ids, p[0], para_idx=p[1], text=p[2], list_level=p[3], part=p[4], nodes=made, n_changes=p[5])
        if e[0]:
            yield rows(ids, e[0], seq=e[1], op=e[2], n_changes=e[3], error=e[4])


def text_nodes(text: Column) -> Column:
    """Nodes of a plain text: one for each line that isn't empty, and breaks (null texts) between lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    node = lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("style"))
    both = F.transform(lines, lambda t, i: F.filter(F.array(F.when(i > 0, node(F.lit(None).cast("string"))), F.when(t != "", node(t))), lambda x: x.isNotNull()))
    return F.flatten(both)


def run_log(paragraphs: DataFrame, edits: DataFrame, as_of: datetime | None = None, lang: str = "pl", texts: bool = True, nodes: bool = True, told: bool = True) -> DataFrame:
    """Rows of ``RUN``: the paragraphs after all edits (``para_idx`` is set) and one report for each edit (``seq`` is set).

    ``paragraphs``: doc_id, para_idx, text, and where known list_level, part and nodes (text, null for a break, and style);
    ``edits``: doc_id, seq, op, params, and where needed items and values. With ``as_of``, dynamic tokens in the bodies of
    ``snippetExpand`` are resolved first. Without ``texts`` there are no paragraphs, without ``nodes`` these are null, and
    without ``told`` there are no reports."""
    kind = dict(paragraphs.dtypes)["doc_id"]
    given = ["nodes"] if "nodes" in paragraphs.columns else []
    known = {"list_level": "int", "part": "string", "nodes": NODES}
    p = paragraphs.select("doc_id", F.col("para_idx").cast("int").alias("at"), F.lit(None).cast("string").alias("edit"), F.coalesce("text", F.lit("")).alias("text"), *((F.col(c) if c in paragraphs.columns else F.lit(None)).cast(known[c]).alias(c) for c in ("list_level", "part", *given)))
    e = edits.select(F.col("doc_id").try_cast(kind).alias("doc_id"), F.col("seq").cast("int").alias("seq"), *((F.col(c) if c in edits.columns else F.lit(None)).cast(t).alias(c) for c, t in EDIT.items())).filter("doc_id is not null")
    op = F.coalesce("op", F.lit("replace"))
    for old, new in OPS.items():
        op = F.when(op == old, new).otherwise(op)
    e = e.withColumn("op", op).withColumn("error", edit_error(F.col("op"), F.col("params"), F.col("items"), F.col("values")))
    if as_of is not None:
        e = e.withColumn("values", F.when(F.col("op") == "snippetExpand", F.transform_values("values", lambda k, v: resolve_body(v, as_of, lang))).otherwise(F.col("values")))
    said = F.to_json(F.struct("op", F.to_json("params").alias("by"), "items", "values", "error"))
    e = e.select("doc_id", F.col("seq").alias("at"), said.alias("edit"), *(F.lit(None).cast(t).alias(c) for c, t in p.dtypes[3:]))
    rows = p.filter("doc_id is not null").unionByName(e).repartition("doc_id").sortWithinPartitions("doc_id", F.col("edit").isNull(), "at")
    done = rows.mapInArrow(lambda batches: _replay(batches, texts, nodes, told), RUN.format(kind))
    if not texts:
        return done
    # paragraphs without a document have no edits, and need not meet in one task
    own = (F.col("nodes") if given else text_nodes(F.col("text"))) if nodes else F.lit(None).cast(NODES)
    rest = p.filter("doc_id is null").select("doc_id", F.col("at").alias("para_idx"), "text", "list_level", "part", own.alias("nodes"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("op"), F.lit(0).cast("bigint").alias("n_changes"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(rest)


def edited(run: DataFrame) -> DataFrame:
    """doc_id, para_idx, text, list_level, part, nodes, n_changes (of the document's whole log)."""
    return run.filter("para_idx is not null").drop("seq", "op", "error")


def report(run: DataFrame) -> DataFrame:
    """doc_id, seq, op, n_changes, error of every edit."""
    return run.filter("para_idx is null").select("doc_id", "seq", "op", "n_changes", "error")
